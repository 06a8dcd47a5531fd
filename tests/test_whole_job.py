"""Cases in which an operator once did less than the whole job."""

from acceptlake.operators import security
from acceptlake.plans import textmatch_queries


def test_long_documents_are_matched_whole(spark, tmp_path):
    late = "common " * 4000 + "lateword"
    spark.createDataFrame([(i, late, "web") for i in range(4)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "lateword")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.id for r in textmatch_queries.tokenize(spark, str(tmp_path)).where("token = 'lateword'").collect()} == {"c0", "c1", "c2", "c3"}
    assert {r.candidate_id for r in textmatch_queries.cosine_join(spark, str(tmp_path)).collect()} == {"c0", "c1", "c2", "c3"}
    assert {r.n for r in textmatch_queries.evidence_candidates(spark, str(tmp_path)).where("kind = 'file'").collect()} == {len(late)}


def test_secrets_of_every_span(spark):
    key, long = "AKIA" + "Q7W3E8R2T5Y9U1I4", "Zx8Kq3Lm7Pv2Rt9Wb4Nc6Yd1Hf5Gj0Ss"
    text = f'x MY_TOKEN={long}\nMY_TOKEN={long}\na = "{key}"\n\ntoken = "{key}" {key}\n{long}'
    files = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "path string, text string")
    found = security.secret_scan(files).collect()
    assert sorted((r.line, r.rule_id, r.value) for r in found) == [(2, "secret.dotenv-value", long), (3, "secret.aws-access-key", key), (5, "secret.aws-access-key", key), (5, "secret.aws-access-key", key)]
    assert sorted((r.line, r.value) for r in security.high_entropy_scan(files).collect()) == [(1, "MY_TOKEN=" + long), (2, "MY_TOKEN=" + long), (6, long)]
