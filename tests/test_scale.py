"""Operators whose work once grew with the square of something: equal rows by brute force, and bounded work."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from acceptlake.functions import text as X
from acceptlake.operators import bestmatch, names, security, textmatch


def test_many_spans_in_one_text(spark):
    n = 25_600
    text = "\n".join(f'token = "q{i:06d}RtzLm2pW"' for i in range(n))
    files = spark.createDataFrame([("a", text), ("a", text), ("b", None)], "path string, text string")
    security.secret_scan(files.limit(1)).count()
    start = time.time()
    rows = security.secret_scan(files)
    assert rows.agg(F.count("*"), F.min("line"), F.max("line"), F.countDistinct("line")).first()[:] == (2 * n, 1, n, n)
    assert time.time() - start < 30


def test_spans_of_rules_that_overlap(spark):
    long = spark.createDataFrame([(1, "xabbcdefg9 abbcdefg9c\nxabbcdefg9")], "path int, text string")
    rows = security.secret_scan(long, (("one", "low", r"x(abbc\w+)"), ("two", "high", r"(abbc\w+?9)c?"))).collect()
    assert sorted((r.line, r.rule_id, r.value) for r in rows) == [(1, "one", "abbcdefg9"), (1, "two", "abbcdefg9"), (2, "one", "abbcdefg9")]


def test_a_map_of_many_entries(spark):
    token = "gh" + "p_" + "A" * 30
    m = {f"k{i}": f"v{i}" for i in range(10_000)} | {f"x {token}": "first", f"x {token[:-1]}B": "last", "password": "p"}
    start = time.time()
    row = security.redact_nested(spark.createDataFrame([(m,), (None,)], "m map<string,string>").coalesce(1)).collect()[0].m
    assert len(row) == 10_002 and row["x [REDACTED]"] == "last" and row["password"] == "[REDACTED]" and time.time() - start < 30
    assert security.redact_nested(spark.createDataFrame([(None,)], "m map<string,string>")).first().m is None


def test_names_in_parts(spark, monkeypatch):
    monkeypatch.setattr(names, "PART_BYTES", 300)
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)] + ["", "é1", None]
    texts = [(k, " ".join("".join(rng.choices("abc", k=6)) for _ in range(rng.randint(0, 9))) + rng.choice(["", "é1"])) for k in range(50)] + [(99, None)]
    got = names.contained(spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame(texts, "text_id int, text string"))
    assert {tuple(r) for r in got.collect()} == {(w, k) for w in set(words) if w is not None for k, t in texts if t is not None and w in t}
    assert names.contained(spark.createDataFrame([], "name string"), spark.createDataFrame(texts, "text_id int, text string")).count() == 0


def evidence():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(80)]
    weights = [1 / (1 + i) for i in range(80)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    candidates = [(f"c{k}", rng.choice(["file", "test", "route", "symbol"]), rng.choice([text(30), text(4), "", None]), f"src/m{k}.py", rng.choice([None, f"pkg.name{k}"])) for k in range(300)]
    requirements = [(f"R{k}", "t", text(rng.choice([1, 5, 20]))) for k in range(25)] + [("R90", "t", "see src/m17.py and pkg.name40 there"), ("R91", "t", ""), ("R92", "t", None)]
    return requirements, candidates


def test_best_matches_are_those_of_all_scores(spark, monkeypatch):
    requirements, candidates = evidence()
    r = spark.createDataFrame(requirements, "id string, title string, text string")
    c = spark.createDataFrame(candidates, "id string, kind string, text string, path string, symbol string")
    every = textmatch.requirement_scores(r, c).withColumn("score", F.round("score", bestmatch.DIGITS))
    by = {}
    for x in every.collect():
        by.setdefault(x.requirement_id, []).append((-x.score, x.candidate_id, x.reasons))
    for k, tokens, broadcast in ((3, 1_000_000, 1_000_000), (8, 40, 5)):
        monkeypatch.setattr(bestmatch, "ROUND_TOKENS", tokens)
        monkeypatch.setattr(bestmatch, "MAX_BROADCAST", broadcast)
        got = {}
        for x in bestmatch.top_scores(r, c.repartition(3), k).collect():
            got.setdefault(x.requirement_id, []).append((-x.score, x.candidate_id, x.reasons))
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v)[:k] for i, v in by.items()}
    made = spark.sparkContext.accumulator(0)
    bestmatch.top_scores(r, c.coalesce(1), 2, made).collect()
    assert 0 < made.value <= len(requirements) * len(candidates)


def test_pairs_below_the_bound_are_not_made():
    """One rare token decides; the lists of common ones are not opened for other candidates."""
    n = 1000
    rows = pa.RecordBatch.from_pylist([{"id": f"c{i:04d}", "kind": "file", "path": None, "symbol": None, "norm": 1.0, "size": 30, "tokens": [{"number": 0, "w": 0.01}, *([{"number": 1, "w": 0.9}] if i % 100 == 0 else [])], "named": []} for i in range(n)])
    block = bestmatch.Block(rows, 2)
    some, score, _, made = block.best("R", np.array([0, 1]), np.array([0.1, 0.9]), 30, 0.3, 10)
    assert made == 10 and len(some) == 10 and (score > 0.3).all()
    assert block.best("R", np.array([0, 1]), np.array([0.1, 0.9]), 30, 0.0, 10)[3] == n


def test_all_pairs_are_made_where_the_candidates_are(spark, monkeypatch):
    """Pairs as by joining tokens, in rounds and small pieces; nothing behind the making of pairs deals them out again."""
    requirements, candidates = evidence()
    r = spark.createDataFrame(requirements, "id string, title string, text string")
    c = spark.createDataFrame(candidates, "id string, kind string, text string, path string, symbol string")
    both = r.select(F.concat(F.lit("r"), "id").alias("id"), "text").unionByName(c.select(F.concat(F.lit("c"), "id").alias("id"), "text"))
    weights = textmatch.idf(textmatch.tokenize(both), both.count())
    plain = textmatch.similarities(textmatch.tfidf(textmatch.tokenize(r), weights), textmatch.tfidf(textmatch.tokenize(c, textmatch.candidate_text()), weights))
    of = lambda df: sorted((x.requirement_id, x.candidate_id, round(x.cosine, 9), round(x.overlap, 9)) for x in df.collect())
    monkeypatch.setattr(bestmatch, "ROUND_TOKENS", 100)
    monkeypatch.setattr(textmatch, "PIECE_ENTRIES", 50)
    assert of(bestmatch.pairs(r, c, references=False)) == of(plain)
    named = {(x.requirement_id, x.candidate_id) for x in bestmatch.pairs(r, c).where("explicit = 1").collect()}
    assert named == {tuple(x) for x in textmatch.explicit_reference(r, c).collect()} and ("R90", "c17") in named
    monkeypatch.undo()
    plan = textmatch.requirement_scores(r, c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_first_rows_of_a_task(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", "d"]), f"c{k}", rng.choice([0.0, 0.1, 0.2, 0.5])) for k in range(500)]
    scores = spark.createDataFrame(rows, "requirement_id string, candidate_id string, score double").repartition(3)
    monkeypatch.setattr(textmatch, "HEAD_ROWS", 40)
    got = {(x.requirement_id, x.candidate_id, x.place) for x in textmatch.requirement_topk(scores, 30, 0.3).collect()}
    expected = {(q, c, n) for q in "abcd" for n, (s, c) in enumerate(sorted((-s, c) for r, c, s in rows if r == q), 1) if n <= 30 and -s >= 0.18}
    assert got == expected and textmatch._heads(scores, 5).count() <= 3 * 4 * 5


def test_pieces_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "t": [["a"] * n if n is not None else None for n in (3, 0, 9, None, 2, 2)]})
    parts = list(textmatch.pieces(batch, "t", most=4))
    assert [p["k"].to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]] and not list(textmatch.pieces(batch.slice(0, 0), "t"))


def odd_texts():
    rng = random.Random(11)
    some = ["a", "Z", "b9", "7", "_", "-", "/", " ", "\n", ".", "the", "With ", "x1/y-z_", "99", "-the ", "中", "文字", "漢", "é", "\u212a", "\u0130", "\u4dff", "\u9fff", "\ua000", "ㄅ", "\U0001f600", "\0"]
    made = ["".join(rng.choices(some, k=rng.randint(0, 25))) for _ in range(400)]
    return [*made, None, "", "x", "中", "中文", "9", "9ab", "ab9", "the", "9the", "-" * 500 + "q", "-" * 500 + "qq", "中" * 50 + "ab" * 50, None]


def test_tokens_are_counted_from_bytes(spark, monkeypatch):
    """As the column function has them, whatever the pieces; no list of tokens leaves the JVM."""
    texts = odd_texts()
    df = spark.createDataFrame([(k, t, texts[-k]) for k, t in enumerate(texts)], "id long, own string, rest string").coalesce(2)
    lists = df.select("id", F.coalesce(X.tokens(F.col("own")), F.array()).alias("own"), F.coalesce(X.tokens(F.col("rest")), F.array()).alias("rest")).collect()
    expected = {(x.id, len(x.own) + len(x.rest), t, n, t in x.own) for x in lists for t, n in Counter([*x.own, *x.rest]).items()}
    for most in (1, 60, textmatch.PIECE_BYTES):
        monkeypatch.setattr(textmatch, "PIECE_BYTES", most)
        got = [tuple(x) for x in textmatch.counted(df).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    plan = textmatch.tokenize(df, F.col("own"))._jdf.queryExecution().executedPlan().toString()
    assert "lower" in plan and "regexp_extract_all" not in plan and "lambda" not in plan
    assert textmatch.counted(df.where("own is null and rest is null")).count() == textmatch.counted(df.limit(0)).count() == 0


def test_frequencies_are_summed_in_the_task(spark, monkeypatch):
    texts = spark.createDataFrame(list(enumerate(odd_texts())), "id long, text string").coalesce(2)
    of = lambda df: sorted((x.token, round(x.idf, 12)) for x in df.collect())
    plain = of(textmatch.idf(textmatch.tokenize(texts), 400))
    monkeypatch.setattr(textmatch, "PIECE_BYTES", 60)
    for held in (3, 40, 1_000_000):
        monkeypatch.setattr(textmatch, "HELD_TOKENS", held)
        assert of(textmatch.idf_of_texts(texts, 400)) == plain
    assert textmatch.frequencies(texts).count() <= 2 * len(plain) and textmatch.frequencies(texts.limit(0)).count() == 0
    same = spark.range(0, 500, 1, 1).select(F.lit("one two two three").alias("text"))
    assert sorted(map(tuple, textmatch.frequencies(same).collect())) == [("one", 500), ("three", 500), ("two", 500)]
