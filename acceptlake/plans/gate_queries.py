"""The flagship: documents as files -> secret scan -> fingerprints -> one finding each -> severity counts -> policy -> verdict per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy as P
from ..operators import security as S
from .base import SEVERITIES, Registry, duck, table
from .security_queries import DOC_FILES, LINES_SQL, SECRETS_SQL

R = Registry()
RULES = [
    ("no-critical", "findings.critical", "lte", 0.0, None, None, None, "fail", ["secrets"]),
    ("few-high", "findings.high", "lt", 2.0, None, None, None, "fail", ["secrets"]),
    ("any-medium", "findings.medium", "eq", 0.0, None, None, None, "warn", []),
]


def secret_findings(spark, d):
    """Secrets of each source, one for each fingerprint (rule, path, line, digest of the value)."""
    docs = table(spark, d, "documents").selectExpr("source", "doc_id", f"{DOC_FILES} AS path", "text")
    found = S.secret_scan(docs.select("path", "text"))
    rows = found.join(docs.select("path", "source", "doc_id"), "path")
    rows = rows.withColumn("fingerprint", S.fingerprint(F.col("rule_id"), F.col("path"), F.col("line"), F.sha2("value", 256)))
    return S.dedupe_findings(rows.select("fingerprint", "doc_id", "source", "rule_id", "severity"), "doc_id")


GATE_SQL = f"""files AS (SELECT source, doc_id, {duck(DOC_FILES)} AS path, text FROM documents WHERE text IS NOT NULL), {LINES_SQL}, {SECRETS_SQL},
f AS (SELECT DISTINCT source, path, line, sha256(value) AS v, rule_id, severity FROM secrets JOIN files USING (path)),
runs AS (SELECT DISTINCT source FROM documents),
c AS (SELECT runs.source, {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITIES)} FROM runs LEFT JOIN f ON f.source = runs.source GROUP BY 1)"""


@R.add(
    "policy_gate",
    f"""WITH {GATE_SQL} SELECT source AS run_id, CAST(critical <= 0 AS BIGINT) + CAST(high < 2 AS BIGINT) + CAST(medium = 0 AS BIGINT) AS n_pass, CAST(medium <> 0 AS BIGINT) AS n_warn, CAST(critical > 0 AS BIGINT) + CAST(high >= 2 AS BIGINT) AS n_fail,
 CASE WHEN critical > 0 OR high >= 2 THEN 'fail' WHEN medium <> 0 THEN 'warn' ELSE 'pass' END AS verdict FROM c""",
)
def policy_gate(spark, d):
    counts = P.severity_counts(secret_findings(spark, d).withColumnRenamed("source", "run_id"))
    runs = table(spark, d, "documents").select(F.col("source").alias("run_id")).distinct()
    counts = runs.join(counts, "run_id", "left").na.fill(0)
    values = F.array(*[F.struct(F.lit(f"findings.{s}").alias("metric"), F.col(s).cast("double").alias("value_num")) for s in SEVERITIES])
    metrics = counts.select("run_id", F.inline(values)).withColumns({"value_str": F.lit(None).cast("string"), "value_bool": F.lit(None).cast("boolean")})
    return P.policy_verdict(P.policy_decisions(metrics, spark.createDataFrame(RULES, P.RULE_SCHEMA)))


QUERIES, SQL = R.queries, R.sql
