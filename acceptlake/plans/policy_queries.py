"""Queries of validation, policy and risk, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy as P
from .base import EXECUTIONS_SQL, FINDINGS_SQL, METRICS_SQL, Registry, executions, findings, metrics, table

R = Registry()
_COUNT = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in P.SEVERITIES)

#: Rules of the stand-in policy: id, metric, operator, number, text, boolean, list, outcome, evidence.
RULES = [
    ("few-orders", "orders.count", "lte", 20.0, None, None, None, "warn", ["orders"]),
    ("some-orders", "orders.count", "gt", 2.0, None, None, None, "fail", ["orders", "orders"]),
    ("total", "orders.total", "lt", 3000000.0, None, None, None, "fail", []),
    ("largest", "orders.max", "gte", 100000.0, None, None, None, "warn", []),
    ("segment-in", "customer.segment", "in", None, None, None, ["FURNITURE", "BUILDING"], "warn", ["segments"]),
    ("segment-not-in", "customer.segment", "not_in", None, "MACHINERY AUTOMOBILE", None, None, "warn", []),
    ("segment-order", "customer.segment", "gt", None, "C", None, None, "warn", []),
    ("active", "customer.active", "eq", None, None, True, None, "fail", []),
    ("not-twenty", "orders.count", "neq", 10.0, None, None, None, "warn", []),
    ("no-owner", "customer.owner", "exists", None, None, False, None, "fail", []),
    ("owner-not-x", "customer.owner", "neq", None, "x", None, None, "warn", []),
]


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(f"'{i}'" for i in x) + "]::VARCHAR[]"
    return f"{x}::DOUBLE" if isinstance(x, float) else f"'{x}'"


RULES_SQL = "rules(rule_id, metric, operator, exp_num, exp_str, exp_bool, exp_list, outcome, evidence) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in RULES) + ")"
DECISIONS_SQL = f"""{METRICS_SQL}, {RULES_SQL},
joined AS (SELECT r.run_id, rules.*, m.metric IS NOT NULL AS present, m.value_num, m.value_str, m.value_bool
 FROM (SELECT DISTINCT run_id FROM metrics) r CROSS JOIN rules LEFT JOIN metrics m ON m.run_id = r.run_id AND m.metric = rules.metric),
matched AS (SELECT *, CASE
  WHEN operator = 'exists' THEN present = exp_bool
  WHEN NOT present THEN false
  WHEN operator = 'eq' THEN coalesce(value_num = exp_num, value_str = exp_str, value_bool = exp_bool, false)
  WHEN operator = 'neq' THEN NOT coalesce(value_num = exp_num, value_str = exp_str, value_bool = exp_bool, false)
  WHEN operator = 'gt' THEN coalesce(value_num > exp_num, value_str > exp_str, false)
  WHEN operator = 'gte' THEN coalesce(value_num >= exp_num, value_str >= exp_str, false)
  WHEN operator = 'lt' THEN coalesce(value_num < exp_num, value_str < exp_str, false)
  WHEN operator = 'lte' THEN coalesce(value_num <= exp_num, value_str <= exp_str, false)
  WHEN operator = 'in' THEN coalesce(list_contains(exp_list, value_str), contains(exp_str, value_str), false)
  ELSE NOT coalesce(list_contains(exp_list, value_str), contains(exp_str, value_str), false) END AS matched FROM joined),
decisions AS (SELECT run_id, rule_id, metric, operator, present, matched, CASE WHEN matched THEN 'pass' ELSE outcome END AS outcome, evidence FROM matched)"""


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, P.RULE_SCHEMA)


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return P.policy_decisions(metrics(spark, d), rules(spark))


@R.add("severity_counts", f"WITH {FINDINGS_SQL} SELECT run_id, {_COUNT} FROM findings GROUP BY run_id")
def severity_counts(spark, d):
    return P.severity_counts(findings(spark, d))


@R.add("validation_counts", f"WITH {EXECUTIONS_SQL} SELECT run_id, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status IN ('failed', 'timed_out')) AS failed, count(*) AS total FROM executions GROUP BY run_id")
def validation_counts(spark, d):
    return P.validation_counts(executions(spark, d))


@R.add(
    "validation_status",
    f"""WITH {EXECUTIONS_SQL}, n AS (SELECT run_id, status, count(*) AS n FROM executions GROUP BY ALL)
SELECT run_id, CASE WHEN bool_or(status = 'timed_out') THEN 'timed_out' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'unavailable') THEN 'unavailable' WHEN bool_or(status = 'passed') THEN 'passed' ELSE 'skipped' END AS overall,
 string_agg(status || ': ' || n, ', ' ORDER BY list_position(['passed', 'failed', 'skipped', 'timed_out', 'unavailable'], status)) AS message FROM n GROUP BY run_id""",
)
def validation_status(spark, d):
    return P.validation_status(executions(spark, d))


@R.add("validation_findings", f"WITH {EXECUTIONS_SQL} SELECT run_id, execution_id, CASE WHEN status IN ('failed', 'timed_out') THEN 'high' ELSE 'medium' END AS severity, 'validation.' || status AS rule_id, 'Command ' || command || ' is ' || status AS title FROM executions WHERE status <> 'passed'")
def validation_findings(spark, d):
    return P.validation_findings(executions(spark, d))


@R.add(
    "metrics_table",
    f"""WITH {FINDINGS_SQL}, {EXECUTIONS_SQL}, names AS (SELECT unnest({["findings." + s for s in P.SEVERITIES] + ["validation.passed", "validation.failed", "validation.total"]}) AS metric),
runs AS (SELECT run_id FROM findings UNION SELECT run_id FROM executions),
v AS (SELECT run_id, 'findings.' || severity AS metric, count(*) AS n FROM findings GROUP BY ALL
 UNION ALL SELECT run_id, CASE WHEN status = 'passed' THEN 'validation.passed' ELSE 'validation.failed' END, count(*) FROM executions WHERE status IN ('passed', 'failed', 'timed_out') GROUP BY ALL
 UNION ALL SELECT run_id, 'validation.total', count(*) FROM executions GROUP BY ALL)
SELECT runs.run_id, names.metric, CAST(coalesce(v.n, 0) AS DOUBLE) AS value FROM runs CROSS JOIN names LEFT JOIN v ON v.run_id = runs.run_id AND v.metric = names.metric""",
)
def metrics_table(spark, d):
    return P.metrics_table(findings(spark, d), executions(spark, d))


@R.add("policy_compare", f"WITH {DECISIONS_SQL} SELECT run_id, rule_id, present, matched FROM decisions")
def policy_compare(spark, d):
    return P.policy_compare(metrics(spark, d), rules(spark)).select("run_id", "rule_id", "present", "matched")


@R.add("policy_decisions", f"WITH {DECISIONS_SQL} SELECT run_id, rule_id, metric, operator, present, matched, outcome, array_to_string(list_sort(list_distinct(evidence)), ',') AS evidence FROM decisions")
def policy_decisions(spark, d):
    return decisions(spark, d).drop("explanation").withColumn("evidence", F.array_join(F.array_sort("evidence"), ","))


_VERDICT = "SELECT run_id, count(*) FILTER (WHERE outcome = 'pass') AS n_pass, count(*) FILTER (WHERE outcome = 'warn') AS n_warn, count(*) FILTER (WHERE outcome = 'fail') AS n_fail, CASE WHEN bool_or(outcome = 'fail') THEN 'fail' WHEN bool_or(outcome = 'warn') THEN 'warn' ELSE 'pass' END AS verdict FROM decisions GROUP BY run_id"


@R.add("policy_verdict", f"WITH {DECISIONS_SQL} {_VERDICT}")
def policy_verdict(spark, d):
    return P.policy_verdict(decisions(spark, d))


@R.add("policy_findings", f"WITH {DECISIONS_SQL} SELECT run_id, 'policy.' || rule_id AS rule_id, CASE WHEN outcome = 'fail' THEN 'high' ELSE 'medium' END AS severity, 'Policy rule ' || outcome AS title, sha256('policy:' || rule_id || ':' || outcome) AS fingerprint FROM decisions WHERE outcome <> 'pass'")
def policy_findings(spark, d):
    return P.policy_findings(decisions(spark, d))


def factors(spark: SparkSession, d: str) -> DataFrame:
    """Risk inputs of each customer: findings by severity, secret rules, failed validations, and counts over orders."""
    f = findings(spark, d)
    by = f.groupBy("run_id").agg(
        F.count_if((F.col("severity") == "critical") & (F.col("amount") > 290000)).alias("critical_findings"),
        F.count_if((F.col("severity") == "high") & (F.col("amount") > 200000)).alias("high_findings"),
        F.count_if((F.col("severity") == "medium") & (F.col("amount") > 200000)).alias("medium_findings"),
        F.count_if(F.col("severity") == "low").alias("low_findings"),
        F.count_if((F.col("rule_id").contains("secret") | F.col("rule_id").contains("credential")) & (F.col("amount") > 295000)).alias("secrets_detected"),
        F.count_distinct("file_path").alias("changed_files"),
        F.sum("start_line").alias("additions"),
        F.count_if(F.col("category") == "database").alias("database_migrations"),
    )
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    ratio = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("requirement_coverage"))
    checks = P.validation_counts(executions(spark, d)).select("run_id", F.col("failed").alias("failed_validations"))
    return P.risk_factors(runs, by, ratio, checks)


FACTORS_SQL = f"""{FINDINGS_SQL}, {EXECUTIONS_SQL},
f AS (SELECT run_id, count(*) FILTER (WHERE severity = 'critical' AND amount > 290000) AS critical_findings, count(*) FILTER (WHERE severity = 'high' AND amount > 200000) AS high_findings,
 count(*) FILTER (WHERE severity = 'medium' AND amount > 200000) AS medium_findings, count(*) FILTER (WHERE severity = 'low') AS low_findings,
 count(*) FILTER (WHERE (contains(rule_id, 'secret') OR contains(rule_id, 'credential')) AND amount > 295000) AS secrets_detected, count(DISTINCT file_path) AS changed_files,
 CAST(sum(start_line) AS BIGINT) AS additions, count(*) FILTER (WHERE category = 'database') AS database_migrations FROM findings GROUP BY run_id),
q AS (SELECT o_custkey AS run_id, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS requirement_coverage FROM orders GROUP BY 1),
x AS (SELECT run_id, count(*) FILTER (WHERE status IN ('failed', 'timed_out')) AS failed_validations FROM executions GROUP BY 1),
factors AS (SELECT c_custkey AS run_id, coalesce(changed_files, 0) AS changed_files, coalesce(additions, 0) AS additions, 0::BIGINT AS deletions, 0::BIGINT AS high_complexity_symbols, 0::BIGINT AS high_fan_in_symbols,
 0::BIGINT AS breaking_api_changes, coalesce(database_migrations, 0) AS database_migrations, 0::BIGINT AS dependency_changes, coalesce(critical_findings, 0) AS critical_findings, coalesce(high_findings, 0) AS high_findings,
 coalesce(medium_findings, 0) AS medium_findings, coalesce(low_findings, 0) AS low_findings, coalesce(secrets_detected, 0) AS secrets_detected, coalesce(failed_validations, 0) AS failed_validations, 0::BIGINT AS config_drifts,
 0::BIGINT AS ci_files_changed, 1.0::DOUBLE AS test_evidence_score, coalesce(requirement_coverage, 1.0) AS requirement_coverage
 FROM customer LEFT JOIN f ON f.run_id = c_custkey LEFT JOIN q ON q.run_id = c_custkey LEFT JOIN x ON x.run_id = c_custkey)"""
_PARTS = {k: e.replace("5.0D", "5.0").replace("D)", ")").replace("0D", "0").replace("5D", "5") for k, e in P._components().items()}
COMPONENTS_SQL = FACTORS_SQL + ", components AS (" + " UNION ALL ".join(f"SELECT run_id, '{k}' AS component, greatest(0.0::DOUBLE, least({P.WEIGHTS[k]}::DOUBLE, CAST({e} AS DOUBLE))) AS score, {P.WEIGHTS[k]}::DOUBLE AS maximum FROM factors" for k, e in _PARTS.items()) + ")"
SCORE_SQL = COMPONENTS_SQL + """, raw AS (SELECT run_id, least(100.0::DOUBLE, sum(score)) AS raw_score FROM components GROUP BY run_id),
s0 AS (SELECT raw.run_id, raw_score, CAST(ceil(round(raw_score, 9)) AS BIGINT) AS s, critical_findings, secrets_detected, high_findings FROM raw JOIN factors USING (run_id)),
s1 AS (SELECT *, critical_findings > 0 AND s < 90 AS f90 FROM s0), s2 AS (SELECT *, CASE WHEN f90 THEN 90 ELSE s END AS t FROM s1),
s3 AS (SELECT *, secrets_detected > 0 AND t < 75 AS f75 FROM s2), s4 AS (SELECT *, CASE WHEN f75 THEN 75 ELSE t END AS u FROM s3),
s5 AS (SELECT *, high_findings >= 3 AND u < 70 AS f70 FROM s4),
scored AS (SELECT run_id, raw_score, CASE WHEN f70 THEN 70 ELSE u END AS score, array_to_string(list_filter([CASE WHEN f90 THEN '90' END, CASE WHEN f75 THEN '75' END, CASE WHEN f70 THEN '70' END], lambda x: x IS NOT NULL), ',') AS floors FROM s5)"""
_LEVEL = "CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' WHEN score >= 15 THEN 'low' ELSE 'minimal' END"


@R.add("risk_factors", f"WITH {FACTORS_SQL} SELECT * REPLACE (round(requirement_coverage, 6) AS requirement_coverage) FROM factors")
def risk_factors(spark, d):
    return factors(spark, d).withColumn("requirement_coverage", F.round("requirement_coverage", 6))


@R.add("risk_components", f"WITH {COMPONENTS_SQL} SELECT run_id, component, round(score, 6) AS score, maximum FROM components")
def risk_components(spark, d):
    return P.risk_components(factors(spark, d)).withColumn("score", F.round("score", 6))


@R.add("risk_score", f"WITH {SCORE_SQL} SELECT run_id, round(raw_score, 6) AS raw_score, CAST(score AS BIGINT) AS score, floors FROM scored")
def risk_score(spark, d):
    return P.risk_score(factors(spark, d)).select("run_id", F.round("raw_score", 6).alias("raw_score"), "score", F.array_join(F.col("floors").cast("array<string>"), ",").alias("floors"))


@R.add("risk_level", f"WITH {SCORE_SQL} SELECT run_id, {_LEVEL} AS level FROM scored")
def risk_level(spark, d):
    return P.risk_score(factors(spark, d)).select("run_id", "level")


QUERIES, SQL = R.queries, R.sql
