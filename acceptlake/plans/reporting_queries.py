"""Reporting queries, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting as P
from .base import EXECUTIONS_SQL, FINDINGS_SQL, SEVERITIES, Registry, executions, findings, runs, table

R = Registry()
_RANK = f"list_position({list(SEVERITIES)}, severity)"
_COUNT = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITIES)
_COLUMNS = ["finding_id", "run_id", "severity", "category", "status", "file_path", "start_line", "rule_id"]


@R.add("findings_page", f"WITH {FINDINGS_SQL} SELECT {', '.join(_COLUMNS)} FROM findings WHERE status = 'open' AND category IN ('security') ORDER BY {_RANK}, file_path, start_line, finding_id LIMIT 25 OFFSET 25")
def findings_page(spark, d):
    return P.findings_page(findings(spark, d), category="security", status="open", number=2, size=25).select(*_COLUMNS)


@R.add(
    "finding_triage",
    f"""WITH {FINDINGS_SQL}, c AS (SELECT user_id AS finding_id, arg_max(event_type, [strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), event_type]) AS s FROM events GROUP BY 1)
SELECT f.finding_id, coalesce(c.s, f.status) AS status, CASE WHEN coalesce(c.s, f.status) IS DISTINCT FROM f.status THEN f.status END AS old_status FROM findings f LEFT JOIN c ON c.finding_id = f.finding_id""",
)
def finding_triage(spark, d):
    changes = table(spark, d, "events").select(F.col("user_id").alias("finding_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"))
    return P.finding_triage(findings(spark, d), changes)


@R.add(
    "run_summary",
    f"""WITH {FINDINGS_SQL}, {EXECUTIONS_SQL}, f AS (SELECT run_id, count(*) AS findings, count(*) FILTER (WHERE severity = 'critical') AS critical_findings FROM findings GROUP BY 1),
c AS (SELECT o_custkey AS run_id, count(*) AS changed_files, avg(l_discount * 10) AS coverage FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
e AS (SELECT run_id, avg(CAST(status = 'passed' AS DOUBLE)) AS passed_share FROM executions GROUP BY 1)
SELECT c_custkey AS run_id, coalesce(findings, 0) AS findings, coalesce(critical_findings, 0) AS critical_findings, coalesce(changed_files, 0) AS changed_files,
 round(coalesce(coverage, 0), 6) AS coverage, round(coalesce(passed_share, 0), 6) AS passed_share
FROM customer LEFT JOIN f ON f.run_id = c_custkey LEFT JOIN c ON c.run_id = c_custkey LEFT JOIN e ON e.run_id = c_custkey""",
)
def run_summary(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("run_id"), (F.col("l_discount") * 10).alias("score"))
    out = P.run_summary(runs(spark, d), findings(spark, d), lines, lines, executions(spark, d))
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("passed_share", F.round("passed_share", 6))


@R.add(
    "dashboard_totals",
    f"""WITH {FINDINGS_SQL}, p AS (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'), r AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM p))
SELECT (SELECT count(*) FROM p) AS projects, (SELECT count(*) FROM r) AS runs, (SELECT count(*) FROM findings WHERE severity IN ('critical', 'high') AND run_id IN (SELECT c_custkey FROM r)) AS severe_findings""",
)
def dashboard_totals(spark, d):
    projects = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("project_id"), F.col("r_name").alias("tenant"))
    return P.dashboard_totals(projects, runs(spark, d), findings(spark, d), F.col("tenant") == "ASIA")


@R.add("verdict_counts", "SELECT v AS verdict, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS v) LEFT JOIN orders ON o_orderstatus = v GROUP BY 1")
def verdict_counts(spark, d):
    domain = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "verdict string")
    return P.zero_filled_counts(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "verdict"), "verdict", domain)


@R.add("recent_runs", "SELECT o_orderkey AS run_id, o_custkey AS project_id, o_orderstatus AS verdict FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_runs(spark, d):
    return P.newest(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 10).select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("verdict"))


@R.add(
    "avg_run_duration",
    """WITH r AS (SELECT user_id AS run_id, min(ts) FILTER (WHERE event_type = 'view') AS s, max(ts) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY 1),
n AS (SELECT * FROM r WHERE s IS NOT NULL AND c IS NOT NULL ORDER BY c DESC, run_id DESC LIMIT 30) SELECT round(coalesce(avg(greatest(0, (epoch_us(c) - epoch_us(s)) / 1e6)), 0), 3) AS seconds FROM n""",
)
def avg_run_duration(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("completed_at"))
    return P.avg_run_duration(e).select(F.round("seconds", 3).alias("seconds"))


@R.add("risk_trend", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS risk, o_orderstatus AS verdict, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INT) AS place FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 14)")
def risk_trend(spark, d):
    from pyspark.sql import Window

    last = P.newest(table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderdate", "o_orderkey", 14)
    place = F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey"))  # 14 rows
    return last.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("risk"), F.col("o_orderstatus").alias("verdict"), place.alias("place")).orderBy("place")


_STATE = "CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END"


@R.add("run_state_metrics", f"SELECT count(*) AS total, count(*) FILTER (WHERE {_STATE} = 'running') AS running, count(*) FILTER (WHERE {_STATE} = 'failed') AS failed FROM events")
def run_state_metrics(spark, d):
    return P.run_state_metrics(table(spark, d, "events").selectExpr(f"{_STATE} AS state"))


@R.add("stage_status_map", f"SELECT event_id, {_STATE} AS state FROM events")
def stage_status_map(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{_STATE} AS state")


@R.add("run_progress", "SELECT user_id AS run_id, arg_max(event_type, [epoch_us(ts), event_id]) AS current, string_agg(event_type, ',' ORDER BY ts, event_id) AS stages FROM events GROUP BY 1")
def run_progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("stage"), "ts")
    return P.run_progress(e).withColumn("stages", F.array_join("stages", ","))


@R.add("projects_search", "SELECT c_custkey AS project_id, c_name AS name, count(o_orderkey) AS runs FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE (c_name ILIKE '%r#00000001%' OR c_mktsegment ILIKE '%r#00000001%') AND c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY c_custkey DESC LIMIT 20")
def projects_search(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    found = P.search(c, "R#00000001", ["c_name", "c_mktsegment"])
    out = found.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name")).agg(F.count("o_orderkey").alias("runs"))
    return P.page(out, [F.desc("project_id")], 1, 20)


@R.add("project_runs", "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE o_custkey = 4 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def project_runs(spark, d):
    own = table(spark, d, "orders").where("o_custkey = 4 AND o_orderstatus = 'O'")
    return P.page(own, [F.desc("o_orderdate"), F.desc("o_orderkey")], 1, 10).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))


@R.add("audit_search", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id < 40 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def audit_search(spark, d):
    return P.page(table(spark, d, "events").where("event_type = 'click' AND user_id < 40"), [F.desc("ts"), F.desc("event_id")], 2, 50).select("event_id", "user_id", "event_type")


@R.add("audit_recent", "SELECT event_id, user_id, event_type AS action FROM events WHERE user_id % 3 = 1 ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_recent(spark, d):
    return P.newest(table(spark, d, "events").where("user_id % 3 = 1"), "ts", "event_id", 100).select("event_id", "user_id", F.col("event_type").alias("action"))


@R.add("members_page", "SELECT s_suppkey AS user_id, s_name AS name FROM supplier ORDER BY s_suppkey LIMIT 100")
def members_page(spark, d):
    return P.page(table(spark, d, "supplier"), [F.col("s_suppkey")], 0, 1000).select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))


@R.add("tenant_scope", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)")
def tenant_scope(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey = 2")
    own = P.in_scope(table(spark, d, "customer"), "c_nationkey", nations, "n_nationkey")
    own = P.in_scope(table(spark, d, "orders"), "o_custkey", own, "c_custkey")
    return P.in_scope(table(spark, d, "lineitem"), "l_orderkey", own, "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@R.add("project_purge", "WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey % 5 = 0) SELECT 'orders' AS child, count(*) AS rows_left, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone)")
def project_purge(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    left = P.purge({"orders": o, "lineitem": table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")}, o.where("o_custkey % 5 = 0"), "k")
    parts = [df.agg(F.count("*").alias("rows_left"), F.sum("k").alias("key_sum")).select(F.lit(name).alias("child"), "rows_left", "key_sum") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


@R.add(
    "summary_table",
    f"""WITH {FINDINGS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_RANK}, finding_id) AS p FROM findings)
SELECT run_id, count(*) AS findings, {_COUNT}, string_agg(title, ',' ORDER BY p) FILTER (WHERE p <= 10) AS first FROM p GROUP BY run_id""",
)
def summary_table(spark, d):
    return P.summary_table(findings(spark, d)).withColumn("first", F.array_join("first", ","))


@R.add("client_rollups", f"WITH {FINDINGS_SQL} SELECT severity, status, category, count(*) AS n, count(DISTINCT file_path) AS files, CAST(GROUPING(severity, status, category) AS INT) AS level FROM findings GROUP BY GROUPING SETS ((severity), (status), (category), ())")
def client_rollups(spark, d):
    return P.client_rollups(findings(spark, d))


QUERIES, SQL = R.queries, R.sql
