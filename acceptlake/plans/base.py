"""Tables, and the rows that stand in for a run's evidence, for both engines.

Each stand-in is a DataFrame here and the same rule as a SQL text for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")
CATEGORIES = ("security", "api", "database", "dependency", "configuration", "test", "requirement", "policy", "quality")
STATUSES = ("open", "accepted", "fixed", "dismissed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of texts that has fewer splits than the cluster has cores (one file of one row group is one split) dealt over all cores; any
    other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


class Registry:
    """Collects QUERIES and SQL of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put


def _pick(values: tuple[str, ...], key: str) -> str:
    """SQL of both engines: the value whose place is key."""
    return "CASE " + " ".join(f"WHEN {key} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_FINDING = f"""o_orderkey AS finding_id, o_custkey AS run_id, {_pick(SEVERITIES, "CAST(substring(o_orderpriority, 1, 1) AS INT) - 1")} AS severity,
 {_pick(CATEGORIES, "o_orderkey % 9")} AS category, {_pick(STATUSES, "o_orderkey % 4")} AS status,
 concat('src/m', CAST(o_orderkey % 50 AS STRING), '.py') AS file_path, CAST(o_orderkey % 400 + 1 AS INT) AS start_line,
 {_pick(("secret.aws-access-key", "python.eval", "api.removed", "compose.literal-secret", "db.drop-table", "python.cors-wildcard-credentials", "deps.unpinned"), "o_orderkey % 7")} AS rule_id,
 concat('Finding ', CAST(o_orderkey AS STRING)) AS title, o_orderdate AS created_at, o_totalprice AS amount"""

_EXECUTION = f"""event_id AS execution_id, user_id AS run_id, {_pick(("passed", "failed", "timed_out", "unavailable", "skipped"), "CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")} AS status,
 CAST(floor(value) AS BIGINT) AS duration_ms, concat('cmd ', CAST(event_id % 11 AS STRING)) AS command, ts AS created_at"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings of the run that their customer is."""
    return table(spark, d, "orders").selectExpr(*_split(_FINDING))


def executions(spark: SparkSession, d: str) -> DataFrame:
    """Events as validation commands of the run that their user is."""
    return table(spark, d, "events").selectExpr(*_split(_EXECUTION))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("project_id"), F.col("c_acctbal").alias("balance"))


def _split(text: str) -> list[str]:
    """The select items of a list, cut at commas outside brackets."""
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


def duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


FINDINGS_SQL = f"findings AS (SELECT {duck(_FINDING)} FROM orders)"
EXECUTIONS_SQL = f"executions AS (SELECT {duck(_EXECUTION)} FROM events)"
RUNS_SQL = "runs AS (SELECT c_custkey AS run_id, c_nationkey AS project_id, c_acctbal AS balance FROM customer)"

#: A run's metrics as dotted names: typed value columns, exactly one of them set.
METRIC_NAMES = ("orders.count", "orders.total", "orders.max", "customer.segment", "customer.active")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """metrics(run_id, metric, value_num, value_str, value_bool) of each customer; a customer without orders lacks the order metrics."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("t"), F.max("o_totalprice").alias("m"))
    rows = per.selectExpr("run_id", "stack(3, 'orders.count', n, 'orders.total', round(t, 2), 'orders.max', m) AS (metric, value_num)")
    rows = rows.selectExpr("run_id", "metric", "value_num", "CAST(NULL AS STRING) AS value_str", "CAST(NULL AS BOOLEAN) AS value_bool")
    c = table(spark, d, "customer")
    text = c.selectExpr("c_custkey AS run_id", "'customer.segment' AS metric", "CAST(NULL AS DOUBLE) AS value_num", "c_mktsegment AS value_str", "CAST(NULL AS BOOLEAN) AS value_bool")
    flag = c.selectExpr("c_custkey AS run_id", "'customer.active' AS metric", "CAST(NULL AS DOUBLE) AS value_num", "CAST(NULL AS STRING) AS value_str", "c_acctbal > 0 AS value_bool")
    return rows.unionByName(text).unionByName(flag)


METRICS_SQL = """metrics AS (
 SELECT run_id, metric, value_num, CAST(NULL AS VARCHAR) AS value_str, CAST(NULL AS BOOLEAN) AS value_bool FROM (
  SELECT o_custkey AS run_id, 'orders.count' AS metric, CAST(count(*) AS DOUBLE) AS value_num FROM orders GROUP BY 1
  UNION ALL SELECT o_custkey, 'orders.total', round(sum(o_totalprice), 2) FROM orders GROUP BY 1
  UNION ALL SELECT o_custkey, 'orders.max', max(o_totalprice) FROM orders GROUP BY 1)
 UNION ALL SELECT c_custkey, 'customer.segment', NULL, c_mktsegment, NULL FROM customer
 UNION ALL SELECT c_custkey, 'customer.active', NULL, NULL, c_acctbal > 0 FROM customer)"""
