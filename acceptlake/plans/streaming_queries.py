"""Streaming queries over the event table (and documents), each with its batch twin as oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import policy as PO
from ..sources.staging import shared_folder
from ..streaming import progress as P
from .base import Registry, duck, table
from .security_queries import DOC_FILES, q

R = Registry()
_STATUS = "CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END"
_STAGE = "concat('stage', CAST(event_id % 3 AS STRING))"
_EVENT = ["user_id AS run_id", "event_id", f"{_STAGE} AS stage", f"{_STATUS} AS status", "CAST(ts AS TIMESTAMP) AS ts", "value"]


def events(spark, d):
    return table(spark, d, "events").selectExpr(*_EVENT)


def stream(spark, d, name: str):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def event_stream(spark, d):
    return stream(spark, d, "events").selectExpr(*_EVENT)


#: A batch for each part of the events (a file for each core, or fewer), in no order of their times; an event long after all others ends the stream.
_PARTS, _LATE = 3, "2000 days"


def shuffled_stream(spark, d):
    """All events dealt into batches without regard to their times, then one that lets the watermark pass them all."""
    root, rows, files = shared_folder(spark, "shuffled"), events(spark, d), spark.sparkContext.defaultParallelism
    for part in range(_PARTS):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(_PARTS)) == part).repartition(files).write.parquet(f"{root}/{part}")
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast(rows.schema["run_id"].dataType).alias("run_id"), F.lit(-1).cast(rows.schema["event_id"].dataType).alias("event_id"), F.lit("end").alias("stage"), F.lit("queued").alias("status"), (F.col("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts"), F.lit(0).cast(rows.schema["value"].dataType).alias("value"))
    end.coalesce(1).write.parquet(f"{root}/end")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(root)


EVENTS_SQL = f"e AS (SELECT user_id AS run_id, event_id, {duck(_STAGE)} AS stage, {_STATUS} AS status, ts, value FROM events)"


PAIRING_SQL = f"""WITH {EVENTS_SQL}, p AS (SELECT *, last_value(CASE WHEN status = 'running' THEN ts END IGNORE NULLS) OVER (PARTITION BY run_id, stage ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e)
SELECT run_id, stage, event_id, status, (epoch_us(ts) - epoch_us(s)) // 1000 AS duration_ms FROM p WHERE status IN ('completed', 'failed')"""


@R.add("stage_event_pairing", PAIRING_SQL)
def stage_event_pairing(spark, d):
    return P.stage_event_pairing(events(spark, d))


@R.add("stream_stage_pairing", PAIRING_SQL)
def stream_stage_pairing(spark, d):
    """Starts may come in a later batch than their finishes."""
    return P.into_table(P.stage_event_stream(shuffled_stream(spark, d), _LATE, keep=_LATE))


@R.add("stream_run_progress", f"WITH {EVENTS_SQL} SELECT run_id, arg_max(stage, [epoch_us(ts), event_id]) AS stage, arg_max(status, [epoch_us(ts), event_id]) AS status, count(*) AS events FROM e GROUP BY run_id")
def stream_run_progress(spark, d):
    return P.into_table(P.run_progress_stream(shuffled_stream(spark, d), _LATE), ["run_id"]).where("run_id IS NOT NULL")


_SEVERITY = "CASE CAST(floor(value) AS INT) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"


@R.add("stream_finding_counts", f"WITH {EVENTS_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, {_SEVERITY} AS severity, count(*) AS n FROM e GROUP BY ALL")
def stream_finding_counts(spark, d):
    out = P.into_table(P.finding_counts(event_stream(spark, d).withColumn("severity", F.expr(_SEVERITY))), ["start", "severity"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "severity", "n")


@R.add("stream_finding_dedupe", f"WITH {EVENTS_SQL} SELECT DISTINCT sha256(concat_ws(':', run_id, stage, status)) AS fingerprint FROM e")
def stream_finding_dedupe(spark, d):
    rows = event_stream(spark, d).withColumn("fingerprint", F.sha2(F.concat_ws(":", "run_id", "stage", "status"), 256))
    return P.into_table(P.dedupe_within(rows).select("fingerprint"))


@R.add("stream_secret_scan", f"""SELECT {duck(DOC_FILES)} AS path, regexp_matches(text, {q(X.URI_CREDENTIAL)}) OR {" OR ".join(f"regexp_matches(text, {q(p)})" for p in X.TOKEN_FORMS)} OR len(list_filter(regexp_extract_all(text, {q(X.ASSIGNMENT)}, 2), lambda v: NOT contains(v, '[REDACTED]'))) > 0 AS leaks FROM documents""")
def stream_secret_scan(spark, d):
    return P.into_table(P.scan_texts(stream(spark, d, "documents").selectExpr(f"{DOC_FILES} AS path", "text")).select("path", "leaks"))


@R.add("stream_policy_gate", "SELECT event_id AS run_id, CASE WHEN value >= 400 THEN 'fail' WHEN event_type = 'error' THEN 'warn' ELSE 'pass' END AS verdict FROM events")
def stream_policy_gate(spark, d):
    rules = spark.createDataFrame([("small", "event.value", "lt", 400.0, None, None, None, "fail", []), ("kind", "event.kind", "neq", None, "error", None, None, "warn", [])], PO.RULE_SCHEMA)
    e = stream(spark, d, "events")
    pair = "stack(2, 'event.value', value, NULL, 'event.kind', NULL, event_type) AS (metric, value_num, value_str)"
    metrics = e.selectExpr("event_id AS run_id", pair).withColumn("value_bool", F.lit(None).cast("boolean"))
    root = shared_folder(spark, "gate")
    P.policy_gate(metrics, rules, root)
    return spark.read.parquet(f"{root}/batch=*").select("run_id", "verdict")


SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS run_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS end, count(*) AS events FROM s GROUP BY user_id, k"""


def _session_rows(out):
    return out.where("run_id IS NOT NULL").select("run_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "events")


@R.add("run_activity_sessions", SESSIONS_SQL)
def run_activity_sessions(spark, d):
    return _session_rows(P.activity_sessions(events(spark, d)))


@R.add("stream_activity_sessions", SESSIONS_SQL)
def stream_activity_sessions(spark, d):
    """Sessions whose events come in batches without regard to their times."""
    return _session_rows(P.into_table(P.activity_sessions(shuffled_stream(spark, d), late=_LATE)))


QUERIES, SQL = R.queries, R.sql
