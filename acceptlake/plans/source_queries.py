"""Queries of readers, writers and evidence checks, over the documents, events and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import snapshots as P
from ..sources.staging import shared_folder
from .base import Registry, duck, table
from .security_queries import DOC_FILES

R = Registry()
_PATH = f"concat({DOC_FILES}, CASE doc_id % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.md' WHEN 2 THEN '/node_modules/x.js' ELSE '' END)"


#: Every 25 documents are one file; a file of every fifth has a NUL in front.
_FILE = "CAST(floor(doc_id / 25) AS BIGINT)"
_FILE_LIMIT = 60_000
_BODY = "concat(CASE WHEN doc_id % 125 = 0 THEN chr(0) ELSE '' END, coalesce(text, ''))"


def written(df: DataFrame, root: str) -> None:
    """rows (k, doc_id, body) as one text file a k."""
    df.repartition("k").sortWithinPartitions("k", "doc_id").select("k", "body").write.partitionBy("k").text(root)


@R.add(
    "scan_snapshot",
    f"""WITH f AS (SELECT {_FILE} AS k, string_agg({_BODY} || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY 1)
SELECT 's' AS snapshot, 'src/k=' || k AS path, md5(text) AS text FROM f WHERE k % 3 < 2 AND strlen(text) <= {_FILE_LIMIT} AND NOT contains(encode(text)[1:8192]::BLOB::VARCHAR, '\\x00')""",
)
def scan_snapshot(spark, d):
    """All documents, written as files below src and node_modules and read again."""
    root = shared_folder(spark, "out")
    rows = table(spark, d, "documents").selectExpr(f"{_FILE} AS k", "doc_id", f"{_BODY} AS body")
    written(rows.where("k % 3 < 2"), f"{root}/src")
    written(rows.where("k % 3 = 2"), f"{root}/node_modules")
    files = P.scan_snapshot(spark, root, "s", _FILE_LIMIT, 10**9)
    return files.select("snapshot", F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.md5("text").alias("text"))


@R.add("snapshot_stats", "SELECT source AS snapshot, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS repository_bytes, count(*) FILTER (WHERE doc_id % 9 = 0) AS binary_count, concat_ws(',', CASE WHEN count(*) > 45 THEN 'file_count_exceeded' END, CASE WHEN max(strlen(text)) > 15000 THEN 'file_too_large' END, CASE WHEN sum(strlen(text)) > 120000 THEN 'repository_too_large' END) AS violations FROM documents GROUP BY 1")
def snapshot_stats(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("snapshot"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 9 == 0).alias("binary"))
    return P.snapshot_stats(rows, 45, 15_000, 120_000).withColumn("violations", F.array_join("violations", ","))


@R.add(
    "read_patches",
    f"""WITH f AS (SELECT {_FILE} AS k, string_agg({_BODY} || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY 1)
SELECT k, CASE WHEN strlen(text) > {_FILE_LIMIT} THEN 'too_large' WHEN contains(text, chr(0)) THEN 'nul_byte' END AS reason, CASE WHEN strlen(text) <= {_FILE_LIMIT} AND NOT contains(text, chr(0)) THEN md5(text) END AS digest FROM f""",
)
def read_patches(spark, d):
    """All documents, written as files of many each and read again as patches."""
    root = shared_folder(spark, "out")
    written(table(spark, d, "documents").selectExpr(f"{_FILE} AS k", "doc_id", f"{_BODY} AS body"), root)
    good, rejected = P.read_patches(spark, root, _FILE_LIMIT, "*.txt")
    k = F.regexp_extract("patch_id", "/k=([0-9]+)/", 1).cast("long").alias("k")
    return good.select(k, F.lit(None).cast("string").alias("reason"), F.md5("text").alias("digest")).unionByName(rejected.select(k, "reason", F.lit(None).cast("string").alias("digest")))


@R.add("diffless_as_added", f"SELECT doc_id % 40 AS run_id, NULL AS old_path, {duck(DOC_FILES)} AS new_path, 'added' AS change_type FROM documents WHERE doc_id % 40 NOT IN (SELECT doc_id % 40 FROM documents WHERE doc_id % 8 = 0)")
def diffless_as_added(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id % 40 AS run_id", f"{DOC_FILES} AS path", "doc_id")
    return P.diffless_as_added(t, t.where("doc_id % 8 = 0"))


@R.add(
    "scanner_json_ingest",
    """SELECT event_id AS report_id, CASE WHEN user_id % 4 < 2 THEN 'completed' ELSE 'failed' END AS status, 'r.' || event_type AS rule_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'critical' WHEN 'view' THEN 'medium' WHEN 'signup' THEN 'low' ELSE 'medium' END AS severity,
 'p' || user_id AS path, CASE WHEN event_id % 50 > 0 THEN CAST(event_id % 50 AS INT) END AS start_line, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 + 2 AS INT) WHEN event_id % 50 > 0 THEN CAST(event_id % 50 AS INT) END AS end_line FROM events""",
)
def scanner_json_ingest(spark, d):
    text = """concat('{"results":[{"check_id":"r.', event_type, '","path":"p', user_id, '","start":{"line":', event_id % 50, '},', CASE WHEN event_id % 3 = 0 THEN concat('"end":{"line":', event_id % 50 + 2, '},') ELSE '' END,
 '"extra":{"severity":"', CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'critical' WHEN 'view' THEN 'WARNING' WHEN 'signup' THEN 'INFO' ELSE 'OTHER' END, '"}}]}')"""
    reports = table(spark, d, "events").selectExpr("event_id AS report_id", f"{text} AS json", "user_id % 4 AS exit_code")
    return P.scanner_json_ingest(reports).drop("message", "fix")


_ENTRY = """concat(CASE p_partkey % 6 WHEN 0 THEN '../' WHEN 1 THEN '/abs/' WHEN 2 THEN 'aux.x/' WHEN 3 THEN 'D' ELSE 'ok/' END, CASE WHEN p_partkey % 6 = 3 THEN CASE WHEN p_size % 2 = 0 THEN 'UP' ELSE 'up' END ELSE concat('f', CAST(p_partkey AS STRING)) END)"""


@R.add(
    "archive_inventory_audit",
    f"""WITH e AS (SELECT p_brand AS archive, p_partkey AS pos, {duck(_ENTRY)} AS path, p_size * 300000 AS size, p_partkey % 11 = 0 AS encrypted, p_partkey % 13 = 0 AS link FROM part),
t AS (SELECT *, sum(size) OVER (PARTITION BY archive ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER (PARTITION BY archive, lower(path)) AS same, row_number() OVER (PARTITION BY archive ORDER BY pos) AS place FROM e)
SELECT archive, pos, 'unsafe_path' AS code FROM t WHERE pos % 6 IN (0, 1) UNION ALL SELECT archive, pos, 'non_portable_name' FROM t WHERE pos % 6 = 2 UNION ALL SELECT archive, pos, 'duplicate_path' FROM t WHERE same > 1 UNION ALL SELECT archive, pos, 'special_file' FROM t WHERE link
UNION ALL SELECT archive, pos, 'encrypted' FROM t WHERE encrypted UNION ALL SELECT archive, pos, 'entry_too_large' FROM t WHERE size > 10485760 UNION ALL SELECT archive, pos, 'total_too_large' FROM t WHERE total > 104857600 UNION ALL SELECT archive, pos, 'too_many_entries' FROM t WHERE place > 10000""",
)
def archive_inventory_audit(spark, d):
    e = table(spark, d, "part").selectExpr("p_brand AS archive", "p_partkey AS pos", f"{_ENTRY} AS path", "CAST(p_size * 300000 AS BIGINT) AS size", "CAST(p_size * 100000 AS BIGINT) AS packed", "CASE WHEN p_partkey % 13 = 0 THEN 41471 ELSE 33188 END AS mode", "p_partkey % 11 = 0 AS encrypted")
    return P.archive_inventory_audit(e)


#: Tables of results: the table that stands in, its key, and the value of a row (SQL of both engines).
_RESULTS = {
    "changed_files": ("part", "p_partkey", "concat('src/m', p_partkey, ' ', p_size)"),
    "symbols": ("part", "p_partkey", "p_name"),
    "edges": ("orders", "o_orderkey", "concat('o', o_orderkey, ' c', o_custkey)"),
    "requirements": ("benchmark", "item_id", "text"),
    "findings": ("orders", "o_orderkey", "o_orderpriority"),
    "executions": ("events", "event_id", "event_type"),
    "policy_decisions": ("events", "event_id", "concat(event_type, ' ', user_id)"),
    "artifacts": ("documents", "doc_id", "source"),
}


def _results_sql() -> str:
    """Runs that a rerun replaces have its rows and no others; it has brought no artifacts."""
    value = lambda n, v: f"concat({v}, ' [REDACTED] n', {_RESULTS[n][1]})" if n == "findings" else v
    first = [f"SELECT '{n}' AS name, {k} % 16 AS run_id, {k} AS item, {value(n, v)} AS value FROM {t} WHERE {k} % 4 <> 0" for n, (t, k, v) in _RESULTS.items()]
    again = [f"SELECT '{n}', {k} % 16, {k}, concat('again ', {value(n, v)}) FROM {t} WHERE {k} % 8 = 4" for n, (t, k, v) in _RESULTS.items() if n != "artifacts"]
    return " UNION ALL ".join(first + again)


@R.add("results_sink", _results_sql())
def results_sink(spark, d):
    """All tables of sixteen runs; a rerun of four of them that brings half their rows; an attempt that was never published."""
    root = shared_folder(spark, "out")

    def tables(again: bool):
        out = {}
        for name, (t, k, v) in _RESULTS.items():
            rows = table(spark, d, t).selectExpr(f"CAST({k} % 16 AS BIGINT) AS run_id", f"{k} AS item", f"{'concat(`again `, '.replace('`', chr(39)) if again else '('}{v}) AS value")
            if name == "findings":
                rows = rows.withColumn("evidence", F.create_map(F.lit("password"), F.lit("x1"), F.lit("note"), F.concat(F.lit("n"), "item")))
            if not again or name != "artifacts":
                out[name] = rows.where("item % 8 = 4") if again else rows
        return out

    P.results_sink(tables(False), root)
    P.results_sink(tables(True), root, spark.range(4).select((F.col("id") * 4).alias("run_id")))
    table(spark, d, "part").selectExpr("CAST(1 AS BIGINT) AS run_id", "p_partkey AS item", "'lost' AS value").write.parquet(f"{root}/symbols/attempt=lost")
    parts = []
    for name in _RESULTS:
        value = F.concat("value", F.lit(" "), F.col("evidence")["password"], F.lit(" "), F.col("evidence")["note"]) if name == "findings" else F.col("value")
        parts.append(P.read_results(spark, root, name).select(F.lit(name).alias("name"), "run_id", "item", value.alias("value")))
    return reduce(lambda x, y: x.unionByName(y), parts)


#: Datasets of evidence: the table that stands in, and its key.
_EVIDENCE = {"analysis": ("customer", "c_custkey"), "changed_files": ("part", "p_partkey"), "requirements": ("benchmark", "item_id"), "dependency_graph": ("supplier", "s_suppkey"), "findings": ("part", "p_size"), "test_results": ("events", "event_id"), "policy_decisions": ("nation", "n_nationkey"), "audit_events": ("conversations", "conv_id")}
_TOKEN, _SECRET = "gh" + "p_" + "A" * 30, "hunter2secret"


def _evidence_sql() -> str:
    """The lines as they must stand, written out."""
    row = lambda k: f"""'{{"api_key":"[REDACTED]","body":{{"a":null,"b":"use [REDACTED] and [REDACTED] k' || {k} || '"}},"list":[{{"x":"v' || {k} || '","y":' || {k} || '}}],"zeta":' || {k} || '}}'"""
    line = lambda n, k: f"""'{{"{n}":' || {row(k)} || ',"schema_version":"1.0"}}'""" if n < "schema_version" else f"""'{{"schema_version":"1.0","{n}":' || {row(k)} || '}}'"""
    return " UNION ALL ".join([f"SELECT '{n}' AS name, {line(n, k)} AS value FROM {t}" for n, (t, k) in _EVIDENCE.items()] + [f"SELECT '{n}', 'same digest, ' || count(*) FROM {t}" for n, (t, k) in _EVIDENCE.items()])


@R.add("evidence_sink", _evidence_sql())
def evidence_sink(spark, d):
    """All datasets, written twice from rows that lie differently: the lines, and whether the digests agree."""
    def tables(parts: int):
        body = f"map('b', concat('use {_TOKEN} and {_SECRET} k', k), 'a', CAST(NULL AS STRING)) AS body"
        return {n: table(spark, d, t).selectExpr(f"CAST({k} AS BIGINT) AS k").repartition(parts).selectExpr("k AS zeta", "concat('key', k) AS api_key", body, "array(named_struct('y', k, 'x', concat('v', k))) AS list") for n, (t, k) in _EVIDENCE.items()}

    roots = [shared_folder(spark, "out") for _ in range(2)]
    cores = spark.sparkContext.defaultParallelism
    one, two = (P.evidence_sink(tables(n), root, (_SECRET,)) for n, root in zip((cores, cores + 5), roots, strict=True))
    same = one.join(two.withColumnsRenamed({"sha256": "other", "rows": "r", "size": "s"}), "name").where("size = s AND rows = r")
    lines = [spark.read.text(f"{roots[0]}/{n}").select(F.lit(n).alias("name"), "value") for n in _EVIDENCE]
    verdict = same.select("name", F.concat(F.when(F.col("sha256") == F.col("other"), "same digest, ").otherwise("other digest, "), "rows").alias("value"))
    return reduce(lambda x, y: x.unionByName(y), [*lines, verdict])


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/octet-stream' ELSE 'text/plain' END"


@R.add("evidence_manifest", f"SELECT {duck(_PATH)} AS name, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, {_KIND} AS content_type FROM documents")
def evidence_manifest(spark, d):
    return P.evidence_manifest(table(spark, d, "documents").selectExpr(f"{_PATH} AS name", "text AS content"))


@R.add(
    "checksum_index_parse",
    """SELECT 'b' || p_size AS bundle, count(*) FILTER (WHERE p_partkey % 5 > 0 AND NOT dup) AS good, count(*) FILTER (WHERE p_partkey % 5 = 0) AS invalid, count(*) FILTER (WHERE p_partkey % 5 > 0 AND dup) AS duplicate
FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_partkey % 5 = 0, p_partkey % 7 ORDER BY p_partkey) > 1 AS dup FROM part) GROUP BY p_size""",
)
def checksum_index_parse(spark, d):
    line = F.when(F.col("p_partkey") % 5 == 0, "broken line").otherwise(F.concat(F.sha2("p_name", 256), F.lit("  n"), (F.col("p_partkey") % 7)))
    texts = table(spark, d, "part").groupBy(F.concat(F.lit("b"), "p_size").alias("bundle")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))).alias("x")).select("bundle", F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("text"))
    good, issues = P.checksum_index_parse(texts)
    rows = good.select("bundle", F.lit("good").alias("k")).unionByName(issues.select("bundle", F.col("code").alias("k")))
    return rows.groupBy("bundle").agg(F.count_if(F.col("k") == "good").alias("good"), F.count_if(F.col("k") == "invalid_checksum_line").alias("invalid"), F.count_if(F.col("k") == "duplicate_checksum").alias("duplicate"))


@R.add(
    "manifest_verify",
    f"""SELECT {duck(DOC_FILES)} AS name, unnest(list_filter([CASE WHEN doc_id % 10 = 0 THEN 'missing_file' END, CASE WHEN doc_id % 10 = 1 THEN 'unexpected_file' END, CASE WHEN doc_id % 10 > 1 AND doc_id % 7 = 0 THEN 'checksum_mismatch' END, CASE WHEN doc_id % 10 > 1 AND doc_id % 7 = 0 THEN 'size_mismatch' END], lambda x: x IS NOT NULL)) AS code FROM documents""",
)
def manifest_verify(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{DOC_FILES} AS name", "text", "CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END AS changed")
    side = lambda df, c: df.select("name", F.sha2(c, 256).alias("sha256"), F.octet_length(c).cast("long").alias("size"))
    return P.manifest_verify(side(t.where("doc_id % 10 <> 1"), "text"), side(t.where("doc_id % 10 <> 0"), "changed"))


#: Ten documents are one bundle: f0 its checksum index, f1 its manifest. Each rule below breaks some of the files.
_BUNDLE = ("CAST(floor(doc_id / 10) AS BIGINT)", "concat('f', CAST(doc_id % 10 AS STRING))")


@R.add(
    "bundle_verify",
    f"""WITH t AS (SELECT {_BUNDLE[0]} AS bundle, {duck(_BUNDLE[1])} AS name, doc_id, doc_id % 10 AS f, doc_id % 7 = 0 AS gone, doc_id % 13 = 0 AS odd, doc_id % 11 = 0 AS moved, doc_id % 17 = 0 AS unsummed, doc_id % 19 = 0 AS unlisted, doc_id % 23 = 0 AS twice, doc_id % 29 = 0 AS untyped FROM documents)
SELECT bundle, CASE WHEN odd THEN 'odd-' || name ELSE name END AS name, 'unexpected_file' AS code FROM t WHERE odd AND NOT gone
UNION ALL SELECT bundle, name, 'missing_file' FROM t WHERE gone OR odd
UNION ALL SELECT bundle, name, 'checksum_mismatch' FROM t WHERE f > 0 AND moved AND NOT unsummed AND NOT gone AND NOT odd
UNION ALL SELECT bundle, name, 'manifest_artifact_mismatch' FROM t WHERE f > 1 AND (moved OR untyped) AND NOT unlisted AND NOT gone AND NOT odd
UNION ALL SELECT bundle, name, 'duplicate_manifest_artifact' FROM t WHERE f > 1 AND twice AND NOT unlisted
UNION ALL SELECT bundle, name, 'invalid_manifest_artifact' FROM t WHERE f < 2 AND twice AND NOT unlisted
UNION ALL SELECT bundle, name, 'invalid_manifest_artifact' FROM t WHERE f < 2 AND twice AND NOT unlisted
UNION ALL SELECT DISTINCT bundle, 'f0', 'checksum_entries_missing' FROM t WHERE f > 0 AND unsummed
UNION ALL SELECT DISTINCT bundle, 'f0', 'checksum_entries_unexpected' FROM t WHERE f = 0 AND twice AND NOT unsummed
UNION ALL SELECT DISTINCT bundle, 'f1', 'manifest_artifacts_incomplete' FROM t WHERE f > 1 AND unlisted""",
)
def bundle_verify(spark, d):
    t = table(spark, d, "documents").selectExpr(f"{_BUNDLE[0]} AS bundle", f"{_BUNDLE[1]} AS name", "doc_id", "coalesce(text, '') AS text", "concat(coalesce(text, ''), CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END) AS found")
    observed = t.where("doc_id % 7 <> 0").selectExpr("bundle", "CASE WHEN doc_id % 13 = 0 THEN concat('odd-', name) ELSE name END AS name", "sha2(found, 256) AS sha256", "CAST(octet_length(found) AS BIGINT) AS size")
    sums = t.where("doc_id % 17 <> 0 AND (doc_id % 10 > 0 OR doc_id % 23 = 0)").selectExpr("bundle", "name", "sha2(text, 256) AS digest")
    entries = t.where("doc_id % 19 <> 0 AND (doc_id % 10 > 1 OR doc_id % 23 = 0)").selectExpr("bundle", "name", "sha2(text, 256) AS sha256", "CAST(octet_length(text) AS BIGINT) AS size", "CASE WHEN doc_id % 29 > 0 THEN 'text/plain' END AS content_type", "explode(sequence(0, CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END)) AS position")
    return P.bundle_verify(t, observed, entries, sums, "f0", "f1")


@R.add(
    "evidence_schema_check",
    """SELECT event_id AS name, CASE event_id % 5 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'invalid_root' WHEN 2 THEN 'schema_version_mismatch' ELSE 'missing_root' END AS code FROM events WHERE event_id % 5 < 4""",
)
def evidence_schema_check(spark, d):
    text = """CASE event_id % 5 WHEN 0 THEN substring(props, 1, 4) WHEN 1 THEN concat('[', props, ']') WHEN 2 THEN concat('{"schema_version":"0.9","k":', event_id, '}') WHEN 3 THEN '{"schema_version":"1.0","x":1}' ELSE '{"schema_version":"1.0","k":1}' END"""
    return P.evidence_schema_check(table(spark, d, "events").selectExpr("event_id AS name", f"{text} AS text", "'k' AS root"))


QUERIES, SQL = R.queries, R.sql
