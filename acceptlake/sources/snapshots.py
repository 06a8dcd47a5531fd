"""Readers and writers: source snapshots, patches, scanner reports, archive inventories, evidence tables and their manifests."""

from __future__ import annotations

import time
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .staging import exists, publish, staged, unstage

MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES, MAX_PATCH_BYTES = 20_000, 2_000_000, 100 << 20, 10 << 20
# Path parts that are no source.
IGNORED = (".git", ".hg", ".svn", ".venv", "build", "dist", "node_modules")


def is_binary(content: Column) -> Column:
    """NUL among the first 8,192 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), "\0") > 0


def below(root: str, path: str = "path") -> Column:
    """A path's part below the folder root, whatever scheme either is written with."""
    base = urlparse(root).path.rstrip("/") + "/"
    return F.substring(F.col(path), F.instr(F.col(path), base) + len(base), F.length(path))


def scan_snapshot(spark: SparkSession, root: str, snapshot: str, max_file_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """files(snapshot, path, text) of a folder tree: ignored parts, large and binary files are left out; bad UTF-8 is replaced.
    More than max_files text files are an error."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_file_bytes)
    files = snapshot_files(rows.select(F.lit(snapshot).alias("snapshot"), below(root).alias("path"), "content"))
    if files.select("path").limit(max_files + 1).count() > max_files:
        raise ValueError(f"{root} holds more than {max_files} source files")
    return files


def snapshot_files(rows: DataFrame) -> DataFrame:
    """Text files of rows (snapshot, path, content)."""
    ignored = F.exists(F.split("path", "/"), lambda p: p.isin(*IGNORED))
    return rows.where(~ignored & ~is_binary(F.col("content"))).select("snapshot", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def snapshot_stats(files: DataFrame, max_files: int = MAX_FILES, max_file: int = MAX_FILE_BYTES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """Per snapshot: files, bytes, binary files and the limits that are passed. files: snapshot, size, binary."""
    out = files.groupBy("snapshot").agg(F.count("*").alias("file_count"), F.sum("size").alias("repository_bytes"), F.max("size").alias("largest"), F.count_if(F.col("binary")).alias("binary_count"))
    limits = F.array(F.when(F.col("file_count") > max_files, "file_count_exceeded"), F.when(F.col("largest") > max_file, "file_too_large"), F.when(F.col("repository_bytes") > max_total, "repository_too_large"))
    return out.withColumn("violations", F.array_compact(limits)).drop("largest")


def read_patches(spark: SparkSession, root: str, max_bytes: int = MAX_PATCH_BYTES, pattern: str = "*.{diff,patch}") -> tuple[DataFrame, DataFrame]:
    """patches(patch_id, text) of the files under root that match, and the rejected ones with a reason; files above max_bytes are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    large = rows.where(F.col("length") > max_bytes).select(F.col("path").alias("patch_id"), F.lit("too_large").alias("reason"))
    rows = rows.where(F.col("length") <= max_bytes)
    nul = F.instr(F.decode("content", "ISO-8859-1"), "\0") > 0
    patches = rows.where(~nul).select(F.col("path").alias("patch_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return patches, large.unionByName(rows.where(nul).select(F.col("path").alias("patch_id"), F.lit("nul_byte").alias("reason")))


def diffless_as_added(files: DataFrame, diff_files: DataFrame) -> DataFrame:
    """Runs without a diff: every file of the snapshot as an added one."""
    rest = files.join(diff_files.select("run_id").distinct(), "run_id", "left_anti")
    return rest.select("run_id", F.lit(None).cast("string").alias("old_path"), F.col("path").alias("new_path"), F.lit("added").alias("change_type"))


def scanner_json_ingest(reports: DataFrame) -> DataFrame:
    """Findings of a scanner's JSON reports (report_id, json, exit_code): severity mapped, only positive lines, the end defaults to the start."""
    item = "struct<check_id:string,path:string,start:struct<line:string>,end:struct<line:string>,extra:struct<message:string,severity:string,fix:string>>"
    rows = reports.select("report_id", F.when(F.col("exit_code").isin(0, 1), "completed").otherwise("failed").alias("status"), F.explode_outer(F.from_json("json", f"results array<{item}>")["results"]).alias("r"))
    level = F.upper(F.coalesce("r.extra.severity", F.lit("")))
    severity = F.when(level == "ERROR", "high").when(level == "CRITICAL", "critical").when(level == "WARNING", "medium").when(level == "INFO", "low").otherwise("medium")
    line = lambda c: F.when(F.col(c).try_cast("int") > 0, F.col(c).try_cast("int"))
    start = line("r.start.line")
    return rows.where("r IS NOT NULL").select("report_id", "status", F.col("r.check_id").alias("rule_id"), severity.alias("severity"), F.col("r.path").alias("path"), start.alias("start_line"), F.coalesce(line("r.end.line"), start).alias("end_line"), F.col("r.extra.message").alias("message"), F.col("r.extra.fix").alias("fix"))


def archive_inventory_audit(entries: DataFrame, max_entries: int = 10_000, max_entry: int = 10 << 20, max_total: int = 100 << 20, max_ratio: float = 100.0) -> DataFrame:
    """Violations of archive entries (archive, pos, path, size, packed, mode, encrypted): archive, pos, code."""
    order = Window.partitionBy("archive").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.withColumn("total", F.sum("size").over(order)).withColumn("same", F.count("*").over(Window.partitionBy("archive", F.lower("path")))).withColumn("place", F.row_number().over(Window.partitionBy("archive").orderBy("pos")))
    p = F.col("path")
    parts = F.split(p, "/")
    reserved = F.exists(parts, lambda x: F.lower(F.substring_index(x, ".", 1)).rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"))
    tests = {
        "unsafe_path": p.rlike(r"^/|^[A-Za-z]:|\\") | F.exists(parts, lambda x: x == ".."),
        "non_portable_name": reserved | p.rlike(r'[<>:"|?*\x00-\x1f]') | F.exists(parts, lambda x: x.rlike(r"[ .]$") & ~x.isin(".", "..")),
        "duplicate_path": F.col("same") > 1,
        "special_file": F.shiftright(F.col("mode"), 12).isin(1, 2, 6, 10, 12),
        "encrypted": F.col("encrypted"),
        "entry_too_large": F.col("size") > max_entry,
        "total_too_large": F.col("total") > max_total,
        "ratio_exceeded": (F.col("packed") > 0) & (F.col("size") / F.col("packed") > max_ratio),
        "too_many_entries": F.col("place") > max_entries,
    }
    return rows.select("archive", "pos", F.explode(F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))).alias("code"))


# The tables of a run's results, and the datasets of its evidence.
RESULT_TABLES = ("changed_files", "symbols", "edges", "requirements", "findings", "executions", "policy_decisions", "artifacts")
EVIDENCE_SETS = ("analysis", "changed_files", "requirements", "dependency_graph", "findings", "test_results", "policy_decisions", "audit_events")


def _known(names, known: tuple[str, ...]) -> None:
    if odd := sorted(set(names) - set(known)):
        raise ValueError(f"unknown: {', '.join(odd)}")


def results_sink(tables: dict[str, DataFrame], root: str, runs: DataFrame | None = None) -> str:
    """Publish the results of runs: tables (of RESULT_TABLES, each with run_id) under root. Evidence of findings is redacted.

    All tables are written as one attempt first. One file with the runs and their attempt then publishes them all at once; what an attempt
    without it has left is never read. Runs that are published again replace all that they had, also in tables that they no longer bring. runs: the
    runs (run_id), if some may have no row at all. Returns the attempt.
    """
    from ..operators.security import redacted_column

    _known(tables, RESULT_TABLES)
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        if name == "findings" and "evidence" in df.columns:
            df = df.withColumn("evidence", redacted_column(df.schema["evidence"]))
        df.write.parquet(f"{root}/{name}/attempt={attempt}")
    mine = [spark.read.parquet(f"{root}/{name}/attempt={attempt}").select("run_id") for name in tables] + ([] if runs is None else [runs.select("run_id")])
    ids = reduce(DataFrame.unionByName, mine).distinct()
    ids.select("run_id", F.lit(attempt).alias("attempt"), F.lit(time.time_ns()).alias("published")).coalesce(1).write.mode("append").parquet(f"{root}/published")
    return attempt


def read_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a table of results_sink, of each run's last attempt."""
    _known([name], RESULT_TABLES)
    last = spark.read.parquet(f"{root}/published").groupBy("run_id").agg(F.max_by("attempt", F.struct("published", "attempt")).alias("attempt"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
    return rows.join(last, ["run_id", "attempt"], "left_semi").drop("attempt")


def _canonical(c: Column, kind: T.DataType) -> Column:
    """c with the fields and keys of all that it holds in the order of their names."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(c))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _canonical(F.try_element_at(c, k), kind.valueType)))
    return c


def canonical_json(df: DataFrame, name: str) -> DataFrame:
    """A line of JSON (value) for each row, under name and beside the schema's version: keys sorted at every depth, nulls kept."""
    row = {name: _canonical(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema), "schema_version": F.lit("1.0")}
    return df.select(F.to_json(F.struct(*[row[k].alias(k) for k in sorted(row)]), {"ignoreNullFields": "false"}).alias("value"))


def lines_digest(lines: DataFrame) -> DataFrame:
    """rows, size and sha256 of a dataset (value), the same however its lines lie: of the sorted digests of the lines, in 4,096 parts by their first digits."""
    rows = lines.select(F.sha2("value", 256).alias("d"), (F.octet_length("value") + 1).cast("long").alias("size"))
    parts = rows.groupBy(F.left("d", F.lit(3)).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count("*").alias("n"), F.sum("size").alias("size"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))


def evidence_sink(tables: dict[str, DataFrame], root: str, known: tuple[str, ...] = ()) -> DataFrame:
    """Datasets of evidence (of EVIDENCE_SETS) as redacted canonical JSON lines, sorted, a folder each under root, which comes into being as a
    whole: one that is there already is an error. known: secrets to be hidden wherever they stand. Returns name, rows, size and sha256 of each."""
    from ..operators.security import redact_nested

    _known(tables, EVIDENCE_SETS)
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, root):
        raise FileExistsError(f"{root} is there already")
    made, digests = f"{root.rstrip('/')}.{uuid.uuid4().hex}", []
    for name, df in tables.items():
        lines = staged(canonical_json(redact_nested(df, known), name), "lines")  # a sort reads its input twice: to find its bounds, and to deal it
        lines.sort("value").write.text(f"{made}/{name}")
        unstage(lines)
    publish(spark, made, root)
    for name in tables:
        digests.append(lines_digest(spark.read.text(f"{root}/{name}")).select(F.lit(name).alias("name"), "rows", "size", "sha256"))
    return reduce(DataFrame.unionByName, digests)


def evidence_manifest(artifacts: DataFrame) -> DataFrame:
    """Name, digest, size and content type of artifacts (name, content)."""
    end = X.suffix(F.col("name"))
    kind = F.when(end == ".json", "application/json").when(end == ".md", "text/markdown").when(end == ".html", "text/html").when(end == ".txt", "text/plain").otherwise("application/octet-stream")
    return artifacts.select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), kind.alias("content_type"))


def checksum_index_parse(indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checksums (bundle, name, digest) of index texts (bundle, text), the first of a repeated name, and the issues (bundle, line, code)."""
    rows = indexes.select("bundle", F.posexplode(X.lines(F.col("text"))).alias("p", "raw")).withColumn("line", F.col("p") + 1)
    form = r"^([0-9a-f]{64})  ([A-Za-z0-9][A-Za-z0-9.-]*)$"
    rows = rows.withColumn("digest", F.nullif(F.regexp_extract("raw", form, 1), F.lit(""))).withColumn("name", F.regexp_extract("raw", form, 2))
    good = rows.where("digest IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("bundle", "name").orderBy("line")))
    issues = rows.where("digest IS NULL").select("bundle", "line", F.lit("invalid_checksum_line").alias("code")).unionByName(good.where("r > 1").select("bundle", "line", F.lit("duplicate_checksum").alias("code")))
    return good.where("r = 1").select("bundle", "name", "digest"), issues


def manifest_verify(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Issues of artifacts that a manifest (name, sha256, size) and a folder (name, sha256, size) don't agree on: name, code.
    Of a name's repeated entries the one with the least digest and size counts."""
    m = manifest.groupBy("name").agg(F.min(F.struct("sha256", "size")).alias("m"), F.count("*").alias("n")).select("name", "n", F.col("m.sha256").alias("m_sha"), F.col("m.size").alias("m_size"))
    o = observed.select("name", F.col("sha256").alias("o_sha"), F.col("size").alias("o_size"))
    rows = m.join(o, "name", "full")
    both = F.col("m_sha").isNotNull() & F.col("o_sha").isNotNull()
    codes = F.array(F.when(F.col("o_sha").isNull(), "missing_file"), F.when(F.col("m_sha").isNull(), "unexpected_file"), F.when(both & (F.col("m_sha") != F.col("o_sha")), "checksum_mismatch"), F.when(both & (F.col("m_size") != F.col("o_size")), "size_mismatch"), F.when(F.col("n") > 1, "duplicate_manifest_artifact"))
    return rows.select("name", F.explode(F.array_compact(codes)).alias("code"))


def bundle_verify(required: DataFrame, observed: DataFrame, manifest: DataFrame, checksums: DataFrame, index: str = "checksums.sha256", listing: str = "manifest.json") -> DataFrame:
    """Issues (bundle, name, code) of many bundles at once.

    required(bundle, name): the files a bundle must have, the checksum index and the manifest among them; observed(bundle, name, sha256,
    size): those that it has; manifest(bundle, position, name, sha256, size, content_type): its manifest's entries, of which the first of a
    name counts; checksums(bundle, name, digest): its checksum index. The index lists all required files but itself, the manifest all but
    those two. A bundle is valid if it has no row here. The sides meet in one grouping by bundle and name.
    """
    key = ["bundle", "name"]
    nothing = {"need": "boolean", "o": "struct<sha256:string,size:bigint>", "m": "struct<position:bigint,sha256:string,size:bigint,content_type:string>", "digest": "string"}

    def side(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(*key, *[(value if c == name else F.lit(None)).cast(t).alias(c) for c, t in nothing.items()])

    sides = side(required, "need", F.lit(True)), side(observed, "o", F.struct("sha256", "size")), side(manifest, "m", F.struct("position", "sha256", "size", "content_type")), side(checksums, "digest", F.col("digest"))
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3]).groupBy(*key).agg(F.coalesce(F.max("need"), F.lit(False)).alias("need"), F.min("o").alias("o"), F.min("m").alias("m"), F.count("m").cast("int").alias("n"), F.min("digest").alias("digest"))
    need, here = F.col("need"), F.col("o").isNotNull()
    summed, listed = need & (F.col("name") != index), need & ~F.col("name").isin(index, listing)
    agrees = F.col("m.sha256").eqNullSafe(F.col("o.sha256")) & F.col("m.size").eqNullSafe(F.col("o.size")) & F.col("m.content_type").isNotNull()
    one = F.array(
        F.when(need & ~here, "missing_file"),
        F.when(here & ~need, "unexpected_file"),
        F.when(summed & here & (F.col("digest") != F.col("o.sha256")), "checksum_mismatch"),
        F.when(listed & here & (F.col("n") > 0) & ~agrees, "manifest_artifact_mismatch"),
    )
    again = F.when(listed, F.array_repeat(F.lit("duplicate_manifest_artifact"), F.col("n") - 1)).otherwise(F.array_repeat(F.lit("invalid_manifest_artifact"), F.col("n")))
    files = rows.select(*key, F.explode(F.concat(F.array_compact(one), again)).alias("code"))
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    sets = rows.groupBy("bundle").agg(some(summed & F.col("digest").isNull()).alias("lacks"), some(~summed & F.col("digest").isNotNull()).alias("extra"), some(listed & (F.col("n") == 0)).alias("short"))
    issue = lambda test, name, code: F.when(F.col(test), F.struct(F.lit(name).alias("name"), F.lit(code).alias("code")))
    whole = F.array(issue("lacks", index, "checksum_entries_missing"), issue("extra", index, "checksum_entries_unexpected"), issue("short", listing, "manifest_artifacts_incomplete"))
    return files.unionByName(sets.select("bundle", F.explode(F.array_compact(whole)).alias("i")).select("bundle", "i.*"))


def evidence_schema_check(artifacts: DataFrame, version: str = "1.0") -> DataFrame:
    """Issues of JSON artifacts (name, text, root): invalid JSON, root no object, other schema version, missing root key."""
    v = F.try_parse_json("text")
    object_ = F.schema_of_variant(v).startswith("OBJECT")
    ok = v.isNotNull() & object_
    root = F.from_json("text", "map<string,string>")
    codes = F.array(
        F.when(v.isNull(), "invalid_json"),
        F.when(v.isNotNull() & ~object_, "invalid_root"),
        F.when(ok & ~F.coalesce(F.try_variant_get(v, "$.schema_version", "string") == version, F.lit(False)), "schema_version_mismatch"),
        F.when(ok & ~F.coalesce(F.map_contains_key(root, F.col("root")), F.lit(False)), "missing_root"),
    )
    return artifacts.select("name", F.explode(F.array_compact(codes)).alias("code"))
