"""Readers over real files, whole bundles, and the stateful stream over several batches."""

import pytest
from pyspark.sql import functions as F

from acceptlake.sources import snapshots as S
from acceptlake.streaming import progress as P


def test_scan_snapshot(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    files = {"src/x.py": b"x = 1\n", "src/bad.txt": b"a\xffb", "bin.dat": b"a\0b", "node_modules/y.js": b"y", "venv/z.py": b"z", "large.txt": b"l" * 50, "late.bin": b"a" * 9000 + b"\0"}
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    got = {r.path: r.text for r in S.scan_snapshot(spark, f"file://{root}", "s", 10_000).collect()}
    assert got == {"src/x.py": "x = 1\n", "src/bad.txt": "a�b", "venv/z.py": "z", "large.txt": "l" * 50, "late.bin": "a" * 9000 + "\0"}
    assert set(got) - {r.path for r in S.scan_snapshot(spark, str(root), "s", 49).collect()} == {"large.txt", "late.bin"}
    with pytest.raises(ValueError):
        S.scan_snapshot(spark, str(root), "s", max_files=4)


def test_read_patches(spark, tmp_path):
    for name, content in {"a.diff": b"--- a\n", "b.patch": b"x\0", "c.patch": b"y" * 100, "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    good, rejected = S.read_patches(spark, str(tmp_path), 50)
    assert [(r.patch_id.rsplit("/", 1)[1], r.text) for r in good.collect()] == [("a.diff", "--- a\n")]
    assert {(r.patch_id.rsplit("/", 1)[1], r.reason) for r in rejected.collect()} == {("b.patch", "nul_byte"), ("c.patch", "too_large")}


def test_a_whole_bundle_has_no_issue(spark):
    names = [("b", n) for n in ("checksums.sha256", "manifest.json", "r.json")]
    required = spark.createDataFrame(names, "bundle string, name string")
    observed = required.withColumn("sha256", F.sha2("name", 256)).withColumn("size", F.lit(1))
    entry = observed.where("name = 'r.json'").withColumn("content_type", F.lit("application/json")).withColumn("position", F.lit(0))
    sums = observed.where("name <> 'checksums.sha256'").select("bundle", "name", F.col("sha256").alias("digest"))
    assert S.bundle_verify(required, observed, entry, sums).count() == 0
    codes = {(r.name, r.code) for r in S.bundle_verify(required, observed, entry.limit(0), sums.limit(0)).collect()}
    assert codes == {("manifest.json", "manifest_artifacts_incomplete"), ("checksums.sha256", "checksum_entries_missing")}


def test_starts_are_kept_between_batches(spark, tmp_path):
    kind = "run_id long, event_id long, stage string, status string, ts timestamp"
    parts = [
        [(1, 1, "a", "running", "2024-01-01 00:00:00"), (2, 2, "a", "completed", "2024-01-01 00:00:01")],
        [(1, 3, "a", "completed", "2024-01-01 00:00:02.5"), (1, 4, "a", "running", "2024-01-01 00:00:03")],
        [(1, 5, "a", "failed", "2024-01-01 00:00:04")],
        [(9, 9, "end", "queued", "2024-01-03 00:00:00")],  # events wait until the watermark has passed them
    ]
    for rows in parts:
        df = spark.createDataFrame(rows, kind.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r.event_id: r.duration_ms for r in P.into_table(P.stage_event_stream(stream)).collect()}
    assert got == {2: None, 3: 2500, 5: 1000}
    counts = P.into_table(P.run_progress(stream), ["run_id"]).collect()
    assert {(r.run_id, r.status, r.events) for r in counts} == {(1, "failed", 4), (2, "completed", 1), (9, "queued", 1)}
