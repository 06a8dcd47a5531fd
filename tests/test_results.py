"""Sinks, flattening, the reach of a change and streams, on cases written out."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from acceptlake.operators import graph, manifests
from acceptlake.sources import snapshots
from acceptlake.streaming import progress


def test_a_rerun_replaces_a_run(spark, tmp_path):
    root = f"file://{tmp_path}/results"
    rows = lambda *r: spark.createDataFrame(list(r), "run_id int, v string")
    snapshots.results_sink({"findings": rows((1, "a"), (2, "b")), "edges": rows((1, "e"))}, root)
    snapshots.results_sink({"findings": rows((1, "c"), (1, "d"))}, root)
    rows((2, "lost")).write.parquet(f"{root}/findings/attempt=lost")  # what a killed attempt leaves
    read = lambda name: sorted(tuple(r) for r in snapshots.read_results(spark, root, name).collect())
    assert read("findings") == [(1, "c"), (1, "d"), (2, "b")] and read("edges") == []
    snapshots.results_sink({"edges": rows()}, root, spark.createDataFrame([(2,)], "run_id int"))
    assert read("findings") == [(1, "c"), (1, "d")]
    with pytest.raises(ValueError):
        snapshots.results_sink({"else": rows((1, "a"))}, root)


def test_evidence_is_canonical_and_comes_as_a_whole(spark, tmp_path):
    kind = "z int, a struct<y:string,b:map<string,array<struct<q:int,p:string>>>>, token string"
    rows = [(1, ("x", {"k2": [(1, "s")], "k1": None}), "t"), (None, None, None), (1, ("hush hush", {}), "t")]
    lines = []
    for n in (1, 3):
        df = spark.createDataFrame(rows, kind).repartition(n)
        (r,) = snapshots.evidence_sink({"findings": df}, f"file://{tmp_path}/e{n}", ("hush",)).collect()
        assert (r.name, r.rows) == ("findings", 3)
        lines.append((r.sha256, sorted(x.value for x in spark.read.text(f"file://{tmp_path}/e{n}/findings").collect())))
        with pytest.raises(FileExistsError):
            snapshots.evidence_sink({"findings": df}, f"file://{tmp_path}/e{n}")
    assert lines[0] == lines[1]
    assert lines[0][1][0] == '{"findings":{"a":null,"token":"[REDACTED]","z":null},"schema_version":"1.0"}'
    assert '{"findings":{"a":{"b":{"k1":null,"k2":[{"p":"s","q":1}]},"y":"x"},"token":"[REDACTED]","z":1},"schema_version":"1.0"}' in lines[0][1]
    assert "hush" not in "".join(lines[0][1]) and all(json.loads(x) for x in lines[0][1])


def test_configuration_of_any_depth(spark):
    deep = 1
    for k in reversed(range(200)):
        deep = {f"k{k}": deep}
    texts = [("a.json", json.dumps(deep)), ("b.toml", "[x.y]\nz = [1, 2]\nt = 1979-05-27"), ("c.json", "{bad"), ("d.json", "[1]"), ("e.json", "{}"), ("f.json", None), (None, "{}"), ("g.json", "[" * 200_000), ("h.json", '{"a": {"b": "é", "c": {}}, "a2": null}')]
    got = {r.key: r.value for r in manifests.config_flatten(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {"a.json:" + ":".join(f"k{k}" for k in range(200)): "1", "b.toml:x:y:z": "[1,2]", "b.toml:x:y:t": '"1979-05-27"', "d.json": "[1]", "h.json:a:b": '"é"', "h.json:a2": "null"}


def test_reach_in_a_dense_graph(spark):
    """Every node of a layer depends on every node of the layer before, and back: walked paths would be 30 ** 8."""
    edges = [(f"n{d + 1}.{i}", f"n{d}.{j}") for d in range(9) for i in range(30) for j in range(30)]
    edges += [(t, s) for s, t in edges]
    df = spark.createDataFrame(edges, "source string, target string")
    got = {r.id: (r.distance, r.reach) for r in graph.blast_radius(df, spark.createDataFrame([("n0.0",), ("gone",)], "id string"), 8).collect()}
    assert len(got) == 8 * 30 + 29 and got["n8.3"] == (8, "transitive") and got["n1.0"] == (1, "direct") and got["n0.5"] == (2, "one_hop") and "n0.0" not in got
    assert graph.blast_radius(df, spark.createDataFrame([], "id string")).count() == 0


def events(spark, rows, folder):
    """A batch for each list of rows."""
    kind = "run_id int, event_id int, stage string, status string, ts timestamp"
    at = dt.datetime(2024, 1, 1)
    for k, part in enumerate(rows):
        spark.createDataFrame([(r, i, s, status, at + dt.timedelta(minutes=m)) for r, i, s, status, m in part], kind).coalesce(1).write.parquet(f"file://{folder}/{k}")
    return spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def test_pairing_does_not_depend_on_the_batches(spark, tmp_path):
    late = [(1, 3, "a", "completed", 30), (1, 5, "a", "failed", 50), (2, 9, "a", "completed", 5)]
    early = [(1, 4, "a", "running", 40), (1, 2, "a", "running", 10), (1, 6, "b", "completed", 60), (2, 8, "a", "queued", 1)]
    out = progress.into_table(progress.stage_event_stream(events(spark, [late, early, [(0, 0, "end", "queued", 9_000)]], tmp_path), "2 hours"))
    got = {(r.run_id, r.event_id): r.duration_ms for r in out.collect()}
    assert got == {(1, 3): 20 * 60_000, (1, 5): 10 * 60_000, (1, 6): None, (2, 9): None}


def test_a_start_that_is_too_old_is_forgotten(spark, tmp_path):
    parts = [[(1, 1, "a", "running", 0)], [(3, 7, "x", "queued", 10_000)], [(1, 2, "a", "completed", 11_000)], [(0, 0, "end", "queued", 90_000)]]
    kept = progress.into_table(progress.stage_event_stream(events(spark, parts, tmp_path / "a"), "1 hour", "30 days"))
    gone = progress.into_table(progress.stage_event_stream(events(spark, parts, tmp_path / "b"), "1 hour", "1 day"))
    assert [r.duration_ms for r in kept.collect()] == [11_000 * 60_000] and [r.duration_ms for r in gone.collect()] == [None]


def test_sessions_and_progress_of_shuffled_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k % 3, k, "s", rng.choice(["running", "completed"]), m) for k, m in enumerate(rng.sample(range(2_000), 60))]
    stream = events(spark, [rows[k::4] for k in range(4)] + [[(0, 999, "end", "queued", 90_000)]], tmp_path)
    batch = spark.read.parquet(*[f"file://{tmp_path}/{k}" for k in range(4)])
    key = lambda df: sorted(tuple(r) for r in df.collect() if r[1] != "end" and getattr(r, "start", None) != dt.datetime(2024, 1, 1) + dt.timedelta(minutes=90_000))
    assert key(progress.into_table(progress.activity_sessions(stream, late="40 days"))) == key(progress.activity_sessions(batch))
    last = {r.run_id: r for r in progress.into_table(progress.run_progress_stream(stream, "40 days"), ["run_id"]).collect()}
    want = {r.run_id: r for r in progress.run_progress(batch).collect()}
    assert {k: (r.stage, r.status, r.events) for k, r in last.items() if k} == {k: (r.stage, r.status, r.events) for k, r in want.items() if k} and last[0].events == want[0].events + 1
    assert batch.agg(F.count("*")).first()[0] == 60
