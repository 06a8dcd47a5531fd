"""Cases in which an operator once did less than the whole job."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from acceptlake.llm import decontamination, nn_descent, secret_forest


def test_secrets_assigned_without_blanks(spark):
    texts = [
        "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzKEY",
        "password=hunter2correct",
        'DB_PASSWORD="p@ss;w0rd!",',
        "pwd=a1",
        '{"api_key":"k1","secret":"z9"}',
        "set password = hunter2; now",
        "plain words, then padding: abcdefghijklmnop12==",
        "password == hunter2",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.id, r.value) for r in secret_forest.candidates(docs, "doc_id", "text", F.lit(None).cast("string")).collect()}
    assert found == {(0, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzKEY"), (1, "hunter2correct"), (2, "p@ss;w0rd!"), (3, "a1"), (4, "k1"), (4, "z9"), (5, "hunter2"), (6, "abcdefghijklmnop12==")}


def test_benchmark_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five six"), (3, "clean text here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (None, "four five six"), (7, "seven eight nine")], "item_id long, text string")
    for most in (500_000, 1):
        found = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, 3, max_broadcast=most).collect()}
        assert [(len(found[k].hit_spans), found[k].hit_items) for k in (1, 2, 3)] == [(1, []), (1, []), (0, [])]
        assert [r.doc_id for r in decontamination.decontaminate(docs, bench, 3, action="drop_documents", max_broadcast=most).collect()] == [3]


def test_pipeline_keeps_one_row_a_component(spark):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcde")
    rows = [(3, b), (7, a), (7, b + " end"), (8, c), (8, d), (None, e), (None, e), (None, e + " end"), (None, c)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert {(3, b), (7, a), (8, c), (8, d)} <= set(kept) and len(kept) == 5
    assert [t for k, t in kept if k is None][0] in (e, e + " end")


def test_neighbours_are_searched_until_none_is_open(spark, monkeypatch):
    for name, value in (("KEPT", 6), ("EXPANDED", 2), ("ENTRIES", 1)):
        monkeypatch.setattr(nn_descent, name, value)
    n = 40  # a chain on a half circle: a hop comes a step or two nearer to the query
    rows = [(i, [math.cos(math.pi * i / n), math.sin(math.pi * i / n)]) for i in range(n)]
    nodes = spark.createDataFrame(rows, "id long, v array<double>")
    chain = nn_descent._Edges(np.arange(n - 1), np.zeros(n - 1, np.int32), np.arange(1, n), np.ones(n - 1, np.float32), np.ones(n - 1, bool)).lists()
    chain = spark.createDataFrame(pa.Table.from_batches([chain]))
    entry = nodes.orderBy(F.xxhash64("id"), "id").first().id
    target = entry + 11 if entry + 11 < n else entry - 11
    query = spark.createDataFrame([(-1, rows[target][1])], "id long, v array<double>")
    assert nn_descent.search(query, nodes, chain, 1, 1).first().vec_id == target
