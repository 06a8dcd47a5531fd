"""Hard negatives against the SQL, brute force and edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acceptlake.llm import negative_mining

from .. import oracle

SF = "/root/testdata/sf0.001"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_sql(spark):
    oracle.compare(spark, oracle.connect(SF), negative_mining.op11_hard_negatives, negative_mining.ORACLE, SF)


def brute(rows, anchor, positives, negatives, window):
    """rows: (id, label, whole numbers), each id once."""
    out = []
    for a, label, v in rows:
        if not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a]
        best = sorted((-s, i) for s, i, other in scored if other == label)[:positives]
        for p, i in best:
            hard = sorted((-s, j) for s, j, other in scored if other != label and window[0] * -p <= 100 * s <= window[1] * -p)[:negatives]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(hard, 1)]
    return sorted(out)


def crowded():
    """Groups of equal and nearly equal vectors, with some far ones."""
    rng, rows = random.Random(4), []
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)] + [[0.0] * 6]
    for k in range(260):
        c = centres[0] if k % 3 == 0 else rng.choice(centres)
        noise = rng.choice([0, 0, 0.05, 1])
        rows.append((k, rng.randrange(3), [x + noise * rng.gauss(0, 1) for x in c]))
    rows[7] = (7, 1, [1e5, -1e5, 0.5, 0.0, 2.0, 1.0])
    return rows


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("window", [(80, 100), (-50, 130)])
def test_brute_force(spark, monkeypatch, small, window):
    if small:
        for name, value in (("BLOCK", 20), ("CHUNK", 4), ("LEAF", 5), ("FANOUT", 3), ("SAMPLE", 60)):
            monkeypatch.setattr(negative_mining, name, value)
    rows = crowded()
    odd = [(None, 1, [0.0] * 6), (300, None, [0.0] * 6), (310, 1, None), (320, 1, [0.0] * 5 + [None]), (330, 1, [0.0] * 5 + [math.nan]), (340, 1, [math.inf] + [0.0] * 5), (350, 1, [1.0]), (360, 1, [1e30] + [0.0] * 5)]
    repeated = [(10, -1, [0.0] * 6), (10, -1, [0.0] * 6)]
    table = spark.createDataFrame([(*r, 1, "x", 0) for r in rows + odd + repeated], "vec_id long, label int, embedding array<double>, leaf int, `a.b` string, anchor int")
    got = negative_mining.hard_negatives(table, F.col("id") % 10 == 0, 4, 3, window).collect()
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    want = brute(whole, lambda a: a % 10 == 0, 4, 3, window)
    assert sorted(tuple(r[n] for n in NAMES) for r in got) == want and len(want) > 100
    assert negative_mining.hard_negatives(table.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negative_mining.hard_negatives(table, F.col("id") < 0).count() == 0


def test_ranges_eliminate(monkeypatch):
    """In a tree over clusters an anchor with a narrow window meets few leaves, and none that holds a row of the window is left out."""
    rng = np.random.default_rng(2)
    v = np.rint(np.concatenate([rng.normal(c, 3, (200, 4)) for c in rng.normal(0, 200, (12, 4))]))
    space = negative_mining.Space(4, int(abs(v).max()), int((v * v).sum(1).max()))
    x = space.lengthened(v)
    monkeypatch.setattr(negative_mining, "BLOCK", 60)
    upper = negative_mining.Upper(x[::5], len(x), space)
    home = upper.homes(x, widen=True)
    at = np.arange(0, len(v), 50)
    score = (v[at] @ v.T).astype(np.int64)
    low = np.sort(score, axis=1)[:, -6]
    table = pa.table({"anchor": pa.array(at), "of": pa.array(at * 0), "a": pa.array([r.tobytes() for r in v[at].astype(space.kind)]), "low": [[s] for s in low.tolist()], "high": [[negative_mining.FAR]] * len(at)})
    anchor, leaf = upper.reached(negative_mining.Anchors(table, space, 5))
    reached = set(zip(anchor.tolist(), leaf.tolist(), strict=True))
    assert len(reached) < 0.5 * upper.leaves * len(at)
    for i, j in zip(*np.nonzero(score >= low[:, None]), strict=True):
        assert (int(i), int(home[j])) in reached
