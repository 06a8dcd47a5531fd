"""SimHash near duplicates against brute force and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from acceptlake.llm import simhash

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components_of(rows, bits=4):
    """rows (id, fingerprint) -> Counter of (id, hex, component)."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, f in rows:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return Counter((k, f"{f:016x}", least.get(find(f))) for k, f in rows)


def near_copies():
    rng, rows = random.Random(5), []
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 60, 400]))]
        for _ in range(rng.choice([1, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.choice([len(rows), len(rows), None, k]), " ".join(copy)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (None, "one"), (903, "One  TWO\tthree"), (904, "one two three"), (905, "w " * 30_000), (905, "w " * 30_000), (906, "été À x y z")]


def test_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    out = simhash.op13_simhash(spark, SF)
    assert Counter(tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()) == components_of(rows)


@pytest.mark.parametrize("block,chunk,small,held", [(8192, 65_536, 64, 1 << 20), (7, 11, 2, 5)])
def test_copies_and_edges(spark, monkeypatch, block, chunk, small, held):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "HELD", held)
    rows = near_copies()
    docs = spark.createDataFrame([(*r, 1, "x", 2, True) for r in rows], "doc_id long, text string, fp int, `a.b` string, component_id int, guest boolean")
    want = components_of([(k, fingerprint(t)) for k, t in rows])
    assert len({c for _, _, c in want}) < len(want)
    assert Counter(map(tuple, simhash.simhash_components(docs).collect())) == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_crowded_fingerprints(monkeypatch):
    """Trees and forests find every link of fingerprints in a ball, on a chain and at random, with the bounds tight."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "HELD", 50)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, 7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    fps |= {(1 << k) - 1 for k in range(0, 65, 3)}
    fps = np.array(sorted(fps), np.uint64)
    for bits in (0, 1, 3, 4, 7):
        masks = simhash.pieces(bits)
        forest = simhash._Forest()
        for m in masks:
            metrics = [(m, bits // len(masks)), (simhash._ALL, bits)]
            tree = simhash.Tree(fps[::3], len(fps), metrics)
            assert tree.leaves > 3
            (i, home), (j, leaf) = tree.leaves_of(fps, False), tree.leaves_of(fps, True)
            assert sorted(i.tolist()) == list(range(len(fps)))
            for k in range(tree.leaves):
                simhash.linked(fps[i[home == k]], fps[j[leaf == k]], metrics, bits, forest)
        x, y = forest.edges()
        found = dict(zip(x.tolist(), y.tolist(), strict=True))
        want = components_of(list(enumerate(fps.tolist())), bits)
        of = {int(h, 16): c for _, h, c in want}
        assert all(of[int(f)] == of[found.get(int(f), int(f))] for f in fps)
        assert len({found.get(int(f), int(f)) for f in fps}) == len(set(of.values()))


def test_fingerprints_of_long_texts():
    texts = [" ".join(str(i * k) for i in range(20_000)) for k in (1, 2)] + ["a b c", None]
    got = simhash.fingerprints(pa.array(texts), 4).tolist()
    assert got == [fingerprint(t) for t in texts]
