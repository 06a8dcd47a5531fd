"""Mixing and sharding, as operators and as the pipeline's stages, against plain versions of their rules."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acceptlake.llm import mixing, sharding

SF = "/root/testdata/sf0.001"


def times_of(rows, cycle=(3, 1, 2), share=1.5, cap=2.0):
    """rows (id, text, source) -> Counter of (id, how often the mix takes it)."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[k] for k, _, x in rows if x == s) for s in sources}
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}
    target, open_, total = {}, set(sources), share * sum(own.values())
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * own[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * own[s] for s in full}
        open_ -= full
    out = []
    for s in sources:
        epochs = int(target[s] // own[s]) if own[s] else 0
        rest, keyed, upto = target[s] - epochs * own[s], [], 0
        for k, t, x in rows:
            if x == s:
                mean = len((t or "").encode()) / size[k] if size[k] else 0
                quality = 1.0 if not size[k] else 2.0 if 3 <= mean <= 12 else 0.5
                u = (int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                keyed.append((-math.log(u) / quality, k))
        for _, k in sorted(keyed):
            upto += size[k]
            out.append((k, epochs + (rest > 0 and upto - size[k] / 2 <= rest)))
    return Counter(dict(out))


def shards_of(rows, n, whole=sharding.WHOLE_GROUP):
    """rows (key, id, text hash, size) -> Counter of (id, shard, slot) by the law "bytes"."""
    rows, total, upto, cut = sorted(rows), sum(r[3] for r in rows), 0, []
    for r in rows:
        upto += r[3]
        cut.append(min(n - 1, int((upto - r[3] / 2) * n // total)))
    groups = defaultdict(list)
    for r, c in zip(rows, cut, strict=True):
        groups[r[2]].append((c, r[3]))
    low = {t: min(c for c, _ in g) for t, g in groups.items() if len({c for c, _ in g}) > 1 and sum(s for _, s in g) <= whole * total / n}
    seen, out = Counter(), []
    for r, c in zip(rows, cut, strict=True):
        c = low.get(r[2], c)
        out.append((r[1], c, seen[c]))
        seen[c] += 1
    return Counter(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_mixing_stage(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = times_of(rows)
    assert {r.doc_id: r.times for r in mixing.mix(docs).collect()} == dict(want)
    out = Counter(r.doc_id for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF).collect())
    assert out == +want and max(out.values()) == 2 and len(set(want.values())) == 3


@pytest.mark.parametrize("copies", [1, 40])
def test_sharding_stage(spark, docs, copies):
    """With forty copies of each document, groups of copies stand on the borders of shards."""
    docs = docs.select("doc_id", "text").limit(200).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("doc_id", F.col("doc_id") * 100 + F.col("copy"))
    rows = [(r.key, r.id, r.text, r.size) for r in sharding._keyed(docs, "doc_id", "text").collect()]
    for n in (3, corpus_pipeline.SHARDS):
        want = shards_of(rows, n)
        assert Counter((str(r.doc_id), r.shard, r.slot) for r in sharding.shard(docs, n).collect()) == want
    out = dict(corpus_pipeline.STAGES)["sharding"](spark, docs, SF).collect()
    assert Counter((str(r.doc_id), r.shard, r.slot) for r in out) == want
    sizes = Counter()
    for r in sharding.shard(docs).collect():
        sizes[r.shard] += r.size
    if copies > 1:
        assert max(sizes.values()) <= 1.1 * min(sizes.values()) + 2 * max(r[3] for r in rows)
