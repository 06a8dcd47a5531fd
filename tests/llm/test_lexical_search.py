"""Ranked lexical search against the SQL, brute force and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from acceptlake.llm import lexical_search
from acceptlake.llm.common import ALNUM_WORDS, Words

from .. import oracle

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_sql(spark):
    oracle.compare(spark, oracle.connect(SF), lexical_search.op12_lexical_search, lexical_search.ORACLE, SF)


def brute(docs, items, k):
    texts = [(i, Counter(x.translate(LOW) for x in WORD.findall(t or ""))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    holding = Counter(w for _, c in texts for w in c)
    out = []
    for item, text in items:
        words = {x.translate(LOW) for x in WORD.findall(text or "")}
        scored = []
        for i, c in texts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "x9"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(rng.choice([k, k, None, 7]), " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200])))) for k in range(150)]
    docs += [(k, "w1, W2; w3") for k in (500, 501, 502, 499, 498)]  # ties
    docs += [(600, None), (601, ""), (602, " ,.;-"), (603, "w5 " * 50_000), (604, "É é")]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 6, 30])))) for k in range(12)]
    items += [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (None, "W4-w4"), (20, None), (21, ""), (22, "nowhere"), (23, "...")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("ROUND_WORDS", 20), ("SEGMENT_DOCS", 9), ("DEPTH", 1)):
            monkeypatch.setattr(lexical_search, name, value)
        monkeypatch.setattr("acceptlake.llm.common.SLICE_BYTES", 2000)
    docs, items = corpus()
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, score int, `a.b` string, row int").repartition(3)
    queries = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    for k in (1, 5, 50):
        got = Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(table, queries, k).collect())
        assert got == brute(docs, items, k)
    assert lexical_search.search(table.limit(0), queries).count() == 0
    assert lexical_search.search(table, queries.limit(0)).count() == 0


def test_words_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr("acceptlake.llm.common.span_hashes", lambda data, start, end: (end - start).astype(np.uint64) * 0 + np.uint64(5))
    known = lexical_search.Vocabulary([b"ab"])
    at, number = known.of(Words(pa.array(["ab cd ab abc"]), ALNUM_WORDS, lower=True))
    assert at.tolist() == [0, 2] and number.tolist() == [0, 0]
