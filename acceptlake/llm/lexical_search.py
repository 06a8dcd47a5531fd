"""Ranked lexical search by NRA: impact-sorted lists are read in order, each document's score held between bounds, until all is resolved.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. One reading of the documents keeps the counts of
query words in segments (a slice of the documents each), with the corpus counts beside them: documents, words, and documents that
hold a query word. A search takes the segments one by one. In a segment each query word has a list of its documents by falling impact; the lists of
an item's words are read to growing depth, side by side and with no other access. A document's score is at least the sum of the impacts read, and at
most that and the impacts next in the lists where it wasn't met. Reading goes on until no unread document and none outside the first k can
reach them, and the bounds of all that can have met; ties go by id. The k-th best score so far stops later segments early: first within
a task, then from a first part of the segments for all the others.

The words of the items are broadcast in rounds of a bounded number of words and bytes (one longer item is a round of its own). Every word of a document that is
counted has been compared with the query word byte by byte.

Null and empty texts have no word and are found by nothing; an item without words finds nothing. Items are told apart by their row, so those
that repeat an id or have none each have their ranks. Documents that repeat an id are documents of their own; one without an id comes last among
equal scores. Very long texts are counted whole, in a slice of their own. An empty table of either kind gives an empty result; other columns
aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Words, slices, staged, unstage

#: Words, and bytes of words, of the items of a round; bytes of text and documents of a segment; of so many segments one goes first.
ROUND_WORDS, ROUND_BYTES, SEGMENT_BYTES, SEGMENT_DOCS, FIRST = 500_000, 32 << 20, 8 << 20, 65_536, 16
#: Depth to which the lists are read first; it doubles.
DEPTH = 64
_NULL_ID = np.int64((1 << 63) - 1)


def items_of(queries: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, item) of all items, and (row, words: each once, bytes) of those that have a word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = Words(part.column(1), ALNUM_WORDS, lower=True)
            words = [sorted({w.bytes_of(i, i + 1) for i in range(a, b)}) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.binary())), pa.array([sum(map(len, x)) for x in words], pa.int64())], ["row", "words", "bytes"])

    rows = staged(queries.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(text_col).alias("text")), "items")
    words = rows.select("row", "text").mapInArrow(scan, "row long, words array<binary>, bytes long").where("size(words) > 0")
    names, words = staged(rows.select("row", "item"), "item-names"), staged(words, "item-words")
    unstage(rows)
    return names, words


class Vocabulary:
    """Query words by number; found in a slice of texts by hash, then by their bytes."""

    def __init__(self, words: list[bytes]):
        self.words = words
        w = Words(pa.array([x.decode("utf-8", "surrogateescape") for x in words], pa.string()), ALNUM_WORDS, lower=True)
        order = np.argsort(w.hash, kind="stable")
        self.hash, self.number = w.hash[order], order
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the texts, number of the query word that it is)."""
        at = np.flatnonzero(self.seen[(w.hash & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hash, w.hash[at]), len(self.hash) - 1)
        at, number = (hit := at[self.hash[place] == w.hash[at]]), self.number[np.searchsorted(self.hash, w.hash[hit])]
        same, order = np.zeros(len(at), bool), np.argsort(number, kind="stable")
        bounds = np.flatnonzero(np.diff(number[order], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            word = np.frombuffer(self.words[number[order[a]]], np.uint8)
            some = order[a:b]
            some = some[w.end[at[some]] - w.start[at[some]] == len(word)]
            same[some] = (w.data[w.start[at[some]][:, None] + np.arange(len(word))] == word).all(axis=1)
        return at[same], number[same]


def indexed(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """segments (segment, docs, lengths, word, doc, times: packed) and counts (word, documents; word -1: all documents, -2: all their words)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary.value)
        held: list[tuple] = []
        size = docs = 0

        def out() -> pa.RecordBatch:
            ids, lengths, word, doc, times = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(word, kind="stable")
            arrays = [ids, lengths, word[order].astype(np.int32), doc[order].astype(np.int32), times[order]]
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["docs", "lengths", "word", "doc", "times"])

        for part in slices(batches, "text"):
            w = Words(part.column(1), ALNUM_WORDS, lower=True)
            own = np.flatnonzero(w.count > 0)
            at, number = known.of(w)
            key, times = np.unique(number * np.int64(part.num_rows) + w.doc[at], return_counts=True)
            place = np.zeros(part.num_rows, np.int64)
            place[own] = docs + np.arange(len(own))
            ids = part.column(0).fill_null(int(_NULL_ID)).to_numpy()[own]
            held.append((ids, w.count[own].astype(np.int64), key // part.num_rows, place[key % part.num_rows], times.astype(np.int64)))
            size, docs = size + len(w.data), docs + len(own)
            if size >= SEGMENT_BYTES or docs >= SEGMENT_DOCS:
                yield out()
                held, size, docs = [], 0, 0
        if docs:
            yield out()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = texts.mapInArrow(scan, "docs binary, lengths binary, word binary, doc binary, times binary")
    segments = staged(made.withColumn("segment", F.monotonically_increasing_id()), "segments")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value) + 2, np.int64)
        for b in batches:
            for lengths, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[:-2] += np.bincount(np.frombuffer(word, np.int32), minlength=len(total) - 2)
                total[-1] += len(lengths) // 8
                total[-2] += np.frombuffer(lengths, np.int64).sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < len(total) - 2, some, some - len(total))), pa.array(total[some])], ["word", "n"])

    return segments, segments.select("lengths", "word").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class Segment:
    """Lists of a segment by query word: documents by falling impact."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_words: int):
        self.ids, lengths, word, doc, times = (np.frombuffer(row[c], k) for c, k in (("docs", np.int64), ("lengths", np.int64), ("word", np.int32), ("doc", np.int32), ("times", np.int64)))
        m = 100 - 50 + (50 * lengths * n_docs) // n_words
        impact = weights[word] * ((1_000_000_000 * times) // (1000 * times + 20 * m[doc]))
        order = np.lexsort((-impact, word))
        word, self.doc, self.impact = word[order], doc[order], impact[order]
        self.start = np.searchsorted(word, np.arange(len(weights) + 1))

    def first(self, words: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best for these words, all with score `least` or more. Sequential reads only; scores are exact."""
        a, b = self.start[words], self.start[words + 1]
        a, size = a[b > a], (b - a)[b > a]
        if not len(a) or int(self.impact[a].sum()) < least:  # the best first entries together
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(a)), size)
        depth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        at = a[of] + depth
        by_depth = np.argsort(depth, kind="stable")
        of, depth, doc, impact = of[by_depth], depth[by_depth], self.doc[at[by_depth]], self.impact[at[by_depth]]
        low, alive, read, upto, closed = np.zeros(len(self.ids), np.int64), np.ones(len(self.ids), bool), 0, DEPTH, False
        while True:
            end = int(np.searchsorted(depth, upto))
            np.add.at(low, doc[read:end], impact[read:end])
            read = end
            following = np.where(size > upto, self.impact[np.minimum(a + upto, a + size - 1)], 0)  # what each list has next
            rest = int(following.sum())
            met = np.bincount(doc[:read], weights=following[of[:read]].astype(np.float64), minlength=len(low)).astype(np.int64)
            high = low + rest - met
            best = max(least, int(np.partition(low, -k)[-k]) if len(low) >= k else 0, 1)
            can = alive & (high >= best) & (low > 0)
            if rest < best and (low[can] == high[can]).all():
                docs = np.flatnonzero(can)
                order = np.lexsort((self.ids[docs], -low[docs]))[:k]
                return docs[order], low[docs[order]]
            if rest < best and not closed:  # no document that isn't met yet can come in: only entries of those that can are read on
                alive, stay, closed = can, can[doc], True
                read = int(stay[:read].sum())
                of, depth, doc, impact = of[stay], depth[stay], doc[stay], impact[stay]
            upto *= 2


def _searched(segments: DataFrame, shared, k: int) -> DataFrame:
    """row, doc_id, score: the k best of each item in the segments of a task, none below what `shared` has as the item's least."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_words, least = shared.value
        least, best = dict(least), {}
        for b in batches:
            for row in b.to_pylist():
                segment = Segment(row, weights, n_docs, n_words)
                for item, words in items:
                    docs, score = segment.first(words, k, least.get(item, 1))
                    if len(docs):
                        have = best.get(item)
                        ids = segment.ids[docs] if have is None else np.concatenate([have[0], segment.ids[docs]])
                        score = score if have is None else np.concatenate([have[1], score])
                        order = np.lexsort((ids, -score))[:k]
                        best[item] = ids[order], score[order]
                        if len(order) == k:
                            least[item] = max(least.get(item, 1), int(score[order[-1]]))
        for item, (ids, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int64)), pa.array(ids, mask=ids == _NULL_ID), pa.array(score)], ["row", "doc_id", "score"])

    return segments.mapInArrow(scan, "row long, doc_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_col, rank (from 1), doc_id, score: for each item its k best documents with a score above 0."""
    spark = docs.sparkSession
    names, words = items_of(queries, item_col, item_text_col)
    total = words.agg(F.sum(F.size("words")), F.sum("bytes")).first()
    rounds = max(1, -(-(total[0] or 0) // ROUND_WORDS), -(-(total[1] or 0) // ROUND_BYTES))
    found = None
    for r in range(rounds):
        chosen = [(x.row, [bytes(w) for w in x.words]) for x in words.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).toLocalIterator()]
        vocabulary = sorted({w for _, own in chosen for w in own})
        if not vocabulary and rounds > 1:
            continue
        number = {w: i for i, w in enumerate(vocabulary)}
        segments, counts = indexed(docs, spark.sparkContext.broadcast(vocabulary or [b"-"]), id_col, text_col)
        n = {x.word: x.n for x in counts.collect()}  # two rows and one for each query word of the round
        weights = np.array([weight(n.get(-1, 0), n.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        items = [(row, np.array([number[w] for w in own], np.int64)) for row, own in chosen]
        part = F.pmod(F.xxhash64("segment"), F.lit(FIRST))
        share = lambda least: spark.sparkContext.broadcast((items, weights, n.get(-1, 0), max(1, n.get(-2, 0)), least))
        first = staged(_first(_searched(segments.where(part == 0), share({}), k), k), "first")
        kth = {x.row: x.score for x in first.where(F.col("rank") == k).select("row", "score").toLocalIterator()}  # a number for each item of the round
        rest = _searched(segments.where(part != 0), share(kth), k)
        ranked = staged(_first(first.drop("rank").unionByName(rest), k), "ranked")
        unstage(segments, first)
        found = ranked if found is None else found.unionByName(ranked)
    unstage(words)
    out = found.join(names.withColumnRenamed("row", "of"), F.col("row") == F.col("of"))
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS w FROM benchmark),
t AS (SELECT r, w, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT d.r, d.doc_id, 100 - 50 + ((50 * CAST(len(d.w) AS BIGINT) * n_docs) // n_words) AS m FROM d, s WHERE len(d.w) > 0),
score AS (SELECT i.q, i.item_id, p.r, p.doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
          FROM i JOIN t ON t.w = i.w JOIN f ON f.w = i.w JOIN p ON p.r = t.r, s GROUP BY i.q, i.item_id, p.r, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 50
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
SQL = {"op12_lexical_search": ORACLE}
