"""Near duplicates by SimHash: fingerprints are partitioned by vantage-point trees and compared exactly in overlapping shards.

A fingerprint bit is set if it is set in over half the XXH64 hashes (seed 42) of a text's shingles; fingerprints link at few differing bits.
Equal fingerprints are one class, so copies cost nothing. The bits are cut into pieces so that linked fingerprints differ by at most
one bit in one of them. For each piece a vantage-point tree is fitted on a bounded sample: a node holds a vantage point and a distance,
near rows go to one side and far rows to the other. A fingerprint is at home in one leaf, and is a guest of every leaf that the triangle
bound does not rule out: where its distance is within the radius of a node's boundary, of both sides. Leaves are the shards; a full one is cut
into blocks, and its guests into chunks, so a task holds a bounded number of each. In the task the tree is carried on (by the distance over all
bits where a piece can't be split any more) down to small leaves, where all pairs are compared exactly. A task gives a spanning forest
of the links that it finds, and components of these are joined by Spark.

Null and empty texts have no shingle: their fingerprint is zero, and they link like any other. A text of fewer words than a shingle is one shingle.
Rows without an id link too; component_id is the smallest id that is reached, null if no row there has one. Rows that repeat an id or a
text are rows of their own, and ties don't arise. Very long texts are handled in a slice of their own. An empty table gives an empty result; other
columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Words, mix, slices, staged, unstage
from .ngram_join import components

#: Fingerprints of a block, guests of a chunk, leaves of a tree, fingerprints of the sample that it is fitted on, rows of a leaf in a task.
BLOCK, CHUNK, MAX_LEAVES, SAMPLE, SMALL = 8192, 65_536, 1 << 16, 1 << 20, 64
#: Shingles whose bits are counted at once; pairs that a task holds before it cuts them to a forest.
COUNTED, HELD = 1 << 16, 1 << 20
_U = np.uint64
_ALL = _U((1 << 64) - 1)


def fingerprints(texts: pa.Array, n: int) -> np.ndarray:
    """64-bit fingerprint of each text (null: none)."""
    w = Words(texts, SPACE_WORDS, lower=True)
    length = w.end - w.start
    at = np.cumsum(length + 1) - (length + 1)  # where the words stand when one space parts them
    joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[at + length] = False
    joined[inside] = w.data[SPACE_WORDS[w.data]]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    first = np.flatnonzero(w.doc[: max(0, len(w.doc) - n + 1)] == w.doc[n - 1 :])
    last = np.concatenate([first + n - 1, w.first[short + 1] - 1])
    doc = np.concatenate([w.doc[first], short])
    start, end = at[np.concatenate([first, w.first[short]])], at[last] + length[last]
    order = np.argsort(doc, kind="stable")
    doc, start, end, raw, digest = doc[order], start[order], end[order], joined.tobytes(), xxhash.xxh64_intdigest
    counts = np.zeros((len(texts), 64), np.int64)
    for a in range(0, len(doc), COUNTED):
        some = slice(a, a + COUNTED)
        h = np.fromiter((digest(raw[s:e], 42) for s, e in zip(start[some].tolist(), end[some].tolist(), strict=True)), _U, len(doc[some]))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, head = np.unique(doc[some], return_index=True)
        counts[own] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    over = 2 * counts > np.bincount(doc, minlength=len(texts))[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def _fingerprinted(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), n).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, "id long, fp long")


def pieces(bits: int) -> list[np.uint64]:
    """Masks of pieces of the 64 bits: where at most `bits` bits differ, at most one differs in some piece."""
    n = bits // 2 + 1
    return [_U(sum(1 << j for j in range(64 * k // n, 64 * (k + 1) // n))) for k in range(n)]


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int16)


def _split(rows: np.ndarray, metrics: list[tuple[np.uint64, int]]) -> tuple[np.uint64, np.uint64, int, int] | None:
    """Vantage point, mask, radius and greatest distance of the inner side, in the first metric that tells some of the rows apart.

    Of a few candidates for the vantage point, that from which the distances are spread most.
    """
    some = rows[np.linspace(0, len(rows) - 1, min(8, len(rows))).astype(int)]
    for mask, radius in metrics:
        d = distance(some[:, None], rows[None, :], mask)
        k = int(d.std(axis=1).argmax())
        cut = int(np.median(d[k]))
        cut = cut if (d[k] > cut).any() else cut - 1
        if (d[k] <= cut).any() and (d[k] > cut).any():
            return some[k], mask, radius, cut
    return None


class Tree:
    """A vantage-point tree as arrays: a node's children are nodes, or leaf k as -1 - k."""

    def __init__(self, sample: np.ndarray, rows: int, metrics: list[tuple[np.uint64, int]]):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self.root = self._grown(sample, max(BLOCK * max(1, len(sample)) / max(1, rows), len(sample) / MAX_LEAVES, 1), metrics)
        vantage, mask, radius, cut, inner, outer = zip(*self.nodes, strict=True) if self.nodes else ((),) * 6
        self.vantage, self.mask = np.array(vantage, _U), np.array(mask, _U)
        self.radius, self.cut = np.array(radius, np.int16), np.array(cut, np.int16)
        self.inner, self.outer = np.array(inner, np.int64), np.array(outer, np.int64)

    def _grown(self, sample: np.ndarray, enough: float, metrics: list[tuple[np.uint64, int]]) -> int:
        if len(sample) <= enough or (split := _split(sample, metrics)) is None:
            self.leaves += 1
            return -self.leaves
        vantage, mask, _, cut = split
        k, near = len(self.nodes), distance(sample, vantage, mask) <= cut
        self.nodes.append(())
        self.nodes[k] = (*split, self._grown(sample[near], enough, metrics), self._grown(sample[~near], enough, metrics))
        return k

    def leaves_of(self, fp: np.ndarray, guests: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in fp, leaf): each one's home, or every leaf that may hold a fingerprint that links with it."""
        item, node, found = np.arange(len(fp)), np.full(len(fp), self.root), []
        while True:
            leaf = node < 0
            found.append((item[leaf], -1 - node[leaf]))
            item, node = item[~leaf], node[~leaf]
            if not len(item):
                return tuple(np.concatenate(x) for x in zip(*found, strict=True))
            d, cut, slack = distance(fp[item], self.vantage[node], self.mask[node]), self.cut[node], self.radius[node] * guests
            near, far = d - slack <= cut, d + slack > cut
            item, node = np.concatenate([item[near], item[far]]), np.concatenate([self.inner[node[near]], self.outer[node[far]]])


class _Forest:
    """Spanning forest of the links that a task finds."""

    def __init__(self) -> None:
        self.x, self.y, self.size = [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x.append(x)
        self.y.append(y)
        self.size += len(x)
        if self.size > HELD:
            x, y = self.edges()
            self.x, self.y, self.size = [x], [y], 0

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node but the least of its tree, with that least."""
        if not self.x:
            return np.zeros(0, _U), np.zeros(0, _U)
        nodes, place = np.unique(np.concatenate(self.x + self.y), return_inverse=True)
        a, b = np.split(place, 2)
        label = np.arange(len(nodes))
        while True:
            low, before = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if (label == before).all() and (label[a] == label[b]).all():
                rest = np.flatnonzero(label != np.arange(len(nodes)))
                return nodes[rest], nodes[label[rest]]


def linked(rows: np.ndarray, guests: np.ndarray, metrics: list[tuple[np.uint64, int]], bits: int, forest: _Forest) -> None:
    """Adds the links between rows and guests: a vantage-point tree down to small leaves, all pairs there."""
    if not len(rows) or not len(guests):
        return
    if len(rows) > SMALL and (split := _split(rows, metrics)) is not None:
        vantage, mask, radius, cut = split
        near, d = distance(rows, vantage, mask) <= cut, distance(guests, vantage, mask)
        linked(rows[near], guests[d - radius <= cut], metrics, bits, forest)
        linked(rows[~near], guests[d + radius > cut], metrics, bits, forest)
        return
    step = max(1, HELD // len(rows))
    for a in range(0, len(guests), step):
        some = guests[a : a + step]
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ some[None, :]) <= bits)
        i, j = i[(other := rows[i] != some[j])], j[other]
        if len(i):
            forest.add(rows[i], some[j])


def links(classes: DataFrame, bits: int) -> DataFrame:
    """(x, y): links of fingerprints (fp, each once), as many as join the components."""
    n = classes.count()
    wanted = min(SAMPLE, max(BLOCK, 32 * n // BLOCK))
    sample = classes.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(max(1, n // wanted))) == 0).limit(SAMPLE)
    drawn = np.sort(np.array([r.fp for r in sample.collect()], np.int64).view(_U))
    drawn = drawn[np.argsort(mix(drawn))]  # in no order, so that any few are spread
    masks = pieces(bits)
    metrics = [[(m, bits // len(masks)), (_ALL, bits)] for m in masks]
    trees = classes.sparkSession.sparkContext.broadcast([Tree(drawn, n, m) for m in metrics])  # at most MAX_LEAVES nodes each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(_U)
            for k, tree in enumerate(trees.value):
                for guest in (False, True):
                    item, leaf = tree.leaves_of(fp, guest)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), k, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(np.full(len(item), guest)), pa.array(fp[item].view(np.int64))], ["tree", "leaf", "guest", "fp"])

    placed = classes.select("fp").mapInArrow(place, "tree int, leaf int, guest boolean, fp long")
    many = placed.groupBy("tree", "leaf").agg(F.ceil(F.count_if(~F.col("guest")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("guest") / CHUNK).cast("int").alias("chunks"))
    many = staged(many, "leaves")  # a row for each leaf
    own, all_ = F.pmod(F.xxhash64("fp", F.lit(2)), F.when(F.col("guest"), F.col("chunks")).otherwise(F.col("blocks"))).cast("int"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = placed.join(F.broadcast(many), ["tree", "leaf"]).where("blocks > 0 and chunks > 0")  # at most MAX_LEAVES rows a tree
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("guest"), all_("blocks")).otherwise(all_("chunks"))))
    dealt = dealt.select("tree", "leaf", F.when(F.col("guest"), F.col("other")).otherwise(F.col("own")).alias("block"), F.when(F.col("guest"), F.col("own")).otherwise(F.col("other")).alias("chunk"), "guest", "fp")

    def compare(table: pa.Table) -> pa.Table:
        guest, fp, forest = table["guest"].to_numpy(), table["fp"].to_numpy().view(_U), _Forest()
        linked(fp[~guest], fp[guest], metrics[table["tree"][0].as_py()], bits, forest)
        return pa.table([pa.array(c.view(np.int64)) for c in forest.edges()], ["x", "y"])

    found = staged(dealt.groupBy("tree", "leaf", "block", "chunk").applyInArrow(compare, "x long, y long"), "links")
    unstage(many)
    return found


def simhash_components(docs: DataFrame, n: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, the fingerprint in hexadecimal digits, and component_id, the smallest id that links of at most
    `bits` differing bits reach from it, its own included."""
    rows = staged(_fingerprinted(docs, n, id_col, text_col), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = links(classes, bits)
    parts = components(found)
    unstage(found)
    named = parts.join(classes.hint("merge"), F.col("node") == F.col("fp"))
    least = named.groupBy("component").agg(F.min("least").alias("of_component"))
    named = named.join(least, "component").select("node", "of_component")
    final = classes.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("k"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("of_component")).alias("component_id"))
    final = staged(final, "final")  # a join of two plain tables, of which Spark can split a full class
    unstage(classes, parts)
    out = rows.join(final.hint("merge"), F.col("fp") == F.col("k"), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op13_simhash": op13_simhash}
#: No SQL: DuckDB has no XXH64 with a seed; a test holds the rows against brute force.
SQL: dict[str, str] = {}
