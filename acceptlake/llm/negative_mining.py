"""Hard negatives by a GNAT: a multiway hyperplane tree with distance ranges between its split points and their siblings' subtrees.

Components become whole numbers, floor(scale * x), and scores are inner products of these in whole numbers. Vectors are lengthened by one
coordinate to the largest norm and anchors by zero, so that a window of scores is an annulus of distances round the anchor. A node of the tree has
several split points; a row belongs to the nearest, and for each two of them the node holds the least and greatest distance from the one
to the rows of the other. A subtree goes where an anchor's annulus, moved by its distance to some split point, misses that range.

The upper tree is fitted on a bounded sample, and its ranges are those of all rows. Its leaves are the shards, cut into blocks of a bounded number
of rows however the vectors crowd. An anchor is first compared with its own shard, where the k-th best score narrows its windows, then
with all shards that are not eliminated. A task holds a block of rows and a chunk of anchors, carries the tree on over its rows, and compares
scores exactly in the leaves. Positives are the best rows of the anchor's label; the windows of their scores are then
searched for the best rows of other labels.

Rows with a null id, label or vector, a null or non-finite component, a vector of another length than most, or a squared length (in whole
numbers) of 2**55 or more take no part. Rows that repeat an id count once (with the greatest label and vector). Ties go to the smaller id.
A positive with a negative score has no negatives. An empty table, or one without anchors, gives an empty result. The label is a whole number; other
columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, unstage

#: Split points of a node, rows of a block, anchors of a chunk, leaves of the upper tree, rows of the sample, rows of a leaf in a task, depth of a tree.
FANOUT, BLOCK, CHUNK, MAX_LEAVES, SAMPLE, LEAF, DEPTH = 8, 8192, 4096, 4096, 16_384, 256, 24
#: Scores that no whole number of the data reaches.
FAR = 1 << 61


def prepared(table: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label, v: the whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where("id is not null and label is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(F.least(F.greatest(x, F.lit(-1e9)), F.lit(1e9)) * scale)).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    rows = rows.where(norm < float(1 << 55))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (common.d if common else 0))
    return staged(rows.groupBy("id").agg(F.max(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "vectors")


class Space:
    """What holds for all vectors: their length, the type they are kept in, whether doubles hold all sums exactly, the largest squared norm."""

    def __init__(self, dims: int, most: int, square: int):
        self.dims, self.square = dims, float(square)
        self.kind = next((k for k in (np.int16, np.int32) if most <= np.iinfo(k).max), np.int64)
        self.exact = square < 1 << 52
        self.slack = 1e-6 * math.sqrt(max(1.0, self.square))

    def unpacked(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Matrix of packed vectors, of doubles where these are exact."""
        v = np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.dims)
        return v.astype(np.float64 if self.exact else np.int64)

    def lengthened(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        v = v.astype(np.float64)
        rest = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(0, self.square - (v * v).sum(1)))
        return np.hstack([v, rest[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


class Node:
    """Split points, ranges (low[i, j], high[i, j]: of the distances from point i to the rows under child j) and children: nodes or leaves."""

    def __init__(self, points: np.ndarray):
        self.points, self.kids = points, []
        self.low, self.high = np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)

    def widen(self, d: np.ndarray, own: np.ndarray) -> None:
        for j in np.unique(own).tolist():
            self.low[:, j] = np.minimum(self.low[:, j], d[own == j].min(0))
            self.high[:, j] = np.maximum(self.high[:, j], d[own == j].max(0))


def grown(x: np.ndarray, rows: np.ndarray, enough: float, slack: float, depth: int = 0) -> Node | np.ndarray:
    """Tree over these rows of x. A leaf is the numbers of its rows; more than enough only where they can't be told apart."""
    if len(rows) <= enough or depth == DEPTH:
        return rows
    some = x[rows[np.linspace(0, len(rows) - 1, min(len(rows), 4 * FANOUT)).astype(int)]]
    picked = [some[0]]
    while len(picked) < FANOUT:  # each next point is the farthest from those before
        d = distances(some, np.array(picked)).min(1)
        if d.max() <= slack:
            break
        picked.append(some[d.argmax()])
    if len(picked) == 1:
        d = distances(x[rows], some[:1])[:, 0]
        if d.max() <= slack:
            return rows
        picked.append(x[rows[d.argmax()]])
    node = Node(np.array(picked))
    d = distances(x[rows], node.points)
    own = d.argmin(1)
    node.widen(d, own)
    node.kids = [grown(x, rows[own == j], enough, slack, depth + 1) for j in range(len(picked))]
    return node


class Upper:
    """The upper tree: nodes in a list, leaves by number."""

    def __init__(self, x: np.ndarray, n: int, space: Space):
        enough = max(BLOCK * max(1, len(x)) / max(1, n), len(x) / MAX_LEAVES, 1)
        self.nodes: list[Node] = []
        self.leaves = 0
        self.space, self.root = space, self._listed(grown(x, np.arange(len(x)), enough, space.slack))

    def _listed(self, tree: Node | np.ndarray) -> Node | int:
        if not isinstance(tree, Node):
            self.leaves += 1
            return self.leaves - 1
        self.nodes.append(tree)
        tree.low[:], tree.high[:] = np.inf, -np.inf  # the sample's ranges; those of all rows follow
        tree.kids = [self._listed(k) for k in tree.kids]
        return tree

    def homes(self, x: np.ndarray, widen: bool = False) -> np.ndarray:
        """Leaf of each; with widen the ranges take them in."""
        home, todo = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, Node):
                home[rows] = node
            elif len(rows):
                d = distances(x[rows], node.points)
                own = d.argmin(1)
                if widen:
                    node.widen(d, own)
                todo += [(kid, rows[own == j]) for j, kid in enumerate(node.kids)]
        return home

    def reached(self, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) where no range eliminates the leaf."""
        found, todo = [], [(self.root, np.arange(len(anchors.label)))]
        while todo:
            node, some = todo.pop()
            if not isinstance(node, Node):
                found.append((some, np.full(len(some), node, np.int32)))
            elif len(some):
                d = distances(anchors.x[some], node.points)
                todo += [(kid, some[anchors.meets(some, d, node.low[:, j], node.high[:, j])]) for j, kid in enumerate(node.kids)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Anchors:
    """Anchors with windows of scores (one or more each), of which low rises to the k-th best score found."""

    def __init__(self, table: pa.Table | pa.RecordBatch, space: Space, k: int):
        self.id, self.label = table.column("anchor").to_numpy(), table.column("of").to_numpy()
        self.v, self.space, self.k = space.unpacked(table.column("a")), space, k
        self.x = space.lengthened(self.v, anchors=True)
        self.square = (self.x * self.x).sum(1) + space.square
        windows = [table.column(c).to_pylist() for c in ("low", "high")]
        slots = max((len(w) for w in windows[0]), default=1)
        self.low, self.high = (np.array([[*w, *[none] * (slots - len(w))] for w in side], np.int64).reshape(len(self.id), slots) for side, none in zip(windows, (FAR, -FAR), strict=True))
        self.best = tuple(np.zeros(0, np.int64) for _ in range(4))

    def meets(self, some: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an annulus of each meets the ranges (of one child) round all split points at these distances."""
        out = np.zeros(len(some), bool)
        for s in range(self.low.shape[1]):
            inner, outer = (np.sqrt(np.maximum(0, self.square[some] - 2.0 * x[some, s])) for x in (self.high, self.low))
            inner, outer = inner - self.space.slack, outer + self.space.slack
            least = np.maximum(d - outer[:, None], inner[:, None] - d)
            out |= (self.low[some, s] <= self.high[some, s]) & ((least <= high) & (d + outer[:, None] >= low)).all(1)
        return out

    def compare(self, some: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool) -> None:
        """Exact scores of these anchors with these rows; the k best in each window are kept."""
        score = (self.v[some] @ v.T).astype(np.int64)
        fit = ((self.label[some, None] == labels) == same) & (self.id[some, None] != ids)
        new = []
        for s in range(self.low.shape[1]):
            i, j = np.nonzero(fit & (score >= self.low[some, s, None]) & (score <= self.high[some, s, None]))
            new.append((some[i], np.full(len(i), s), score[i, j], ids[j]))
        if not sum(len(n[0]) for n in new):
            return
        anchor, slot, score, ids = (np.concatenate(c) for c in zip(self.best, *new, strict=True))
        order = np.lexsort((ids, -score, slot, anchor))
        key = (anchor * self.low.shape[1] + slot)[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        order = order[rank < self.k]
        self.best = anchor, slot, score, ids = anchor[order], slot[order], score[order], ids[order]
        last = rank[rank < self.k] == self.k - 1
        self.low[anchor[last], slot[last]] = np.maximum(self.low[anchor[last], slot[last]], score[last])


def search(anchors: Anchors, tree: Node | np.ndarray, some: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool) -> None:
    """Takes these anchors down the tree; an anchor leaves out the children that its windows can't meet any more."""
    if not len(some):
        return
    if isinstance(tree, Node):
        d = distances(anchors.x[some], tree.points)
        for j in np.argsort(d.mean(0)).tolist():
            search(anchors, tree.kids[j], some[anchors.meets(some, d, tree.low[:, j], tree.high[:, j])], v, ids, labels, same)
        return
    for a in range(0, len(tree), LEAF):
        rows = tree[a : a + LEAF]
        anchors.compare(some, v[rows], ids[rows], labels[rows], same)


class Index:
    """All rows in the shards of the upper tree (placed: id, label, a, leaf, block), and the tree with the ranges of all rows."""

    def __init__(self, rows: DataFrame, n: int, space: Space):
        spark = rows.sparkSession
        wanted = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(2 * SAMPLE)
        drawn = [r.v for r in wanted.collect()]
        drawn = np.array(drawn, np.int64).reshape(len(drawn), space.dims)
        drawn = drawn[np.lexsort(drawn.T[::-1])] if len(drawn) and space.dims else drawn
        drawn = drawn[np.random.default_rng(1).permutation(len(drawn))]
        upper = Upper(space.lengthened(drawn), n, space)
        shared = spark.sparkContext.broadcast(upper)  # at most MAX_LEAVES leaves, FANOUT points and ranges a node

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, space.dims)
                leaf = shared.value.homes(space.lengthened(v))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in v.astype(space.kind)], pa.binary()), pa.array(leaf)], ["id", "label", "a", "leaf"])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Upper.__new__(Upper)
            own.__dict__.update(shared.value.__dict__)
            for node in own.nodes:
                node.low[:], node.high[:] = np.inf, -np.inf
            for b in batches:
                own.homes(space.lengthened(space.unpacked(b.column(0))), widen=True)
            found = [(k, i, j, node.low[i, j], node.high[i, j]) for k, node in enumerate(own.nodes) for i in range(len(node.points)) for j in range(len(node.points)) if node.low[i, j] <= node.high[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((),) * 5, (*[pa.int32()] * 3, *[pa.float64()] * 2), strict=True)], ["node", "i", "j", "low", "high"])

        homed = staged(rows.select("id", "label", "v").mapInArrow(place, "id long, label long, a binary, leaf int"), "homed")
        ranges = homed.select("a").mapInArrow(measure, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        for r in ranges.collect():  # FANOUT**2 rows a node at most
            upper.nodes[r.node].low[r.i, r.j], upper.nodes[r.node].high[r.i, r.j] = r.low, r.high
        self.blocks = staged(homed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")  # a row for each leaf
        block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
        self.placed = homed.join(F.broadcast(self.blocks), "leaf").select("id", "label", "a", "leaf", block.alias("block"))
        self.homed, self.space, self.tree = homed, space, spark.sparkContext.broadcast(upper)

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """anchors (anchor, of: its label, a, low, high: its windows) -> anchor, slot (of the window), rank, id, score: the k best rows of each window."""
        chunks = max(1, -(-anchors.count() // CHUNK))
        first = staged(self._compared(anchors, chunks, "home", same, k), "home")
        kth = first.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))
        narrowed = anchors.join(kth.withColumnRenamed("anchor", "k"), F.col("anchor") == F.col("k"), "left")
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
        narrowed = staged(narrowed.select("anchor", "of", "a", raised.alias("low"), "high"), "narrowed")
        rest = staged(self._compared(narrowed, chunks, "others", same, k), "others")
        unstage(narrowed)
        out = staged(_ranked(first.unionByName(rest), k), "best")
        unstage(first, rest)
        return out

    def _compared(self, anchors: DataFrame, chunks: int, where: str, same: bool, k: int) -> DataFrame:
        space, tree = self.space, self.tree

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                own = Anchors(b, space, k)
                home = tree.value.homes(space.lengthened(own.v))
                at, leaf = (np.arange(b.num_rows), home) if where == "home" else tree.value.reached(own)
                if where != "home":
                    at, leaf = at[(other := leaf != home[at])], leaf[other]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(leaf)], ["anchor", "of", "a", "low", "high", "leaf"])

        sent = anchors.select("anchor", "of", "a", "low", "high").mapInArrow(reach, "anchor long, of long, a binary, low array<long>, high array<long>, leaf int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
        sent = sent.join(F.broadcast(self.blocks), "leaf").withColumn("block", upto(F.col("blocks"))).withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int")).drop("blocks")
        rows = self.placed.withColumn("chunk", upto(F.lit(chunks)))

        def compare(rows: pa.Table, anchors: pa.Table) -> pa.Table:
            names = ["anchor", "slot", "id", "score"]
            if not rows.num_rows or not anchors.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names)
            own, v = Anchors(anchors, space, k), space.unpacked(rows["a"])
            x = space.lengthened(v)
            search(own, grown(x, np.arange(len(x)), LEAF, space.slack), np.arange(len(own.id)), v, rows["id"].to_numpy(), rows["label"].to_numpy(), same)
            at, slot, score, ids = own.best
            return pa.table([pa.array(own.id[at]), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(score)], names)

        key = ["leaf", "block", "chunk"]
        return rows.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(compare, "anchor long, slot int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("anchor", "slot", "rank", "id", "score")


def hard_negatives(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor (rows where `anchor`, a condition on the column id, holds) and each of its first `positives` rows of its label: the first
    `negatives` rows of other labels whose score is window[0] to window[1] per cent of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = prepared(table, scale, id_col, label_col, vector_col)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x * x)
    n, dims, most, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(square)).first()
    space = Space(dims or 0, most or 0, largest or 0)
    index = Index(rows, n, space)
    chosen = staged(index.homed.where(anchor).select(F.col("id").alias("anchor"), F.col("label").alias("of"), "a"), "anchors")
    anywhere = chosen.withColumns({"low": F.array(F.lit(-FAR)), "high": F.array(F.lit(FAR))})
    near = index.best(anywhere, True, positives)

    def rounded(per_cent: int, up: bool) -> Column:
        x = f"score * {-per_cent if up else per_cent}"
        down = F.expr(f"({x} - pmod({x}, 100)) div 100")
        return -down if up else down

    windows = near.withColumns({"low": rounded(window[0], True), "high": rounded(window[1], False)}).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    windows = staged(chosen.join(windows.withColumnRenamed("anchor", "k"), F.col("anchor") == F.col("k")).select("anchor", "of", "a", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "windows")
    hard = index.best(windows, False, negatives)
    unstage(rows, chosen, windows, index.homed, index.blocks)
    of = near.select(F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).alias("of_slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(of, (F.col("anchor") == F.col("anchor_id")) & (F.col("slot") == F.col("of_slot")))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
      FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {"op11_hard_negatives": ORACLE}
