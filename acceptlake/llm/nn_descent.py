"""Approximate nearest neighbours by NN-descent: a neighbour graph through joins of neighbours of neighbours, searched greedily.

Vectors are lengthened by one coordinate to the largest norm, so that the order by inner product is an order by distance; the
graph is built on these. It starts from the best neighbours within blocks of a few random orders (signs of random directions, then
one projection; blocks of about equal numbers of rows however the vectors crowd) and is improved in rounds: a Spark join brings a
node's neighbours and reverse neighbours together, and every pair of them of which one is new since the last round is compared; a pair
goes out only if it is better than the worst neighbour that one of the two has. Rounds go on until few edges are new.
Reverse neighbours of one node are as many as its own (the method's sampling). Lists of one node are cut to the best in the task, before the
exchange and while they are merged, so a node that many point to is no hot key. All rows are indexed.

Queries start from their own place in the graph, if they have one, and from a fixed number of spread nodes, and expand
their best unexpanded nodes round by round until none of the best is unexpanded. The nodes to score go to blocks of vectors with one row for
each query and block. The best are scored again at the end: inner products of the original vectors in double precision.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; nor do rows
without an id. Rows that repeat an id count once (with the greatest vector). Ties go to the smaller id; of more equal vectors than a
query keeps, any may be found. An empty table or no queries give an empty result; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, staged, unstage

#: Neighbours of a node; random orders at the start, rows of their blocks; the share of edges that must still be new for another round.
NEIGHBOURS, ORDERS, BLOCK, CHANGE = 48, 8, 1024, 0.01
#: Best nodes that a query keeps, nodes it expands a hop, spread nodes it starts from, nodes of a block of vectors.
KEPT, EXPANDED, ENTRIES, SCORED = 128, 48, 32, 4096


def prepared(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (the vector), a (float32 bytes: the vector lengthened to norm 1)."""
    v = F.col(vector_col)
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common.d if common else 0
    rows = staged(rows.where(F.size("v") == dims).groupBy("id").agg(F.max("v").alias("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    most = rows.agg(F.max(norm)).first()[0] or 1.0

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) / most
            rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))
            a = np.ascontiguousarray(np.hstack([v, rest]), np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in a], pa.binary())], ["id", "v", "a"])

    return staged(rows.mapInArrow(lengthen, "id long, v array<double>, a binary"), "lengthened")


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of packed lists, and how many each has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), np.diff(at) // np.dtype(kind).itemsize


def _packed(values: np.ndarray, count: np.ndarray) -> pa.Array:
    places = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


#: Lists (one or more for a node): u, packed ids, scores and flags; side 0: neighbours, 1: reverse neighbours.
_LISTS = "u long, side int, v binary, s binary, new binary"
_KINDS = (np.int64, np.float32, np.bool_)


class _Edges:
    """Edges u, side, v, s, new as arrays."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Edges:
        lists = [_flat(batch.column(2 + k), kind) for k, kind in enumerate(_KINDS)]
        count = lists[0][1]
        return cls(np.repeat(batch.column(0).to_numpy(), count), np.repeat(batch.column(1).to_numpy(), count), *[x[0] for x in lists])

    @classmethod
    def none(cls) -> _Edges:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool))

    def __add__(self, other: _Edges) -> _Edges:
        return _Edges(*[np.concatenate([a, b]) for a, b in zip(self.columns, other.columns, strict=True)])

    def __getitem__(self, at) -> _Edges:
        return _Edges(*[c[at] for c in self.columns])

    def __len__(self) -> int:
        return len(self.columns[0])

    def best(self, k: int) -> _Edges:
        """The k best of each u and side, each v once (not new if it was there before), in order of u, side, score and v."""
        u, side, v, _, new = self.columns
        e = self[np.lexsort((new, v, side, u))]
        u, side, v, s, new = e.columns
        first = np.ones(len(e), bool)
        first[1:] = (u[1:] != u[:-1]) | (side[1:] != side[:-1]) | (v[1:] != v[:-1])
        e = e[first]
        u, side, v, s, new = e.columns
        e = e[np.lexsort((v, -s, side, u))]
        u, side = e.columns[:2]
        head = np.ones(len(e), bool)
        head[1:] = (u[1:] != u[:-1]) | (side[1:] != side[:-1])
        start = np.flatnonzero(head)
        return e[np.arange(len(e)) - np.repeat(start, np.diff(np.append(start, len(e)))) < k]

    def lists(self) -> pa.RecordBatch:
        """A row for each run of one u and side."""
        u, side, v, s, new = self.columns
        head = np.ones(len(self), bool)
        head[1:] = (u[1:] != u[:-1]) | (side[1:] != side[:-1])
        start = np.flatnonzero(head)
        count = np.diff(np.append(start, len(self)))
        return pa.RecordBatch.from_arrays([pa.array(u[start]), pa.array(side[start].astype(np.int32)), *[_packed(x, count) for x in (v, s, new)]], ["u", "side", "v", "s", "new"])


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list for each u and side: its k best."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Edges.none()
        for batch in batches:
            held = held + _Edges.of(batch)
            if len(held):
                done = held.columns[0] != held.columns[0][-1]
                if done.any():
                    yield held[done].best(k).lists()
                held = held[~done].best(k)
        if len(held):
            yield held.lists()

    return lists.repartition("u").sortWithinPartitions("u").mapInArrow(scan, _LISTS)


def _pairs(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> _Edges:
    i, j = np.nonzero(ok)
    return _Edges(ids[i], np.zeros(len(i), np.int32), ids[j], scores[i, j].astype(np.float32), np.ones(len(i), bool))


def _in_blocks(nodes: DataFrame, count: int, order: int, k: int) -> DataFrame:
    """Each node's best within its block of one random order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = None
        for batch in batches:
            a = _matrix(batch.column(1))
            if way is None:
                way = np.random.default_rng(1000 + order).standard_normal((a.shape[1], 9)).astype(np.float32)
            x = a @ way
            cell = ((x[:, :8] > 0) << np.arange(8)).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(x[:, 8].astype(np.float64))], ["id", "a", "cell", "at"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out():
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            a = np.vstack([_matrix(b.column(1)) for b in held])
            scores = a @ a.T
            np.fill_diagonal(scores, -np.inf)
            n = min(k, len(ids) - 1)
            ok = np.zeros(scores.shape, bool)
            np.put_along_axis(ok, np.argpartition(-scores, n - 1, axis=1)[:, :n], True, 1)
            return _pairs(scores, ids, ok).best(k).lists()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                rows += held[-1].num_rows
                if rows >= BLOCK:
                    yield out()
                    held, rows = [], 0
        if rows > 1:
            yield out()

    placed = nodes.select("id", "a").mapInArrow(place, "id long, a binary, cell int, at double")
    blocks = placed.repartitionByRange(max(1, -(-count // BLOCK)), "cell", "at").sortWithinPartitions("cell", "at", "id")
    return blocks.select("id", "a").mapInArrow(compare, _LISTS)


def around(graph: DataFrame, k: int) -> DataFrame:
    """Lists of the k reverse neighbours beside those of the neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, side, v, s, new = _Edges.of(batch).columns
            if len(u):
                yield (_Edges(u, side, v, s, new) + _Edges(v, side + 1, u, s, new).best(k)).lists()

    return _merged(graph.mapInArrow(scan, _LISTS), k)


def _compared(lists: DataFrame, graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """For each node, the pairs of what is near it of which one is new, as far as they better the neighbours that either has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, _, v, _, new = _Edges.of(batch).columns
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(new)], ["node", "near", "new"])

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, count = _flat(batch.column(3), np.float32)
            last = s[np.cumsum(count) - 1] if len(s) else s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(count < k, -np.inf, last).astype(np.float32))], ["u", "worst"])

    near = lists.mapInArrow(spread, "node long, near long, new boolean").groupBy("node", "near").agg(F.max("new").alias("new"))
    awake = near.where("new").select("node").distinct()
    known = nodes.join(graph.mapInArrow(worst, "u long, worst float"), F.col("id") == F.col("u")).select(F.col("id").alias("near"), "a", "worst")
    rows = near.join(awake, "node", "left_semi").join(known.hint("merge"), "near").select("node", "near", "new", "worst", "a")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] | None = None

        def out(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            node, ids, new, worst_ = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
            a = _matrix(columns[4])
            edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            found, size = [], 0
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(node)], strict=True):
                scores = a[x:y] @ a[x:y].T
                ok = (new[x:y, None] | new[None, x:y]) & (scores > worst_[x:y, None])
                np.fill_diagonal(ok, False)
                found.append(_pairs(scores, ids[x:y], ok))
                size += len(found[-1])
                if size > 1 << 20 or y == len(node):
                    if size:
                        yield _Edges(*[np.concatenate(c) for c in zip(*[f.columns for f in found], strict=True)]).best(k).lists()
                    found, size = [], 0

        for batch in batches:
            columns = batch.columns if held is None else [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns, strict=True)]
            node = columns[0].to_numpy()
            cut = int(np.searchsorted(node, node[-1]))
            held = [c.slice(cut) for c in columns]
            if cut:
                yield from out([c.slice(0, cut) for c in columns])
        if held is not None and len(held[0]):
            yield from out(held)

    return rows.repartition("node").sortWithinPartitions("node", "near").mapInArrow(scan, _LISTS)


def _as_old(graph: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = _flat(batch.column(4), np.bool_)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _packed(np.zeros(count.sum(), bool), count)], batch.schema.names)

    return graph.mapInArrow(scan, _LISTS)


def _edge_counts(graph: DataFrame) -> tuple[int, int]:
    """Edges, and those that are new."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = _flat(batch.column(4), np.bool_)[0]
            yield pa.RecordBatch.from_arrays([pa.array([len(new)]), pa.array([int(new.sum())])], ["edges", "fresh"])

    row = graph.mapInArrow(scan, "edges long, fresh long").agg(F.sum("edges"), F.sum("fresh")).first()
    return row[0] or 0, row[1] or 0


def build_graph(nodes: DataFrame, neighbours: int | None = None) -> DataFrame:
    """Lists (u, v, s, new) of the best neighbours of each node. Rounds end, as a node's neighbours only get better."""
    k = neighbours or NEIGHBOURS
    count = nodes.count()
    parts = [_in_blocks(nodes, count, order, k) for order in range(ORDERS)]
    first = parts[0]
    for part in parts[1:]:
        first = first.unionByName(part)
    graph = staged(_merged(first, k), "graph")
    while True:
        lists = staged(around(graph, k), "around")
        found = _compared(lists, graph, nodes, k)
        better = staged(_merged(_as_old(graph).unionByName(found), k), "graph")
        unstage(lists, graph)
        graph = better
        edges, fresh = _edge_counts(graph)
        if fresh <= CHANGE * edges:
            return graph


def _inner(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, z: t + z)


def _blocks(nodes: DataFrame, n_blocks: int) -> DataFrame:
    """Vectors in single precision by block: block, ids, vectors."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _block(batch.column(0).to_numpy(), n_blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0), _rows(batch.column(1))], ["block", "id", "m"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            count = np.diff(np.append(start, len(block)))
            m = _matrix(batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(block[start]), _packed(batch.column(1).to_numpy(), count), _packed(m.ravel(), count * m.shape[1])], ["block", "ids", "m"])

    rows = nodes.select("id", "v").mapInArrow(place, "block int, id long, m binary")
    return rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(pack, "block int, ids binary, m binary")


def _block(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int32)


def _rows(vectors: pa.Array) -> pa.Array:
    """A column of lists of numbers as packed single-precision vectors."""
    count = vectors.value_lengths().to_numpy()
    return _packed(vectors.flatten().to_numpy().astype(np.float32), count)


#: A query: its vector; ids, scores and flags of the best (the own id comes first with an infinite score, so it keeps its place).
_STATE = "q long, qv binary, ids binary, s binary, open binary"


def _to_expand(s: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Places of the nodes that a query expands next; its nodes lie in order of their scores."""
    return np.flatnonzero(open_)[:EXPANDED]


def _hop(state: DataFrame, reached: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The state after the nodes in reached (q, v: packed ids) are scored."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []  # the query's row, what it has reached

        def out():
            q, qv, ids = own
            new = np.setdiff1d(np.unique(np.concatenate(parts)), ids) if parts else ids[:0]
            block = _block(new, n_blocks)
            order = np.argsort(block, kind="stable")
            new, block = new[order], block[order]
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(new) else np.zeros(0, np.int64)
            return q, qv, block[start], new, np.diff(np.append(start, len(new)))

        def batch_of(found):
            n = [len(f[2]) for f in found]
            q = np.repeat(np.array([f[0] for f in found], np.int64), n)
            qv = pa.array([f[1] for f, m in zip(found, n, strict=True) for _ in range(m)], pa.binary())
            block, ids, count = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
            return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.ones(len(q), np.int32)), pa.array(q), _packed(ids.astype(np.int64), count), qv], ["block", "kind", "q", "ids", "m"])

        for batch in batches:
            found = []
            for kind, q, qv, v in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                ids = np.frombuffer(v, np.int64)
                if kind == 0:
                    if own is not None:
                        found.append(out())
                    own, parts = (q, qv, ids), []
                else:
                    parts.append(ids)
                    if len(parts) > 256:
                        parts = [np.unique(np.concatenate(parts))]
            if found:
                yield batch_of(found)
        if own is not None:
            yield batch_of([out()])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, m = None, np.zeros(0, np.int64), None
        for batch in batches:
            found = []
            for block, kind, q, v, x in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                own = np.frombuffer(v, np.int64)
                if kind == 0:
                    rows = np.frombuffer(x, np.float32).reshape(len(own), -1)
                    ids, m = (np.concatenate([ids, own]), np.vstack([m, rows])) if block == at else (own, rows)
                    if len(ids) > 1 and not (ids[1:] > ids[:-1]).all():
                        order = np.argsort(ids)
                        ids, m = ids[order], m[order]
                    at = block
                elif block == at:
                    place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                    there = ids[place] == own
                    found.append((q, own[there], m[place[there]] @ np.frombuffer(x, np.float32)))
            if found:
                count = np.array([len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), pa.array([f[0] for f in found], pa.int64()), _packed(np.concatenate([f[1] for f in found]), count), _packed(np.concatenate([f[2] for f in found]).astype(np.float32), count)], ["kind", "q", "ids", "s"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def cut(q, qv, ids, s, open_):
            order = np.lexsort((ids, -s))[:KEPT]
            return q, qv, ids[order], s[order], open_[order]

        def batch_of(found):
            count = np.array([len(f[2]) for f in found])
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), *[_packed(np.concatenate([f[k] for f in found]), count) for k in (2, 3, 4)]], ["q", "qv", "ids", "s", "open"])

        for batch in batches:
            found = []
            for kind, q, qv, v, s, o in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                ids, scores = np.frombuffer(v, np.int64), np.frombuffer(s, np.float32)
                if kind == 0:
                    if own is not None:
                        found.append(own)
                    own = (q, qv, ids, scores, np.frombuffer(o, np.bool_))
                else:
                    own = cut(q, own[1], np.concatenate([own[2], ids]), np.concatenate([own[3], scores]), np.concatenate([own[4], np.ones(len(ids), bool)]))
            if found:
                yield batch_of(found)
        if own is not None:
            yield batch_of([own])

    none = F.lit(b"")
    asked = state.select(F.lit(0).alias("kind"), "q", "qv", F.col("ids").alias("v")).unionByName(reached.select(F.lit(1).alias("kind"), "q", none.alias("qv"), "v"))
    asked = asked.repartition("q").sortWithinPartitions("q", "kind").mapInArrow(ask, "block int, kind int, q long, ids binary, m binary")
    rows = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("q"), "ids", "m").unionByName(asked)
    scored = rows.repartition("block").sortWithinPartitions("block", "kind", "q").mapInArrow(answer, "kind int, q long, ids binary, s binary")
    kept = _closed(state).select(F.lit(0).alias("kind"), "q", "qv", "ids", "s", "open").unionByName(scored.select("kind", "q", none.alias("qv"), "ids", "s", none.alias("open")))
    return kept.repartition("q").sortWithinPartitions("q", "kind").mapInArrow(keep, _STATE)


def _closed(state: DataFrame) -> DataFrame:
    """The state with the nodes closed that have just been expanded."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, o in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                open_ = np.frombuffer(o, np.bool_).copy()
                open_[_to_expand(np.frombuffer(s, np.float32), open_)] = False
                out.append(open_.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], batch.schema.names)

    return state.mapInArrow(scan, _STATE)


def _expanded(state: DataFrame) -> DataFrame:
    """q, node: what each query expands next."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [np.frombuffer(v, np.int64)[_to_expand(np.frombuffer(s, np.float32), np.frombuffer(o, np.bool_))] for v, s, o in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(n) for n in nodes])), pa.array(np.concatenate(nodes))], ["q", "node"])

    return state.mapInArrow(scan, "q long, node long")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int, neighbours: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query (id, v), the query's own id excepted."""
    lists = staged(around(graph, neighbours or NEIGHBOURS).select(F.col("u").alias("node"), "v"), "around")
    n_blocks = max(1, -(-nodes.count() // SCORED))
    blocks = staged(_blocks(nodes, n_blocks), "blocks")
    entries = np.sort(np.array([r.id for r in nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()], np.int64))  # ENTRIES ids

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = np.ones(batch.num_rows, np.int64)
            columns = [_packed(batch.column(0).to_numpy(), one), _packed(np.full(len(one), np.inf, np.float32), one), _packed(one.astype(bool), one)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _rows(batch.column(1)), *columns], ["q", "qv", "ids", "s", "open"])

    state = staged(queries.select("id", "v").mapInArrow(begin, _STATE), "state")
    reached = state.select("q", F.lit(entries.tobytes()).alias("v"))
    while True:  # ends, as a node that has left the best kept never comes back unless it is better than before
        grown = staged(_expanded(state), "grown")
        if grown.isEmpty():
            unstage(grown)
            break
        near = grown.join(lists.hint("merge"), "node").select("q", "v")
        after = staged(_hop(state, near if reached is None else near.unionByName(reached), blocks, n_blocks), "state")
        unstage(grown, state)
        state, reached = after, None

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, count = _flat(batch.column(2), np.int64)
            q = np.repeat(batch.column(0).to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(q[q != ids]), pa.array(ids[q != ids])], ["q", "id"])

    found = state.mapInArrow(kept, "q long, id long").join(nodes.select("id", "v"), "id").join(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    best = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    ranked = found.select("q", "id", _inner(F.col("qv"), F.col("v")).alias("s")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = staged(ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("s").alias("score")), "ranked")
    unstage(lists, blocks, state)
    return ranked


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row of table for which is_query (on `id`) holds."""
    nodes = prepared(table, id_col, vector_col)
    graph = build_graph(nodes)
    out = search(nodes.where(is_query), nodes, graph, k)
    unstage(graph, nodes)
    return out


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, F.col("id") % 20 == 0)


QUERIES = {"op8_nn_descent": op8_nn_descent}
SQL: dict[str, str] = {}
