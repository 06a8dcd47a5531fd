"""N-gram Jaccard join over a count-vector R-tree.

A document's set holds the 58-bit hashes of its distinct n-word shingles. Hashed into groups, a set becomes a point of group counts,
and the sum of the coordinate minima of two points bounds the overlap of their sets from above. The tree has these levels:

* Cells. With the finest groups (a group a shingle) in one fixed order, rare words first, two sets whose overlap reaches the
  threshold must have SHARED non-zero minima (or as many as are needed, if fewer) among the first size - needed + SHARED
  coordinates of both: the minima of the rest alone sum to less than what is left. So points are dealt to a cell for each of
  these coordinates, and points that share fewer cells with others are passed over, without loss.
  The order comes from word counts over all documents: a shingle ranks by its rarest word.
* Inner nodes and leaves. Points that meet in cells lie sorted by size in leaves of LEAF, and FAN leaves or nodes make a node of the
  next level; each has the maximum of every coordinate. Pairs of nodes are passed over if their sizes are too far apart or their
  maxima's minima sum to less than any needed overlap; else their children are compared.
* Points. The pairs of the remaining leaves are bounded one by one, and the survivors verified on the exact sets.

Sets that are equal form one class, which takes part once. For components, links only matter as far as they join what isn't joined yet: first
each class is verified against the pivot it shares most cells with, then, among the cells that still hold several components, every pair of
different components that passes the bounds. So a group of near copies costs a star and not all its pairs, and no link between
components is lost. `join_links` leaves the stars out and finds every link between classes.

Cells that hold many classes are told from counts made in the tasks and dealt by class. Cells whose least component is the same
are one tree; a tree of more than BLOCK points is cut into blocks, of its largest component and of the rest, and each task compares
two blocks. Copies in one task send their cells and text once.

Null texts and texts without words have an empty set and are linked with nothing; a text of fewer words than n is one shingle. A very
long text is handled in a slice of its own. Repeated rows get a row each. A null id takes part in links but is never the name of a
component, unless the component has no other. An empty table gives an empty result. Ties don't arise, as the least id names a component.
Only the id and the text of the documents are looked at, so other columns may have any name. Hashes stand for shingles (58 bits)
and for sets (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SPACE_WORDS, Words, mix, slices, staged, tracked, unstage

#: Points of a leaf, children of an inner node, points of a block.
LEAF, FAN, BLOCK = 32, 8, 2048
#: Shingles to a coordinate of the coarse points, about.
PER_GROUP = 4
#: Words in the table of frequent words, and places in its hashed form; fixed sizes.
FREQUENT, PLACES = 1 << 17, 1 << 20
#: Cells that two linked sets share at least, unless their overlap need not be as large.
SHARED = 5
#: Cells that may be told as full (a fixed size); a task names those with this share of its own.
FULL = 1 << 12
#: Members that one task verifies against one pivot, about.
MEMBERS = 256
#: Classes that a task remembers to send their text once.
SEEN = 1 << 18
#: Different keys that a task counts before it forgets those that it has met once.
COUNTED = 1 << 19
_U = np.uint64


def _needed(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of two sets whose sizes add up to total: 100 * i >= percent * (total - i)."""
    return -(-percent * total // (100 + percent))


def _first(size: np.ndarray, percent: int) -> np.ndarray:
    """Coordinates that are dealt: size - least overlap with any set + cells that must be shared."""
    least = -(-percent * size // 100)
    return size - least + np.minimum(SHARED, least)


class Sets:
    """Shingle sets of a slice of texts: hashes[first[i]:first[i+1]] are those of text i, sorted and distinct; size, and a hash of the set."""

    def __init__(self, texts: pa.Array, n: int, levels: np.ndarray | None = None):
        w = Words(texts, SPACE_WORDS, lower=True)
        i, h = w.runs(n)
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        doc = np.concatenate([w.doc[i], short])
        hashes = np.concatenate([h, w.whole(short) if len(short) else np.zeros(0, np.uint64)])
        hashes = hashes >> _U(6)
        if levels is not None:  # the level of the rarest word leads, so that sorting puts rare shingles first
            level = levels[(w.hash & _U(PLACES - 1)).astype(np.int64)]
            rare = level[i].copy()
            for t in range(1, n):
                np.minimum(rare, level[i + t], out=rare)
            lead = np.concatenate([rare, np.zeros(len(short), np.uint8)]).astype(np.uint64)
            hashes |= lead << _U(58)
        if len(short):
            order = np.argsort(doc, kind="stable")
            doc, hashes = doc[order], hashes[order]
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            hashes[a:b].sort()
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hashes = hashes[keep]
        self.size = np.bincount(doc[keep], minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes & _U((1 << 58) - 1)))])
        self.key = mix((sums[self.first[1:]] - sums[self.first[:-1]]) ^ mix(self.size.astype(np.uint64))).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


class _Once:
    """Tells which keys a task meets for the first time, as far as it remembers."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        fresh = np.zeros(len(keys), bool)
        first = np.unique(keys, return_index=True)[1]
        fresh[first] = [k not in self.seen for k in keys[first].tolist()]
        if len(self.seen) > SEEN:
            self.seen.clear()
        self.seen.update(keys[fresh].tolist())
        return fresh


def groups(size: int) -> int:
    """Coordinates of the point of a set: a power of two, about size / PER_GROUP."""
    return 1 << max(4, int(max(1, size // PER_GROUP)).bit_length())


def point(hashes: np.ndarray) -> np.ndarray:
    """Group counts in one byte each; should a count not fit, all coordinates are set to the most, so that nothing is ruled out by them."""
    n = groups(len(hashes))
    counts = np.bincount((hashes & _U(n - 1)).astype(np.int64), minlength=n)
    return counts.astype(np.uint8) if counts.max() < 255 else np.full(n, 255, np.uint8)


def folded(v: np.ndarray, n: int) -> np.ndarray:
    """The point(s) with n coordinates instead of more: group = hash modulo n."""
    if v.shape[-1] > n:
        v = v.astype(np.uint16)
    while v.shape[-1] > n:
        v = v[..., : v.shape[-1] // 2] + v[..., v.shape[-1] // 2 :]
    return v


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima over the last axis."""
    n = min(a.shape[-1], b.shape[-1])
    return np.minimum(folded(a, n), folded(b, n)).sum(-1, dtype=np.int64)


class _Counts:
    """Counts of what a task meets often: of rare keys those seen once are forgotten when there are too many."""

    def __init__(self) -> None:
        self.keys, self.count, self.total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, keys: np.ndarray) -> None:
        self.total += len(keys)
        new, n = np.unique(keys, return_counts=True)
        self.keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.count = np.bincount(at, np.concatenate([self.count, n]), len(self.keys)).astype(np.int64)
        if len(self.keys) > COUNTED:  # what is rare so far can't become frequent by what it had
            often = self.count > 1
            self.keys, self.count = self.keys[often], self.count[often]

    def often(self, share: int) -> tuple[pa.Array, pa.Array]:
        """Keys that make up 1 / share of all, and at least two."""
        often = self.count >= max(2, self.total // share)
        return pa.array(self.keys[often].view(np.int64)), pa.array(self.count[often])


def frequent_words(texts: DataFrame, n_words: int = FREQUENT) -> np.ndarray:
    """Level of each place of the hashed word table: the bit length of the largest count of a frequent word there, else 0.

    Counts cover all texts; a task keeps the words that make up 1 / 32768 of its own, so any word that frequent overall is seen.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for part in slices(batches, "text"):
            counts.add(Words(part.column(0), SPACE_WORDS, lower=True).hash)
        yield pa.RecordBatch.from_arrays([*counts.often(1 << 15)], ["word", "n"])

    counts = texts.select("text").mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    levels = np.zeros(PLACES, np.uint8)
    for r in counts.orderBy(F.desc("n"), "word").limit(n_words).toLocalIterator():
        at = r.word & (PLACES - 1)
        levels[at] = max(levels[at], min(63, int(r.n).bit_length()))
    return levels


def dealt(texts: DataFrame, levels: np.ndarray, n: int, percent: int) -> DataFrame:
    """id, size, class (hash of the set) and the cells of each text; a class that comes again in a task brings no cells again.
    A last row of each task (size -1, cells and counts) names the cells that are frequent in it."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    names = ["id", "size", "class", "cells", "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, counts = _Once(), _Counts()
        for part in slices(batches, "text"):
            s = Sets(part.column(1), n, shared.value)
            first = np.where(once(s.key), _first(s.size, percent), 0)
            places = np.concatenate([[0], np.cumsum(first)])
            at = np.arange(places[-1]) - np.repeat(places[:-1], first) + np.repeat(s.first[:-1], first)
            counts.add(s.hashes[at])
            cells = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(s.hashes[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.size.astype(np.int64)), pa.array(s.key), cells, pa.nulls(part.num_rows, pa.list_(pa.int64()))], names)
        full, count = counts.often(FULL)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(full)], pa.int32()), x) for x in (full, count)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([0]), *lists], names)

    return texts.mapInArrow(scan, "id long, size long, class long, cells array<long>, counts array<long>")


def _members(points: DataFrame) -> DataFrame:
    """(cell, size, class), once each, of the cells that have several classes. Full cells are made distinct by class; the others pass in sorted
    order, and a cell may span batches."""
    told = points.where("size = -1").select(F.explode(F.arrays_zip("cells", "counts")).alias("c")).groupBy(F.col("c.cells").alias("cell")).agg(F.sum("c.counts").alias("n"))
    full = told.orderBy(F.desc("n"), "cell").select("cell").limit(FULL).toArrow()  # FULL rows
    full = F.broadcast(points.sparkSession.createDataFrame(full))
    cells = points.where("size > 0").select(F.explode("cells").alias("cell"), "size", "class")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the last row, as long as it is the only class of its cell
        many, last = None, (None, None)  # the last cell of which rows have gone out; the last row
        for batch in batches:
            c, s, k = (np.concatenate([h, batch.column(x).to_numpy()]) for x, h in enumerate(held))
            fresh = np.ones(len(c), bool)
            fresh[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
            fresh[0] = len(held[0]) > 0 or (c[0], k[0]) != last
            last = (c[-1], k[-1])
            c, s, k = c[fresh], s[fresh], k[fresh]
            held = [np.zeros(0, np.int64)] * 3
            if not len(c):
                continue
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(c)))
            several = count > 1
            several[0] |= c[0] == many
            if several[-1]:
                many = c[-1]
            else:
                held = [x[start[-1] :] for x in (c, s, k)]
            out = np.repeat(several, count)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (c, s, k)], ["cell", "size", "class"])

    sparse = cells.join(full, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell", "size", "class")
    return sparse.mapInArrow(scan, "cell long, size long, class long").unionByName(cells.join(full, "cell", "left_semi").distinct())


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """(x, y): for each class y the pivot x it shares most cells with. The pivot of a cell, among sets of about one size, is the class
    the largest part of whose cells is shared: the text that the others are copies of rather than a copy with changes of its own."""
    step = F.floor(F.log("size") / -float(np.log(percent / 100))).alias("step")
    stepped = members.select("cell", "class", step, "part")
    pivots = stepped.groupBy("cell", "step").agg(F.max_by("class", F.struct("part", "class")).alias("pivot"))
    shares = stepped.join(pivots.hint("merge"), ["cell", "step"]).where(F.col("class") != F.col("pivot")).groupBy("class", "pivot").count()
    shares = shares.where(F.col("count") >= 2)
    stars = shares.groupBy("class").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    return stars.select(F.col("pivot").alias("x"), F.col("class").alias("y"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches, cut where SLICE_BYTES of unpacked texts are reached, and the texts (packed in column z, their size in column bytes)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        size = np.cumsum(batch.column(batch.schema.get_field_index("bytes")).to_numpy())
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES, side="right")))
            part = batch.slice(a, b - a)
            z = part.column(part.schema.get_field_index("z"))
            yield part, pa.array([unpack.decompress(x).decode() for x in z.to_pylist()], pa.string())
            a = b


def _verified(pairs: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (x, y) of classes those that link. A pivot's members are dealt to several tasks if they are many."""
    salts = pairs.groupBy("x").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    salted = pairs.join(salts, "x").withColumn("salt", F.pmod(F.xxhash64("y"), F.col("salts")).cast("int")).select("x", "salt", "y")
    heads = salted.select("x", "salt").distinct().select("x", "salt", F.col("x").alias("y"))
    rows = heads.unionByName(salted).join(known.hint("merge"), F.col("y") == F.col("class"))
    rows = rows.select("x", "salt", (F.col("x") != F.col("y")).cast("int").alias("member"), "y", "bytes", "z")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, at = (None, None), np.zeros(0, np.uint64), None
        for part, texts in _unpacked(batches):
            s = Sets(texts, n)
            xs, salts_, ys = (part.column(c).to_pylist() for c in (0, 1, 3))
            found = []
            for i, (x, salt, y) in enumerate(zip(xs, salts_, ys, strict=True)):
                theirs = s.of(i)
                if x == y:
                    head, own = (x, salt), theirs.copy()
                    at = point(own)
                elif head == (x, salt):
                    need = _needed(len(own) + len(theirs), percent)
                    if min(len(own), len(theirs)) >= need and bound(at, point(theirs)) >= need:
                        a, b = (own, theirs) if len(own) < len(theirs) else (theirs, own)
                        place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                        if np.count_nonzero(b[place] == a) >= need:
                            found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["x", "y"])

    return rows.repartition("x", "salt").sortWithinPartitions("x", "salt", "member", "y").mapInArrow(scan, "x long, y long")


class _Node:
    """A leaf (rows: size, key, comp, points) or an inner node (children) of the tree: least and greatest size and component, and maxima."""

    __slots__ = ("children", "comps", "rows", "sizes", "top")

    def __init__(self, children: list[_Node] | None = None, rows: tuple[np.ndarray, ...] | None = None):
        self.children, self.rows = children, rows
        if rows is not None:
            size, _, comp, points = rows
            self.sizes, self.comps, self.top = (int(size[0]), int(size[-1])), (int(comp.min()), int(comp.max())), points.max(0)
        else:
            n = min(len(c.top) for c in children)
            self.sizes = children[0].sizes[0], children[-1].sizes[1]
            self.comps = min(c.comps[0] for c in children), max(c.comps[1] for c in children)
            self.top = np.max([folded(c.top, n) for c in children], 0)


def grown(size: np.ndarray, key: np.ndarray, comp: np.ndarray, points: list[np.ndarray]) -> _Node | None:
    """The root over points sorted by size."""
    nodes = []
    for a in range(0, len(size), LEAF):
        own = points[a : a + LEAF]
        n = min(map(len, own))
        nodes.append(_Node(rows=(size[a : a + LEAF], key[a : a + LEAF], comp[a : a + LEAF], np.stack([folded(p, n) for p in own]))))
    while len(nodes) > 1:
        nodes = [_Node(children=nodes[a : a + FAN]) for a in range(0, len(nodes), FAN)]
    return nodes[0] if nodes else None


def met(a: _Node, b: _Node, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of points (keys) below a and b, of different components, that pass all bounds; below one node if a is b."""
    if a.comps[0] == a.comps[1] == b.comps[0] == b.comps[1]:
        return
    if 100 * a.sizes[1] < percent * b.sizes[0] or 100 * b.sizes[1] < percent * a.sizes[0]:
        return
    if bound(a.top, b.top) < _needed(a.sizes[0] + b.sizes[0], percent):
        return
    if a.rows is not None and b.rows is not None:
        yield from _leaf_pairs(a.rows, b.rows, a is b, percent)
    elif a is b:
        for i, c in enumerate(a.children):
            for d in a.children[i:]:
                yield from met(c, d, percent)
    else:
        split, other = (a, b) if b.rows is not None or (a.rows is None and a.sizes[1] - a.sizes[0] >= b.sizes[1] - b.sizes[0]) else (b, a)
        for c in split.children:
            yield from met(c, other, percent)


def _leaf_pairs(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], same: bool, percent: int) -> Iterator[tuple[int, int]]:
    n = min(a[3].shape[1], b[3].shape[1])
    left, right = folded(a[3], n), folded(b[3], n)
    for i in range(len(left)):
        need = _needed(a[0][i] + b[0], percent)
        ok = (a[2][i] != b[2]) & (np.minimum(a[0][i], b[0]) >= need)
        if same:
            ok[: i + 1] = False
        j = np.flatnonzero(ok)
        if len(j):
            j = j[np.minimum(left[i], right[j]).sum(1, dtype=np.int64) >= need[j]]
            for t in j.tolist():
                yield int(a[1][i]), int(b[1][t])


class _Rows:
    """Points of whole trees, sorted (tree, i, j, size): those of at most a leaf are compared together, each other one grows its nodes."""

    def __init__(self, columns: list[pa.Array]):
        self.tree, self.i, self.j, self.side, self.size, self.key, self.comp = (c.to_numpy() for c in columns[:7])
        point = columns[7]
        self.at = np.frombuffer(point.buffers()[1], np.int32)[point.offset : point.offset + len(point) + 1].astype(np.int64)
        self.data = np.frombuffer(point.buffers()[2], np.uint8)
        self.n = np.diff(self.at)

    def starts(self) -> np.ndarray:
        new = (self.tree[1:] != self.tree[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        return np.flatnonzero(np.append(True, new))

    def pairs(self, percent: int) -> list[tuple[int, int]]:
        start = self.starts()
        count = np.diff(np.append(start, len(self.tree)))
        small = count <= LEAF
        found = self._near(np.repeat(small, count), np.repeat(np.arange(len(start)), count), percent)
        for a, b in zip(start[~small].tolist(), (start + count)[~small].tolist(), strict=True):
            if self.i[a] == self.j[a]:
                root = self._root(np.arange(a, b))
                found += met(root, root, percent)
            else:  # two blocks
                roots = [self._root(a + np.flatnonzero(self.side[a:b] == s)) for s in (0, 1)]
                if None not in roots:
                    found += met(*roots, percent)
        return found

    def _root(self, rows: np.ndarray) -> _Node | None:
        return grown(self.size[rows], self.key[rows], self.comp[rows], [self.data[self.at[r] : self.at[r + 1]] for r in rows.tolist()])

    def _near(self, ok: np.ndarray, tree: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Pairs of rows of one tree, both in `ok`, that pass sizes, components and the bound: neighbours at each distance in turn."""
        found = []
        for lag in range(1, LEAF):
            i = np.flatnonzero(ok[:-lag] & (tree[:-lag] == tree[lag:])) if lag < len(tree) else []
            if not len(i):
                break
            j = i + lag
            need = _needed(self.size[i] + self.size[j], percent)
            keep = (self.comp[i] != self.comp[j]) & (np.minimum(self.size[i], self.size[j]) >= need) & ((self.i[i] == self.j[i]) | (self.side[i] != self.side[j]))
            i, j, need = i[keep], j[keep], need[keep]
            for n, m in set(zip(self.n[i].tolist(), self.n[j].tolist(), strict=True)):
                these = np.flatnonzero((self.n[i] == n) & (self.n[j] == m))
                for part in np.array_split(these, max(1, len(these) * (n + m) >> 22)):
                    a, b = (self.data[self.at[x[part], None] + np.arange(k)] for x, k in ((i, n), (j, m)))
                    part = part[bound(a, b) >= need[part]]
                    found += zip(self.key[i[part]].tolist(), self.key[j[part]].tolist(), strict=True)
        return found


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (tree, size, class, comp) with the two blocks (i, j) that a task compares and the row's side.

    A tree of at most BLOCK points is one block. Else its largest component, whose points needn't be compared with each other, is dealt
    into blocks -1, -2, ... and the rest into blocks 0, 1, ...; a row goes wherever its block is compared with another.
    """
    count = rows.groupBy("tree", "comp").count()
    large = count.groupBy("tree").agg(F.sum("count").alias("all"), F.max("count").alias("most"), F.max_by("comp", F.struct("count", "comp")).alias("main"))
    large = large.where(F.col("all") > BLOCK).select("tree", "main", F.ceil(F.col("most") / BLOCK).alias("bd"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("bm"))
    joined = rows.join(staged(large, "large"), "tree", "left")  # of two plain tables, of which Spark can split a large tree

    def to(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))

    own = F.pmod(F.xxhash64("class"), F.when(F.col("comp") == F.col("main"), F.col("bd")).otherwise(F.col("bm")))
    main = F.transform(upto("bm"), lambda i: to(i, -1 - own, F.lit(1)))
    rest = F.concat(F.transform(upto("bd"), lambda k: to(own, -1 - k, F.lit(0))), F.transform(upto("bm"), lambda k: to(F.least(own, k), F.greatest(own, k), own > k)))
    blocks = F.when(F.col("main").isNull(), F.array(to(F.lit(0), F.lit(0), F.lit(0)))).when(F.col("comp") == F.col("main"), main).otherwise(rest)
    return joined.select("tree", "size", "class", "comp", F.explode(blocks).alias("b")).select("tree", "b.i", "b.j", "b.side", "size", "class", "comp")


def _tree_pairs(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of classes of different components in one tree that pass the bounds of the nodes and the points."""
    points = known.select(F.col("class").alias("c"), "point").hint("merge")
    rows = _blocks(rows).join(points, F.col("class") == F.col("c")).select("tree", "i", "j", "side", "size", "class", "comp", "point")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] | None = None  # what may be the beginning of a tree's two blocks

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (min, max)], ["x", "y"])

        for batch in batches:
            columns = batch.columns if held is None else [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns, strict=True)]
            end = int(_Rows(columns).starts()[-1])
            held = [c.slice(end) for c in columns]
            if end and (found := _Rows([c.slice(0, end) for c in columns]).pairs(percent)):
                yield out(found)
        if held is not None and len(held[0]) and (found := _Rows(held).pairs(percent)):
            yield out(found)

    return rows.repartition("tree", "i", "j").sortWithinPartitions("tree", "i", "j", "size", "class").mapInArrow(scan, "x long, y long")


def _shared(size: Column, percent: int) -> Column:
    """Cells that a set of this size shares with any set it links with."""
    return F.least(F.lit(SHARED), F.ceil(F.lit(percent) * size / 100))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (x, y): node and its component, the least node. Alternates large and small stars until nothing changes."""

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))

    edges = staged(links.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        unstage(edges)
        low = least(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = staged(small, "small")
        unstage(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            parts = staged(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "parts")
            unstage(edges)
            return parts
        before = now


def _texts_of(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, text (z: packed, bytes: its size) and point of the wanted classes. Any text of a class stands for it, as their sets are equal."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, pack = _Once(), zstandard.ZstdCompressor(level=1)
        for part in slices(batches, "text"):
            s = Sets(part.column(0), n)
            own = np.flatnonzero(once(s.key) & (s.size > 0))
            raw = [t.encode() for t in part.column(0).take(pa.array(own)).to_pylist()]
            points = pa.array([point(s.of(i)).tobytes() for i in own.tolist()], pa.binary())
            columns = [pa.array(s.key[own]), pa.array([len(t) for t in raw], pa.int64()), pa.array([pack.compress(t) for t in raw], pa.binary()), points]
            yield pa.RecordBatch.from_arrays(columns, ["class", "bytes", "z", "point"])

    rows = texts.select("text").mapInArrow(scan, "class long, bytes long, z binary, point binary")
    return rows.join(wanted.hint("merge"), "class", "left_semi").dropDuplicates(["class"])


def _links(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame]:
    """ids (id, size, class: a row for each row of docs) and links (x, y) of classes: all of them, or as many as join the components."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    points = staged(dealt(texts, frequent_words(texts), n, percent), "points")
    ids = staged(points.where("size >= 0").select("id", "size", "class"), "ids")
    met_in = staged(_members(points), "met")
    unstage(points)
    enough = met_in.groupBy("class").agg(F.count("*").alias("cells"), F.first("size").alias("of")).where(F.col("cells") >= _shared(F.col("of"), percent))
    members = staged(met_in.join(enough.select("class", (F.col("cells") / F.col("of")).cast("float").alias("part")).hint("merge"), "class"), "members")
    unstage(met_in)
    known = staged(_texts_of(texts, members.select("class").distinct(), n), "known")
    if every:
        placed = staged(members.select("cell", "size", "class", F.col("class").alias("comp")), "placed")
        stars = links = None
    else:
        stars = staged(_stars(members, percent), "stars")
        verified = staged(_verified(stars, known, n, percent), "links")
        links = components(verified)
        unstage(verified)
        placed = staged(members.join(links.hint("merge"), F.col("class") == F.col("node"), "left").select("cell", "size", "class", F.coalesce("component", "class").alias("comp")), "placed")
    unstage(members)
    open_cells = placed.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("cell", F.col("low").alias("tree"))
    # cells whose least component is the same are one tree: a class that shares many cells with a group comes into it once
    rows = staged(placed.join(open_cells.hint("merge"), "cell").select("tree", "size", "class", "comp").distinct(), "rows")
    unstage(placed)
    rest = _tree_pairs(rows, known, percent).distinct()
    if stars is not None:
        rest = rest.join(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    rest = staged(rest, "rest")
    unstage(rows, *([stars] if stars is not None else []))
    found = staged(_verified(rest, known, n, percent), "links")
    unstage(rest, known)
    return ids, found if links is None else found.unionByName(links.select(F.col("node").alias("x"), F.col("component").alias("y")))


def join_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, n_shingles (size of its set) and component_id, the smallest id that links of a Jaccard
    similarity of percent / 100 or more reach from it, its own included."""
    with tracked() as made:
        ids, links = _links(docs, n, percent, id_col, text_col, every=False)
        classes = ids.where("size > 0").groupBy("class").agg(F.min("id").alias("least"))
        named = components(links).join(classes.hint("merge"), F.col("node") == F.col("class"))
        least = named.groupBy("component").agg(F.min("least").alias("of_component"))
        named = named.join(least, "component").select(F.col("node"), "of_component")
        final = classes.join(named, F.col("class") == F.col("node"), "left").select(F.col("class").alias("k"), F.coalesce("of_component", "least").alias("component_id"))
        final = staged(final, "final")  # a join of two plain tables, of which Spark can split a full class
    unstage(*[t for t in made if t is not ids and t is not final])
    rows = ids.join(final.hint("merge"), F.col("class") == F.col("k"), "left")
    return rows.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def join_links(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link: pairs (left_class, right_class) of classes, and for each row of docs its id, n_shingles, class_id (hash of its set) and
    n_links, the rows that it links with (copies of its own set included). Work grows with the square of a group of near copies; where
    only groups are asked for, take join_components."""
    ids, links = _links(docs, n, percent, id_col, text_col, every=True)
    links = staged(links.distinct(), "every-link")
    copies = ids.where("size > 0").groupBy("class").agg(F.count("*").alias("copies"))
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    theirs = both.join(copies, F.col("y") == F.col("class")).groupBy("x").agg(F.sum("copies").alias("others"))
    counts = copies.join(theirs, F.col("class") == F.col("x"), "left").select(F.col("class").alias("k"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    rows = ids.join(counts, F.col("class") == F.col("k"), "left")
    rows = rows.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("class").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
    return links.select(F.col("x").alias("left_class"), F.col("y").alias("right_class")), rows


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_components(docs)


QUERIES = {"op1_ngram_join": op1_ngram_join}
SQL: dict[str, str] = {}
