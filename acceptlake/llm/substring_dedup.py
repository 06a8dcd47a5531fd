"""Substring dedup by De Bruijn compaction of token k-mers.

Every run of `window` words is an edge of the De Bruijn graph whose nodes are the runs one word shorter. Edges are dealt out by
minimizer: of the sub-runs of `anchor` words in an edge, the one with the least hash decides where the edge goes, so equal edges
of any documents meet, and neighbouring edges with the same minimizer travel together (about one row for every four and a half edges,
with a 48-bit print for each edge beside the 64-bit hash of its minimizer). Where they meet, an edge is named by the smallest document that
it starts in: its source coordinate (document and word). Edges that no smaller document has are no repeats and end there.

The repeated edges are then compacted. Consecutive edges of a document whose source coordinates run on in step are one path (`spans`,
by Spark windows). In source coordinates, a node at which some span begins or ends is one where documents part or meet, and the
stretches between such nodes are the unbranched paths of the repeated graph (`unitigs`, with how many documents' spans run through them).

Each span is verified: a Spark join brings the spans to the texts of both ends, and the words at the document's and at the source's coordinates
must have the same 128-bit digest. Documents with a span that fails (its print stood for other words) are matched again by
another hash until none fails, so no prints decide what is removed.

Copies of a path inside one task are settled there and pass the exchange under scattered keys, so a passage that a third of
all documents share doesn't fill one task; what does meet is streamed in sorted order with one entry for each different edge.

An edge is removed if it also starts in a document with a smaller doc_id. Null or empty texts, and texts shorter than a
window, keep all their words; an empty table gives an empty result; a very long text is handled in a slice of its own. Rows without an id
are neither sources nor cut. Rows that repeat an id aren't sources for each other: repeated rows stay alike, and rows that share an id but not
the text are told apart by a 16-bit print of the text. Of equal sources any of the smaller documents may be named.
Columns that share a name with a result column are replaced by it; all others pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORDS, Words, carried, mix, restored, slices, span_hashes, staged, unstage

WINDOW, ANCHOR = 13, 6
#: Bits of an edge's print in the first round; later rounds take all 64 of another hash.
PRINT_BITS = 48
#: Rounds after which something else than chance must be wrong.
MAX_ROUNDS = 20
#: Repeated paths that a task remembers to settle their copies.
REMEMBERED = 1 << 20
_U = np.uint64
_SETTLED = 15  # in the offset's place: the row is no path but a span that is settled already
_SPAN = T.StructType([T.StructField("first_word", T.IntegerType(), False), T.StructField("n_words", T.IntegerType(), False), T.StructField("source_id", T.LongType(), False), T.StructField("source_word", T.IntegerType(), False)])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_removed", T.LongType(), False),
    T.StructField("removed_spans", T.ArrayType(_SPAN, False), False),
    T.StructField("kept_sha256", T.StringType(), False),
    T.StructField("kept_text", T.StringType(), True),
])


def _print16(w: Words, docs: np.ndarray) -> np.ndarray:
    return (w.whole(docs) >> _U(48)).astype(np.int64)


def _tags(w: Words, n: int) -> np.ndarray:
    """Print of each text; 0 without words."""
    out = np.zeros(n, np.int64)
    there = np.flatnonzero(w.count > 0)
    out[there] = _print16(w, there)
    return out


def _print_bytes(h: np.ndarray, round_: int) -> np.ndarray:
    """Prints of edges, a row of bytes each."""
    p = h if round_ else (h >> _U(16)) & _U((1 << PRINT_BITS) - 1)
    return p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if round_ else 6]


def _prints(data: np.ndarray, round_: int) -> np.ndarray:
    n = 8 if round_ else 6
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = data.reshape(-1, n)
    return out.reshape(-1).view("<u8")


def paths(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, round_: int = 0) -> DataFrame:
    """Runs of edges: a (hash of the minimizer), d (document), at (text print, first word, offset of the minimizer), f (edge prints)."""
    if not 1 <= window - anchor + 1 <= 14:
        raise ValueError("the minimizer's offset must be 0 to 13")

    def binary(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(rows.tobytes())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # runs, their smallest document in this task and its word
        for part in slices(batches, "text"):
            w = Words(part.column(1), SPACE_WORDS, lower=False)
            hashes = span_hashes(w.data ^ np.uint8(round_ & 255), w.start, w.end) if round_ else w.hash
            i, h = w.runs(window, hashes)
            if not len(i):
                continue
            ids = part.column(0).to_numpy()
            sub = np.zeros(len(w.hash), np.uint64)
            k, kh = w.runs(anchor, hashes)
            sub[k] = kh
            least, place = sub[i], i.copy()
            for t in range(1, window - anchor + 1):
                less = sub[i + t] < least
                least[less], place[less] = sub[i + t][less], (i + t)[less]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1] + 1) | (place[1:] != place[:-1])
            first = np.flatnonzero(new)
            stop = np.append(first[1:], len(i))
            doc = w.doc[i[first]]
            d, word = ids[doc], i[first] - w.first[doc]
            at = (_tags(w, part.num_rows)[doc] << 44) | (word << 4) | (place[first] - i[first])
            # a run is known by its first and last edge; all but the smallest document's are settled here
            key = mix(h[first] ^ mix(h[stop - 1] + (stop - first).astype(np.uint64)))
            order = np.lexsort((d, key))
            head = np.ones(len(order), bool)
            head[1:] = key[order][1:] != key[order][:-1]
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            src, src_word = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            src[order], src_word[order] = d[lead], word[lead]
            several = np.append(head[1:], True) < head  # heads that have copies here
            heads = order[several]
            # the smallest so far of each run that has copies in a slice (known and these, sorted by run and document)
            keys, ds, words = (np.concatenate([x, y[heads]]) for x, y in zip(known, (key, d, word), strict=True))
            by = np.lexsort((ds, keys))
            by = by[np.append(True, keys[by][1:] != keys[by][:-1])[: len(by)]]
            known = tuple(x[by] for x in (keys, ds, words))
            if len(heads):
                spot = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
                hit = (known[0][spot] == key) & (known[1][spot] < src)
                src[hit], src_word[hit] = known[1][spot[hit]], known[2][spot[hit]]
            if len(known[0]) > REMEMBERED:
                known = tuple(x[:0] for x in known)
            done = d > src
            live = ~done
            take = np.repeat(live, stop - first)
            f = binary(_print_bytes(h[take], round_), np.cumsum((stop - first)[live] * (8 if round_ else 6)))
            yield pa.RecordBatch.from_arrays([pa.array(least[first][live].view(np.int64)), pa.array(d[live]), pa.array(at[live]), f], ["a", "d", "at", "f"])
            if done.any():
                row = np.zeros(int(done.sum()), np.dtype([("n", "<i4"), ("word", "<i4"), ("id", "<i8")]))
                row["n"], row["word"], row["id"] = (stop - first)[done], src_word[done], src[done]
                scattered = mix(d[done].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + at[done].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(scattered.view(np.int64)), pa.array(d[done]), pa.array(at[done] | _SETTLED), binary(row, np.arange(16, 16 * len(row) + 1, 16))], ["a", "d", "at", "f"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "a long, d long, at long, f binary")


class _Meeting:
    """Matches edges in a stream of runs sorted by minimizer and document; keeps the smallest source of each edge of the last minimizer."""

    def __init__(self) -> None:
        self.a, self.key, self.d, self.word = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, a: np.ndarray, d: np.ndarray, at: np.ndarray, n: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, ...]:
        """Matched pieces: row, first word, edges, source document, source word."""
        row = np.repeat(np.arange(len(a)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        offset = (at & 15)[row] - j + 16
        word = ((at >> 4) & ((1 << 40) - 1))[row] + j
        key = mix(a.view(np.uint64)[row] ^ mix(prints + offset.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        own = len(self.key) if self.a == a[0] else 0
        keys, ds, words = np.concatenate([self.key[:own], key]), np.concatenate([self.d[:own], d[row]]), np.concatenate([self.word[:own], word])
        order = np.argsort(keys, kind="stable")
        head = np.ones(len(order), bool)
        head[1:] = keys[order][1:] != keys[order][:-1]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        source = np.empty(len(order), np.int64)
        source[order] = lead
        last = np.concatenate([np.full(own, self.a == a[-1]), a[row] == a[-1]])
        keep = order[head]
        keep = keep[last[keep]]
        self.a, self.key, self.d, self.word = a[-1], keys[keep], ds[keep], words[keep]
        source = source[own:]
        hit = np.flatnonzero(d[row] > ds[source])
        src, src_word = ds[source[hit]], words[source[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1]) | (src[1:] != src[:-1]) | (src_word[1:] != src_word[:-1] + 1)
        first = np.flatnonzero(new)
        return row[hit[first]], word[hit[first]], np.diff(np.append(first, len(hit))), src[first], src_word[first]


def matched(rows: DataFrame, round_: int = 0) -> DataFrame:
    """Pieces of documents that also start in a smaller document: d, tag (text print), word, edges, source, source_word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = _Meeting()
        names = ["d", "tag", "word", "edges", "source", "source_word"]

        def out(d, at, word, n, src, src_word):
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((d, at >> 44, word, n, src, src_word), kinds, strict=True)], names)

        for batch in batches:
            a, d, at = (batch.column(c).to_numpy() for c in range(3))
            f = batch.column(3)
            places = np.frombuffer(f.buffers()[1], np.int32)[f.offset : f.offset + len(f) + 1].astype(np.int64)
            data = np.frombuffer(f.buffers()[2], np.uint8) if len(f) else np.zeros(0, np.uint8)
            done = (at & 15) == _SETTLED
            inside = np.repeat(done, np.diff(places))
            data = data[places[0] : places[-1]]
            if done.any():
                row = np.frombuffer(data[inside].tobytes(), np.dtype([("n", "<i4"), ("word", "<i4"), ("id", "<i8")]))
                yield out(d[done], at[done], (at[done] >> 4) & ((1 << 40) - 1), row["n"], row["id"], row["word"])
            live = ~done
            if live.any():
                n = np.diff(places)[live] // (8 if round_ else 6)
                piece = meeting.pieces(a[live], d[live], at[live], n, _prints(data[~inside], round_))
                yield out(d[live][piece[0]], at[live][piece[0]], *piece[1:])

    met = rows.repartition("a").sortWithinPartitions("a", "d", "at")
    return met.mapInArrow(scan, "d long, tag int, word int, edges int, source long, source_word int")


def compacted(pieces: DataFrame) -> DataFrame:
    """Pieces of one document and source that run on in step, joined: d, tag, word, edges, source, source_word."""
    lane = ["d", "tag", "source", "step"]
    end = F.col("word") + F.col("edges")
    order = Window.partitionBy(*lane).orderBy("word", "edges")
    rows = pieces.withColumn("step", F.col("source_word") - F.col("word"))
    rows = rows.withColumn("reached", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("word") <= F.col("reached"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*lane, "run").agg(F.min("word").alias("word"), F.max(end).alias("end"), F.min("source_word").alias("source_word"))
    return runs.select("d", "tag", "word", (F.col("end") - F.col("word")).alias("edges"), "source", "source_word")


def unitigs(spans: DataFrame) -> DataFrame:
    """The unbranched paths of the repeated graph in source coordinates: source, source_word, edges, copies (spans that run through).

    Where some span begins or ends, the node before the edge branches: some documents come or leave there. Counts are added up for each node
    before they meet, so a source that many share brings a row for each of its branching nodes.
    """
    ends = spans.select("source", F.col("source_word").alias("at"), F.lit(1).alias("change")).unionByName(spans.select("source", (F.col("source_word") + F.col("edges")).alias("at"), F.lit(-1).alias("change")))
    nodes = ends.groupBy("source", "at").agg(F.sum("change").alias("change"))
    order = Window.partitionBy("source").orderBy("at")
    through = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = nodes.select("source", "at", through.alias("copies"), F.lead("at").over(order).alias("next")).where("copies > 0")
    return rows.select("source", F.col("at").alias("source_word"), (F.col("next") - F.col("at")).alias("edges"), "copies")


def _joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (kept) words of a slice, each with one space behind it, and where each begins, with the end."""
    start, end = (w.start, w.end) if keep is None else (w.start[keep], w.end[keep])
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1], size) + inside] = w.raw[np.repeat(start, size) + inside]
    return out, at


def _digests(docs: DataFrame, spans: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """id, tag, word, edges, digest of the words at both ends of the spans, in every text of that id that is long enough."""
    wanted = spans.select(F.col("d").alias("w_id"), "word", "edges").unionByName(spans.select(F.col("source").alias("w_id"), F.col("source_word").alias("word"), "edges")).distinct()
    wanted = staged(wanted.groupBy("w_id").agg(F.collect_list(F.struct("word", "edges")).alias("wanted")), "wanted")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted.hint("merge"), F.col("id") == F.col("w_id")).select("id", "text", "wanted")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = Words(part.column(1), SPACE_WORDS, lower=False)
            flat, at = _joined(w)
            data, tags = flat.tobytes(), _tags(w, part.num_rows)
            lists = part.column(2)
            edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            values = lists.flatten()
            word, edges = (values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(part.num_rows), np.diff(edge))
            a = w.first[row] + word
            b = a + edges + window - 1
            ok = b <= w.first[row + 1]
            row, word, edges, a, b = (x[ok] for x in (row, word, edges, a, b))
            digest = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(at[a].tolist(), (at[b] - 1).tolist(), strict=True)]
            ids = part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(tags[row], pa.int32()), pa.array(word, pa.int32()), pa.array(edges, pa.int32()), pa.array(digest, pa.binary())], ["id", "tag", "word", "edges", "digest"])

    out = staged(rows.mapInArrow(scan, "id long, tag int, word int, edges int, digest binary").distinct(), "digests")
    unstage(wanted)
    return out


def _unverified(spans: DataFrame, digests: DataFrame) -> DataFrame:
    """d of the spans whose words differ from those at the source."""
    own = digests.select(F.col("id").alias("d"), "tag", "word", "edges", F.col("digest").alias("own"))
    theirs = digests.select(F.col("id").alias("source"), F.col("word").alias("source_word"), "edges", F.col("digest").alias("own"), F.lit(1).alias("same")).distinct()
    checked = spans.join(own.hint("merge"), ["d", "tag", "word", "edges"], "left").join(theirs.hint("merge"), ["source", "source_word", "edges", "own"], "left")
    return checked.groupBy(*spans.columns).agg(F.max("same").alias("same")).where(F.col("same").isNull()).select("d").distinct()


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: d, tag, word, edges (windows), source, source_word."""

    def round_of(k: int) -> DataFrame:
        pieces = staged(matched(paths(docs, id_col, text_col, window, anchor, k), k), "pieces")
        spans = staged(compacted(pieces), "spans")
        unstage(pieces)
        return spans

    spans, k = round_of(0), 0
    open_ = spans
    while True:
        digests = _digests(docs, open_, window, id_col, text_col)
        failed = staged(_unverified(open_, digests), "failed")
        unstage(digests)
        if failed.isEmpty():
            unstage(failed)
            return spans
        k += 1
        if k > MAX_ROUNDS:
            raise RuntimeError("spans fail whatever the hash")
        again = round_of(k)
        open_ = staged(again.join(failed, "d", "left_semi"), "again")
        better = staged(spans.join(failed, "d", "left_anti").unionByName(open_), "spans")
        unstage(again, spans, failed)
        spans = better


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed, removed_spans (with source coordinates), kept_text and its digest."""
    texts = carried(docs, text_col, *RESULT.names, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`"))
    spans = repeated_spans(docs, window, anchor, id_col, text_col)
    lists = staged(spans.groupBy(F.col("d").alias("span_d")).agg(F.array_sort(F.collect_list(F.struct("word", "tag", "edges", "source", "source_word"))).alias("spans")), "lists")
    unstage(spans)
    joined = texts.join(lists.hint("merge"), F.col("id") == F.col("span_d"), "left").select("doc", "spans", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, found, texts = part.columns
            w = Words(texts, SPACE_WORDS, lower=False)
            gone = np.zeros(len(w.hash) + 1, np.int64)
            word, tag, edges, source, source_word = (x.to_numpy() for x in found.flatten().flatten())
            row = np.repeat(np.arange(part.num_rows), pc.fill_null(found.value_lengths(), 0).to_numpy())
            ok = tag == _tags(w, part.num_rows)[row]
            row, word, n, source, source_word = row[ok], word[ok], edges[ok] + window - 1, source[ok], source_word[ok]
            np.add.at(gone, w.first[row] + word, 1)
            np.add.at(gone, w.first[row] + word + n, -1)
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(x) for x in (word, n.astype(np.int32), source, source_word)], ["first_word", "n_words", "source_id", "source_word"]))
            gone = np.cumsum(gone)[:-1] > 0
            flat, at = _joined(w, ~gone)
            data = flat.tobytes()
            cut = at[np.concatenate([[0], np.cumsum(~gone)])[w.first]]
            out = [data[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            removed = np.bincount(w.doc[gone], minlength=part.num_rows)
            columns = [
                pa.array(w.count.astype(np.int64)),
                pa.array(removed.astype(np.int64)),
                spans,
                pa.array([hashlib.sha256(t).hexdigest() for t in out]),
                pa.array([None if null else t.decode("utf-8", "replace") for t, null in zip(out, texts.is_null().to_pylist(), strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([doc, texts, *columns], ["doc", "text", *RESULT.names])

    out = joined.mapInArrow(scan, T.StructType([joined.schema["doc"], joined.schema["text"], *RESULT.fields]))
    return out.select(*restored(docs, *RESULT.names, **{text_col: F.col("text")}), *RESULT.names)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS key FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
first AS (SELECT key, min(doc_id) AS least FROM win GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM win JOIN first USING (key) WHERE doc_id > least),
words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT words.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.p) AS text FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""

QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL = {"op9_substring_dedup": ORACLE}
