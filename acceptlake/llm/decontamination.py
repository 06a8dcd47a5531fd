"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams scans the token windows of training texts.

Texts and items are lower-cased in A-Z; words are runs of ASCII letters, digits and non-ASCII characters. A window is n
consecutive words of an item (a shorter item is one window of its own length). Every hash hit is verified on the words
themselves before it counts. Null and empty texts have no words, so they are never hit and a null or empty item has no
window. An item without an id hits as any other, but has no name in hit_items. Rows are judged one by one: repeated rows and
rows without an id keep their place, and ties don't arise. A very long text is scanned in a slice of its own. An empty table of documents
gives an empty result, an empty benchmark hits nothing. Where result columns are added, columns of the documents that
share a name with one are replaced by it; all others pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, Words, carried, restored, slices, staged, unstage

#: Windows that one broadcast holds at most; more benchmark windows are scanned in further rounds. Bytes of a usual window's words and items: a
#: longer one counts as several.
MAX_BROADCAST_WINDOWS, WINDOW_BYTES = 500_000, 256

RESULT = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType(), False), T.StructField("n_words", T.IntegerType(), False)]), False), False),
    T.StructField("hit_items", T.ArrayType(T.StringType(), False), False),
    T.StructField("clean_text", T.StringType(), True),
])


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: length in words, 64-bit hash, the words, and the items they come from."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = Words(part.column(1), ALNUM_WORDS, lower=True)
            items, rows = part.column(0).to_pylist(), []
            for d in range(part.num_rows):
                a, b = int(w.first[d]), int(w.first[d + 1])
                size = min(n, b - a)
                for i in range(a, b - size + 1 if size else a):
                    rows.append((size, w.bytes_of(i, i + size), items[d]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["size", "words", "item"])

    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, "size int, words binary, item string").groupBy("size", "words").agg(F.collect_set("item").alias("items"))


class _Windows:
    """Lookup by hash, then by the words; made once in each Python worker."""

    def __init__(self, rows: list[tuple[int, bytes, list[str]]]):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, dict[bytes, list[str]]]] = {}
        for size in sorted({r[0] for r in rows}):
            keys = {bytes(words): list(items) for s, words, items in rows if s == size}
            w = Words(pa.array([k.decode("utf-8", "surrogateescape") for k in keys], pa.string()), ALNUM_WORDS, lower=True)
            hashes = np.unique(w.runs(size)[1])
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_size[size] = (hashes, seen, keys)

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        for size, (hashes, seen, keys) in self.by_size.items():
            i, h = w.runs(size)
            maybe = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(maybe):
                place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                for k in i[maybe[hashes[place] == h[maybe]]].tolist():
                    if (items := keys.get(w.bytes_of(k, k + size))) is not None:
                        yield k, size, items


def _annotated(texts: DataFrame, rows: list) -> DataFrame:
    """texts (any columns, the last one `text`) with the columns of RESULT."""
    shared = texts.sparkSession.sparkContext.broadcast(rows)
    made: list[_Windows] = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(_Windows(shared.value))
        for part in slices(batches, "text"):
            column = part.columns[-1]
            w = Words(column, ALNUM_WORDS, lower=True)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for k, size, names in made[0].hits(w):
                d = int(w.doc[k])
                spans.setdefault(d, []).append((k, k + size))
                items.setdefault(d, set()).update(names)
            joined = {d: _joined(found) for d, found in spans.items()}
            n = part.num_rows
            found = [sorted(items.get(d, ())) for d in range(n)]
            yield pa.RecordBatch.from_arrays([*part.columns, *_columns(w, column, joined, found)], [*part.schema.names, *RESULT.names])

    return texts.mapInArrow(scan, T.StructType([*texts.schema.fields, *RESULT.fields]))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words that touch or overlap, made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _columns(w: Words, column: pa.Array, spans: dict[int, list[tuple[int, int]]], items: list[list[str]]) -> list[pa.Array]:
    """The columns of RESULT; spans: first word (of the slice) and the word behind the last, by text."""
    clean = {}
    for d, found in spans.items():
        at, out = int(w.at[d]), []
        for a, b in found:
            out.append(w.raw[at : w.start[a]].tobytes())
            at = int(w.end[b - 1])
        clean[d] = b"".join([*out, w.raw[at : w.at[d + 1]].tobytes()]).decode("utf-8", "replace")
    shown = [[{"first_word": a - int(w.first[d]), "n_words": b - a} for a, b in spans.get(d, ())] for d in range(len(column))]
    texts = pa.array([clean.get(d, t) for d, t in enumerate(column.to_pylist())], pa.string()) if clean else column
    kind = pa.list_(pa.struct([pa.field("first_word", pa.int32(), False), pa.field("n_words", pa.int32(), False)]))
    return [pa.array(w.count.astype(np.int64)), pa.array(shown, kind), pa.array(items, pa.list_(pa.string())), texts]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "annotate", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Find benchmark windows in documents.

    action "annotate" adds n_words, hit_spans, hit_items and clean_text (the text without hit words); "remove_spans" puts
    clean_text in the text's place; "drop_documents" keeps the documents without a hit. The last two return docs' columns, all as they were.
    The windows are measured before they are broadcast: each counts its words' bytes and the items that it names. Beyond max_broadcast windows of
    usual size they go in several rounds over the documents.
    """
    replaced = RESULT.names if action == "annotate" else ()
    texts = carried(docs, text_col, *replaced, text=F.col(f"`{text_col}`"))
    windows = staged(benchmark_windows(benchmark, n, item_col, item_text_col), "windows")
    rounds = max(1, -(-(windows.agg(F.sum(_usual())).first()[0] or 0) // max_broadcast))
    if rounds == 1:
        out = _annotated(texts, [tuple(r) for r in windows.toLocalIterator()])
    else:
        out = _in_rounds(texts, windows, rounds)
    unstage(windows)
    if action == "drop_documents":
        out = out.where(F.size("hit_spans") == 0)
    text = F.col("clean_text" if action == "remove_spans" else "text")
    return out.select(*restored(docs, *replaced, **{text_col: text}), *replaced)


def _usual() -> Column:
    """How many windows of usual size a window is: WINDOW_BYTES of words and items."""
    size = F.octet_length("words") + F.aggregate("items", F.lit(0), lambda t, x: t + F.octet_length(x) + 60)
    return F.greatest(F.lit(1), F.ceil(size / WINDOW_BYTES)).cast("long")


def _in_rounds(texts: DataFrame, windows: DataFrame, rounds: int) -> DataFrame:
    """Each round broadcasts the windows of one hash class and scans all documents; a row's hits are joined by a row number that is fixed first."""
    numbered = staged(texts.select("doc", F.monotonically_increasing_id().alias("row"), "text"), "numbered")
    spans = None
    for k in range(rounds):
        # a window that many items share is dealt out by its items
        parts = windows.withColumn("item", F.explode_outer("items")).where(F.pmod(F.xxhash64("words", "item"), F.lit(rounds)) == k)
        rows = [tuple(r) for r in parts.groupBy("size", "words").agg(F.collect_list("item").alias("items")).toLocalIterator()]
        found = staged(_annotated(numbered.select("row", "text"), rows).where(F.size("hit_spans") > 0).select("row", "hit_spans", "hit_items"), "hits")
        spans = found if spans is None else spans.unionByName(found)
    merged = spans.groupBy("row").agg(F.flatten(F.collect_list("hit_spans")).alias("gathered"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("gathered_items"))
    base = numbered.join(merged, "row", "left").select("doc", "gathered", "gathered_items", "text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, gathered, items, column = part.columns
            w = Words(column, ALNUM_WORDS, lower=True)
            spans = {d: _joined([(int(w.first[d]) + s["first_word"], int(w.first[d]) + s["first_word"] + s["n_words"]) for s in found]) for d, found in enumerate(gathered.to_pylist()) if found}
            yield pa.RecordBatch.from_arrays([doc, column, *_columns(w, column, spans, [x or [] for x in items.to_pylist()])], ["doc", "text", *RESULT.names])

    return base.mapInArrow(clean, T.StructType([base.schema["doc"], base.schema["text"], *RESULT.fields]))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["n_words"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS key
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS key
       FROM (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.r, dw.p, dw.size, iw.item FROM dw JOIN iw ON dw.key = iw.key AND dw.size = iw.size),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.names, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN s ON s.r = d.r
"""

QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL = {"op2_decontaminate": ORACLE}
