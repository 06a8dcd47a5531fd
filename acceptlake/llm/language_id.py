"""Language ID by rank-order profiles: a document's most frequent character n-grams against each language's, by out-of-place distance.

Texts are lower-cased; everything that is no letter separates words. The n-grams have one to three characters, a word's borders
included. A language's profile is its PROFILE most frequent n-grams, learned from labelled documents: at most about
TRAIN_DOCS of each language, drawn by a digest of the id; the bound is a parameter, the counts that set the rates cover all rows.
A document's n-grams are counted over its whole text and ranked, ties going to those that a profile holds and then to the first by code
point. An n-gram that no profile holds keeps its place, and as it is equally out of place for every language, the score leaves it out.

Null, empty and letterless texts are `und` with score 0. Ties between languages go to the first by code point. Without any
labelled text all is `und`. A text whose letters no profile knows gets the first language at score 0. An empty table gives an empty
result; a very long text is handled in a slice of its own. Repeated rows each get a row; columns that share a name with a result column are replaced by it, and all
others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, restored, slices, staged, unstage

TRAIN_DOCS, PROFILE = 3_000, 400
#: Counts (texts times n-grams of the profiles) that are held at once.
COUNTS = 1 << 20
#: Languages beyond this number are refused: the profiles are broadcast, PROFILE n-grams each.
MAX_LANGUAGES = 1_000
RESULT = (T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False))
_PLANES = 0x30000
_SPACE = 0x20


class _Letters:
    """Lower case and letters by code point."""

    lower: np.ndarray | None = None
    is_letter: np.ndarray

    @classmethod
    def load(cls) -> None:
        if cls.lower is None:
            chars = [chr(c) for c in range(_PLANES)]
            cls.is_letter = np.array([c.isalpha() for c in chars])
            cls.lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.int64)


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, words parted by one space each; the text each belongs to; whether a text has a letter."""
    _Letters.load()
    texts = [t or "" for t in texts]
    points = np.frombuffer(("".join(f" {t}" for t in texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    sizes[-1] += 1
    doc = np.repeat(np.arange(len(texts)), sizes)
    low = np.minimum(points, _PLANES - 1)
    letter = np.where(points < _PLANES, _Letters.is_letter[low], points < 0x323B0)
    points = np.where(letter, np.where(points < _PLANES, _Letters.lower[low], points), _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    return points[keep], doc[keep], has


def _grams(code: np.ndarray, doc: np.ndarray, space: int, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the 1-, 2- and 3-grams of a row of codes, and their texts. A key is the base-`base` number of the codes, each plus one."""
    letter = code != space
    one = code + 1
    yield one[letter], doc[letter]
    two = one[:-1] * base + one[1:]
    ok = letter[:-1] | letter[1:]
    yield two[ok], np.where(letter[:-1], doc[:-1], doc[1:])[ok]
    ok = letter[1:-1]
    yield (two[:-1] * base + one[2:])[ok], doc[1:-1][ok]


_WIDE = 1 << 21


def profiles(docs: DataFrame, labelled: Column, lang_col: str, text_col: str, id_col: str, train_docs: int, size: int) -> list[tuple[str, int, int]]:
    """(language, n-gram, place) for each language's most frequent n-grams."""
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = staged(rows.groupBy("lang").count(), "langs")
    if (n := counts.count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MAX_LANGUAGES}")
    rate = F.lit(float(train_docs)) / F.col("count") * F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64(F.lit("train"), F.coalesce("id", F.lit(""))), F.lit(1 << 30)) < rate).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            names, tags = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
            code, doc, _ = _letters(part.column(1).to_pylist())
            for key, of in _grams(code, doc, _SPACE, _WIDE):
                for tag, lang in enumerate(names):
                    gram, n = np.unique(key[tags[of] == tag], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = [(r.lang, r.gram, r.place) for r in grams.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect()]
    unstage(counts)
    return found


class _Ranker:
    """Out-of-place distance to every profile; the n-grams are looked up by the codes of the profiles' own characters."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        grams = sorted({r[1] for r in rows})
        parts = [[p - 1 for p in (g // _WIDE**2, g // _WIDE % _WIDE, g % _WIDE) if p] for g in grams]
        points = sorted({p for x in parts for p in x} | {_SPACE})
        self.code = np.zeros(_PLANES, np.int64)
        self.code[[p for p in points if p < _PLANES]] = [i + 1 for i, p in enumerate(points) if p < _PLANES]
        self.base, self.space = len(points) + 2, points.index(_SPACE) + 1
        keys = []
        for x in parts:
            key = 0
            for p in x:
                key = key * self.base + (int(self.code[p]) if p < _PLANES else 0) + 1
            keys.append(key)
        self.n = len(grams)
        self.table = np.full(self.base**3, -1, np.int32) if self.base**3 <= 1 << 25 else None
        if self.table is not None:
            self.table[keys] = np.arange(self.n)
        self.order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[self.order]
        at = {g: i for i, g in enumerate(grams)}
        self.place = np.full((len(self.langs), self.n), -1, np.int64)
        for lang, gram, place in rows:
            self.place[self.langs.index(lang), at[gram]] = place - 1

    def find(self, key: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[key]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.order[i], -1)

    @staticmethod
    def _before(counts: np.ndarray, key: np.ndarray, of: np.ndarray) -> np.ndarray:
        """For each text and n-gram of the profiles, how many other n-grams (key, of: their texts) the text holds more often."""
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))) if len(key) else np.zeros(0, np.int64)
        often = np.diff(np.append(start, len(key)))
        rows = np.arange(len(counts))
        place = np.sort((of[start] << 32) | ((1 << 32) - 1 - often))
        i, j = np.nonzero(counts)
        out = np.zeros_like(counts)
        out[i, j] = np.searchsorted(place, (i << 32) | ((1 << 32) - 1 - counts[i, j])) - np.searchsorted(place, rows << 32)[i]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        points, doc, has = _letters(texts)
        code = np.where(points < _PLANES, self.code[np.minimum(points, _PLANES - 1)], 0)
        n = len(texts)
        counts = np.zeros(n * self.n, np.int64)
        strange, strange_of = [], []  # n-grams that no profile holds, by their own characters
        for (key, of), (wide, _) in zip(_grams(code, doc, self.space, self.base), _grams(points, doc, _SPACE, _WIDE), strict=True):
            gram = self.find(key)
            ok = gram >= 0
            counts += np.bincount(of[ok] * self.n + gram[ok], minlength=n * self.n)
            strange.append(wide[~ok])
            strange_of.append(of[~ok])
        counts = counts.reshape(n, self.n)
        ranks = np.empty_like(counts)
        np.put_along_axis(ranks, np.argsort(-counts, axis=1, kind="stable"), np.arange(self.n)[None, :], axis=1)
        ranks += self._before(counts, np.concatenate(strange), np.concatenate(strange_of))
        in_doc = (counts > 0) & (ranks < self.size)
        far = np.stack([(np.where(p >= 0, np.minimum(np.abs(ranks - p), self.size), self.size) * in_doc).sum(1) for p in self.place], 1)
        best = far.argmin(1)
        most = self.size * in_doc.sum(1)
        score = np.where(has & (most > 0), 1 - far[np.arange(n), best] / np.maximum(most, 1), 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], score


def identify(docs: DataFrame, labelled: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score; learned from the rows for which `labelled` holds and that have a language."""
    rows = profiles(docs, labelled, lang_col, text_col, id_col, train_docs, size)
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    names = [f.name for f in RESULT]
    texts = carried(docs, text_col, *names, text=F.col(f"`{text_col}`"))
    made: list[_Ranker] = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made and shared.value:
            made.append(_Ranker(shared.value, size))
        most = max(1, COUNTS // max(1, made[0].n)) if made else COUNTS
        for big in slices(batches, "text"):
            for a in range(0, big.num_rows, most):
                part = big.slice(a, most)
                strings = part.columns[-1].to_pylist()
                langs, score = made[0].predict(strings) if made else (["und"] * len(strings), np.zeros(len(strings)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, *names])

    out = texts.mapInArrow(scan, T.StructType([*texts.schema.fields, *RESULT]))
    return out.select(*restored(docs, *names, **{text_col: F.col("text")}), *names)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = identify(docs, remainder(F.col("doc_id")) != 2)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
