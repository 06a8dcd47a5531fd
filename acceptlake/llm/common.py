"""Helpers shared by the operators of this subpackage: shared scratch tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or in local mode without that setting a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="acceptlake-"))
    return _OWN[0]


#: Spark's own setting by which a query's shuffle files go when it has ended.
_CONF = threading.RLock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut and lost executors cost nothing that is done.

    The written table stands for df from here on, so the shuffle files that made it go at once and not when the driver's JVM happens
    to collect its garbage. df itself shouldn't be run again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _CONF:  # the setting is the session's; writes of several threads take turns at it
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._acceptlake_path = path
    for made in _TRACKED:
        made.append(out)
    return out


_TRACKED: list[list[DataFrame]] = []


@contextmanager
def tracked() -> Iterator[list[DataFrame]]:
    """The tables that are staged meanwhile, for those to be deleted that no later plan reads."""
    made: list[DataFrame] = []
    _TRACKED.append(made)
    try:
        yield made
    finally:
        _TRACKED.remove(made)


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._acceptlake_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, *replaced: str) -> Column:
    """df's columns but the replaced ones in one struct, so that no name of theirs can meet one that an operator uses."""
    kept = without(df, *replaced).columns
    return F.struct(*[df[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(None).alias("none"))


def unpacked(df: DataFrame, name: str, like: DataFrame, *replaced: str) -> list[Column]:
    """The packed columns of df again, in like's order."""
    return [F.col(name)[c].alias(c) for c in without(like, *replaced).columns]


def carried(docs: DataFrame, *replaced: str, **columns: Column) -> DataFrame:
    """docs' columns but the replaced ones packed as `doc`, beside these columns."""
    return docs.select(packed(docs, *replaced).alias("doc"), *[c.alias(n) for n, c in columns.items()])


def restored(like: DataFrame, *replaced: str, **given: Column) -> list[Column]:
    """like's columns but the replaced ones, in its order: the given ones, and the others out of `doc`."""
    return [given[c].alias(c) if c in given else F.col("doc")[c].alias(c) for c in without(like, *replaced).columns]


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column of that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result column is about to replace (names compare as Spark's resolver does, without case)."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


# ---------------------------------------------------------------- words in numpy

#: Text bytes that are handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def _byte_class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Words of [^\x20\x09-\x0D]+ over UTF-8 bytes.
SPACE_WORDS = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over UTF-8 bytes with A-Z lower-cased.
ALNUM_WORDS = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 64)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for x in (base, inverse):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[base] = have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer, so that any bits of a hash can be used."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another (null: none), and the places where each starts, with the end."""
    texts = pc.fill_null(texts, "")
    _, places, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each span."""
    power, back = _powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * back[start])


class Words:
    """Words of a slice of texts. first[i]:first[i+1] are those of text i; start and end are byte places in data; hash is 64 bit."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool):
        raw, at = text_bytes(texts)
        self.raw, self.at, self.data = raw, at, _LOWER[raw] if lower else raw
        inside = is_word[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = at[:-1][at[:-1] < len(raw)]
        begins[edges] = inside[edges]
        edges = edges[edges > 0]
        ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = span_hashes(self.data, self.start, self.end)

    def runs(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of n words inside one text, and the runs' hashes."""
        h = self.hash if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, back = _powers(_STEP, len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=total[1:])
        i = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :])
        return i, mix((total[i + n] - total[i]) * back[i] + _U(n))

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each of these texts, none of them empty."""
        power, back = _powers(_STEP, len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * power[: len(self.hash)], out=total[1:])
        a, b = self.first[docs], self.first[docs + 1]
        return mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))

    def bytes_of(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        d, s, e = self.data, self.start, self.end
        return b" ".join(d[s[i] : e[i]].tobytes() for i in range(a, b))


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds SLICE_BYTES of text, or one longer text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES, side="right"))
            b = max(b, a + 1)
            yield batch.slice(a, b - a)
            a = b
    pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it needs only
