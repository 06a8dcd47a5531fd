"""Token ids in Arrow file format: record batches of fixed-size lists, for zero-copy access to sequences of equal length.

Documents are put in ascending id order by range partitions; each partition encodes its texts and writes one pair of files:
`part-n.arrow` with columns `ids` (fixed-size list of the smallest unsigned type that holds the vocabulary) and `mask`
(fixed-size list of booleans, false on the padding after the last document of the file), and `part-n.docs.arrow` with doc_id,
start and n_tokens in the file. A file is written under a name of the task attempt and then moved, so that a task that runs again
leaves the same files. The files' own sizes, a row each, give the global starts by a window; ids never pass through the driver.

Encoding: byte-level pre-tokens never cross from a non-space into a following space or line break, nor from a letter into an
ASCII mark, so a text is cut there, and each different piece is encoded once by the tokenizers library and kept in a bounded cache;
texts with other runs of white space, or with a special token, are encoded whole, and so are all texts where the tokenizer isn't byte-level BPE. Null
and empty texts give the end id alone. Repeated rows are encoded each; null ids come first. Documents that share an id are in the order of a hash of the
text and then of the text, so the results don't depend on how the rows lay; ids that a third of all rows share are parted by that hash.
A very long text is a slice of its own; an empty table gives no files and an empty result. Only the id and the text are looked at, so other
columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, slices, span_hashes, staged, text_bytes, unstage

SEQUENCE, BATCH, FILE_BYTES = 2048, 256, 32 << 20
#: Different pieces whose ids a Python worker keeps (about 30 bytes each).
CACHE = 3_000_000
_U = np.uint64


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_LETTER = _table(lambda b: chr(b).isascii() and chr(b).isalpha())
_MARK = _table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum())
_BLANK = _table(lambda b: 9 <= b <= 13 or 0x1C <= b <= 0x20)
_WIDE_BLANKS = ["\u0085", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


class Encoder:
    """Ids of texts; one for each tokenizer in a Python worker, kept between tasks. Pieces are known by 64-bit hashes."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, dtype: np.dtype):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library, self.dtype = Tokenizer.from_file(path), dtype
        made = json.loads(self.library.to_str())
        before = made["pre_tokenizer"] or {}
        self.cuts = made["model"]["type"] == "BPE" and made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # one character stands for one byte
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place, self.n, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    @classmethod
    def at(cls, path: str, dtype: np.dtype) -> Encoder:
        key = (path, dtype.str)
        if key not in cls._made:
            cls._made[key] = cls(path, dtype)
        return cls._made[key]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces. Those that start with a space or line break and end in no blank are joined to longer texts, whose
        ids are parted by the bytes they stand for; the rest are encoded one by one."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        joins = np.array([p[0] in (10, 32) and not _BLANK[p[-1]] for p in pieces], bool)
        joined, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        for a in range(0, len(joined), 8192):
            part = joined[a : a + 8192]
            data = [pieces[i] for i in part]
            ids = self.whole([b"".join(data).decode()])[0]
            ends, stops = np.cumsum([len(p) for p in data]), np.cumsum(self.length[ids])
            cut = np.searchsorted(stops, ends)
            if cut[-1] == len(ids) - 1 and (stops[np.minimum(cut, len(ids) - 1)] == ends).all():
                found.append((keys[part], np.diff(np.concatenate([[-1], cut])), ids))
            else:
                alone = np.concatenate([alone, part])
        if len(alone):
            ids = self.whole([pieces[i].decode() for i in alone])
            found.append((keys[alone], np.array([len(x) for x in ids]), np.concatenate(ids)))
        key, n, ids = (np.concatenate([f[k] for f in found]) for k in range(3))
        key, n = np.concatenate([self.keys, key]), np.concatenate([self.n, n])
        place = np.concatenate([self.place, len(self.store) + np.cumsum(n[len(self.keys) :]) - n[len(self.keys) :]])
        order = np.argsort(key, kind="stable")
        self.keys, self.n, self.place, self.store = key[order], n[order], place[order], np.concatenate([self.store, ids])

    def _uneven(self, raw: np.ndarray, at: np.ndarray, data: bytes) -> np.ndarray:
        """Texts in which a blank comes before a space or line break, or that hold an added token."""
        gap = np.flatnonzero((raw[1:] == 32) | (raw[1:] == 10))
        before = raw[gap]
        odd = list(gap[_BLANK[before]] + 1)
        for i in (gap[before >= 0x80] + 1).tolist():
            if bytes(raw[max(0, i - 3) : i]).endswith(tuple(c.encode() for c in _WIDE_BLANKS)):
                odd.append(i)
        odd = np.array(odd, np.int64)
        text = np.searchsorted(at, odd, side="right") - 1
        special = np.array([m.start() for token in self.special for m in re.finditer(re.escape(token), data)], np.int64)
        return np.unique(np.concatenate([text[odd > at[text]], np.searchsorted(at, special, side="right") - 1]))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and the number of ids of each text."""
        if not self.cuts:
            parts = self.whole([t or "" for t in texts.to_pylist()])
            return np.concatenate([x for p in parts for x in (p, np.array([end_id], self.dtype))]), np.array([len(p) + 1 for p in parts], np.int64)
        raw, at = text_bytes(texts)
        data = raw.tobytes()
        begins = (raw == 32) | (raw == 10)
        wide = np.zeros(len(raw), bool)  # the last byte of a letter of U+00C0 to U+024F
        wide[1:] = (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC9) & (raw[1:] >= 0x80) & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
        begins[1:] |= _MARK[raw[1:]] & (_LETTER[raw[:-1]] | wide[:-1])
        begins[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(raw)) if len(start) else start
        hashes = span_hashes(raw, start, stop)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._clear()
        k = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            self._add(unique[new], [data[start[i] : stop[i]] for i in first[new].tolist()])
            k = np.searchsorted(self.keys, unique)
        n, place = self.n[k][back], self.place[k][back]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.store[np.repeat(place - total[:-1], n) + np.arange(total[-1])]
        cut = total[np.searchsorted(start, at)]
        sizes = np.diff(cut)
        uneven = self._uneven(raw, at, data)
        if len(uneven):
            parts = [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
            for i, own in zip(uneven.tolist(), self.whole([texts[i].as_py() for i in uneven.tolist()]), strict=True):
                parts[i], sizes[i] = own, len(own)
            ids = np.concatenate(parts)
        out = np.full(len(ids) + len(texts), end_id, self.dtype)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(sizes + 1) - 1] = False
        out[keep] = ids
        return out, sizes + 1


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, with the folder's path there; Spark's names for one kind of store mean the same here."""
    kind, _, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if kind in ("s3a", "s3n") else folder)


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """A pair of files of one partition."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, length: int):
        self.store, self.root = _at(folder)
        self.name, self.attempt = f"part-{part:06d}", uuid.uuid4().hex
        self.dtype, self.length, self.schema = dtype, length, _schema(dtype, length)
        self.sinks = [self.store.open_output_stream(f"{self.root}/{self.name}.{self.attempt}{end}") for end in (".arrow", ".docs.arrow")]
        self.files = [pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (self.schema, _DOCS), strict=True)]
        self.held, self.size, self.tokens, self.docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.files[1].write(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)], schema=_DOCS))
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)
        self.docs += len(sizes)
        if self.size >= BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, self.dtype), *self.held])
        step = BATCH * self.length
        full = len(ids) // step * step
        for a in range(0, full, step):
            self._batch(ids[a : a + step], step)
        if last and full < len(ids):
            self._batch(ids[full:], len(ids) - full)
            full = len(ids)
        self.held, self.size = [ids[full:]], len(ids) - full

    def _batch(self, ids: np.ndarray, real: int) -> None:
        whole = -(-real // self.length) * self.length
        padded = np.concatenate([ids, np.zeros(whole - real, self.dtype)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(whole) < real)]
        self.files[0].write(pa.record_batch(columns, schema=self.schema))

    def close(self) -> tuple[str, str]:
        self._flush(True)
        done = []
        for file, sink, end in zip(self.files, self.sinks, (".arrow", ".docs.arrow"), strict=True):
            file.close()
            sink.close()
            done.append(f"{self.root}/{self.name}{end}")
            self.store.move(f"{self.root}/{self.name}.{self.attempt}{end}", done[-1])
        return done[0], done[1]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs' ids under folder (a URI that driver and executors share) and return a row for each file:
    part, ids_file, docs_file, n_docs, n_tokens and start (ids in the files before it)."""
    from tokenizers import Tokenizer

    dtype = np.dtype("<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    store, root = _at(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer, dtype)
        out, part = None, TaskContext.get().partitionId()
        for rows in slices(batches, "text"):
            out = out or _Writer(folder, part, dtype, length)
            out.add(rows.column(0), *encoder.encode(rows.column(2), end_id))
        if out:
            names = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array(names[:1]), pa.array(names[1:]), pa.array([out.docs], pa.int64()), pa.array([out.tokens], pa.int64())], ["part", "ids_file", "docs_file", "n_docs", "n_tokens"])

    in_order = rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    files = staged(in_order.mapInArrow(write, "part int, ids_file string, docs_file string, n_docs long, n_tokens long"), "files")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = staged(files.withColumn("start", before), "index")
    unstage(files)
    return index


def read_sequences(folder: str, ids_file: str) -> Iterator[pa.RecordBatch]:
    """The batches of a file, memory-mapped where the folder is local: ids and mask are views on the file."""
    store, _ = _at(folder)
    local = isinstance(store, fs.LocalFileSystem)
    with pa.memory_map(ids_file) if local else store.open_input_file(ids_file) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start over all files, n_tokens, ids (bytes of little-endian unsigned 32-bit ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _at(folder)
        for rows in batches:
            for row in rows.to_pylist():
                flat = [b.column(0).flatten().to_numpy() for b in read_sequences(folder, row["ids_file"])]
                ids = np.concatenate(flat).astype("<u4") if flat else np.zeros(0, "<u4")
                with store.open_input_file(row["docs_file"]) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        b = reader.get_batch(k)
                        start, n = b.column(1).to_numpy(), b.column(2).to_numpy()
                        data = [ids[s : s + m].tobytes() for s, m in zip(start, n, strict=True)]
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start + row["start"]), pa.array(n), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    parts = max(1, index.count())
    return index.select("ids_file", "docs_file", "start").repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    index = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read_documents(index, folder))


def digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_files": op6_token_files}
SQL: dict[str, str] = {}
