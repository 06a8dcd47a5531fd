"""Language ID, token files, mixing, sharding and decontamination against brute force and edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from acceptlake.llm import decontamination, language_id, mixing, sharding, token_files

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score int, __key int"
EDGES = [
    (1, None, "en", "a", None, 1, "x", 1, 1),
    (2, "", None, None, 0, 1, "x", 1, 1),
    (3, "the the the " * 3000, "en", "a", 5, None, None, None, None),
    (3, "the the the " * 3000, "en", "a", 5, None, None, None, None),
    (4, " \n\t ", "de", "b", 4, 1, "x", 1, 1),
    (5, "12 34 !!", "de", None, 4, 1, "x", 1, 1),
    (6, "中文 字符", "de", "c", 4, 1, "x", 1, 1),
    (None, "und die der das", "de", "b", 4, 1, "x", 1, 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_decontamination_brute_force(spark):
    rows = decontamination.op2_decontaminate(spark, SF).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(low))
        for i in range(max(1, len(w) - 9) if w else 0):
            items[tuple(w[i : i + 10])].add(str(r.item_id))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any(r.contaminated for r in rows)
    for r in rows:
        w, hit, found = word.findall((texts[r.doc_id] or "").translate(low)), set(), set()
        for n in {len(k) for k in items}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in items:
                    hit |= set(range(i, i + n))
                    found |= items[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_rounds_and_actions(spark, edges, docs):
    bench = spark.createDataFrame([(1, "der, DAS und"), (2, None), (3, ""), (4, "und die")], "item_id long, text string")
    one = decontamination.decontaminate(edges, bench).collect()
    two = decontamination.decontaminate(edges, bench, max_broadcast=1).collect()
    key = lambda r: str(sorted(r.asDict(recursive=True).items(), key=str))
    assert sorted(map(key, one)) == sorted(map(key, two))
    hit = next(r for r in one if r.doc_id is None)
    assert hit.hit_items == ["4"] and hit.clean_text.split() == ["der", "das"]
    assert decontamination.decontaminate(edges, bench, action="drop_documents").count() == len(EDGES) - 1
    clean = decontamination.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), action="remove_spans")
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontamination.decontaminate(edges.limit(0), bench).count() == 0
    assert decontamination.decontaminate(edges, bench.limit(0)).where("size(hit_items) > 0").count() == 0


def test_language_accuracy_and_edges(spark, edges):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    out = language_id.identify(edges, F.lit(True)).collect()
    assert len(out) == len(EDGES) and {r.lang_pred for r in out if r.doc_id in (1, 2, 4, 5)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out if r.doc_id == 3} == {"en"}
    assert {r.lang_pred for r in language_id.identify(edges, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(edges.limit(0), F.lit(True)).count() == 0


def test_language_distance_brute_force(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der hund und die katze und", "de"), (3, "zz the zz und zz zz xx", None), (4, "Ünd ßt aa aa", None), (5, "katze", None)], "doc_id long, text string, lang string")
    grams = lambda t: [w[i : i + n] for w in (f" {x} " for x in re.findall(r"[^\W\d_]+", t.lower())) for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n].strip() and not (n > 1 and w[i : i + n] == " ")]
    size, order = 12, lambda g: sum((ord(c) + 1) * (1 << 21) ** (len(g) - 1 - k) for k, c in enumerate(g))

    def ranked(t, first=()):
        c = Counter(grams(t))
        return sorted(c, key=lambda g: (-c[g], g not in first, order(g)))

    profile = {r.lang: {g: k for k, g in enumerate(ranked(r.text)[:size])} for r in docs.where("lang IS NOT NULL").collect()}
    known = {g for p in profile.values() for g in p}
    out = {r.doc_id: r for r in language_id.identify(docs, F.lit(True), size=size).collect()}
    for r in docs.collect():
        ranks = {g: k for k, g in enumerate(ranked(r.text, known)) if g in known and k < size}
        far = {lang: sum(min(abs(k - p[g]), size) if g in p else size for g, k in ranks.items()) for lang, p in profile.items()}
        lang = min(sorted(far), key=far.get)
        assert (out[r.doc_id].lang_pred, round(out[r.doc_id].score, 9)) == (lang, round(1 - far[lang] / (size * len(ranks)) if ranks else 0, 9))


def _library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files_round_trip(spark, docs):
    rows = sorted(token_files.op6_token_files(spark, SF).collect())
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    start = 0
    for r, (doc_id, _), ids in zip(rows, texts, _library_ids([t for _, t in texts]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_edges(spark, edges, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["a  b", "a   b", " a\n b \n", "\n\n x\t y", "it's  we'll", "x <|endoftext|> y<|endoftext|>z", "   x", "\x1c \x85 a", "é \U0001f600 \n \n", "a\n\nb", "  ", "a ", "tab\t\tx \ty", "\0 a"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    index = token_files.write_token_files(frame, f"file://{tmp_path}/a", path, length=8, file_bytes=64)
    out = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_documents(index, f"file://{tmp_path}/a").collect()}
    assert out == {i: [*ids, 0] for i, ids in enumerate(_library_ids(odd))}
    batch = next(token_files.read_sequences(f"file://{tmp_path}/a", index.first().ids_file))
    assert batch.column(0).type.list_size == 8 and batch.num_rows == batch.column(1).to_numpy(zero_copy_only=False).shape[0]
    index = token_files.write_token_files(edges, f"file://{tmp_path}/b", path)
    assert token_files.read_documents(index, f"file://{tmp_path}/b").count() == len(EDGES)
    index = token_files.write_token_files(edges.limit(0), f"file://{tmp_path}/c", path)
    assert token_files.read_documents(index, f"file://{tmp_path}/c").count() == 0


def test_mixing(spark, edges):
    rows = mixing.op3_mix_sources(spark, SF).collect()
    assert sorted(rows) == sorted(mixing.op3_mix_sources(spark, SF).repartition(3).collect())
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, sizes, targets = Counter(), Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        targets[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    largest = max(r.size for r in rows)
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - targets[s]) <= largest / 2 and targets[s] <= 2 * sizes[s] + 1e-6 for s in targets)
    out = mixing.mix(edges).collect()
    assert len(out) == len(EDGES) and all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix(edges.limit(0)).count() == 0
    assert mixing.mixed_documents(edges).columns == edges.columns  # a document in the mix keeps its own size


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(spark, edges, law):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, 24, law).collect()
    sizes, slots, counts = Counter(), defaultdict(list), Counter()
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        sizes[r.shard] += r.size
        counts[r.shard] += 1
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    if law == "rows":
        assert max(counts.values()) - min(counts.values()) <= 1
    else:
        mean = sum(sizes.values()) / 24
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows) + 0.08 * mean
    assert sharding.shard(edges, 3, law).count() == len(EDGES)
    assert sharding.shard(edges.limit(0), 3, law).count() == 0


def test_sharding_cuts_a_large_group(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same text")).otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
    sizes = [r.bytes for r in sharding.shard(hot, 8).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)


NAMES = "id doc text source size key quality bytes rows rest epochs border bin l_bin l_source t_source b_source target times taken copy cell range lo hi before offset low high weight w in_range in_group in_bin cut_shard shard slot law g_text o_shard o_range row gathered spans hit_spans hit_items clean_text n_words item items words __row __key __text __docs".split()


def test_columns_may_have_any_name(spark):
    fields = [n for n in NAMES if n not in ("text", "source")]
    rows = [(k, f"one two three four five {k % 3}", "a", *[k] * len(fields)) for k in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *fields])
    bench = spark.createDataFrame([(1, "two three"), (2, "four five"), (3, "zero one")], "item_id long, text string")
    for out, results in (
        (mixing.mix(docs), mixing.RESULT),
        (sharding.shard(docs, 2), sharding.RESULT),
        (decontamination.decontaminate(docs, bench, 2), decontamination.RESULT.names),
        (decontamination.decontaminate(docs, bench, 2, max_broadcast=1), decontamination.RESULT.names),
    ):
        assert out.columns == [*[c for c in docs.columns if c not in results], *results]
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == 4 and all(got[k][c] == k for k in got for c in fields if c not in results)
    assert mixing.mixed_documents(docs).columns == [c for c in docs.columns if c not in mixing.RESULT]
