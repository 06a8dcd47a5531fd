"""Documents keep all their columns, whatever their names, through every operator and stage that returns documents."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acceptlake.llm import decontamination, language_id, mixing, substring_dedup, token_files

NAMES = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, n_removed int, size string, taken string, `a.b` string, shard string, row int, doc string, spans string, clean_text int, id string, copy int"
CLASHES = ["score", "n_words", "n_removed", "size", "taken", "a.b", "shard", "row", "doc", "spans", "clean_text", "id", "copy"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "and", "house", "green", "river", "over"], k=40)) + f" word{i}", "en", "ab"[i % 2], 1, "s", "w", 7, "z", "t", "dot", "h", 3, "d", "p", 4, "i", 5) for i in range(30)]
    return spark.createDataFrame([*rows, (99, None, None, None, *rows[0][4:])], NAMES)


def unchanged(out, docs, but=()):
    names = [c for c in docs.columns if c not in but]
    assert set(names) <= set(out.columns)
    row = next(r for r in out.collect() if r.doc_id == 3)
    first = docs.where("doc_id = 3").first()
    assert [row[c] for c in names] == [first[c] for c in names]


def test_operators(spark, docs):
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "item_id long, text string")
    assert decontamination.decontaminate(docs, bench, 3, action="drop_documents").columns == docs.columns
    assert decontamination.decontaminate(docs, bench, 3, action="remove_spans").columns == docs.columns
    for most in (500_000, 1):
        unchanged(decontamination.decontaminate(docs, bench, 3, max_broadcast=most), docs, ("n_words", "clean_text"))
    unchanged(language_id.identify(docs, F.lit(True)), docs, ("score",))
    unchanged(substring_dedup.remove_repeats(docs), docs, ("n_words", "n_removed"))
    unchanged(mixing.mixed_documents(docs, F.col("`row`")), docs)


def test_every_stage(spark, docs, tmp_path):
    spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        unchanged(out, docs)
        assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns)
        assert out.count() > 0


def test_token_files_of_repeated_ids(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(rng.choice([7, 7, 7, None, 8]), " ".join(rng.choices("abcdef", k=rng.randint(0, 9)))) for _ in range(200)]
    path, found = public_tokenizers.path("byte_bpe_50k.json"), []
    for k, parts in enumerate((1, 5)):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        folder = f"file://{tmp_path}/{k}"
        found.append([tuple(r) for r in token_files.digests(token_files.read_documents(token_files.write_token_files(docs, folder, path, file_bytes=1000 * parts), folder)).orderBy("start").collect()])
    assert found[0] == found[1] and len(found[0]) == 200
    words = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some Words, here.", "", None, "été  x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = token_files.read_documents(token_files.write_token_files(docs, f"file://{tmp_path}/w", words), f"file://{tmp_path}/w").orderBy("doc_id").collect()
    library = Tokenizer.from_file(words)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in out] == [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert zlib.crc32(out[0].ids) >= 0


def test_items_that_share_a_window_go_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "WINDOW_BYTES", 64)
    bench = spark.createDataFrame([(i, "one two three") for i in range(40)] + [(50, "four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "four five"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, 3, max_broadcast=10).collect()}
    assert rows[1].hit_items == sorted(map(str, [*range(40), 50])) and [tuple(s) for s in rows[1].hit_spans] == [(0, 6)] and rows[1].clean_text.split() == []
    assert rows[2].hit_items == [] and rows[3].clean_text is None
