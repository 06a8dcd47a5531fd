"""Many names looked for in many texts at once: an Aho-Corasick automaton over a part of the names reads a part of the texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the names of an automaton and of the texts that it reads in a task.
PART_BYTES = 8 << 20


def names_in(names: list[str], texts: list[str]) -> list[tuple[int, int]]:
    """(name, text): which of the names, each once, stand in which of the texts. The empty name stands in every text."""
    automaton, found = ahocorasick.Automaton(), []
    for i, name in enumerate(names):
        if name:
            automaton.add_word(name, i)
        else:
            found += [(i, t) for t in range(len(texts))]
    if len(automaton):
        automaton.make_automaton()
        for t, text in enumerate(texts):
            found += [(i, t) for i in {i for _, i in automaton.iter(text)}]
    return found


def contained(names: DataFrame, texts: DataFrame) -> DataFrame:
    """names (name), texts (text_id, text) -> (name, text_id) of all texts that hold the name, each once. Nulls stand nowhere.

    Names and texts are dealt into parts of a bounded size, and each part of the one meets each part of the other: nothing is compared name by
    name, and neither side has to fit anywhere.
    """
    names = names.where(F.col("name").isNotNull()).select("name").distinct()
    texts = texts.where(F.col("text").isNotNull()).select("text_id", "text")
    sizes = [(df.agg(F.sum(F.octet_length(c) + 16)).first()[0] or 0) for df, c in ((names, "name"), (texts, "text"))]
    name_parts, text_parts = (max(1, -(-s // PART_BYTES)) for s in sizes)
    text_parts = max(text_parts, -(-names.sparkSession.sparkContext.defaultParallelism // name_parts))  # enough tasks for all cores
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = names.select("name", part("name", name_parts).alias("i"), every(text_parts).alias("j"))
    right = texts.select("text_id", "text", every(name_parts).alias("i"), part("text_id", text_parts).alias("j"))
    kind = texts.schema["text_id"].dataType.simpleString()

    def meet(names: pa.Table, texts: pa.Table) -> pa.Table:
        pairs = names_in(names["name"].to_pylist(), texts["text"].to_pylist())
        ids = texts["text_id"].combine_chunks() if texts.num_rows else texts["text_id"]
        return pa.table([pa.array([names["name"][i].as_py() for i, _ in pairs], pa.string()), ids.take(pa.array([t for _, t in pairs], pa.int64()))], ["name", "text_id"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"name string, text_id {kind}")
    return found.distinct()
