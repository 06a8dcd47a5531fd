"""A corpus in five stages, each one operator of acceptlake.llm on all that its predecessor kept.

language ID -> n-gram Jaccard join -> benchmark decontamination -> mixing sources to target weights -> sharding.
Each stage is written as Parquet and read again as the documents of the next.

Null and empty texts go at the first stage, as they have no letter; given to a later stage, they are near duplicates of nothing, hit nothing,
are taken as often as their source is read whole, and have a place in a shard. Rows without an id or a source are judged like any other. Of
repeated rows the second stage keeps one; the first and the third judge each row alone. Very long texts are handled whole. Ties are named at
each stage. An empty table passes as an empty table. All columns of the documents come out of every stage as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acceptlake.llm import decontamination, language_id, mixing, ngram_join, sharding
from acceptlake.llm.common import carried, free_name, restored, staged, tracked, unstage

#: A document whose best language fits worse than this is rejected, as is one without a letter.
MIN_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS, SIMILARITY_PERCENT, BENCHMARK_WORDS, SHARDS = 5, 80, 10, 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that have no letter, or that no learned language fits."""
    slim = carried(docs, "text", doc_id=F.col("doc_id"), lang=F.col("lang"), text=F.col("text"))
    judged = language_id.identify(slim, language_id.remainder(F.col("doc_id")) != 2)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*restored(docs, text=F.col("text")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that with the smallest id; rows without an id come last, and the hash of the text decides among equal ids.
"""
    key = free_name(docs, "row_key")
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    of = ngram_join.join_components(rows, SHINGLE_WORDS, SIMILARITY_PERCENT, id_col=key).select(F.col(key).alias("k"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.col(key).alias("k"))
    first = of.join(rows.select(F.col(key).alias("row_k"), order.alias("o")), F.col("k") == F.col("row_k")).groupBy("component_id").agg(F.min("o").alias("o"))
    stay = staged(first.select(F.col("o.k").alias(key)), "stay")
    return rows.join(stay.hint("merge"), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, bench, BENCHMARK_WORDS, action="drop_documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; where they have such a column already, the new one's name begins with an underscore."""
    slim = carried(docs, "text", doc_id=F.col("doc_id"), text=F.col("text"))
    placed = sharding.shard(slim, SHARDS)
    return placed.select(*restored(docs, text=F.col("text")), *[F.col(c).alias(free_name(docs, c)) for c in ("shard", "slot")])


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
#: Language profiles, set links and sampled splitters have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with tracked() as scratch:
            made = stage(spark, docs, sf_dir)
        written = staged(made, name)
        unstage(*scratch, *([docs] if k else []))  # the stage's own tables, now that its documents are written
        docs = written

