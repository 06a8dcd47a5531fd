"""Sharding by sampled splitters, in DataFrame operations only.

Records have a 64-bit key: the upper 40 bits come from the text, so that equal texts lie side by side, the lower 24 from the
id, so that a group of copies of any size can be cut. A sample drawn in proportion to the sizes (bounded: shards x ranges x
samples rows are expected) gives the quantiles that cut the key line into ranges; the ranges are then summed exactly over all records,
and where a range goes over the budget of its shard it is subdivided at the very record. A group of copies on a border stays
whole in the lower shard if it is small against a shard, else it is cut as well.

Laws: "bytes" (the sizes of the shards are near equal) and "rows" (record counts at most one apart; groups are then cut like
all else). Null texts count as empty. Repeated rows keep a place each; rows equal in id and text take neighbouring slots in any order. Null ids hash
like any value. Very long texts are a record as any other; a text larger than a shard's share makes that shard larger. An empty table gives
an empty result. Columns that share a name with a result column are replaced by it; all others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, staged, unpacked, unstage

RANGES_PER_SHARD, SAMPLES_PER_RANGE = 64, 32
#: A group of copies on a border is not cut if it is at most this share of a shard.
WHOLE_GROUP = 0.02
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_LOW = (1 << 24) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the columns that pass through), id, size, text_crc32, text (a hash) and key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(packed(docs, *RESULT).alias("doc"), F.col(id_col).cast("string").alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text"))
    return out.withColumn("key", F.col("text").bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.xxhash64(F.coalesce(F.col("id"), F.lit("null"))).bitwiseAND(F.lit(_LOW))))


def splitters(small: DataFrame, total: int, ranges: int) -> DataFrame:
    """Ranges of the key line: range, lo (included), hi (excluded; null: open), from a size-weighted sample of the keys."""
    rate = F.col("weight") * F.lit(ranges * SAMPLES_PER_RANGE / max(total, 1))
    drawn = small.where(F.pmod(F.xxhash64(F.lit("sample"), "key", "id"), F.lit(1 << 30)) < rate * F.lit(float(1 << 30))).select("key", F.greatest(rate, F.lit(1.0)).alias("w"))
    order = Window.orderBy("key")
    place = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    part = F.floor(place * F.lit(ranges) / F.sum("w").over(Window.partitionBy())).cast("int")
    lows = drawn.withColumn("range", part).groupBy("range").agg(F.min("key").alias("lo")).groupBy("lo").agg(F.min("range").alias("range"))
    in_order = Window.orderBy("lo")
    first = F.row_number().over(in_order) == 1
    return lows.select("range", F.when(first, F.lit(-(1 << 63))).otherwise(F.col("lo")).alias("lo"), F.lead("lo").over(in_order).alias("hi"))


def _cells(table: DataFrame) -> DataFrame:
    """The ranges under each cell of the key line (its upper 12 bits) that they touch, for an equi join."""
    last = F.coalesce(F.shiftright(F.col("hi"), 52), F.lit(2047))
    return table.withColumn("cell", F.explode(F.sequence(F.shiftright(F.col("lo"), 52), last)))


def _ranged(df: DataFrame, cells: DataFrame) -> DataFrame:
    """df with the columns of its range. cells has a row for each range and cell, which the splitter count bounds, so it is broadcast."""
    inside = (F.shiftright(F.col("key"), 52) == F.col("cell")) & (F.col("key") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("key") < F.col("hi")))
    return df.join(F.broadcast(cells), inside)


def shard(docs: DataFrame, n_shards: int = 24, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot (gapless in the shard) and grown_shard (null for these laws)."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    keyed = _keyed(docs, id_col, text_col)
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    small = staged(keyed.select("id", "text", "key", weight.alias("weight")), "keys")
    total = small.agg(F.sum("weight")).first()[0] or 0
    splits = staged(splitters(small, total, n_shards * RANGES_PER_SHARD), "splitters")
    placed = _ranged(small, _cells(splits))
    sums = placed.groupBy("range").agg(F.sum("weight").alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = staged(splits.join(sums.withColumn("before", before).select("range", "before"), "range"), "ranges")
    cells = staged(_cells(ranges), "cells")

    def cut(df: DataFrame, weight: Column) -> DataFrame:
        order = Window.partitionBy("range").orderBy("key", "id", "text")
        upto = F.col("before") + F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return _ranged(df, cells).withColumn("cut_shard", F.least(F.lit(n_shards - 1), F.floor((upto - weight / 2) * n_shards / F.lit(max(total, 1))).cast("int")))

    kept = F.col("cut_shard")
    rows = cut(small, F.col("weight"))
    if law == "bytes":
        groups = rows.groupBy("text").agg(F.min("cut_shard").alias("low"), F.max("cut_shard").alias("high"), F.sum("weight").alias("in_group"))
        on_border = groups.where((F.col("low") < F.col("high")) & (F.col("in_group") <= WHOLE_GROUP * total / n_shards))
        on_border = staged(on_border.select(F.col("text").alias("g_text"), "low"), "borders")  # neighbours on the key line: at most one a border
        kept = F.coalesce(F.col("low"), F.col("cut_shard"))

    def settled(df: DataFrame) -> DataFrame:
        if law == "bytes":
            df = df.join(F.broadcast(on_border), F.col("text") == F.col("g_text"), "left")
        return df.withColumn("shard", kept)

    counts = settled(rows).groupBy("shard", "range").agg(F.count("*").alias("rows"))
    offset = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(counts.select(F.col("shard").alias("o_shard"), F.col("range").alias("o_range"), offset.alias("offset")), "offsets")  # a row a range and border at most

    full = settled(cut(keyed, weight))
    full = full.join(F.broadcast(offsets), (F.col("shard") == F.col("o_shard")) & (F.col("range") == F.col("o_range")))
    slot = F.col("offset") + F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "id", "text")) - 1
    full = full.withColumn("slot", slot.cast("long")).withColumn("law", F.lit(law)).withColumn("grown_shard", F.lit(None).cast("int"))
    unstage(small, splits, ranges)
    return full.select(*unpacked(full, "doc", docs, *RESULT), *RESULT)


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **options) -> None:
    """Write the sharded documents, a folder a shard. Rows of a shard come from several tasks, so that no task holds a whole shard."""
    shard(docs, n_shards, **options).write.partitionBy("shard").parquet(path)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", *RESULT)


QUERIES = {"op10_shard": op10_shard}
SQL: dict[str, str] = {}
