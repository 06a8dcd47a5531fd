"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target number of words: the sources, ordered by code point with null last, weigh by a repeating cycle and
share a multiple of all words; a target stops at `cap` times its source's words and the excess is reshared by weight until no
target is above. A source is then read in complete epochs, and the rest of its target is filled by documents in the order of
the exponential keys -ln(u) / quality weight, as far as the prefix sum of their words comes nearest to the target.

u comes from a digest of seed and doc_id, so that reruns agree. The prefix sum is taken in two levels: key ranges ("bins") of
about ROWS_PER_BIN documents are summed first, then only the one bin of each source in which the target is met is put in
order, so that a source with a third of all rows does not meet in one task. Only that bin's border goes back to the documents.

Null and empty texts have size 0 and are taken 0 words; documents without a source form a source of their own; rows that
share id, source and size stand for each other in ties and each counts; a null id hashes like the word "null". The query weighs labelled documents by
their labels. Very long texts count as any other, in the JVM. An empty table gives an empty result. Columns that share a name with a result column are replaced by it; all others
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, packed, restored, staged, unpacked, unstage

ROWS_PER_BIN = 2_000
WORD = r"[^\x20\x09-\x0D]+"
RESULT = ("size", "source_size", "target", "times", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_quality(n_bytes: Column, size: Column) -> Column:
    """Quality weight of a text: 2 where a word has 3 to 12 bytes in the mean, as prose has, else 0.5; 1 without words."""
    mean = n_bytes / size
    return F.when(size <= 0, 1.0).when(mean.between(3, 12), 2.0).otherwise(0.5)


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that only seed and id decide: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes: source, source_size, rows, one row a source. Adds target, epochs and rest by filling up to the caps, smallest cap per weight first."""
    everywhere = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(cycle))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everywhere)
    s = s.withColumn("level", (total - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after)).withColumn("place", F.row_number().over(order))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("ratio") > F.col("level"), F.col("place"))).over(everywhere))
    s = s.withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return s.withColumn("epochs", epochs.cast("long")).select("source", "source_size", "rows", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def judged(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Quality weights (mark_id, mark) of labelled documents: 2 where the label is over 0, else 0.5; of several labels of an id the best, null is none."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
    return rows.groupBy(F.col(id_col).alias("mark_id")).agg(F.when(F.max(quality_col) > 0, 2.0).otherwise(0.5).alias("mark"))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: Column | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_text: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """Documents with size, source_size, target, times (how often the mix takes the document) and taken (its words, repeats counted).

    quality: a weight of each document from its columns (null or not positive: 1); without it, default_quality. labels (mark_id, mark; an id once):
    weights that go before either. Without with_text the text is left out of the result, and the texts are read once only.
    """
    result = (*RESULT, *([] if with_text else [text_col]))
    keyed = docs.select(packed(docs, *result).alias("doc"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), (F.lit(None).cast("double") if quality is None else F.when(quality > 0, quality).otherwise(1.0)).alias("quality"), F.octet_length(text_col).alias("bytes"))
    weight = default_quality(F.col("bytes"), F.col("size")) if quality is None else F.col("quality")
    if labels is not None:
        keyed = keyed.join(labels, F.col("id") == F.col("mark_id"), "left")
        weight = F.coalesce("mark", weight)
    keyed = keyed.withColumn("key", -F.log(uniform(F.col("id"), seed)) / weight)
    if with_text:
        small = staged(keyed.select("source", "id", "size", "key"), "mix")
    else:
        small = keyed = staged(keyed.select("doc", "source", "id", "size", "key"), "mix")
    targets = staged(source_targets(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), cycle, share, cap), "targets")

    def binned(key: str) -> Column:
        bins = F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_PER_BIN))
        return F.least(bins - 1, F.floor((1 - F.exp(-F.col(key))) * bins)).cast("long")

    t = targets.withColumnRenamed("source", "t_source")
    rows = small.join(t, F.col("source").eqNullSafe(F.col("t_source"))).where(F.col("rest") > 0).withColumn("bin", binned("key"))
    sums = rows.groupBy("source", "rest", "bin").agg(F.sum("size").alias("in_bin"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = sums.where(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max_by(F.struct("bin", "before"), "bin").alias("last")).select(F.col("source").alias("l_source"), "last.*")
    met = rows.join(last.withColumnRenamed("bin", "l_bin"), F.col("source").eqNullSafe(F.col("l_source")) & (F.col("bin") == F.col("l_bin")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    border = met.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "id", "size")).alias("border")).withColumnRenamed("source", "b_source")
    cuts = t.join(last.withColumnRenamed("bin", "l_bin"), F.col("t_source").eqNullSafe(F.col("l_source")), "left").join(border, F.col("t_source").eqNullSafe(F.col("b_source")), "left")
    cuts = staged(cuts.select("t_source", "source_size", "rows", "target", "epochs", "rest", "l_bin", "border"), "cuts")
    unstage(targets, *([small] if with_text else []))

    out = keyed.join(cuts, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("bin", binned("key"))
    here = F.struct("key", "id", "size")
    in_rest = F.coalesce((F.col("rest") > 0) & ((F.col("bin") < F.col("l_bin")) | ((F.col("bin") == F.col("l_bin")) & (here <= F.col("border")))), F.lit(False))
    out = out.withColumn("times", F.col("epochs") + in_rest.cast("long")).withColumn("taken", F.col("times") * F.col("size"))
    return out.select(*unpacked(out, "doc", docs, *result), *RESULT)


def mixed_documents(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs, all as they were."""
    named = {n: F.col(f"`{c}`") for n, c in (("id", id_col), ("text", text_col), ("source", source_col))}
    slim = carried(docs, text_col, **named, quality=F.lit(None) if quality is None else quality)
    taken = mix(slim, quality=None if quality is None else F.col("quality"), id_col="id", text_col="text", source_col="source", **options).where("times > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(*restored(docs, **{text_col: F.col("text")}))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    labels = judged(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, with_text=False, labels=labels).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(strlen(text), 0) AS bytes,
                  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
lab AS (SELECT doc_id AS id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln(u) / (CASE WHEN quality > 0 THEN 2.0::DOUBLE WHEN quality IS NOT NULL THEN 0.5::DOUBLE WHEN size <= 0 THEN 1.0::DOUBLE WHEN bytes::DOUBLE / size BETWEEN 3 AND 12 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS key FROM d LEFT JOIN lab ON lab.id = d.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
f AS (SELECT *, (total - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM r),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, place) FROM f WHERE ratio > level), 'infinity'::DOUBLE) * weight) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x
"""

QUERIES = {"op3_mix_sources": op3_mix_sources}
SQL = {"op3_mix_sources": ORACLE}
