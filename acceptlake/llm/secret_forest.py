"""Secret scan with a random forest that removes false positives; DataFrame operations and Spark's own tree learner only.

Candidates are runs of 16 or more of [A-Za-z0-9+/_-] (with up to two trailing =) that hold a digit, or that a credential word or
an assignment introduces, and what a credential word is assigned (NAME=value, "name": "value", name = value), at any length and of
any marks up to a quote or a blank (the scheme words bearer and basic are no values). The forest sees a candidate's length, its character transitions and classes, its entropy, how far
dictionary words cover it, its path, and the neighbouring words. It is trained on labelled findings (id, value, is_secret): at most
about MAX_TRAIN of them, drawn by a digest of the value. The dictionary holds the DICTIONARY most frequent lower-case words of three to twelve letters in all texts.

Without labelled findings of the query's own, weak labels stand in: findings that a credential word introduces and that are mixed
hexadecimal or base64 are secrets, purely numeric and all-letter runs are not, the rest is unlabelled and judged by the forest.

Null and empty texts have no candidates; an empty table gives an empty result. A very long text is split in the JVM like any other. Repeated
rows give their findings again, rows without an id theirs with a null id (labels don't reach those). Ties: two findings of one word with equal
values are equal rows. With labels of only one kind, or none, there
is no forest and each candidate's probability is the share of secrets among the labels (none: 1, nothing is removed).
Only the id, the text and what `path` names are looked at, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, unstage

MAX_TRAIN, DICTIONARY, TREES, DEPTH = 20_000, 500, 24, 6
#: A = that more of the text follows assigns and is no part of the run before it.
RUN = r"""(?<![A-Za-z0-9+/_\-])([A-Za-z0-9+/_\-]{16,}(?:={1,2}(?!=*["']?[A-Za-z0-9+/_\-]))?)"""
#: Words that introduce credentials, and path parts of samples.
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api_?key|apikey|auth|credential|bearer|private|access)"
#: What a credential word is assigned, in the last word of a text: group 1 is the name with the sign and an opening quote, group 2 the value.
ASSIGNED = r"""(?i)((?:token|secret|passw|pwd|api_?key|apikey|auth|credential|bearer|private|access)[A-Za-z0-9_.\-]*["'\])]{0,2}\s*(?::=|=>|[=:])\s*["']?(?:(?:bearer|basic)\s+)?)(?!(?:bearer|basic)$)((?<=")[^"\s]+|(?<=')[^'\s]+|(?<!["'])[^\s"'=>](?:[^\s"']*[^\s"',;)}\]])?)(?=\S*$)"""
SAMPLE_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"
FEATURES = ["length", "transitions", "case_changes", "digits", "uppers", "distinct", "entropy", "covered", "introduced", "assigned", "quoted", "follows", "sample_path", "depth"]


def candidates(docs: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """id, path, word (place of the word in the text), value, before and after (neighbouring words), own (the word it stands in)."""
    text = F.col(text_col)
    w = docs.where(F.length(text) > 0).select(F.col(id_col).alias("id"), path.alias("path"), F.split(text, r"[ \t\n\x0B\f\r]+").alias("w"), text.rlike(CREDENTIAL).alias("named"))
    around = lambda i, k: F.when(i + k >= 0, F.get("w", i + k))
    near = lambda i: F.concat_ws(" ", around(i, -2), around(i, -1), F.get("w", i))
    given = lambda i: F.col("named") & near(i).rlike("[=:]") & near(i).rlike(ASSIGNED)
    places = F.filter(F.transform("w", lambda x, i: F.when((F.length(x) >= 16) | given(i), i)), lambda i: i.isNotNull())
    found = w.select("id", "path", "w", "named", F.explode(places).alias("i")).select(
        "id", "path", F.col("i").alias("word"), F.get("w", F.col("i")).alias("own"), F.concat_ws(" ", around(F.col("i"), -2), around(F.col("i"), -1)).alias("before"), F.coalesce(around(F.col("i"), 1), F.lit("")).alias("after"),
        F.when(F.col("named"), near(F.col("i"))).otherwise("").alias("near"),
    )
    runs = F.regexp_extract_all("own", F.lit(RUN), F.lit(1))
    led = F.transform(runs, lambda v: F.struct(v.alias("value"), F.concat_ws(" ", "before", F.call_function("substring_index", F.col("own"), v, F.lit(1))).alias("lead")))
    names, values = (F.regexp_extract_all("near", F.lit(ASSIGNED), F.lit(g)) for g in (1, 2))
    assigned = F.filter(F.zip_with(values, names, lambda v, n: F.struct(v.alias("value"), n.alias("lead"))), lambda s: ~F.array_contains(runs, s["value"]))
    found = found.withColumn("found", F.explode(F.concat(led, assigned))).select("*", "found.*")
    return found.where(F.col("value").rlike("[0-9]") | F.col("lead").rlike(CREDENTIAL) | F.col("lead").rlike("[=:]"))


def dictionary(docs: DataFrame, text_col: str, size: int) -> list[str]:
    """The most frequent words of all texts."""
    words = docs.select(F.explode(F.split(F.col(text_col), "[^a-z]+")).alias("x")).where(F.length("x").between(3, 12))
    return [r.x for r in words.groupBy("x").count().orderBy(F.desc("count"), "x").limit(size).collect()]


def features(found: DataFrame, vocabulary: list[str]) -> DataFrame:
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    chars = F.split(v, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    left = F.regexp_replace(F.lower(v), "|".join(sorted(vocabulary, key=lambda x: (-len(x), x))), "") if vocabulary else F.lower(v)
    return found.select(
        "id", "path", "word", "value", "lead",
        n.alias("length"),
        share(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])").alias("transitions"),
        share(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])").alias("case_changes"),
        share(r"[0-9]").alias("digits"),
        share(r"[A-Z]").alias("uppers"),
        (F.size(F.array_distinct(chars)) / n).alias("distinct"),
        F.aggregate(counts, F.lit(0.0), lambda t, p: t - p * F.log2(p)).alias("entropy"),
        (1 - F.length(left) / n).alias("covered"),
        F.col("lead").rlike(CREDENTIAL).cast("double").alias("introduced"),
        F.col("lead").rlike("[=:]").cast("double").alias("assigned"),
        F.col("own").rlike("[\"']").cast("double").alias("quoted"),
        F.col("after").rlike("^[A-Za-z]").cast("double").alias("follows"),
        F.coalesce(F.col("path").rlike(SAMPLE_PATH), F.lit(False)).cast("double").alias("sample_path"),
        F.coalesce(F.size(F.split(F.col("path"), "/")), F.lit(0)).cast("double").alias("depth"),
    )


def weak_labels(rows: DataFrame) -> DataFrame:
    """id, value, is_secret from the form of a finding alone; what neither rule covers is left out."""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    plain = ~mixed
    label = F.when(F.col("lead").rlike(CREDENTIAL) & mixed, 1.0).when(plain, 0.0)
    return rows.select("id", "value", label.alias("is_secret")).where("is_secret IS NOT NULL")


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, learn_from: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """A row for each candidate: id, word, value, probability and is_secret. labelled: findings (id, value, is_secret) to learn from;
    without them weak labels of the rows for which learn_from (on `id`) holds."""
    path = F.lit(None).cast("string") if path is None else path
    rows = staged(features(candidates(docs, id_col, text_col, path), dictionary(docs, text_col, DICTIONARY)), "candidates")
    labels = weak_labels(rows if learn_from is None else rows.where(learn_from)) if labelled is None else labelled.select("id", "value", F.col("is_secret").cast("double").alias("is_secret"))
    labels = labels.where(F.col("is_secret").isNotNull()).groupBy("id", "value").agg(F.max("is_secret").alias("is_secret"))  # of two labels the graver
    train = staged(rows.join(labels, ["id", "value"]).select("id", "value", "word", "is_secret", *FEATURES), "labelled")
    n = {r.is_secret: r["count"] for r in train.groupBy("is_secret").count().collect()}
    if len(n) < 2:
        share = F.lit(float(next(iter(n), 1.0)))
        return rows.select(F.col("id").alias(id_col), "word", "value", share.alias("probability"), (share >= threshold).alias("is_secret"))
    rate = F.when(F.col("is_secret") > 0, F.lit(max_train / 2 / n[1.0])).otherwise(F.lit(max_train / 2 / n[0.0]))
    drawn = train.where(F.pmod(F.xxhash64(F.lit("forest"), "id", "value", "word"), F.lit(1 << 30)) < rate * F.lit(float(1 << 30)))
    drawn = staged(drawn.coalesce(1).sortWithinPartitions("value", "id", "word"), "sample")  # about max_train rows, in one order, so that reruns agree
    into = VectorAssembler(inputCols=FEATURES, outputCol="x")
    forest = RandomForestClassifier(featuresCol="x", labelCol="is_secret", numTrees=TREES, maxDepth=DEPTH, seed=7)
    model = forest.fit(into.transform(drawn.coalesce(1)))
    unstage(train, drawn)
    judged = model.transform(into.transform(rows.select("id", "word", "value", *FEATURES)))
    probability = F.element_at(vector_to_array("probability"), -1)
    return judged.select(F.col("id").alias(id_col), "word", "value", F.round(probability, 6).alias("probability"), (F.round(probability, 6) >= threshold).alias("is_secret"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(4)) != 2
    found = find_secrets(docs, learn_from=learn, path=F.concat(F.lit("src/"), F.col("source"), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt")))
    masked = F.when(F.length("value") < 16, "...").otherwise(F.concat(F.substring("value", 1, 4), F.lit("..."), F.substring(F.col("value"), -2, 2)))
    return found.select("doc_id", F.col("word").cast("long").alias("word"), masked.alias("masked"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


QUERIES = {"op5_secret_forest": op5_secret_forest}
SQL: dict[str, str] = {}
