"""Unified diffs as tables: files, hunks, lines, statistics, ranges and errors of many patches at once.

patches: patch_id, text. One patch's lines are ordered by windows over the patch; a patch has a size limit, so no task grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

GIT = r'^diff --git\s+("(?:\\.|[^"\\])*"|\S+)\s+("(?:\\.|[^"\\])*"|\S+)$'
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(?: ?(.*))?$"
_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34}


def unquoted(path: Column) -> Column:
    """A quoted path with its escapes and octal bytes undone; other paths unchanged."""
    body = F.regexp_extract(path, r'^"(.*)"$', 1)
    parts = F.regexp_extract_all(body, F.lit(r"(\\[0-7]{1,3}|\\.|[^\\])"), F.lit(1))

    def as_hex(p: Column) -> Column:
        out = F.hex(F.encode(p, "UTF-8"))
        for c, code in _ESCAPES.items():
            out = F.when(p == F.lit("\\" + c), f"{code:02X}").otherwise(out)
        return F.when(p.rlike(r"^\\[0-7]"), F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")).otherwise(out)

    return F.when(path.startswith('"'), F.make_valid_utf8(F.unhex(F.array_join(F.transform(parts, as_hex), "")).cast("string"))).otherwise(path)


def git_path(path: Column, strip: bool = True) -> Column:
    """The path of a diff header: quotes and escapes undone, slashes merged, a/ or b/ stripped."""
    out = F.regexp_replace(unquoted(F.trim(path)), "/{2,}", "/")
    return F.regexp_replace(out, "^[ab]/", "") if strip else out


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | (path == "")


def header_path(raw: Column) -> Column:
    """The path of a --- or +++ line; null for /dev/null."""
    value = F.substring_index(F.substring(raw, 5, 1 << 30), "\t", 1)
    return F.when(value != "/dev/null", git_path(value))


def parsed(patches: DataFrame) -> DataFrame:
    """Every line with its file (0: before the first), its hunk in the file (0: before the first) and its kind.

    A git header opens a file. Without one, --- opens a file if it is the first, or if +++ follows and the hunk before has all its
    lines. While a file is open, lines that start with --- or +++ are headers, never content.
    """
    rows = patches.select("patch_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "raw"))
    order = Window.partitionBy("patch_id").orderBy("pos")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    raw, minus, plus = F.col("raw"), F.col("raw").startswith("--- "), F.col("raw").startswith("+++ ")
    attribute = raw.rlike(r"^(new file mode|deleted file mode|old mode|new mode|similarity index|rename from|rename to|Binary files|GIT binary patch)\b") | raw.rlike(r"^index [0-9a-f]")
    rows = rows.withColumn("git", raw.rlike(GIT)).withColumn("at", raw.rlike(HUNK))
    kind = F.when(F.col("git"), "git").when(minus, "old").when(plus, "new").when(F.col("at"), "hunk").when(attribute, "attribute").when(raw.startswith("\\"), "note")
    rows = rows.withColumn("kind", kind.when(raw.startswith("+"), "added").when(raw.startswith("-"), "removed").when(raw.startswith(" ") | (raw == ""), "context").otherwise("other"))
    rows = rows.withColumn("next", F.lead("raw").over(order)).withColumn("gits", F.count_if(F.col("git")).over(upto)).withColumn("island", F.count_if(F.col("at")).over(upto))
    island = Window.partitionBy("patch_id", "island").orderBy("pos")
    earlier = island.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda i: F.coalesce(F.nullif(F.regexp_extract("raw", HUNK, i), F.lit("")), F.lit("1")).cast("long")
    full = lambda kinds, i: F.count_if(F.col("kind").isin(*kinds)).over(earlier) >= F.first(count(i)).over(island)
    complete = (F.col("island") > 0) & full(("context", "removed"), 2) & full(("context", "added"), 4)
    first = F.coalesce(F.count_if(minus).over(before), F.lit(0)) == 0
    named = (F.col("island") == 0) & (F.coalesce(F.count_if(plus).over(before), F.lit(0)) > 0)
    bare = (F.col("gits") == 0) & minus & (first | (F.col("next").startswith("+++ ") & (complete | named)))
    rows = rows.withColumn("starts", F.col("git") | F.coalesce(bare, F.lit(False)))
    rows = rows.withColumn("file", F.count_if(F.col("starts")).over(upto).cast("int"))
    in_file = Window.partitionBy("patch_id", "file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hunk", F.count_if(F.col("at")).over(in_file).cast("int")).select("patch_id", "pos", "raw", "kind", "file", "hunk")


def patch_files(lines: DataFrame) -> DataFrame:
    """A row for each file section: old and new path, change type, binary flag, modes, similarity."""
    raw, k = F.col("raw"), F.col("kind")
    last = lambda value, test: F.max_by(F.struct(value.alias("v")), F.when(test, F.col("pos")))["v"]
    text = lambda prefix: F.when(raw.startswith(prefix), F.substring(raw, len(prefix) + 1, 1 << 30))
    old = F.when(k == "git", git_path(F.regexp_extract(raw, GIT, 1))).when(k == "old", header_path(raw)).otherwise(git_path(text("rename from "), strip=False))
    new = F.when(k == "git", git_path(F.regexp_extract(raw, GIT, 2))).when(k == "new", header_path(raw)).otherwise(git_path(text("rename to "), strip=False))
    change = F.when(raw.startswith("new file mode ") | ((k == "old") & header_path(raw).isNull()), "added").when(raw.startswith("deleted file mode ") | ((k == "new") & header_path(raw).isNull()), "deleted").when(raw.rlike("^rename (from|to) "), "renamed")
    out = lines.where("file > 0").groupBy("patch_id", "file").agg(
        last(old, k.isin("git", "old") | raw.startswith("rename from ")).alias("old_path"),
        last(new, k.isin("git", "new") | raw.startswith("rename to ")).alias("new_path"),
        F.coalesce(last(change, change.isNotNull()), F.lit("modified")).alias("change_type"),
        F.bool_or(raw.rlike("^(Binary files |GIT binary patch)")).alias("is_binary"),
        last(F.coalesce(text("old mode "), text("deleted file mode ")), raw.rlike("^(old mode|deleted file mode) ")).alias("old_mode"),
        last(F.coalesce(text("new mode "), text("new file mode ")), raw.rlike("^new (file )?mode ")).alias("new_mode"),
        last(F.regexp_extract(raw, r"^similarity index (\d+)%?$", 1).try_cast("int"), raw.startswith("similarity index ")).alias("similarity"),
    )
    return out.withColumn("path", F.coalesce("new_path", "old_path"))


def patch_hunks(lines: DataFrame) -> DataFrame:
    """Hunk headers: starts and counts (1 where none is given) and the section text."""
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract("raw", HUNK, i), F.lit("")), F.lit("1")).cast("long")
    at = lines.where((F.col("kind") == "hunk") & (F.col("file") > 0))
    return at.select("patch_id", "file", "hunk", number(1).alias("old_start"), number(2).alias("old_count"), number(3).alias("new_start"), number(4).alias("new_count"), F.regexp_extract("raw", HUNK, 5).alias("section"))


def patch_lines(lines: DataFrame) -> DataFrame:
    """Content lines with their numbers on both sides: start of the hunk plus the lines of that side before."""
    rows = lines.where("file > 0 AND hunk > 0")
    order = Window.partitionBy("patch_id", "file", "hunk").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = lambda i: F.first(F.regexp_extract("raw", HUNK, i).try_cast("long")).over(order)
    seen = lambda *kinds: F.coalesce(F.count_if(F.col("kind").isin(*kinds)).over(before), F.lit(0))
    rows = rows.withColumn("o", start(1) + seen("context", "removed")).withColumn("n", start(3) + seen("context", "added"))
    rows = rows.where(F.col("kind").isin("context", "added", "removed"))
    return rows.select("patch_id", "file", "hunk", "pos", "kind", F.when(F.col("kind") != "added", F.col("o")).alias("old_line"), F.when(F.col("kind") != "removed", F.col("n")).alias("new_line"), F.substring("raw", 2, 1 << 30).alias("content"))


def patch_stats(content: DataFrame) -> DataFrame:
    """Additions, deletions and files on both levels: each file, and (file null) the whole patch."""
    out = content.rollup("patch_id", "file").agg(F.count_if(F.col("kind") == "added").alias("additions"), F.count_if(F.col("kind") == "removed").alias("deletions"), F.count_distinct("file").alias("files"))
    return out.where("patch_id IS NOT NULL")


def changed_ranges(content: DataFrame) -> DataFrame:
    """For each hunk with added lines the first and last of their numbers."""
    added = content.where("kind = 'added'")
    return added.groupBy("patch_id", "file", "hunk").agg(F.min("new_line").alias("first_line"), F.max("new_line").alias("last_line"))


def patch_errors(patches: DataFrame, lines: DataFrame) -> DataFrame:
    """The first error of each patch: NUL byte, unsafe path, missing header, bad hunk header, unexpected line in a hunk."""
    raw = F.col("raw")
    paths = F.when(F.col("kind") == "git", unsafe_path(git_path(F.regexp_extract(raw, GIT, 1))) | unsafe_path(git_path(F.regexp_extract(raw, GIT, 2)))).when(F.col("kind").isin("old", "new"), F.coalesce(unsafe_path(header_path(raw)), F.lit(False)))
    code = F.when(F.coalesce(paths, F.lit(False)), "unsafe_path").when((F.col("file") == 0) & (raw.startswith("+++ ") | raw.startswith("@@ ")), "missing_header")
    code = code.when((F.col("file") > 0) & raw.startswith("@@") & (F.col("kind") != "hunk"), "invalid_hunk_header").when((F.col("hunk") > 0) & (F.col("kind") == "other"), "unexpected_line")
    bad = lines.select("patch_id", "pos", code.alias("code")).where("code IS NOT NULL")
    nul = patches.where(F.col("text").contains("\0")).select("patch_id", F.lit(-1).alias("pos"), F.lit("nul_byte").alias("code"))
    return bad.unionByName(nul).groupBy("patch_id").agg(F.min(F.struct("pos", "code")).alias("e")).select("patch_id", "e.code", "e.pos")


def hash_changed_text(files: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """Digests of the old and the new text of changed files; the old side is found by old_path, so renames pair up."""
    digest = lambda df, name, path: df.select(F.col("path").alias(path), F.sha2("text", 256).alias(name))
    return files.join(digest(previous, "old_sha256", "old_path"), "old_path", "left").join(digest(current, "new_sha256", "new_path"), "new_path", "left")


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a changed range of their path. symbols: path, symbol, start_line, end_line; ranges: path, first_line, last_line."""
    overlap = (F.col("first_line") <= F.col("end_line")) & (F.col("last_line") >= F.col("start_line"))
    return symbols.join(ranges, "path").where(overlap).select("path", "symbol").distinct()


# Names and endings by which paths are classed.
LANGUAGES = {".go": "go", ".java": "java", ".js": "javascript", ".json": "json", ".jsx": "javascript", ".py": "python", ".pyi": "python", ".rs": "rust", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript", ".yaml": "yaml", ".yml": "yaml"}
CONFIG_NAMES = (".env", ".env.example", "compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml", "dockerfile", "package.json", "pyproject.toml", "setup.cfg", "tox.ini")
MANIFEST_NAMES = ("package-lock.json", "package.json", "pipfile", "pipfile.lock", "pnpm-lock.yaml", "poetry.lock", "pyproject.toml", "requirements-dev.txt", "requirements.txt", "uv.lock", "yarn.lock")
TEST_PATH = r"(?i)(^|/)(tests?|specs?)(/|$)|(^|/)(test_|.*(_test|\.spec|\.test)\.)"


def classify_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """df with language and the flags of its path."""
    p, low = F.col(path), F.lower(path)
    name, end = X.basename(low), X.suffix(low)
    has = lambda *words: low.rlike("|".join(words))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return df.select(
        "*",
        F.coalesce(F.element_at(table, end), F.lit("text")).alias("language"),
        p.rlike(TEST_PATH).alias("is_test"),
        (name.isin(*CONFIG_NAMES) | end.isin(".yaml", ".yml", ".toml", ".ini") | low.contains(".github/workflows")).alias("is_config"),
        (name.isin(*MANIFEST_NAMES) | (name.startswith("requirements") & (end == ".txt"))).alias("is_dependency_manifest"),
        has("migrations/", "alembic/versions/").alias("is_migration"),
        has("openapi", "swagger", "asyncapi").alias("is_api_schema"),
        (low.contains(".github/workflows/") | low.isin(".gitlab-ci.yml", "jenkinsfile")).alias("is_ci"),
        has("auth", "security", "permission", "secret", r"\.env", "private", "credential").alias("is_security_sensitive"),
        has("generated", "_pb2", r"\.min\.").alias("is_generated"),
    )


def file_risk(files: DataFrame) -> DataFrame:
    """files (additions, deletions and path flags) with risk, 0 to 100."""
    flag = lambda c, n: F.when(F.col(c), n).otherwise(0)
    churn = F.least(F.lit(30), F.floor((F.col("additions") + F.col("deletions")) / 20))
    score = churn + flag("is_security_sensitive", 20) + flag("is_dependency_manifest", 15) + flag("is_migration", 20) + flag("is_ci", 10) - flag("is_test", 10)
    return files.withColumn("risk", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))


def changed_files_view(lines: DataFrame) -> DataFrame:
    """One flat row for each changed file: path, type, churn, language, flags, risk."""
    stats = patch_lines(lines).groupBy("patch_id", "file").agg(F.count_if(F.col("kind") == "added").alias("additions"), F.count_if(F.col("kind") == "removed").alias("deletions"))
    return file_risk(classify_paths(patch_files(lines).join(stats, ["patch_id", "file"], "left").na.fill(0, ["additions", "deletions"])))
