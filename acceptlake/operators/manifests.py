"""Manifests, environment references, configuration keys, migrations and models from texts. files: path, text (and snapshot)."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .names import contained
from .security import by_line

try:
    import yaml
except ImportError:  # YAML texts have no keys then
    yaml = None


def _requirement(raw: DataFrame) -> DataFrame:
    """name, spec, locked, direct_url of requirement lines (column raw)."""
    v = F.split_part(F.trim("raw"), F.lit(" #"), F.lit(1))
    rows = raw.withColumn("v", v).where((F.col("v") != "") & ~F.col("v").rlike("^(#|-r|--)"))
    rows = rows.withColumn("name", F.regexp_extract("v", r"^([A-Za-z0-9_.-]+)", 1)).where("name <> ''")
    url = F.col("v").contains(" @ ") | F.col("v").rlike("^(git\\+|https?://)")
    return rows.select("path", "name", F.trim(F.regexp_extract("v", r"^[A-Za-z0-9_.-]+(.*)", 1)).alias("spec"), F.col("v").contains("==").alias("locked"), url.alias("direct_url"))


def parse_requirements_txt(files: DataFrame) -> DataFrame:
    return _requirement(by_line(files).withColumnRenamed("code", "raw"))


def parse_package_json(files: DataFrame) -> DataFrame:
    """Dependencies of the four sections of package.json texts; broken JSON gives none."""
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    kind = "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">"
    rows = files.select("path", F.from_json("text", kind).alias("j"))
    parts = F.concat(*[F.coalesce(F.map_entries(F.col("j")[s]), F.array().cast("array<struct<key:string,value:string>>")) for s in sections])
    rows = rows.select("path", F.explode(parts).alias("e")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("spec"))
    return rows.select("path", "name", "spec", (~F.col("spec").rlike(r"^(\^|~|>|<|\*|latest)")).alias("locked"), F.col("spec").rlike("^(git|http|github:)").alias("direct_url"))


def parse_dockerfile_images(files: DataFrame) -> DataFrame:
    """Images of FROM lines: name and tag (latest if none; a port of a registry is no tag)."""
    image = F.explode(F.regexp_extract_all("text", F.lit(r"(?im)^\s*FROM\s+([^\s]+)"), F.lit(1)))
    rows = files.select("path", image.alias("image"))
    tag = F.when(F.col("image").contains(":"), F.substring_index("image", ":", -1))
    rows = rows.withColumn("tag", F.when(~tag.contains("/"), tag))
    name = F.when(F.col("tag").isNull(), F.col("image")).otherwise(F.regexp_replace("image", ":[^:]*$", ""))
    return rows.select("path", name.alias("name"), F.coalesce("tag", F.lit("latest")).alias("spec"))


def parse_pyproject_deps(files: DataFrame) -> DataFrame:
    """Dependencies of pyproject texts by line and section: quoted entries of [project] lists and [project.optional-dependencies], assignments of the poetry section."""
    rows = by_line(files)
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.nullif(F.regexp_extract("code", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit("")), ignorenulls=True).over(order))
    key = F.last(F.nullif(F.regexp_extract("code", r"^\s*([A-Za-z0-9_-]+)\s*=", 1), F.lit("")), ignorenulls=True).over(order)
    rows = rows.withColumn("key", key)
    listed = (F.col("section") == "project") & (F.col("key") == "dependencies") | (F.col("section") == "project.optional-dependencies")
    entries = rows.where(listed).select("path", F.explode(F.regexp_extract_all("code", F.lit(r'"([^"]+)"'), F.lit(1))).alias("raw"))
    poetry = rows.where("section = 'tool.poetry.dependencies'").select("path", F.regexp_extract("code", r"^\s*([A-Za-z0-9_.-]+)\s*=", 1).alias("name"), F.regexp_extract("code", r"=\s*\"?([^\"]*)\"?\s*$", 1).alias("spec")).where("name <> '' AND lower(name) <> 'python'")
    poetry = poetry.select("path", "name", "spec", F.col("spec").contains("==").alias("locked"), F.col("spec").rlike("git|url").alias("direct_url"))
    return _requirement(entries).unionByName(poetry)


# Lock files.
NPM_LOCKS, PYTHON_LOCKS = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock"), ("pdm.lock", "pipfile.lock", "poetry.lock", "uv.lock")


def lockfile_missing(files: DataFrame) -> DataFrame:
    """Snapshots with a manifest but none of its lock files."""
    name = F.lower(X.basename(F.col("path")))
    has = lambda *names: F.bool_or(name.isin(*names))
    s = files.groupBy("snapshot").agg(has("package.json").alias("npm"), has(*NPM_LOCKS).alias("npm_lock"), has("pyproject.toml").alias("py"), has(*PYTHON_LOCKS).alias("py_lock"))
    found = F.array(F.when(F.col("npm") & ~F.col("npm_lock"), F.struct(F.lit("npm-lockfile-missing").alias("rule_id"), F.lit("medium").alias("severity"))), F.when(F.col("py") & ~F.col("py_lock"), F.struct(F.lit("python-lockfile-missing").alias("rule_id"), F.lit("low").alias("severity"))))
    return s.select("snapshot", F.inline(F.array_compact(found)))


def env_references(files: DataFrame) -> DataFrame:
    """name, path, line, required, default_value: os.environ and os.getenv in Python, process.env.X and ${X} elsewhere; one for each name and line."""
    rows = by_line(files)
    python = F.col("path").endswith(".py")
    call = r"""(os\.(?:getenv|environ\.get)\(\s*["'][^"']+["'](?:\s*,\s*[^)]*)?\)|os\.environ\[\s*["'][^"']+["']\s*\])"""
    py = rows.where(python).select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(call), F.lit(1))).alias("m"))
    default = F.nullif(F.regexp_replace(F.trim(F.regexp_extract("m", r"^os\.(?:getenv|environ\.get)\([^,]*,\s*(?:default\s*=\s*)?(.*)\)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    py = py.select(F.regexp_extract("m", r"""["']([^"']+)["']""", 1).alias("name"), "path", "line", default.alias("default_value"))
    text = rows.where(~python).select(F.explode(F.regexp_extract_all("code", F.lit(r"(?:process\.env\.|\$\{)([A-Z][A-Z0-9_]{2,})"), F.lit(1))).alias("name"), "path", "line").withColumn("default_value", F.lit(None).cast("string"))
    return py.unionByName(text).dropDuplicates(["name", "path", "line"]).withColumn("required", F.col("default_value").isNull())


def documented_env(files: DataFrame) -> DataFrame:
    """Names that example files and READMEs assign."""
    name = F.lower(X.basename(F.col("path")))
    docs = files.where(name.isin(".env.example", ".env.sample", "readme.md", "readme"))
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:export\s+)?([A-Z][A-Z0-9_]{1,})\s*="), F.lit(1))).alias("name")).distinct()


def undocumented_env(current: DataFrame, previous: DataFrame | None, documented: DataFrame) -> DataFrame:
    """New names that no document has, each with its first reference: high if that is required."""
    new = current.join(documented.select("name").distinct(), "name", "left_anti")
    if previous is not None:
        new = new.join(previous.select("name").distinct(), "name", "left_anti")
    first = F.row_number().over(Window.partitionBy("name").orderBy("path", "line"))
    return new.withColumn("r", first).where("r = 1").select("name", "path", "line", F.when(F.col("required"), "high").otherwise("medium").alias("severity"))


def compose_env_drift(references: DataFrame, compose: DataFrame) -> DataFrame:
    """Names that are read but that no compose file sets; nothing where there is no compose file."""
    keys = compose.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)(?:^|[-{, ]\s*)([A-Z][A-Z0-9_]{2,})\s*(?:=|:)"), F.lit(1))).alias("name")).distinct()
    there = compose.limit(1).select(F.lit(1).alias("there"))
    return references.select("name").distinct().join(keys, "name", "left_anti").join(F.broadcast(there)).drop("there")


def _leaves(key: str, value) -> Iterator[tuple[str, str]]:
    """Leaf keys below key, of any depth, with their values as JSON."""
    todo = [(key, value)]
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{key}:{k}", v) for k, v in reversed(value.items())]
        else:
            yield key, json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def _parsed(path: str, text: str):
    """The value of a configuration text: TOML or YAML by its ending, else JSON. ValueError where it can't be read."""
    end = path.rpartition(".")[2].lower()
    if end == "toml":
        return tomllib.loads(text)
    if end in ("yaml", "yml"):
        if yaml is None:
            raise ValueError("no YAML parser")
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
    return json.loads(text)


def config_flatten(rows: DataFrame) -> DataFrame:
    """Leaf keys of configuration texts (path, text) as path:key:..., of any depth, with their values as JSON; lists are leaves. Each text is parsed
    once, in the task that holds it; one that can't be parsed has no keys, nor has an empty object."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    found += _leaves(path, _parsed(path, text)) if path is not None and text is not None else []
                except (ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["key", "value"])

    return rows.select("path", "text").mapInArrow(scan, "key string, value string")


def model_fields(files: DataFrame) -> DataFrame:
    """Fields (Class.name) of lines that assign a column under the last class above them."""
    rows = by_line(files.where(F.col("path").endswith(".py") & F.col("text").rlike(r"Mapped\[|Column\(|mapped_column\(")))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.nullif(F.regexp_extract("code", r"^\s*class\s+(\w+)", 1), F.lit("")), ignorenulls=True).over(order)
    rows = rows.withColumn("owner", owner).withColumn("name", F.regexp_extract("code", r"^\s+(\w+)\s*(?::[^=]+)?=\s*(?:mapped_column|Column)\s*\(", 1))
    return rows.where("name <> '' AND owner IS NOT NULL").select(F.concat_ws(".", "owner", "name").alias("field")).distinct()


def model_field_diff(previous: DataFrame, current: DataFrame, migrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields added and removed, and a finding that names the first eight if there are any and no migration has changed."""
    diff = current.exceptAll(previous).select("field", F.lit("added").alias("change")).unionByName(previous.exceptAll(current).select("field", F.lit("removed").alias("change")))
    named = diff.agg(F.slice(F.array_sort(F.collect_list("field")), 1, 8).alias("fields")).where(F.size("fields") > 0)
    none = migrations.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("database.model-change-without-migration").alias("rule_id"))
    return diff, none.join(named)


# Operations of migrations and their severities.
OPERATIONS = (("drop_column", "high", r"op\.drop_column\s*\("), ("drop_table", "critical", r"op\.drop_table\s*\("), ("rename_column", "high", r"op\.alter_column\s*\([^)]*new_column_name"), ("raw_sql", "medium", r"op\.execute\s*\("), ("create_index", "medium", r"op\.create_index\s*\("))


def migration_operations(files: DataFrame) -> DataFrame:
    """Operations of migration texts, each with severity and line."""
    hits = [F.when(F.col("code").rlike(p), F.struct(F.lit(o).alias("operation"), F.lit(s).alias("severity"))) for o, s, p in OPERATIONS]
    return by_line(files).select("path", "line", F.inline(F.array_compact(F.array(*hits))))


def non_null_without_default(files: DataFrame) -> DataFrame:
    """Added columns that may not be null and have no default: path, call."""
    calls = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(op\.add_column\s*\([^)]*\))"), F.lit(1))).alias("call"))
    return calls.where(F.col("call").rlike(r"nullable\s*=\s*False") & ~F.col("call").rlike("default"))


def irreversible_migration(files: DataFrame) -> DataFrame:
    """Migrations without a downgrade, or with one that does nothing."""
    none = ~F.col("text").contains("def downgrade") | F.col("text").rlike(r"def downgrade\([^)]*\):\s+(?:pass|raise NotImplementedError)")
    return files.where(none).select("path", F.lit("database.irreversible-migration").alias("rule_id"))


# Forms of metric names and rule ids, and the comparison operators.
METRIC, RULE_ID = r"^[A-Za-z][A-Za-z0-9_-]*(?:\.[A-Za-z][A-Za-z0-9_-]*)*$", r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in", "exists")


def policy_rules_load(rules: DataFrame) -> DataFrame:
    """Verdict on rules (policy, version, id, metric, operator, value as JSON, outcome): the first error, null if there is none."""
    kind = F.when(F.col("value").isNull(), "missing").when(F.col("value").startswith("["), "list").when(F.col("value").startswith('"'), "text").when(F.col("value").isin("true", "false"), "boolean").otherwise("number")
    same = F.count("*").over(Window.partitionBy("policy", "id"))
    error = F.when(F.coalesce(F.col("version"), F.lit(0)) < 1, "bad_version").when(~F.coalesce(F.col("id").rlike(RULE_ID), F.lit(False)), "bad_id").when(~F.coalesce(F.col("metric").rlike(METRIC), F.lit(False)), "bad_metric").when(~F.coalesce(F.col("operator").isin(*OPERATORS), F.lit(False)), "bad_operator")
    error = error.when((F.col("operator") != "exists") & (kind == "missing"), "value_required").when(F.col("operator").isin("in", "not_in") & ~kind.isin("list", "text"), "bad_collection").when((F.col("operator") == "exists") & ~kind.isin("missing", "boolean"), "bad_exists")
    error = error.when(~F.coalesce(F.col("outcome"), F.lit("fail")).isin("warn", "fail"), "bad_outcome").when(same > 1, "duplicate_id")
    return rules.withColumn("error", error)


def test_framework(path: Column, text: Column) -> Column:
    low = F.lower(path)
    python = path.endswith(".py") & (low.rlike(r"(^|/)(test_.+|.+_test)\.py$") | text.contains("import pytest") | text.contains("unittest.TestCase"))
    script = low.rlike(r"\.(?:test|spec)\.[jt]sx?$")
    out = F.when(python, F.when(text.contains("pytest") | ~text.contains("unittest"), "pytest").otherwise("unittest"))
    out = out.when(script, F.when(text.contains("@playwright/test"), "playwright").when(text.contains("vitest"), "vitest").otherwise("jest"))
    return out.when(low.contains("playwright") & text.rlike(r"\btest\s*\("), "playwright")


def test_discovery(files: DataFrame) -> DataFrame:
    """Test files with their framework, and whether they are integration tests by path."""
    rows = files.withColumn("framework", test_framework(F.col("path"), F.col("text"))).where("framework IS NOT NULL")
    return rows.select("path", "framework", F.lower("path").rlike("integration|e2e|contract").alias("integration"), "text")


def test_facts(tests: DataFrame) -> DataFrame:
    """Test names, fixtures and imported modules of discovered test files."""
    defs = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:async\s+)?def\s+(test_\w+)\s*\("), F.lit(1))
    args = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:async\s+)?def\s+test_\w+\s*\(([^)]*)\)"), F.lit(1))
    names = F.filter(F.flatten(F.transform(args, lambda a: F.transform(F.split(a, ","), lambda x: F.regexp_extract(F.trim(x), r"^\w+", 0)))), lambda x: (x != "") & ~x.isin("self", "cls"))
    modules = F.filter(F.concat(F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import"), F.lit(1))), lambda m: m != "")
    return tests.select("path", "framework", "integration", defs.alias("tests"), names.alias("fixtures"), modules.alias("modules"))


def _stem(path: Column) -> Column:
    return F.regexp_replace(X.basename(path), r"\.[^.]*$", "")


def test_source_match(facts: DataFrame, sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, test) pairs: same basename, an import of the source's module or below it, or a changed symbol of it in test or fixture names.

    facts: of test_facts; sources: path; symbols: symbol (changed, qualified). Name and module are equi joins; for the third all symbols are looked for at once.
    """
    s = sources.select(F.col("path").alias("source")).distinct()
    module = F.regexp_replace(F.regexp_replace("source", r"\.[^./]*$", ""), "/", ".")
    modules = s.select("source", F.explode(F.array_distinct(F.array(module, F.regexp_replace(module, r"^(src|lib|python)\.", "")))).alias("module"))
    name = s.withColumn("name", F.regexp_replace(_stem(F.col("source")), "^test_", ""))
    t_name = facts.select(F.col("path").alias("test"), F.regexp_replace(F.regexp_replace(_stem(F.col("path")), "^test_", ""), "_test$", "").alias("name"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("m", r"\."))), lambda i: F.array_join(F.slice(F.split("m", r"\."), 1, i), "."))
    imports = facts.select(F.col("path").alias("test"), F.explode("modules").alias("m")).select("test", F.explode(prefixes).alias("module"))
    below = F.transform(F.sequence(F.lit(1), F.size(F.split("symbol", r"\."))), lambda i: F.array_join(F.slice(F.split("symbol", r"\."), 1, i), "."))
    own = symbols.select("symbol", F.explode(below).alias("module")).join(modules, "module").select("source", F.lower(F.substring_index("symbol", ".", -1)).alias("short")).where(F.length("short") > 3).distinct()
    words = facts.select(F.col("path").alias("text_id"), F.lower(F.concat_ws(" ", "tests", "fixtures")).alias("text"))
    named = own.join(contained(own.select(F.col("short").alias("name")), words), F.col("short") == F.col("name")).select("source", F.col("text_id").alias("test"))
    return name.join(t_name, "name").select("source", "test").unionByName(modules.join(imports, "module").select("source", "test")).unionByName(named).distinct()


def test_gap_findings(sources: DataFrame, matches: DataFrame, facts: DataFrame, changed_tests: int = 0) -> DataFrame:
    """Findings on changed sources (path, public_api): none of the tests matches (high; medium if tests changed), or a public one lacks an integration test."""
    pairs = matches.join(facts.select(F.col("path").alias("test"), "integration"), "test").groupBy(F.col("source").alias("path")).agg(F.bool_or("integration").alias("integration"))
    rows = sources.join(pairs, "path", "left")
    found = F.array(F.when(F.col("integration").isNull(), F.struct(F.lit("test.changed-source-without-evidence").alias("rule_id"), F.lit("medium" if changed_tests else "high").alias("severity"))), F.when(F.col("public_api") & ~F.coalesce("integration", F.lit(False)), F.struct(F.lit("test.public-api-without-integration-test").alias("rule_id"), F.lit("high").alias("severity"))))
    return rows.select("path", F.inline(F.array_compact(found)))


def test_evidence_score(sources: DataFrame, matches: DataFrame, coverage: float | None, changed_tests: int) -> DataFrame:
    """min(1, 0.75 * share of sources with a test + 0.25 * requirement coverage + min(0.15, 0.03 * changed tests)); 1 for no sources."""
    share = sources.select(F.col("path").alias("source")).distinct().join(matches.select("source").distinct().withColumn("hit", F.lit(1.0)), "source", "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(1.0)).alias("share"))
    other = F.col("share") if coverage is None else F.lit(float(coverage))
    return share.select(F.least(F.lit(1.0), F.col("share") * 0.75 + other * 0.25 + min(0.15, changed_tests * 0.03)).alias("score"))


def test_suggestions(uncovered: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each source without a test: name and path of one to write, and its target, the first changed symbol that holds the stem."""
    rows = uncovered.select("path", _stem(F.col("path")).alias("stem"))
    held = contained(rows.select(F.col("stem").alias("name")), symbols.select(F.col("symbol").alias("text_id"), F.col("symbol").alias("text")).distinct())
    first = held.groupBy("name").agg(F.min("text_id").alias("symbol"))
    met = rows.join(first, F.col("stem") == F.col("name"), "left")
    return met.select("path", F.concat(F.lit("test_"), "stem", F.lit("_changed_behavior")).alias("name"), F.coalesce("symbol", "path").alias("target"), F.concat(F.lit("tests/test_"), "stem", F.lit(".py")).alias("recommended_path"))
