"""Code facts as DataFrame operations: declarations, imports, calls, complexity, exports, behaviour, warnings, routes, dangerous calls.

facts: of functions.pysource.code_facts, where each fact carries the scope and the declarations around it, so nothing joins lines with intervals.
Names are qualified by the module that the path stands for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .security import dedupe_findings

# Dangerous calls by what they call: rule and severity.
DANGEROUS = {
    "eval": ("python.eval", "high"),
    "exec": ("python.exec", "high"),
    "pickle.loads": ("python.pickle-loads", "high"),
    "os.system": ("python.os-system", "high"),
    "tempfile.mktemp": ("python.insecure-tempfile", "high"),
    "hashlib.md5": ("python.weak-hash", "medium"),
    "hashlib.sha1": ("python.weak-hash", "medium"),
}
# Calls that may start a shell, and the methods of a router.
SHELL_CALLS = ("subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_call", "subprocess.check_output")
ROUTE_METHODS = ("get", "post", "put", "patch", "delete", "options", "head", "trace")
# Annotations that are no model of a request.
PLAIN_TYPES = ("Request", "Response", "str", "int", "float", "bool", "bytes")


def _of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("fact").isin(*kinds))


def _qualified() -> Column:
    return F.concat_ws(".", F.nullif("scope", F.lit("")), "name")


def _keyword(name: str, form: str | None = None) -> Column:
    """The arguments passed by this keyword, or the parts of such a list or dict."""
    return F.filter("args", lambda a: (a["name"] == name) & ((a["form"] == form) if form else ~a["form"].isin("element", "entry")))


def code_declarations(facts: DataFrame) -> DataFrame:
    """Functions, methods and classes: number (in the file), qualified_name, owner (the class of a method; the class around a class), kind, lines, signature, bases, decorators."""
    marks = _of(facts, "decorator").where("name <> ''").groupBy("path", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("weight", "name"))), lambda x: x["name"]).alias("decorators"))
    rows = _of(facts, "declaration").join(marks, ["path", "number"], "left")
    kind = F.when(F.col("form") == "class", "class").when(F.col("alias").isNotNull(), "method").otherwise("function")
    none = F.array().cast("array<string>")
    bases = F.when(F.col("form") == "class", F.filter(F.transform("args", lambda a: a["name"]), lambda x: x != "")).otherwise(none)
    return rows.select("path", "number", _qualified().alias("qualified_name"), F.col("alias").alias("owner"), kind.alias("kind"), F.col("line").alias("start_line"), "end_line", F.col("form").startswith("async").alias("is_async"), F.col("value").alias("signature"), bases.alias("bases"), F.coalesce("decorators", none).alias("decorators"))


def code_imports(facts: DataFrame) -> DataFrame:
    """module (with its leading dots), name, alias, line, wildcard, dynamic of imports and dynamic imports."""
    return _of(facts, "import").select("path", "line", F.col("name").alias("module"), F.col("value").alias("name"), "alias", (F.col("form") == "dynamic").alias("dynamic"), F.coalesce(F.col("value") == "*", F.lit(False)).alias("wildcard"))


def code_calls(facts: DataFrame) -> DataFrame:
    """caller (the scope; the module outside of declarations), target, line."""
    return _of(facts, "call").where("name <> ''").select("path", F.col("scope").alias("caller"), F.col("name").alias("target"), "line")


def _names(facts: DataFrame) -> DataFrame:
    return _of(facts, "declaration").select("path", "number", "form", _qualified().alias("qualified_name"))


def code_complexity(facts: DataFrame) -> DataFrame:
    """1 + branches and further operands of and / or inside each declaration, nested bodies included."""
    inside = _of(facts, "branch").select("path", F.explode("within").alias("number"), "weight").groupBy("path", "number").agg(F.sum("weight").alias("n"))
    return _names(facts).join(inside, ["path", "number"], "left").select("path", "number", "qualified_name", (F.lit(1) + F.coalesce("n", F.lit(0))).cast("long").alias("complexity"))


def code_exports(facts: DataFrame) -> DataFrame:
    """Whether a symbol is exported: no leading underscore; where the module sets a literal __all__, its last decides for symbols without an owner."""
    listed = _of(facts, "export").groupBy("path").agg(F.max_by(F.transform("args", lambda a: a["literal"]), "line").alias("names"))
    rows = _of(facts, "declaration").select("path", "number", _qualified().alias("qualified_name"), "name", F.col("alias").alias("owner")).join(listed, "path", "left")
    chosen = F.exists("names", lambda x: x.eqNullSafe(F.col("name")))
    return rows.select("path", "number", "qualified_name", F.when(F.col("owner").isNull() & F.col("names").isNotNull(), chosen).otherwise(~F.col("name").startswith("_")).alias("exported"))


def code_behaviour(facts: DataFrame) -> DataFrame:
    """Return shapes and raised names of each function, those of nested functions and classes excluded."""
    own = _of(facts, "return", "raise").where("size(within) > 0").select("path", F.element_at("within", -1).alias("number"), "fact", "name")
    own = own.groupBy("path", "number").agg(*[F.sort_array(F.collect_set(F.when(F.col("fact") == f, F.col("name")))).alias(n) for f, n in (("return", "return_shapes"), ("raise", "raises"))])
    none = F.array().cast("array<string>")
    rows = _names(facts).where("form <> 'class'").join(own, ["path", "number"], "left")
    return rows.select("path", "number", "qualified_name", F.coalesce("return_shapes", none).alias("return_shapes"), F.coalesce("raises", none).alias("raises"))


def code_warnings(facts: DataFrame) -> DataFrame:
    """Wildcard and dynamic imports, and texts that can't be parsed (line: where that showed, if known)."""
    rule = F.when((F.col("fact") == "import") & (F.col("value") == "*"), "python.wildcard-import").when((F.col("fact") == "import") & (F.col("form") == "dynamic"), "python.dynamic-import").when(F.col("fact") == "error", "python.syntax-error")
    rows = facts.select("path", F.when(F.col("fact") == "error", F.col("weight")).otherwise(F.col("line")).alias("line"), rule.alias("rule_id"), F.lit("medium").alias("severity"))
    return rows.where("rule_id IS NOT NULL")


def danger_calls(facts: DataFrame) -> DataFrame:
    """Calls that run code, start a shell, read unsafe data, skip a check or build SQL from texts, wherever their arguments stand; each rule once a line."""
    target, first = F.coalesce("value", F.lit("")), F.get(F.filter("args", lambda a: a["name"].isNull()), F.lit(0))
    has = lambda name, text: F.exists(_keyword(name), lambda a: a["text"] == text)
    safe = F.exists(_keyword("Loader"), lambda a: a["text"].endswith("SafeLoader"))
    unverified = F.exists(_keyword("options", "entry"), lambda a: (a["first"] == "'verify_signature'") & (a["text"] == "False"))
    sql = F.lower(first["text"]).rlike("select |insert |update |delete ") & (first["form"].isin("BinOp", "JoinedStr") | F.lower(first["text"]).contains(".format("))
    rules = [
        *[(target == call, rule, severity) for call, (rule, severity) in DANGEROUS.items()],
        (target.isin(*SHELL_CALLS) & has("shell", "True"), "python.subprocess-shell", "critical"),
        (target.isin("yaml.load", "yaml.unsafe_load") & ~safe, "python.unsafe-yaml-load", "high"),
        (has("verify", "False"), "python.tls-verification-disabled", "high"),
        (target.endswith("jwt.decode") & ((F.size(_keyword("algorithms")) == 0) | unverified), "python.jwt-validation-incomplete", "high"),
        (F.lower(target).rlike("(execute|executemany)$") & sql, "python.sql-string-concatenation", "high"),
    ]
    hits = [F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))) for test, rule, severity in rules]
    return _of(facts, "call").select("path", "line", F.inline(F.array_compact(F.array(*hits)))).select("path", "rule_id", "severity", "line").distinct()


def web_routes(facts: DataFrame) -> DataFrame:
    """Routes of decorators: method, router prefix and path, handler, request models, response model, status (null: not given), dependencies, line.

    A parameter whose default is a call of Depends is a dependency; any other with an annotation that is no plain type is a request model.
    """
    own = _of(facts, "decorator").where((F.col("form") == "call") & F.col("value").contains(".")).select("path", "number", "weight", "args", F.regexp_extract("value", r"^(.*)\.[^.]*$", 1).alias("router"), F.substring_index("value", ".", -1).alias("method"))
    own = own.where(F.lower("method").isin(*ROUTE_METHODS))
    first = F.get(F.filter("args", lambda a: a["name"].isNull()), F.lit(0))
    own = own.withColumn("own", F.when(F.size(F.filter("args", lambda a: a["name"].isNull())) == 0, "").otherwise(first["literal"])).where("own IS NOT NULL")
    prefix = F.coalesce(F.get(_keyword("prefix"), F.lit(0))["literal"], F.lit(""))
    last = Window.partitionBy("path", "router").orderBy(F.desc("weight"), F.desc("line"))
    routers = _of(facts, "assigned call").where(F.col("value").endswith("APIRouter")).select("path", F.col("name").alias("router"), prefix.alias("prefix"), "weight", "line").withColumn("k", F.row_number().over(last)).where("k = 1")
    handlers = _of(facts, "declaration").where("form <> 'class'").select("path", "number", F.col("name").alias("handler"), F.col("args").alias("parameters"), "line")
    rows = own.join(handlers, ["path", "number"]).join(routers.select("path", "router", "prefix"), ["path", "router"], "left")
    parts = F.filter(F.split(F.concat_ws("/", F.coalesce("prefix", F.lit("")), "own"), "/"), lambda x: x != "")
    depends = lambda p: (p["form"] == "Call") & p["callee"].endswith("Depends")
    named = lambda a, other: F.coalesce(a["first"], other)
    models = F.transform(F.filter("parameters", lambda p: ~F.coalesce(depends(p), F.lit(False)) & ~p["annotation"].isin(*PLAIN_TYPES)), lambda p: p["annotation"])
    by_default = F.transform(F.filter("parameters", depends), lambda p: named(p, F.lit("Depends")))
    declared = F.transform(F.filter(_keyword("dependencies", "element"), lambda a: a["callee"].isNotNull()), lambda a: named(a, a["callee"]))
    status = F.get(F.filter(_keyword("status_code"), lambda a: a["text"].rlike(r"^[+-]?\d+$")), F.lit(0))["text"].try_cast("int")
    return rows.select(
        "path", F.upper("method").alias("method"), F.concat(F.lit("/"), F.array_join(parts, "/")).alias("route"), "handler", F.array_distinct(models).alias("request_models"),
        F.get(_keyword("response_model"), F.lit(0))["text"].alias("response_model"), status.alias("status"), F.array_distinct(F.concat(by_default, declared)).alias("dependencies"), "line",
    )


#: Findings of analyzers written in Python.
FINDINGS = "fingerprint string, seq long, path string, analyzer string, rule_id string, severity string, line int, message string"


def run_analyzers(files: DataFrame, analyzers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Findings (fingerprint, seq and what else all analyzers return) of user functions from files to findings, one for each fingerprint."""
    out = None
    for f in analyzers:
        out = f(files) if out is None else out.unionByName(f(files))
    return dedupe_findings(out, "seq")


def python_analyzer(name: str, body: Callable[[str, str], Iterable[dict]], severity: str = "medium") -> Callable[[DataFrame], DataFrame]:
    """An analyzer for run_analyzers with a Python body: body(path, text) gives findings as dicts of rule_id and, if need be, severity, line and message.

    files: seq, path, text. Each file is analysed alone where it lies: one whose analysis fails, or gives what is no finding, has a finding
    "analyzer.failed" in place of its own, and the others keep theirs. A file without text isn't analysed.
    """
    names = [c.split()[0] for c in FINDINGS.split(", ")]

    def of(seq: int, path: str, text: str) -> list[tuple]:
        def finding(rule_id: str, severity: str = severity, line: int | None = None, message: str | None = None) -> tuple:
            digest = hashlib.sha256(f"{name}:{rule_id}:{path}:{line}:{message}".encode("utf-8", "replace")).hexdigest()
            return digest, seq, path, name, str(rule_id), str(severity), None if line is None else int(line), None if message is None else str(message)

        try:
            return [finding(**f) for f in body(path, text)]
        except Exception as e:  # whatever a user's function raises
            return [finding("analyzer.failed", "high", None, f"{type(e).__name__}: {e}")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string()]
        for batch in batches:
            for seq, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text is not None and (rows := of(seq, path, text)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return lambda files: files.select(F.col("seq").cast("long"), "path", "text").mapInArrow(scan, FINDINGS)


def rescored(scores: DataFrame, scorer: Column) -> DataFrame:
    """Requirement scores with a scorer of the user's own in place of the built-in one; the same cut follows."""
    return scores.withColumn("score", scorer.cast("double")).where("score > 0")
