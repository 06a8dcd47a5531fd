"""Scans of texts for credentials and risky settings; fingerprints, deduplication and redaction of findings.

files: path, text (and mode). Findings: path, rule_id, severity, line and what a rule adds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# Credential rules in the order in which they claim a value: id, severity, pattern with the value in group 1.
SECRET_RULES = (
    ("secret.aws-access-key", "critical", r"(AKIA[0-9A-Z]{16})"),
    ("secret.github-token", "critical", r"(gh[pousr]_[A-Za-z0-9]{30,255})"),
    ("secret.jwt", "high", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("secret.private-key", "critical", r"(-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)"),
    ("secret.bearer-token", "critical", r"(?i)Bearer\s+([A-Za-z0-9._~+/-]{20,}={0,2})"),
    ("secret.database-url", "critical", r"""((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]+:[^\s@/]+@[^\s'"]+)"""),
    ("secret.assigned-credential", "high", r"""(?i)(?:api[_-]?key|secret|token|password|passwd|client[_-]?secret)\s*[:=]\s*['"]([^'"\s]{8,})['"]"""),
    ("secret.dotenv-value", "high", r"""(?im)^(?:[A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|API_KEY)[A-Z0-9_]*)\s*=\s*['"]?([^\s#'"]{12,})"""),
)
RULE_SCHEMA = "rule_id string, severity string, pattern string, value_group int, excuse string"


def user_rules(files: DataFrame, rules: DataFrame, max_rules: int = 1_000) -> DataFrame:
    """Rules that come as data (RULE_SCHEMA; group 0: the whole match) against every text; their number is checked before they are broadcast."""
    if (n := rules.count()) > max_rules:
        raise ValueError(f"{n} rules; at most {max_rules}")
    hit = F.regexp_count(F.col("text"), F.col("pattern")) > 0
    free = F.col("excuse").isNull() | (F.regexp_count(F.col("text"), F.col("excuse")) == 0)
    met = files.join(F.broadcast(rules), hit & free)
    return met.select("path", "rule_id", "severity", F.explode(F.regexp_extract_all(F.col("text"), F.col("pattern"), F.col("value_group"))).alias("value"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once; inside another lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# What every match of a rule holds, in lower case (any of the texts); rules that aren't named here are matched with every text.
HINTS = {
    "secret.aws-access-key": ("akia",),
    "secret.github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "secret.jwt": ("eyj",),
    "secret.private-key": ("-----begin ",),
    "secret.bearer-token": ("bearer",),
    "secret.database-url": ("://",),
    "secret.assigned-credential": ("api", "secret", "token", "passw"),
    "secret.dotenv-value": ("secret", "token", "password", "api_key"),
}


def _matches(place: int, pattern: str, hints: tuple[str, ...]) -> Column:
    """Every match of a pattern in text, in order: place (of the rule), k, size and breaks (characters and line breaks of the match and the gap before it),
    value (group 1), behind and breaks_behind (of the match behind the value, and of the value)."""
    wholes, values = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (0, 1))
    rows = F.arrays_zip(wholes.alias("m"), values.alias("v"), F.split("text", pattern, -1).alias("g"))  # the gap after the last match has none
    breaks = lambda c: F.regexp_count(c, F.lit("\n"))

    def row(x: Column, k: Column) -> Column:
        m, v, g = x["m"], x["v"], x["g"]
        behind = F.call_function("substring_index", m, v, F.lit(-1))
        fields = {"place": F.lit(place), "k": k, "size": F.length(g) + F.length(m), "breaks": breaks(g) + breaks(m), "value": v, "behind": F.length(behind), "breaks_behind": breaks(behind) + breaks(v)}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    low = F.lower("text")
    near = F.lit(True) if not hints else reduce(lambda x, y: x | y, [F.contains(low, F.lit(h)) for h in hints])
    found = F.transform(F.filter(rows, lambda x: x["m"].isNotNull()), row)
    return F.when(near & F.col("text").rlike(pattern), found).otherwise(F.array().cast("array<struct<place:int,k:int,size:int,breaks:int,value:string,behind:int,breaks_behind:int>>"))


def spans_of(files: DataFrame, patterns: list[tuple[str, tuple[str, ...]]], key: str) -> DataFrame:
    """Spans of patterns (with their hints) in text, each once, for the first pattern that finds it: key, place (of the pattern), start, stop (characters),
    line, value. Placeholders are passed over. Offsets are running sums over a text's matches, so many matches cost no more each."""
    rows = files.select(key, F.monotonically_increasing_id().alias("row"), F.concat(*[_matches(i, p, h) for i, (p, h) in enumerate(patterns)]).alias("f"))
    rows = rows.where(F.size("f") > 0).select(key, "row", F.inline("f")).repartition("row")
    upto = Window.partitionBy("row", "place").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("size").over(upto) - F.col("behind")
    rows = rows.select(key, "row", "place", "value", stop.alias("stop"), (F.sum("breaks").over(upto) + 1 - F.col("breaks_behind")).cast("int").alias("line"))
    rows = rows.where((F.col("value") != "") & ~X.is_placeholder(F.col("value"))).withColumn("start", F.col("stop") - F.length("value"))
    first = Window.partitionBy("row", "start", "stop").orderBy("place")
    return rows.withColumn("claim", F.row_number().over(first)).where("claim = 1").select(key, "place", "start", "stop", "line", "value")


def _hinted(rules: tuple) -> list[tuple[str, tuple[str, ...]]]:
    return [(pattern, HINTS.get(rule, ()) if (rule, severity, pattern) in SECRET_RULES else ()) for rule, severity, pattern in rules]


def secret_scan(files: DataFrame, rules: tuple = SECRET_RULES, key: str = "path") -> DataFrame:
    """Credentials: key, rule_id, severity, line, value, masked. Each span of a text goes to the first rule that finds it; placeholders are passed over."""
    named = F.element_at(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity")) for r, s, _ in rules]), F.col("place") + 1)
    rows = spans_of(files, _hinted(rules), key).withColumn("rule", named)
    return rows.select(key, "rule.rule_id", "rule.severity", "line", "value", X.mask(F.col("value")).alias("masked"))


def high_entropy_scan(files: DataFrame, threshold: float = 4.25, length: int = 28, key: str = "path") -> DataFrame:
    """Long tokens of high entropy whose span no credential rule has claimed: key, value, entropy, line."""
    pattern = rf"((?<![A-Za-z0-9])[A-Za-z0-9+/=_-]{{{length},}}(?![A-Za-z0-9]))"
    # where no such token is, no span needs its rules
    rows = spans_of(files.where(F.col("text").rlike(pattern)), [*_hinted(SECRET_RULES), (pattern, ())], key).where(F.col("place") == len(SECRET_RULES))
    rows = rows.where(~F.col("value").rlike("^(sha256-|symbol:|https)"))
    return rows.withColumn("entropy", X.shannon_entropy(F.col("value"))).where(F.col("entropy") >= threshold).select(key, "value", "entropy", "line")


def by_line(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(X.lines(F.col("text"))).alias("p", "code")).select("path", (F.col("p") + 1).alias("line"), "code")


def line_rules(files: DataFrame, rules: tuple) -> DataFrame:
    """Findings of rules that look at one line: path, rule_id, severity, line."""
    hits = [F.when(F.col("code").rlike(p) & (F.lit(True) if e is None else ~F.col("code").rlike(e)), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p, e in rules]
    return by_line(files).select("path", "line", F.inline(F.array_compact(F.array(*hits)))).select("path", "rule_id", "severity", "line")


def _first(files: DataFrame, rule: str, severity: str, pattern: str, test: Column | None = None) -> DataFrame:
    """The first place of a pattern in each text."""
    value = F.regexp_extract("text", pattern, 0)
    rows = files.where(F.col("text").rlike(pattern) if test is None else test & F.col("text").rlike(pattern))
    return rows.select("path", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), X.line_of(F.col("text"), value).alias("line"))


def text_danger_rules(files: DataFrame) -> DataFrame:
    """Wildcard origins with credentials, debug mode, and paths that a user controls; the first place of each."""
    cors = _first(files, "python.cors-wildcard-credentials", "critical", r"""allow_origins\s*=\s*\[\s*['"]\*['"]\s*\]""", F.col("text").rlike(r"allow_credentials\s*=\s*True"))
    debug = _first(files, "python.debug-enabled", "medium", r"\bdebug\s*=\s*True\b")
    paths = _first(files, "python.path-traversal-input", "high", r"\b(?:open|Path)\s*\(\s*(?:request\.|user_|filename\b|path_param\b)")
    return cors.unionByName(debug).unionByName(paths)


def committed_env_files(files: DataFrame) -> DataFrame:
    name = X.basename(F.col("path"))
    return files.where(((name == ".env") | name.startswith(".env.")) & ~name.isin(".env.example", ".env.sample")).select("path", F.lit("env.committed").alias("rule_id"), F.lit("high").alias("severity"))


def world_writable(files: DataFrame) -> DataFrame:
    return files.where(F.col("mode").bitwiseAND(2) != 0).select("path", F.lit("file.world-writable").alias("rule_id"), F.lit("high").alias("severity"))


def dockerfile_rules(files: DataFrame) -> DataFrame:
    """Base images without a version, a last user that is root or none, and chmod 777."""
    from_ = line_rules(files, (("docker.floating-base-image", "medium", r"(?i)^\s*FROM\s+(?:[^\s:]+|\S*:latest)(?:\s|$)", None), ("docker.world-writable", "high", r"(?i)\bchmod\s+(?:-R\s+)?777\b", None)))
    users = F.regexp_extract_all("text", F.lit(r"(?im)^\s*USER\s+([^\s]+)"), F.lit(1))
    root = files.where((F.size(users) == 0) | F.lower(F.try_element_at(users, F.lit(-1))).isin("root", "0", "0:0"))
    return from_.unionByName(root.select("path", F.lit("docker.root-user").alias("rule_id"), F.lit("high").alias("severity"), F.lit(1).alias("line")))


def workflow_unpinned(files: DataFrame) -> DataFrame:
    """Actions that are not pinned to a commit: path, action, line."""
    rows = by_line(files).withColumn("action", F.regexp_extract("code", r"^\s*-?\s*uses:\s*([^\s#]+)", 1)).where(F.col("action") != "")
    pinned = F.when(F.col("action").contains("@"), F.substring_index("action", "@", -1)).otherwise("").rlike("^[0-9a-fA-F]{40}$")
    return rows.where(~F.col("action").rlike(r"^(\./|docker://)") & ~pinned).select("path", "action", "line")


def compose_rules(files: DataFrame) -> DataFrame:
    """Literal secrets (each), the first debug port, the first bind to all interfaces."""
    secret = line_rules(files, (("compose.literal-secret", "critical", r"""(?i)^\s*[A-Z0-9_]*(?:PASSWORD|TOKEN|SECRET|API_KEY)[A-Z0-9_]*\s*:\s*['"]?[^\s'"$][^\s'"]*""", None),))
    port = _first(files, "compose.debug-port", "medium", r"(?:0\.0\.0\.0:)?(?:5678|9229|2345):")
    bind = _first(files, "network.wildcard-bind", "medium", r"""(?i)(?:--host\s+|host\s*:\s*['"]?)0\.0\.0\.0\b""")
    return secret.unionByName(port).unionByName(bind)


def fingerprint(*parts: Column) -> Column:
    """Digest of the parts, joined by colons; a missing part reads None."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def dedupe_findings(findings: DataFrame, order: str) -> DataFrame:
    """One finding for each fingerprint: the last one's values at the first one's place (column first)."""
    rest = [c for c in findings.columns if c != "fingerprint"]
    out = findings.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), order).alias("f"), F.min(order).alias("first"))
    return out.select("fingerprint", "first", "f.*")


def _hidden(kind: T.DataType) -> Column:
    """What stands for a value under a sensitive name: the marker in every text, one element or entry for any number, else null."""
    if isinstance(kind, T.StringType):
        return F.lit(X.REDACTED)
    if isinstance(kind, T.ArrayType):
        return F.array(_hidden(kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.create_map(F.lit(X.REDACTED), _hidden(kind.valueType))
    if isinstance(kind, T.StructType):
        return F.struct(*[_hidden(f.dataType).alias(f.name) for f in kind])
    return F.lit(None).cast(kind)


def _last_of_each_key(entries: Column) -> Column:
    """A map of entries, of those with one key the last: their keys and places are sorted, and each that another of its key follows goes."""

    def kept(order: Column) -> Column:
        following = F.concat(F.slice(order, F.lit(2), F.size(order)), F.array(F.lit(None)))
        places = F.zip_with(order, following, lambda a, b: F.when(b["k"].isNull() | (a["k"] != b["k"]), a["i"]))
        return F.map_from_entries(F.transform(F.array_sort(F.filter(places, lambda i: i.isNotNull())), lambda i: F.get(entries, i)))

    sorted_ = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), i.alias("i"))))
    return F.when(entries.isNotNull(), _let(sorted_, kept))


def redacted_column(f: T.StructField, known: tuple[str, ...] = ()) -> Column:
    """A column redacted at any depth, map keys as well; known: secrets to be hidden wherever they stand."""

    def visit(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return X.redact_text(c, known)
        if isinstance(kind, T.BinaryType):
            return X.redact_text(F.make_valid_utf8(c.cast("string")), known).cast("binary")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: visit(x, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            value = lambda e: F.when(X.sensitive_key(e["key"]), _hidden(kind.valueType)).otherwise(visit(e["value"], kind.valueType))
            clean = F.transform(F.map_entries(c), lambda e: F.struct(X.redact_text(e["key"], known).alias("key"), value(e).alias("value")))
            return _let(clean, _last_of_each_key)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[field(c[f.name], f) for f in kind]))
        return c

    def field(c: Column, f: T.StructField) -> Column:
        return F.when(X.sensitive_key(F.lit(f.name)), _hidden(f.dataType)).otherwise(visit(c, f.dataType)).alias(f.name)

    return field(F.col(f"`{f.name}`"), f)


def redact_nested(df: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Every text of df redacted, at any depth, map keys as well. What stands under a sensitive column, field or key is hidden whatever its
    type, nulls too. Of map keys that redaction makes equal the last counts."""
    return df.select(*[redacted_column(f, known) for f in df.schema])
