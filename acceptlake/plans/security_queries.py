"""Queries of scans and redaction, with oracle SQL. Code, image, workflow and compose files are derived from the tables by one rule in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import security as P
from .base import Registry, duck, table

R = Registry()
DOC_FILES = "concat('src/', source, '/doc_', CAST(doc_id AS STRING), '.txt')"
_NL = "chr(10)"


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


CODE = f"""concat('import os', {_NL}, {_case("p_partkey % 13", ["'x = eval(data)'", "'exec(code)'", "'pickle.loads(b)'", "'os.system(cmd)'", "'t = tempfile.mktemp()'", "'h = hashlib.md5(b)'", "'subprocess.run(cmd, shell=True)'", "'yaml.load(f)'", "'yaml.load(f, Loader=SafeLoader)'", "'get(url, verify=False)'", "'jwt.decode(t, key)'", "'db.execute(f\"select\")'", "'literal_eval(x)'"])}, {_NL},
 {_case("p_size % 5", ["'app = App(debug=True)'", "'open(user_path)'", "'cors(allow_origins=[\"*\"], allow_credentials=True)'", "'cors(allow_origins=[\"*\"])'", "concat('n = ', CAST(p_size AS STRING))"])}, {_NL}, 'Path(request.path)')"""
IMAGE = f"""concat('FROM ', {_case("p_size % 3", ["'python'", "'python:latest'", "concat('python:3.', CAST(p_size AS STRING))"])}, {_NL}, 'RUN chmod ', {_case("p_partkey % 4", ["'777'", "'-R 777'", "'755'"])}, ' /app', {_case("p_partkey % 3", ["''", f"concat({_NL}, 'USER root')", f"concat({_NL}, 'USER root', {_NL}, 'USER app')"])})"""
FLOW = f"""concat('steps:', {_NL}, '  - uses: acme/build@', {_case("p_partkey % 3", ["'v4'", "concat(md5(p_name), substring(md5(p_brand), 1, 8))", "'main'"])}, {_NL}, '    uses: ./local', {_NL}, '  - uses: docker://alpine', {_NL}, '- uses: acme/plain', {_NL}, '  run: x')"""
STACK = f"""concat('services:', {_NL}, '  DB_PASSWORD: ', {_case("p_partkey % 3", ["concat('pw', CAST(p_partkey AS STRING))", "concat('$', '{DB_PASSWORD}')", "'\"quoted\"'"])}, {_NL}, '  ports: ', {_case("p_size % 3", ["'0.0.0.0:5678:80'", "'80:80'", "'9229:9229'"])}, {_NL}, {_case("p_size % 4", ["'  host: 0.0.0.0'", "'  run --host 0.0.0.0'", "'  host: 127.0.0.1'"])})"""


def docs(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{DOC_FILES} AS path", "text")


def derived(spark, d, text: str, kind: str):
    return table(spark, d, "part").selectExpr(f"concat('{kind}/', CAST(p_partkey AS STRING)) AS path", f"{text} AS text")


def files_sql(text: str, kind: str) -> str:
    return f"files AS (SELECT concat('{kind}/', CAST(p_partkey AS VARCHAR)) AS path, {duck(text)} AS text FROM part)"


LINES_SQL = "lines AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line, unnest(l) AS code FROM (SELECT path, string_split(text, chr(10)) AS l FROM files))"
_PLACEHOLDER = f"(regexp_matches(lower(value), '{'|'.join(X.PLACEHOLDER_WORDS)}') OR len(list_distinct(string_split(regexp_replace(lower(value), '[^a-z0-9]', '', 'g'), ''))) <= 3 OR regexp_full_match(regexp_replace(lower(value), '[^a-z0-9]', '', 'g'), '(?:abc|123|xyz)+'))"
_MASK = "CASE WHEN length(value) <= 8 THEN repeat('*', length(value)) ELSE left(value, 4) || repeat('*', least(12, length(value) - 7)) || right(value, 3) END"


def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: Line by line: the j-th time that a value stands in a line belongs to the first rule that finds it there as often.
SECRETS_SQL = (
    "hits AS ("
    + " UNION ALL ".join(f"SELECT path, line, {i} AS place, '{r}' AS rule_id, '{s}' AS severity, unnest(regexp_extract_all(code, {q(p)}, 1)) AS value FROM lines" for i, (r, s, p) in enumerate(P.SECRET_RULES))
    + f"), secrets AS (SELECT path, line, value, j, arg_min(rule_id, place) AS rule_id, arg_min(severity, place) AS severity FROM (SELECT *, row_number() OVER (PARTITION BY path, line, place, value) AS j FROM hits WHERE NOT {_PLACEHOLDER}) GROUP BY ALL)"
)
DOCS_SQL = f"files AS (SELECT doc_id, {duck(DOC_FILES)} AS path, text FROM documents WHERE text IS NOT NULL), {LINES_SQL}"


@R.add("secret_scan", f"WITH {DOCS_SQL}, {SECRETS_SQL} SELECT path, rule_id, severity, line, {_MASK} AS masked FROM secrets")
def secret_scan(spark, d):
    return P.secret_scan(docs(spark, d)).drop("value")


_ENTROPY = "round(coalesce(-list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: (len(list_filter(string_split(value, ''), lambda x: x = c))::DOUBLE / length(value)) * log2(len(list_filter(string_split(value, ''), lambda x: x = c))::DOUBLE / length(value)))), 0), 6)"


@R.add(
    "high_entropy_scan",
    f"""WITH {DOCS_SQL}, {SECRETS_SQL}, c AS (SELECT path, line, unnest(regexp_extract_all(code, '[A-Za-z0-9+/=_-]{{18,}}')) AS value FROM lines)
SELECT path, line, {_ENTROPY} AS entropy, {_MASK} AS masked FROM c WHERE NOT {_PLACEHOLDER} AND NOT regexp_matches(value, '^(sha256-|symbol:|https)') AND {_ENTROPY} >= 3.0 AND NOT EXISTS (SELECT 1 FROM secrets s WHERE s.path = c.path AND s.value = c.value)""",
)
def high_entropy_scan(spark, d):
    return P.high_entropy_scan(docs(spark, d), threshold=3.0, length=18).select("path", "line", F.round("entropy", 6).alias("entropy"), X.mask(F.col("value")).alias("masked"))


@R.add("shannon_entropy", f"SELECT p_partkey, {_ENTROPY.replace('value', 'p_name')} AS entropy FROM part")
def shannon_entropy(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.shannon_entropy(F.col("p_name")), 6).alias("entropy"))


@R.add("placeholder_filter", f"SELECT p_partkey, {_PLACEHOLDER.replace('value', 'p_brand')} AS placeholder FROM part")
def placeholder_filter(spark, d):
    return table(spark, d, "part").select("p_partkey", X.is_placeholder(F.col("p_brand")).alias("placeholder"))


@R.add("mask_value", f"SELECT c_custkey, {_MASK.replace('value', 'c_name')} AS masked, {_MASK.replace('value', 'c_mktsegment')} AS short FROM customer")
def mask_value(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.mask(F.col("c_name")).alias("masked"), X.mask(F.col("c_mktsegment")).alias("short"))


def _rule_lines(rules) -> str:
    return " UNION ALL ".join(f"SELECT path, '{r}' AS rule_id, '{s}' AS severity, line FROM lines WHERE regexp_matches(code, {q(p)})" + (f" AND NOT regexp_matches(code, {q(e)})" if e else "") for r, s, p, e in rules)


def _first_sql(rule, severity, pattern, test="true"):
    return f"SELECT path, '{rule}' AS rule_id, '{severity}' AS severity, min(line) AS line FROM lines JOIN files USING (path) WHERE regexp_matches(code, {q(pattern)}) AND {test} GROUP BY path"


@R.add(
    "text_danger_rules",
    f"WITH {files_sql(CODE, 'app')}, {LINES_SQL} "
    + _first_sql("python.cors-wildcard-credentials", "critical", r"""allow_origins\s*=\s*\[\s*['"]\*['"]\s*\]""", r"regexp_matches(text, 'allow_credentials\s*=\s*True')")
    + " UNION ALL "
    + _first_sql("python.debug-enabled", "medium", r"\bdebug\s*=\s*True\b")
    + " UNION ALL "
    + _first_sql("python.path-traversal-input", "high", r"\b(?:open|Path)\s*\(\s*(?:request\.|user_|filename\b|path_param\b)"),
)
def text_danger_rules(spark, d):
    return P.text_danger_rules(derived(spark, d, CODE, "app"))


_ENV_PATH = "concat('c', CAST(c_custkey AS STRING), '/', CASE c_custkey % 6 WHEN 0 THEN '.env' WHEN 1 THEN 'cfg/.env.prod' WHEN 2 THEN '.env.example' WHEN 3 THEN 'a/.env.sample' WHEN 4 THEN 'x.env' ELSE 'src/x.py' END)"
_MODE = "CAST(CASE c_custkey % 4 WHEN 0 THEN 438 WHEN 1 THEN 420 WHEN 2 THEN 511 ELSE 493 END AS INT)"


@R.add("committed_env_files", f"SELECT path, 'env.committed' AS rule_id, 'high' AS severity FROM (SELECT {duck(_ENV_PATH)} AS path FROM customer) WHERE regexp_matches(path, '(^|/)\\.env(\\.[^/]*)?$') AND NOT regexp_matches(path, '\\.env\\.(example|sample)$')")
def committed_env_files(spark, d):
    return P.committed_env_files(table(spark, d, "customer").selectExpr(f"{_ENV_PATH} AS path"))


@R.add("world_writable", f"SELECT path, 'file.world-writable' AS rule_id, 'high' AS severity FROM (SELECT {duck(_ENV_PATH)} AS path, {_MODE} AS mode FROM customer) WHERE mode & 2 <> 0")
def world_writable(spark, d):
    return P.world_writable(table(spark, d, "customer").selectExpr(f"{_ENV_PATH} AS path", f"{_MODE} AS mode"))


@R.add(
    "dockerfile_rules",
    f"""WITH {files_sql(IMAGE, "image")}, {LINES_SQL}, u AS (SELECT path, arg_max(lower(regexp_extract(code, '(?i)^\\s*USER\\s+([^\\s]+)', 1)), line) AS last FROM lines WHERE regexp_matches(code, '(?i)^\\s*USER\\s') GROUP BY path)
SELECT path, 'docker.floating-base-image' AS rule_id, 'medium' AS severity, line FROM lines WHERE regexp_matches(code, '(?i)^\\s*FROM\\s') AND (NOT contains(code, ':') OR code LIKE '%:latest')
UNION ALL SELECT path, 'docker.world-writable', 'high', line FROM lines WHERE regexp_matches(code, '(?i)\\bchmod\\s+(?:-R\\s+)?777\\b')
UNION ALL SELECT files.path, 'docker.root-user', 'high', 1 FROM files LEFT JOIN u ON u.path = files.path WHERE last IS NULL OR last IN ('root', '0', '0:0')""",
)
def dockerfile_rules(spark, d):
    return P.dockerfile_rules(derived(spark, d, IMAGE, "image"))


@R.add(
    "workflow_unpinned",
    f"""WITH {files_sql(FLOW, "flow")}, {LINES_SQL}, a AS (SELECT path, line, regexp_extract(code, '^\\s*-?\\s*uses:\\s*([^\\s#]+)', 1) AS action FROM lines)
SELECT path, action, line FROM a WHERE action <> '' AND NOT starts_with(action, './') AND NOT starts_with(action, 'docker://') AND NOT regexp_matches(action, '@[0-9a-fA-F]{{40}}$')""",
)
def workflow_unpinned(spark, d):
    return P.workflow_unpinned(derived(spark, d, FLOW, "flow"))


@R.add(
    "compose_rules",
    f"WITH {files_sql(STACK, 'stack')}, {LINES_SQL} "
    + _rule_lines((("compose.literal-secret", "critical", r"""(?i)^\s*[A-Z0-9_]*(?:PASSWORD|TOKEN|SECRET|API_KEY)[A-Z0-9_]*\s*:\s*['"]?[^\s'"$][^\s'"]*""", None),))
    + " UNION ALL "
    + _first_sql("compose.debug-port", "medium", r"(?:0\.0\.0\.0:)?(?:5678|9229|2345):")
    + " UNION ALL "
    + _first_sql("network.wildcard-bind", "medium", r"""(?i)(?:--host\s+|host\s*:\s*['"]?)0\.0\.0\.0\b"""),
)
def compose_rules(spark, d):
    return P.compose_rules(derived(spark, d, STACK, "stack"))


@R.add("finding_fingerprint", f"SELECT doc_id, sha256('text.file:' || {duck(DOC_FILES)} || ':' || coalesce(CAST(nullif(n_chars % 7, 0) AS VARCHAR), 'None') || ':' || sha256(text)) AS fingerprint FROM documents")
def finding_fingerprint(spark, d):
    t = table(spark, d, "documents").withColumn("path", F.expr(DOC_FILES))
    line = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") % 7)
    return t.select("doc_id", P.fingerprint(F.lit("text.file"), F.col("path"), line, F.sha2("text", 256)).alias("fingerprint"))


@R.add("dedupe_findings", "SELECT sha256(text) AS fingerprint, min(doc_id) AS first, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY sha256(text)")
def dedupe_findings(spark, d):
    t = table(spark, d, "documents").select(F.sha2("text", 256).alias("fingerprint"), "doc_id", "source")
    return P.dedupe_findings(t, "doc_id")


def _redact_sql(column: str) -> str:
    out = f"regexp_replace({column}, {q(X.URI_CREDENTIAL)}, '\\1[REDACTED]@', 'g')"
    out = f"regexp_replace({out}, {q(X.ASSIGNMENT)}, '\\1[REDACTED]', 'g')"
    for p in X.TOKEN_FORMS:
        out = f"regexp_replace({out}, {q(p)}, '[REDACTED]', 'g')"
    return out


@R.add("redact_text", f"SELECT doc_id, sha256({_redact_sql('text')}) AS digest, contains({_redact_sql('text')}, '[REDACTED]') AS changed FROM documents")
def redact_text(spark, d):
    out = table(spark, d, "documents").select("doc_id", X.redact_text(F.col("text")).alias("t"))
    return out.select("doc_id", F.sha2("t", 256).alias("digest"), F.col("t").contains(X.REDACTED).alias("changed"))


@R.add(
    "leak_gate",
    f"""SELECT doc_id, regexp_matches(text, {q(X.URI_CREDENTIAL)}) OR {" OR ".join(f"regexp_matches(text, {q(p)})" for p in X.TOKEN_FORMS)} OR len(list_filter(regexp_extract_all(text, {q(X.ASSIGNMENT)}, 2), lambda v: NOT contains(v, '[REDACTED]'))) > 0 AS leaks FROM documents""",
)
def leak_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.leaks(F.col("text")).alias("leaks"))


@R.add(
    "redact_nested",
    """WITH e AS (SELECT event_id, event_type = 'click' AS hide, json_extract_string(props, '$.k') AS v, user_id, value FROM events)
SELECT event_id, CASE WHEN hide THEN '[REDACTED]' ELSE v END AS v, CASE WHEN hide THEN '[REDACTED]' ELSE v || ',' || user_id END AS many, CASE WHEN hide THEN '[REDACTED]=[REDACTED]' ELSE 'k=' || v END AS deep,
 '[REDACTED]' AS listed, CAST(NULL AS DOUBLE) AS numbered, '[REDACTED] of ' || user_id AS keys, 'user ' || user_id AS note FROM e""",
)
def redact_nested(spark, d):
    e = table(spark, d, "events").withColumn("v", F.get_json_object("props", "$.k")).withColumn("key", F.when(F.col("event_type") == "click", "api_key").otherwise("k"))
    user = F.col("user_id").cast("string")
    x = F.struct(
        F.create_map("key", "v").alias("values"),
        F.create_map("key", F.array("v", user)).alias("lists"),
        F.create_map("key", F.create_map(F.lit("k"), F.col("v"))).alias("maps"),
        F.struct(F.array("v", user).alias("auth_token"), F.struct(F.col("value").alias("n")).alias("password")).alias("own"),
        F.create_map(F.concat(F.lit("ghp_abcdefghijklmnopqrstuvwxyz0123456789 of "), user), F.lit(1)).alias("keyed"),
        F.concat(F.lit("user "), user).alias("note"),
    )
    out = P.redact_nested(e.select("event_id", x.alias("x")))
    first = lambda c: F.element_at(F.map_values(c), 1)
    deep = F.concat(F.element_at(F.map_keys(first("x.maps")), 1), F.lit("="), F.element_at(F.map_values(first("x.maps")), 1))
    return out.select("event_id", first("x.values").alias("v"), F.array_join(first("x.lists"), ",").alias("many"), deep.alias("deep"), F.array_join("x.own.auth_token", ",").alias("listed"), F.col("x.own.password.n").cast("double").alias("numbered"), F.element_at(F.map_keys("x.keyed"), 1).alias("keys"), F.col("x.note").alias("note"))


@R.add("sensitive_key", "SELECT p_partkey, k AS name, p_partkey % 8 IN (0, 1, 2, 4, 6) AS sensitive FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'apiKey' WHEN 1 THEN 'client-secret' WHEN 2 THEN 'user.password' WHEN 3 THEN 'tokenizer' WHEN 4 THEN 'dbAuthToken' WHEN 5 THEN 'keyboard' WHEN 6 THEN 'SESSION' ELSE 'p' || p_size END AS k FROM part)")
def sensitive_key(spark, d):
    k = "CASE p_partkey % 8 WHEN 0 THEN 'apiKey' WHEN 1 THEN 'client-secret' WHEN 2 THEN 'user.password' WHEN 3 THEN 'tokenizer' WHEN 4 THEN 'dbAuthToken' WHEN 5 THEN 'keyboard' WHEN 6 THEN 'SESSION' ELSE concat('p', p_size) END"
    return table(spark, d, "part").select("p_partkey", F.expr(k).alias("name")).withColumn("sensitive", X.sensitive_key(F.col("name")))


def _runner_sql(column: str) -> str:
    for p, r in X.RUNNER_FORMS:
        column = f"regexp_replace({column}, {q(p)}, '{r.replace('$', chr(92))}', 'g')"
    return column


@R.add("execution_output_redact", f"SELECT conv_id, turn, strlen({_runner_sql('text')}) AS bytes, {_runner_sql('text')} <> text AS changed, strlen({_runner_sql('text')}) > 300 AS cut FROM conversations")
def execution_output_redact(spark, d):
    t = table(spark, d, "conversations").withColumn("out", X.redact_output(F.col("text")))
    return t.select("conv_id", "turn", F.octet_length("out").cast("long").alias("bytes"), (F.col("out") != F.col("text")).alias("changed"), X.truncate_output(F.col("out"), 300).contains("...[output truncated]...").alias("cut"))


@R.add("register_rule_set", "WITH r AS (SELECT doc_id, 'en-the' AS rule_id, 'low' AS severity, len(regexp_extract_all(text, '\\bthe\\b')) AS n FROM documents UNION ALL SELECT doc_id, 'digits', 'info', CASE WHEN regexp_matches(text, 'token') THEN 0 ELSE len(regexp_extract_all(text, '([0-9]{3,})')) END FROM documents) SELECT * FROM r WHERE n > 0")
def register_rule_set(spark, d):
    rules = spark.createDataFrame([("en-the", "low", r"\bthe\b", 0, None), ("digits", "info", "([0-9]{3,})", 1, "token")], P.RULE_SCHEMA)
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    found = P.user_rules(files, rules)
    return found.groupBy(F.col("path").alias("doc_id"), "rule_id", "severity").agg(F.count("*").alias("n"))


QUERIES, SQL = R.queries, R.sql
