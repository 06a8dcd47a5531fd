"""Queries of manifests, environment, migrations, models, rules and test evidence over texts derived from parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import manifests as P
from .base import Registry, table
from .security_queries import _case

R = Registry()
_NL = "chr(10)"
_K = "CAST(p_partkey AS STRING)"


def files(spark, d, path: str, text: str, more: tuple = ()):
    return table(spark, d, "part").selectExpr(f"{path} AS path", f"{text} AS text", *more)


REQ = f"concat('# head', {_NL}, 'pkg', {_K}, {_case('p_size % 4', [repr('==1.2'), repr('>=1.0'), repr(''), repr(' @ git+https://x/y')])}, ' # note', {_NL}, '-r other.txt', {_NL}, 'lib-', {_K}, '<2', {_NL}, '--hash=x')"


@R.add("parse_requirements_txt", "SELECT 'r' || p_partkey AS path, 'pkg' || p_partkey AS name, CASE p_size % 4 WHEN 0 THEN '==1.2' WHEN 1 THEN '>=1.0' WHEN 2 THEN '' ELSE '@ git+https://x/y' END AS spec, p_size % 4 = 0 AS locked, p_size % 4 = 3 AS direct_url FROM part UNION ALL SELECT 'r' || p_partkey, 'lib-' || p_partkey, '<2', false, false FROM part")
def parse_requirements_txt(spark, d):
    return P.parse_requirements_txt(files(spark, d, f"concat('r', {_K})", REQ))


PACKAGE = f"""concat('{{"dependencies":{{"a', {_K}, '":"', {_case("p_size % 3", ["'^1.0'", "'1.2.3'", "'github:x/y'"])}, '"}},"devDependencies":{{"b":"*"}},"peerDependencies":', CASE WHEN p_partkey % 9 = 0 THEN '{{broken' ELSE '{{}}' END, '}}')"""


@R.add("parse_package_json", "SELECT 'p' || p_partkey AS path, 'a' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN '^1.0' WHEN 1 THEN '1.2.3' ELSE 'github:x/y' END AS spec, p_size % 3 > 0 AS locked, p_size % 3 = 2 AS direct_url FROM part WHERE p_partkey % 9 > 0 UNION ALL SELECT 'p' || p_partkey, 'b', '*', false, false FROM part WHERE p_partkey % 9 > 0")
def parse_package_json(spark, d):
    return P.parse_package_json(files(spark, d, f"concat('p', {_K})", PACKAGE).where("text NOT LIKE '%{broken%'"))


IMAGE = f"concat('FROM ', {_case('p_size % 4', [repr('python'), repr('python:3.12'), repr('reg.io:5000/app'), repr('reg.io:5000/app:7')])}, ' AS base', {_NL}, 'RUN x', {_NL}, 'from node:', {_K})"


@R.add("parse_dockerfile_images", "SELECT 'i' || p_partkey AS path, CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'python' ELSE 'reg.io:5000/app' END AS name, CASE p_size % 4 WHEN 1 THEN '3.12' WHEN 3 THEN '7' ELSE 'latest' END AS spec FROM part UNION ALL SELECT 'i' || p_partkey, 'node', CAST(p_partkey AS VARCHAR) FROM part")
def parse_dockerfile_images(spark, d):
    return P.parse_dockerfile_images(files(spark, d, f"concat('i', {_K})", IMAGE))


PYPROJECT = f"""concat('[project]', {_NL}, 'name = "x"', {_NL}, 'dependencies = [', {_NL}, '  "core', {_K}, '==1.0",', {_NL}, '  "web>=2"', {_NL}, ']', {_NL}, '[project.optional-dependencies]', {_NL}, 'dev = ["check"]', {_NL}, '[tool.poetry.dependencies]', {_NL}, 'python = "^3.12"', {_NL}, 'orm', {_K}, ' = "^2.0"')"""


@R.add(
    "parse_pyproject_deps",
    """SELECT 't' || p_partkey AS path, 'core' || p_partkey AS name, '==1.0' AS spec, true AS locked, false AS direct_url FROM part UNION ALL SELECT 't' || p_partkey, 'web', '>=2', false, false FROM part
UNION ALL SELECT 't' || p_partkey, 'check', '', false, false FROM part UNION ALL SELECT 't' || p_partkey, 'orm' || p_partkey, '^2.0', false, false FROM part""",
)
def parse_pyproject_deps(spark, d):
    return P.parse_pyproject_deps(files(spark, d, f"concat('t', {_K})", PYPROJECT))


@R.add("lockfile_missing", "WITH s AS (SELECT p_brand AS snapshot, bool_or(p_partkey % 4 = 0) AS npm, bool_or(p_partkey % 31 = 1) AS npm_lock, bool_or(p_partkey % 4 = 2) AS py, bool_or(p_partkey % 37 = 3) AS py_lock FROM part GROUP BY 1) SELECT snapshot, 'npm-lockfile-missing' AS rule_id, 'medium' AS severity FROM s WHERE npm AND NOT npm_lock UNION ALL SELECT snapshot, 'python-lockfile-missing', 'low' FROM s WHERE py AND NOT py_lock")
def lockfile_missing(spark, d):
    names = "array(IF(p_partkey % 31 = 1, 'yarn.lock', ''), IF(p_partkey % 37 = 3, 'uv.lock', ''), IF(p_partkey % 4 = 0, 'package.json', ''), IF(p_partkey % 4 = 2, 'pyproject.toml', '')) AS n"
    rows = table(spark, d, "part").selectExpr("p_brand AS snapshot", names)
    return P.lockfile_missing(rows.select("snapshot", F.explode("n").alias("path")))


_N = "concat('VAR_', CAST(p_partkey % 60 AS STRING))"
ENV = f"""CASE WHEN p_partkey % 2 = 0 THEN concat('import os', {_NL}, 'x = os.getenv("', {_N}, '")', {_NL}, 'y = os.getenv("OPT_', {_K}, '", "z")', {_NL}, 'z = os.environ["MUST"]') ELSE concat('url: ${{', {_N}, '}}', {_NL}, 'const a = process.env.NODE_', {_K}) END"""
ENV_PATH = f"concat('e', {_K}, CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.js' END)"
ENV_SQL = """refs AS (SELECT 'VAR_' || p_partkey % 60 AS name, 'e' || p_partkey || '.py' AS path, 2 AS line, NULL AS default_value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'OPT_' || p_partkey, 'e' || p_partkey || '.py', 3, 'z' FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT 'MUST', 'e' || p_partkey || '.py', 4, NULL FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'VAR_' || p_partkey % 60, 'e' || p_partkey || '.js', 1, NULL FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT 'NODE_' || p_partkey, 'e' || p_partkey || '.js', 2, NULL FROM part WHERE p_partkey % 2 = 1)"""


def env(spark, d):
    return P.env_references(files(spark, d, ENV_PATH, ENV))


@R.add("env_references", f"WITH {ENV_SQL} SELECT name, path, line, default_value, default_value IS NULL AS required FROM refs")
def env_references(spark, d):
    return env(spark, d)


def documented(spark, d):
    rows = table(spark, d, "customer").selectExpr("concat('c', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/.env.example' ELSE '/x.txt' END) AS path", f"concat('# vars', {_NL}, 'export VAR_', c_custkey % 40, ' = 1', {_NL}, 'lower=2') AS text")
    return P.documented_env(rows)


@R.add("documented_env", "SELECT DISTINCT 'VAR_' || c_custkey % 40 AS name FROM customer WHERE c_custkey % 2 = 0")
def documented_env(spark, d):
    return documented(spark, d)


@R.add(
    "undocumented_env",
    f"""WITH {ENV_SQL}, n AS (SELECT * FROM refs WHERE name NOT IN (SELECT 'VAR_' || c_custkey % 40 FROM customer WHERE c_custkey % 2 = 0) AND name NOT IN (SELECT name FROM refs WHERE path LIKE '%5.js'))
SELECT name, arg_min(path, [path, lpad(CAST(line AS VARCHAR), 9, '0')]) AS path, arg_min(line, [path, lpad(CAST(line AS VARCHAR), 9, '0')]) AS line, CASE WHEN arg_min(coalesce(default_value, ''), [path, lpad(CAST(line AS VARCHAR), 9, '0')]) = '' THEN 'high' ELSE 'medium' END AS severity FROM n GROUP BY name""",
)
def undocumented_env(spark, d):
    e = env(spark, d)
    return P.undocumented_env(e, e.where("path LIKE '%5.js'"), documented(spark, d))


@R.add("compose_env_drift", f"WITH {ENV_SQL} SELECT DISTINCT name FROM refs WHERE name NOT IN (SELECT 'VAR_' || c_custkey % 50 FROM customer) AND name <> 'MUST'")
def compose_env_drift(spark, d):
    rows = table(spark, d, "customer").selectExpr(f"concat('environment:', {_NL}, '  - VAR_', c_custkey % 50, '=1', {_NL}, '  MUST: 2') AS text")
    return P.compose_env_drift(env(spark, d), rows)


_DEEP = 40


@R.add(
    "config_flatten",
    f"""SELECT event_id || ':k' AS key, CASE WHEN event_id % 2 = 0 THEN '1' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS value FROM events WHERE event_id % 7 <> 3
UNION ALL SELECT event_id || '{"".join(f":d{i}" for i in range(_DEEP))}', '"x y"' FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 3 UNION ALL SELECT event_id || ':a:c', 'null' FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 3
UNION ALL SELECT event_id || ':l', '[1,{{"z":2}}]' FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 3 UNION ALL SELECT event_id || '.toml:t:n', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 7 = 3""",
)
def config_flatten(spark, d):
    deep = "".join(f'"d{i}":{{' for i in range(_DEEP - 1)) + f'"d{_DEEP - 1}":"x y"' + "}" * (_DEEP - 1)
    text = f"CASE WHEN event_id % 7 = 3 THEN concat('[t]\\nn = ', event_id) WHEN event_id % 2 = 0 THEN '{{\"k\":1,\"a\":{{\"c\":null,\"e\":{{}}}},\"l\":[1,{{\"z\":2}}],{deep}}}' ELSE props END"
    return P.config_flatten(table(spark, d, "events").selectExpr("concat(event_id, IF(event_id % 7 = 3, '.toml', '')) AS path", f"{text} AS text"))


MODEL = f"concat('import x', {_NL}, 'class T', CAST(p_partkey % 30 AS STRING), '(Base):', {_NL}, '    id = Column(Int)', {_NL}, '    f', CAST(p_size AS STRING), ': Mapped[int] = mapped_column(Int)', {_NL}, '    def m(self):', {_NL}, '        pass')"


@R.add("model_fields", "SELECT 'T' || p_partkey % 30 || '.id' AS field FROM part UNION SELECT 'T' || p_partkey % 30 || '.f' || p_size FROM part")
def model_fields(spark, d):
    return P.model_fields(files(spark, d, f"concat('m', {_K}, '.py')", MODEL))


@R.add(
    "model_field_diff",
    """WITH c AS (SELECT 'T' || p_partkey % 30 || '.f' || p_size AS f, p_partkey FROM part), a AS (SELECT DISTINCT f FROM c WHERE p_partkey % 10 <> 1), b AS (SELECT DISTINCT f FROM c WHERE p_partkey % 10 <> 0)
SELECT f AS field, 'added' AS change FROM b WHERE f NOT IN (SELECT f FROM a) UNION ALL SELECT f, 'removed' FROM a WHERE f NOT IN (SELECT f FROM b)""",
)
def model_field_diff(spark, d):
    t = table(spark, d, "part")
    side = lambda rows: P.model_fields(rows.selectExpr(f"concat('m', {_K}, '.py') AS path", f"{MODEL} AS text")).where("field NOT LIKE '%.id'")
    diff, _ = P.model_field_diff(side(t.where("p_partkey % 10 <> 1")), side(t.where("p_partkey % 10 <> 0")), t.limit(0))
    return diff


MIGRATION = f"""concat('def upgrade():', {_NL}, '    op.', {_case("p_size % 5", ["'drop_column(1)'", "'drop_table(1)'", "'execute(1)'", "'create_index(1)'", "'alter_column(1, new_column_name=2)'"])}, {_NL}, '    op.add_column(t, Column(nullable=False', CASE WHEN p_partkey % 2 = 0 THEN ', server_default=0' ELSE '' END, '))', {_NL},
 {_case("p_partkey % 3", ["''", f"concat('def downgrade():', {_NL}, '    pass')", f"concat('def downgrade():', {_NL}, '    op.x()')"])})"""


def migrations(spark, d):
    return files(spark, d, f"concat('db/migrations/', {_K})", MIGRATION)


@R.add("migration_operations", "SELECT 'db/migrations/' || p_partkey AS path, CAST(2 AS INT) AS line, CASE p_size % 5 WHEN 0 THEN 'drop_column' WHEN 1 THEN 'drop_table' WHEN 2 THEN 'raw_sql' WHEN 3 THEN 'create_index' ELSE 'rename_column' END AS operation, CASE p_size % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' ELSE 'high' END AS severity FROM part")
def migration_operations(spark, d):
    return P.migration_operations(migrations(spark, d))


@R.add("non_null_without_default", "SELECT 'db/migrations/' || p_partkey AS path FROM part WHERE p_partkey % 2 = 1")
def non_null_without_default(spark, d):
    return P.non_null_without_default(migrations(spark, d)).select("path")


@R.add("irreversible_migration", "SELECT 'db/migrations/' || p_partkey AS path, 'database.irreversible-migration' AS rule_id FROM part WHERE p_partkey % 3 < 2")
def irreversible_migration(spark, d):
    return P.irreversible_migration(migrations(spark, d))


@R.add("module_name", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'src.p' || p_partkey WHEN 1 THEN 'src.pkg' || p_size ELSE 'a.b.c' || p_partkey END AS module FROM part")
def module_name(spark, d):
    path = f"CASE p_partkey % 3 WHEN 0 THEN concat('src/p', {_K}, '.py') WHEN 1 THEN concat('src/pkg', p_size, '/__init__.py') ELSE concat('a/b/c', {_K}, '.py') END"
    return table(spark, d, "part").select("p_partkey", X.module_name(F.expr(path)).alias("module"))


@R.add(
    "policy_rules_load",
    """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'bad_version' WHEN 1 THEN 'bad_id' WHEN 2 THEN 'bad_metric' WHEN 3 THEN 'bad_operator' WHEN 4 THEN 'value_required' WHEN 5 THEN 'bad_collection' WHEN 6 THEN 'bad_exists' WHEN 7 THEN 'bad_outcome' ELSE CASE WHEN p_partkey % 2 = 0 AND (SELECT count(*) FROM part q WHERE q.p_partkey % 18 = 8 AND q.p_brand = part.p_brand) > 1 THEN 'duplicate_id' END END AS error FROM part""",
)
def policy_rules_load(spark, d):
    t = table(spark, d, "part").selectExpr(
        "p_partkey", "p_brand AS policy", "IF(p_partkey % 9 = 0, 0, 1) AS version", "CASE WHEN p_partkey % 9 = 1 THEN '-x' WHEN p_partkey % 18 = 8 THEN 'same' ELSE concat('r', p_partkey) END AS id", "IF(p_partkey % 9 = 2, '1.x', 'findings.high') AS metric",
        "CASE p_partkey % 9 WHEN 3 THEN 'like' WHEN 5 THEN 'in' WHEN 6 THEN 'exists' ELSE 'lte' END AS operator", "CASE p_partkey % 9 WHEN 4 THEN NULL ELSE '3' END AS value", "IF(p_partkey % 9 = 7, 'pass', 'fail') AS outcome",
    )
    return P.policy_rules_load(t).select("p_partkey", "error")


TEST = f"""{_case("p_size % 4", [f"concat('import pytest', {_NL}, 'from src.p', {_K}, ' import f', {_NL}, 'def test_works_', {_K}, '(client, db):', {_NL}, '    pass')", f"concat('import unittest', {_NL}, 'class A(unittest.TestCase):', {_NL}, '    def test_it(self):', {_NL}, '        pass')", "'import vitest'", "'plain'"])}"""
TEST_PATH = f"concat({_case('p_size % 4', [repr('tests/integration/test_p'), repr('tests/test_u'), repr('web/p'), repr('src/p')])}, {_K}, {_case('p_size % 4', [repr('.py'), repr('.py'), repr('.spec.ts'), repr('.py')])})"


def tests(spark, d):
    return P.test_discovery(files(spark, d, TEST_PATH, TEST))


DISCOVERED_SQL = """tests AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'tests/integration/test_p' || p_partkey || '.py' WHEN 1 THEN 'tests/test_u' || p_partkey || '.py' ELSE 'web/p' || p_partkey || '.spec.ts' END AS path, CASE p_size % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'unittest' ELSE 'vitest' END AS framework, p_size % 4 = 0 AS integration, p_size % 4 AS k FROM part WHERE p_size % 4 < 3),
sources AS (SELECT p_partkey, 'src/p' || p_partkey || '.py' AS path, p_partkey % 5 = 0 AS public_api FROM part WHERE p_partkey % 2 = 0), matches AS (SELECT s.path AS source, t.path AS test, integration FROM sources s JOIN tests t ON t.p_partkey = s.p_partkey AND k = 0)"""


@R.add("test_discovery", f"WITH {DISCOVERED_SQL} SELECT path, framework, integration FROM tests")
def test_discovery(spark, d):
    return tests(spark, d).drop("text")


@R.add("test_facts", f"WITH {DISCOVERED_SQL} SELECT path, CASE k WHEN 0 THEN 'test_works_' || p_partkey WHEN 1 THEN 'test_it' ELSE '' END AS tests, CASE k WHEN 0 THEN 'client,db' ELSE '' END AS fixtures, CASE k WHEN 0 THEN 'pytest,src.p' || p_partkey WHEN 1 THEN 'unittest' ELSE 'vitest' END AS modules FROM tests")
def test_facts(spark, d):
    out = P.test_facts(tests(spark, d))
    return out.select("path", *[F.array_join(c, ",").alias(c) for c in ("tests", "fixtures", "modules")])


def _matched(spark, d):
    sources = table(spark, d, "part").where("p_partkey % 2 = 0").selectExpr(f"concat('src/p', {_K}, '.py') AS path", "p_partkey % 5 = 0 AS public_api")
    facts = P.test_facts(tests(spark, d).where("framework <> 'vitest'"))
    none = spark.createDataFrame([], "symbol string")
    return sources, facts, P.test_source_match(facts, sources, none)


@R.add("test_source_match", f"WITH {DISCOVERED_SQL} SELECT source, test FROM matches")
def test_source_match(spark, d):
    return _matched(spark, d)[2]


@R.add("test_gap_findings", f"WITH {DISCOVERED_SQL} SELECT path, 'test.changed-source-without-evidence' AS rule_id, 'medium' AS severity FROM sources WHERE path NOT IN (SELECT source FROM matches) UNION ALL SELECT path, 'test.public-api-without-integration-test', 'high' FROM sources WHERE public_api AND path NOT IN (SELECT source FROM matches WHERE integration)")
def test_gap_findings(spark, d):
    sources, facts, pairs = _matched(spark, d)
    return P.test_gap_findings(sources, pairs, facts, changed_tests=2)


@R.add("test_evidence_score", f"WITH {DISCOVERED_SQL} SELECT round(least(1.0, 0.75 * avg(CASE WHEN path IN (SELECT source FROM matches) THEN 1.0 ELSE 0.0 END) + 0.25 * 0.5 + 0.06), 6) AS score FROM sources")
def test_evidence_score(spark, d):
    sources, _, pairs = _matched(spark, d)
    return P.test_evidence_score(sources, pairs, 0.5, 2).select(F.round("score", 6).alias("score"))


@R.add("test_suggestions", f"WITH {DISCOVERED_SQL} SELECT path, 'test_p' || p_partkey || '_changed_behavior' AS name, CASE WHEN (SELECT count(*) FROM part q WHERE q.p_partkey % 7 = 0 AND contains('src.p' || q.p_partkey || '.run', 'p' || sources.p_partkey)) > 0 THEN (SELECT min('src.p' || q.p_partkey || '.run') FROM part q WHERE q.p_partkey % 7 = 0 AND contains('src.p' || q.p_partkey || '.run', 'p' || sources.p_partkey)) ELSE path END AS target, 'tests/test_p' || p_partkey || '.py' AS recommended_path FROM sources WHERE path NOT IN (SELECT source FROM matches)")
def test_suggestions(spark, d):
    sources, _, pairs = _matched(spark, d)
    uncovered = sources.join(pairs.select(F.col("source").alias("path")), "path", "left_anti")
    return P.test_suggestions(uncovered, table(spark, d, "part").where("p_partkey % 7 = 0").selectExpr(f"concat('src.p', {_K}, '.run') AS symbol"))


QUERIES, SQL = R.queries, R.sql
