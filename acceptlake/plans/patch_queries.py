"""Queries over patches that are built from documents by one rule in both engines (a line's place: every fifth removed, every seventh added)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patches as P
from ..operators.reporting import page
from .base import Registry, duck, table
from .security_queries import DOC_FILES, q

R = Registry()
_NL = "chr(10)"


def patches(spark, d):
    """patch_id = doc_id; one modified file of one hunk."""
    sign = "CASE WHEN i % 5 = 0 THEN '-' WHEN i % 7 = 0 THEN '+' ELSE ' ' END"
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{DOC_FILES} AS path", r"split(text, '\n') AS l")
    rows = rows.selectExpr("doc_id", "path", f"transform(l, (x, i) -> concat({sign}, x)) AS l")
    head = f"concat('diff --git a/', path, ' b/', path, {_NL}, '--- a/', path, {_NL}, '+++ b/', path, {_NL}, '@@ -1,', size(filter(l, x -> x NOT LIKE '+%')), ' +1,', size(filter(l, x -> x NOT LIKE '-%')), ' @@ part ', doc_id % 3, {_NL}, array_join(l, {_NL}))"
    return rows.selectExpr("doc_id AS patch_id", f"{head} AS text")


LINES_SQL = f"""raw AS (SELECT doc_id AS patch_id, {duck(DOC_FILES)} AS path, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
ex AS (SELECT patch_id, path, CAST(unnest(range(0, len(l))) AS INT) AS i, unnest(l) AS content FROM raw),
content AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'removed' WHEN i % 7 = 0 THEN 'added' ELSE 'context' END AS kind FROM ex),
numbered AS (SELECT *, 1 + coalesce(count(*) FILTER (WHERE kind <> 'added') OVER (PARTITION BY patch_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o,
 1 + coalesce(count(*) FILTER (WHERE kind <> 'removed') OVER (PARTITION BY patch_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM content),
stats AS (SELECT patch_id, path, count(*) FILTER (WHERE kind = 'added') AS additions, count(*) FILTER (WHERE kind = 'removed') AS deletions, count(*) AS total FROM content GROUP BY ALL)"""


def lines(spark, d):
    return P.parsed(patches(spark, d))


@R.add("patch_files", f"SELECT doc_id AS patch_id, 1 AS file, {duck(DOC_FILES)} AS old_path, {duck(DOC_FILES)} AS new_path, 'modified' AS change_type, false AS is_binary FROM documents WHERE text IS NOT NULL")
def patch_files(spark, d):
    return P.patch_files(lines(spark, d)).select("patch_id", "file", "old_path", "new_path", "change_type", "is_binary")


@R.add("patch_hunks", f"WITH {LINES_SQL} SELECT patch_id, 1 AS file, 1 AS hunk, 1::BIGINT AS old_start, total - additions AS old_count, 1::BIGINT AS new_start, total - deletions AS new_count, 'part ' || patch_id % 3 AS section FROM stats")
def patch_hunks(spark, d):
    return P.patch_hunks(lines(spark, d))


@R.add("patch_lines", f"WITH {LINES_SQL} SELECT patch_id, i + 4 AS pos, kind, CASE WHEN kind <> 'added' THEN o END AS old_line, CASE WHEN kind <> 'removed' THEN n END AS new_line, md5(content) AS content FROM numbered")
def patch_lines(spark, d):
    return P.patch_lines(lines(spark, d)).select("patch_id", "pos", "kind", "old_line", "new_line", F.md5("content").alias("content"))


@R.add("patch_stats", f"WITH {LINES_SQL} SELECT patch_id, f AS file, additions, deletions, 1::BIGINT AS files FROM stats, (SELECT unnest([1, NULL]) AS f)")
def patch_stats(spark, d):
    return P.patch_stats(P.patch_lines(lines(spark, d)))


@R.add("changed_ranges", f"WITH {LINES_SQL} SELECT patch_id, 1 AS file, 1 AS hunk, min(n) AS first_line, max(n) AS last_line FROM numbered WHERE kind = 'added' GROUP BY patch_id")
def changed_ranges(spark, d):
    return P.changed_ranges(P.patch_lines(lines(spark, d)))


_BROKEN = f"""CASE doc_id % 6 WHEN 0 THEN concat('diff --git a/../x b/x', {_NL}, '@@ -1 +1 @@') WHEN 1 THEN concat('diff --git a/x b/x', {_NL}, '@@ -x +1 @@') WHEN 2 THEN concat('diff --git a/x b/x', {_NL}, '@@ -1 +1 @@', {_NL}, 'oops')
 WHEN 3 THEN concat('@@ -1 +1 @@', {_NL}, '+a') WHEN 4 THEN concat('--- a/x', {_NL}, '+++ b/x', {_NL}, '@@ -1 +1 @@', {_NL}, '-a', {_NL}, '+b') ELSE concat('--- /etc/x', {_NL}, '+++ b/x') END"""


@R.add("patch_errors", "SELECT doc_id AS patch_id, CASE doc_id % 6 WHEN 0 THEN 'unsafe_path' WHEN 1 THEN 'invalid_hunk_header' WHEN 2 THEN 'unexpected_line' WHEN 3 THEN 'missing_header' ELSE 'unsafe_path' END AS code, CAST(CASE doc_id % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INT) AS pos FROM documents WHERE doc_id % 6 <> 4")
def patch_errors(spark, d):
    broken = table(spark, d, "documents").selectExpr("doc_id AS patch_id", f"{_BROKEN} AS text")
    return P.patch_errors(broken, P.parsed(broken))


@R.add("git_path_decode", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'src/' || p_name WHEN 1 THEN 'd/' || p_name || chr(10) || 'x' WHEN 2 THEN 'é/' || p_brand ELSE 'q\"' || p_name END AS path FROM part")
def git_path_decode(spark, d):
    raw = r"""CASE p_partkey % 4 WHEN 0 THEN concat('a/src//', p_name) WHEN 1 THEN concat('"b/d/', p_name, '\\nx"') WHEN 2 THEN concat('"a/\\303\\251/', p_brand, '"') ELSE concat('"b/q\\"', p_name, '"') END"""
    return table(spark, d, "part").selectExpr("p_partkey", f"{raw} AS raw").select("p_partkey", P.git_path(F.col("raw")).alias("path"))


_CHANGED = "CASE WHEN doc_id % 7 = 0 THEN concat(text, ' x') ELSE text END"


@R.add(
    "hash_changed_text",
    f"SELECT {duck(DOC_FILES)} || '.new' AS new_path, {duck(DOC_FILES)} AS old_path, CASE WHEN doc_id % 10 <> 1 THEN sha256(text) END AS old_sha256, CASE WHEN doc_id % 10 <> 0 THEN sha256({_CHANGED}) END AS new_sha256 FROM documents",
)
def hash_changed_text(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{DOC_FILES} AS old_path", f"concat({DOC_FILES}, '.new') AS new_path", "text", f"{_CHANGED} AS changed")
    previous = t.where("doc_id % 10 <> 1").select(F.col("old_path").alias("path"), "text")
    current = t.where("doc_id % 10 <> 0").select(F.col("new_path").alias("path"), F.col("changed").alias("text"))
    return P.hash_changed_text(t.select("old_path", "new_path"), previous, current)


_PATH = """concat(CASE p_partkey % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/auth/' WHEN 2 THEN '.github/workflows/' WHEN 3 THEN 'db/migrations/' WHEN 4 THEN 'api/openapi/' ELSE 'src/' END,
 CASE p_size % 9 WHEN 0 THEN 'requirements-x.txt' WHEN 1 THEN 'package.json' WHEN 2 THEN 'Main.java' WHEN 3 THEN 'a_test.py' WHEN 4 THEN 'settings.yml' WHEN 5 THEN 'Dockerfile' WHEN 6 THEN '.env' WHEN 7 THEN 'x.generated.ts' ELSE concat('m', CAST(p_size AS STRING), '.rs') END)"""
_NAME = "regexp_extract(lower(path), '[^/]*$')"
_END = "regexp_extract(regexp_extract(lower(path), '[^/]*$'), '[^.].*?(\\.[^.]+)$', 1)"
CLASS_SQL = f"""CASE {_END} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items())} ELSE 'text' END AS language, regexp_matches(path, {q(P.TEST_PATH)}) AS is_test,
 {_NAME} IN {P.CONFIG_NAMES} OR {_END} IN ('.yaml', '.yml', '.toml', '.ini') OR contains(lower(path), '.github/workflows') AS is_config, {_NAME} IN {P.MANIFEST_NAMES} OR (starts_with({_NAME}, 'requirements') AND {_END} = '.txt') AS is_dependency_manifest,
 regexp_matches(lower(path), 'migrations/|alembic/versions/') AS is_migration, regexp_matches(lower(path), 'openapi|swagger|asyncapi') AS is_api_schema, contains(lower(path), '.github/workflows/') OR lower(path) IN ('.gitlab-ci.yml', 'jenkinsfile') AS is_ci,
 regexp_matches(lower(path), 'auth|security|permission|secret|\\.env|private|credential') AS is_security_sensitive, regexp_matches(lower(path), 'generated|_pb2|\\.min\\.') AS is_generated"""


@R.add("classify_paths", f"WITH p AS (SELECT p_partkey, {duck(_PATH)} AS path FROM part) SELECT p_partkey, path, {CLASS_SQL} FROM p")
def classify_paths(spark, d):
    return P.classify_paths(table(spark, d, "part").selectExpr("p_partkey", f"{_PATH} AS path"))


RISK_SQL = """CAST(greatest(0, least(100, least(30, (additions + deletions) // 20) + CASE WHEN is_security_sensitive THEN 20 ELSE 0 END + CASE WHEN is_dependency_manifest THEN 15 ELSE 0 END + CASE WHEN is_migration THEN 20 ELSE 0 END
 + CASE WHEN is_ci THEN 10 ELSE 0 END - CASE WHEN is_test THEN 10 ELSE 0 END)) AS INT)"""


@R.add("file_risk", f"WITH p AS (SELECT p_partkey, {duck(_PATH)} AS path, p_partkey % 700 AS additions, p_size AS deletions FROM part), c AS (SELECT *, {CLASS_SQL} FROM p) SELECT p_partkey, {RISK_SQL} AS risk FROM c")
def file_risk(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", f"{_PATH} AS path", "p_partkey % 700 AS additions", "p_size AS deletions")
    return P.file_risk(P.classify_paths(t)).select("p_partkey", "risk")


@R.add("changed_files_view", f"WITH {LINES_SQL}, c AS (SELECT *, {CLASS_SQL} FROM stats) SELECT patch_id, path, 'modified' AS change_type, additions, deletions, language, is_test, {RISK_SQL} AS risk FROM c")
def changed_files_view(spark, d):
    return P.changed_files_view(lines(spark, d)).select("patch_id", "path", "change_type", "additions", "deletions", "language", "is_test", "risk")


@R.add("filter_changed_files", "SELECT o_orderkey, risk FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk, o_orderkey % 3 = 0 AS is_test FROM orders) WHERE risk >= 40 AND NOT is_test ORDER BY risk DESC, o_orderkey LIMIT 50 OFFSET 50")
def filter_changed_files(spark, d):
    t = table(spark, d, "orders").selectExpr("o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk", "o_orderkey % 3 = 0 AS is_test")
    return page(t.where("risk >= 40 AND NOT is_test"), [F.desc("risk"), F.col("o_orderkey")], 2, 50).select("o_orderkey", "risk")


@R.add(
    "changed_symbols",
    f"""WITH {LINES_SQL}, r AS (SELECT path, min(n) AS a, max(n) AS b FROM numbered WHERE kind = 'added' GROUP BY path),
s AS (SELECT path, 'part ' || k AS symbol, k * 5 + 1 AS x, k * 5 + 5 AS y FROM (SELECT path, unnest(range(0, (total + 4) // 5)) AS k FROM stats)) SELECT DISTINCT s.path, symbol FROM s JOIN r ON r.path = s.path AND a <= y AND b >= x""",
)
def changed_symbols(spark, d):
    parsed = lines(spark, d)
    files = P.patch_files(parsed).select("patch_id", "file", "path")
    ranges = P.changed_ranges(P.patch_lines(parsed)).join(files, ["patch_id", "file"]).select("path", "first_line", "last_line")
    t = table(spark, d, "documents").selectExpr(f"{DOC_FILES} AS path", r"explode(sequence(0, (size(split(text, '\n')) + 4) div 5 - 1)) AS k")
    symbols = t.selectExpr("path", "concat('part ', k) AS symbol", "k * 5 + 1 AS start_line", "k * 5 + 5 AS end_line")
    return P.changed_symbols(symbols, ranges)


QUERIES, SQL = R.queries, R.sql
