"""Queries of requirement matching: benchmark items as requirements, documents as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import textmatch as P
from ..operators.bestmatch import pairs, top_scores
from .base import Registry, duck, table
from .security_queries import DOC_FILES

R = Registry()
_KIND = "CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'route' WHEN 2 THEN 'symbol' ELSE 'file' END"
_SYMBOL = "CASE WHEN doc_id % 4 IN (1, 2) THEN split_part(text, ' ', 1) END"
_ID = "concat('c', CAST(doc_id AS STRING))"
_STOP = "('the', 'and', 'for', 'with', 'that', 'this', 'from', 'should', 'must', 'into')"


def requirements(spark, d):
    return table(spark, d, "benchmark").selectExpr("concat('REQ-', CAST(item_id AS STRING)) AS id", "concat('Item ', CAST(item_id AS STRING)) AS title", "text")


def candidates(spark, d):
    return table(spark, d, "documents").selectExpr(f"{_ID} AS id", f"{_KIND} AS kind", "text", f"{DOC_FILES} AS path", f"{_SYMBOL} AS symbol")


_TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z][a-z0-9_/-]+'), lambda t: t NOT IN {})"
BASE_SQL = f"""req AS (SELECT 'REQ-' || item_id AS id, 'Item ' || item_id AS title, text FROM benchmark),
cand AS (SELECT {duck(_ID)} AS id, {_KIND} AS kind, text, {duck(DOC_FILES)} AS path, {_SYMBOL} AS symbol FROM documents),
plain AS (SELECT 'r' || id AS id, {_TOKENS.format("text", _STOP)} AS t FROM req UNION ALL SELECT 'c' || id, {_TOKENS.format("text", _STOP)} FROM cand),
idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM plain)) / (1 + count(*))) + 1 AS idf FROM (SELECT DISTINCT id, unnest(t) AS token FROM plain) GROUP BY token),
full_ AS (SELECT 'r' AS side, id, {_TOKENS.format("text", _STOP)} AS t FROM req UNION ALL SELECT 'c', id, {_TOKENS.format("concat_ws(' ', nullif(text, ''), path, nullif(symbol, ''))", _STOP)} FROM cand),
cnt AS (SELECT side, id, len(t) AS total, unnest(t) AS token FROM full_),
w AS (SELECT side, id, cnt.token, count(*)::DOUBLE / any_value(total) * coalesce(any_value(idf), 1.0) AS w, count(*) AS n FROM cnt LEFT JOIN idf ON idf.token = cnt.token GROUP BY side, id, cnt.token),
norm AS (SELECT side, id, sqrt(sum(w * w)) AS norm, count(*) AS size FROM w GROUP BY side, id),
sim AS (SELECT l.id AS requirement_id, r.id AS candidate_id, sum(l.w * r.w) AS dot, count(*) AS common FROM w l JOIN w r ON l.token = r.token AND l.side = 'r' AND r.side = 'c' GROUP BY ALL),
near AS (SELECT requirement_id, candidate_id, dot / (a.norm * b.norm) AS cosine, common::DOUBLE / least(a.size, b.size) AS overlap FROM sim JOIN norm a ON a.side = 'r' AND a.id = requirement_id JOIN norm b ON b.side = 'c' AND b.id = candidate_id),
expl AS (SELECT req.id AS requirement_id, cand.id AS candidate_id FROM req, cand WHERE """ + " OR ".join(
    f"coalesce(contains(lower(req.text), lower({v})) OR contains(lower(req.text), regexp_extract(lower({v}), '[^/]*$')) OR (length(regexp_extract(lower({v}), '[^.]*$')) > 3 AND contains(lower(req.text), regexp_extract(lower({v}), '[^.]*$'))), false)" for v in ("cand.path", "nullif(cand.symbol, '')", "cand.id")
) + """),
pairs AS (SELECT coalesce(n.requirement_id, e.requirement_id) AS requirement_id, coalesce(n.candidate_id, e.candidate_id) AS candidate_id, coalesce(cosine, 0) AS cosine, coalesce(overlap, 0) AS overlap, CASE WHEN e.candidate_id IS NULL THEN 0 ELSE 1 END AS explicit
 FROM near n FULL JOIN expl e ON n.requirement_id = e.requirement_id AND n.candidate_id = e.candidate_id),
scores AS (SELECT requirement_id, candidate_id, kind, path, symbol, least(1.0, cosine * 0.62 + overlap * 0.28 + explicit * 0.3 + CASE WHEN kind IN ('test', 'route') AND overlap > 0 THEN 0.04 ELSE 0 END)::DOUBLE AS score, cosine, overlap, explicit FROM pairs JOIN cand ON cand.id = candidate_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY round(score, 9) DESC, candidate_id) AS place FROM scores WHERE score > 0) WHERE place <= 8 AND score >= 0.12),
best AS (SELECT requirement_id, max(score) AS best FROM scores GROUP BY 1),
mapping AS (SELECT req.id, title, coalesce(best, 0.0)::DOUBLE AS score, coalesce(best, 0.0) >= 0.2 AS supported FROM req LEFT JOIN best ON best.requirement_id = req.id)"""


def _counts(spark, d):
    return P.tokenize(candidates(spark, d))


@R.add("tokenize", f"SELECT {duck(_ID)} AS id, CAST(len(t) AS INT) AS total, token, count(*) AS n FROM (SELECT doc_id, t, unnest(t) AS token FROM (SELECT doc_id, {_TOKENS.format('text', _STOP)} AS t FROM documents)) GROUP BY doc_id, len(t), token")
def tokenize(spark, d):
    return _counts(spark, d)


def _weights(spark, d):
    r, c = requirements(spark, d), candidates(spark, d)
    return P.idf_of_texts(r.select("text").unionByName(c.select("text")), r.count() + c.count())


@R.add("idf", f"WITH {BASE_SQL} SELECT token, round(idf, 6) AS idf FROM idf")
def idf(spark, d):
    return _weights(spark, d).withColumn("idf", F.round("idf", 6))


@R.add("tfidf", f"WITH {BASE_SQL} SELECT id, token, round(w, 6) AS w FROM w WHERE side = 'r'")
def tfidf(spark, d):
    return P.tfidf(P.tokenize(requirements(spark, d)), _weights(spark, d)).withColumn("w", F.round("w", 6))


def _near(spark, d):
    return pairs(requirements(spark, d), candidates(spark, d), references=False)


@R.add("cosine_join", f"WITH {BASE_SQL} SELECT requirement_id, candidate_id, round(cosine, 6) AS cosine FROM near")
def cosine_join(spark, d):
    return _near(spark, d).select("requirement_id", "candidate_id", F.round("cosine", 6).alias("cosine"))


@R.add("keyword_overlap", f"WITH {BASE_SQL} SELECT requirement_id, candidate_id, round(overlap, 6) AS overlap FROM near")
def keyword_overlap(spark, d):
    return _near(spark, d).select("requirement_id", "candidate_id", F.round("overlap", 6).alias("overlap"))


@R.add("explicit_reference", f"WITH {BASE_SQL} SELECT requirement_id, candidate_id FROM expl")
def explicit_reference(spark, d):
    return P.explicit_reference(requirements(spark, d), candidates(spark, d))


@R.add(
    "evidence_candidates",
    f"""WITH f AS (SELECT doc_id, {duck(DOC_FILES)} AS path, text, split_part(text, ' ', 1) AS symbol FROM documents)
SELECT 'file:' || path AS id, 'file' AS kind, length(text) AS n, path, NULL AS symbol FROM f
UNION ALL SELECT 'symbol:' || path || ':' || symbol, 'symbol', length(symbol), path, symbol FROM f WHERE doc_id % 2 = 0
UNION ALL SELECT 'test:' || path || ':' || symbol, 'test', length(symbol), path, symbol FROM f WHERE doc_id % 3 = 0
UNION ALL SELECT 'route:' || path || ':' || symbol, 'route', length(symbol), path, symbol FROM f WHERE doc_id % 5 = 0""",
)
def evidence_candidates(spark, d):
    f = table(spark, d, "documents").selectExpr("doc_id", f"{DOC_FILES} AS path", "text", "split_part(text, ' ', 1) AS symbol")
    out = P.evidence_candidates(f, f.where("doc_id % 2 = 0"), f.where("doc_id % 3 = 0"), f.where("doc_id % 5 = 0"))
    return out.select("id", "kind", F.length("text").cast("long").alias("n"), "path", "symbol")


def scores(spark, d):
    return P.requirement_scores(requirements(spark, d), candidates(spark, d))


def rounded(spark, d):
    """Scores rounded far below what tells them apart, so that both engines order ties alike."""
    return scores(spark, d).withColumn("score", F.round("score", 9))


def best(spark, d):
    return top_scores(requirements(spark, d), candidates(spark, d))


@R.add("requirement_scores", f"WITH {BASE_SQL} SELECT requirement_id, candidate_id, round(score, 6) AS score, concat_ws(', ', CASE WHEN explicit > 0 THEN 'explicit name or path reference' END, CASE WHEN overlap > 0 THEN 'shared domain terms' END, CASE WHEN cosine > 0 THEN 'local TF-IDF similarity' END) AS reasons FROM scores WHERE score > 0")
def requirement_scores(spark, d):
    return scores(spark, d).select("requirement_id", "candidate_id", F.round("score", 6).alias("score"), "reasons")


@R.add("requirement_topk", f"WITH {BASE_SQL} SELECT requirement_id, candidate_id, CAST(place AS INT) AS place, round(score, 4) AS score FROM kept")
def requirement_topk(spark, d):
    return P.requirement_topk(best(spark, d)).select("requirement_id", "candidate_id", "place", F.round("score", 4).alias("score"))


@R.add(
    "requirement_mapping",
    f"""WITH {BASE_SQL} SELECT m.id, m.title, round(m.score, 4) AS score, m.supported, coalesce((SELECT string_agg(DISTINCT path, ',' ORDER BY path) FROM kept WHERE requirement_id = m.id AND kind = 'file'), '') AS files,
 coalesce((SELECT string_agg(DISTINCT path, ',' ORDER BY path) FROM kept WHERE requirement_id = m.id AND kind = 'test'), '') AS tests FROM mapping m""",
)
def requirement_mapping(spark, d):
    out = P.requirement_mapping(requirements(spark, d), best(spark, d))
    return out.select("id", "title", F.round("score", 4).alias("score"), "supported", F.array_join("files", ",").alias("files"), F.array_join("tests", ",").alias("tests"))


def _mapping(spark, d):
    return P.requirement_mapping(requirements(spark, d), best(spark, d))


@R.add("requirement_coverage", f"WITH {BASE_SQL} SELECT avg(CAST(supported AS DOUBLE)) AS coverage, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE NOT supported), '') AS unsupported FROM mapping")
def requirement_coverage(spark, d):
    return P.requirement_coverage(_mapping(spark, d)).withColumn("unsupported", F.array_join("unsupported", ","))


@R.add("unmentioned_files", f"WITH {BASE_SQL} SELECT DISTINCT path FROM cand WHERE path NOT IN (SELECT path FROM kept)")
def unmentioned_files(spark, d):
    return P.unmentioned_files(candidates(spark, d), P.requirement_topk(best(spark, d)))


@R.add(
    "external_mapping_merge",
    """WITH e AS (SELECT 'REQ-' || item_id AS id, (item_id % 30 - 5) / 20.0 AS s, ['c' || item_id, 'c' || (item_id + 1), 'zz'] AS ev FROM benchmark WHERE item_id % 4 <> 3)
SELECT 'REQ-' || b.item_id AS id, CASE WHEN s IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, s)) END::DOUBLE AS score, CASE WHEN s IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, s)) END >= 0.5 AS supported,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(ev) AS x) WHERE x IN (SELECT 'c' || doc_id FROM documents)), '') AS evidence FROM benchmark b LEFT JOIN e ON e.id = 'REQ-' || b.item_id""",
)
def external_mapping_merge(spark, d):
    ext = table(spark, d, "benchmark").where("item_id % 4 <> 3").selectExpr("concat('REQ-', item_id) AS id", "(item_id % 30 - 5) / 20.0D AS score", "array(concat('c', item_id), concat('c', item_id + 1), 'zz') AS evidence")
    return P.external_mapping_merge(requirements(spark, d), candidates(spark, d), ext).withColumn("evidence", F.array_join("evidence", ","))


@R.add("requirements_view", f"WITH {BASE_SQL} SELECT id, title, round(score, 4) AS score, supported FROM mapping")
def requirements_view(spark, d):
    return P.requirements_view(requirements(spark, d).select("id", "title"), _mapping(spark, d)).select("id", "title", F.round("score", 4).alias("score"), "supported")


_MARK = r"concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE '# ' END, replace(text, '\n', CASE WHEN doc_id % 2 = 0 THEN '\n- must ' ELSE '\n## ' END))"


@R.add(
    "requirements_from_markdown",
    """WITH m AS (SELECT doc_id, string_split(concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE '# ' END, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- must ' ELSE chr(10) || '## ' END)), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(l))) AS p, trim(unnest(l), ' ') AS raw FROM m), y AS (SELECT *, nullif(regexp_extract(raw, '^#{1,6}\\s+(.+)$', 1), '') AS h FROM x WHERE raw <> ''),
z AS (SELECT *, count(h) OVER (PARTITION BY doc_id ORDER BY p) AS s, CASE WHEN h IS NULL THEN regexp_replace(raw, '^[-* ]+', '') END AS line FROM y),
g AS (SELECT doc_id, s, max(h) AS h, coalesce(string_agg(line, ' ' ORDER BY p), '') AS description, count(*) FILTER (WHERE regexp_matches(line, '(?i)^(given|when|then|accept|must|should)')) AS n FROM z GROUP BY doc_id, s),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS place FROM g)
SELECT doc_id, 'REQ-' || lpad(CAST(place AS VARCHAR), CAST(greatest(3, length(CAST(place AS VARCHAR))) AS INT), '0') AS id, md5(coalesce(trim(h, ' '), 'Requirement ' || place)) AS title, md5(description) AS description, n FROM o""",
)
def requirements_from_markdown(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id AS key", f"{_MARK} AS text")
    out = P.requirements_from_markdown(t)
    return out.select(F.col("key").alias("doc_id"), "id", F.md5("title").alias("title"), F.md5("description").alias("description"), F.size("criteria").cast("long").alias("n"))


QUERIES, SQL = R.queries, R.sql
