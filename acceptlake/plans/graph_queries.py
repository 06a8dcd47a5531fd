"""Queries over the key graph (region <- nation <- customer, supplier; customer <- orders <- lineitem) and over pairs of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as P
from .base import Registry, duck, table
from .patch_queries import _CHANGED
from .security_queries import DOC_FILES

R = Registry()


def _key(kind: str, column: str) -> str:
    return f"concat('{kind}:', CAST({column} AS STRING))"


_LINE = "concat('lineitem:', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))"
_EDGE = {
    "defines": ("nation", _key("nation", "n_nationkey"), _key("region", "n_regionkey")),
    "inherits": ("supplier", _key("supplier", "s_suppkey"), _key("nation", "s_nationkey")),
    "imports": ("customer", _key("customer", "c_custkey"), _key("nation", "c_nationkey")),
}
_CALLS = (("orders", _key("orders", "o_orderkey"), _key("customer", "o_custkey")), ("lineitem", _LINE, _key("orders", "l_orderkey")))


def edges(spark, d):
    one = lambda t: table(spark, d, t[0]).selectExpr(f"{t[1]} AS source", f"{t[2]} AS target")
    return P.graph_edges(**{k: one(t) for k, t in _EDGE.items()}, calls=one(_CALLS[0]).unionByName(one(_CALLS[1])))


def nodes(spark, d):
    one = lambda kind, key: table(spark, d, kind).selectExpr(f"{key} AS id", f"'{kind}' AS kind", f"{key} LIKE '%7' AS changed", "CAST(0 AS BIGINT) AS seq")
    c = one("customer", _key("customer", "c_custkey"))
    return P.graph_nodes(one("region", _key("region", "r_regionkey")), one("nation", _key("nation", "n_nationkey")), c, one("supplier", _key("supplier", "s_suppkey")), c.withColumn("changed", F.lit(True)).where("id LIKE '%3'"))


EDGES_SQL = "edges AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT {duck(s)} AS source, {duck(t)} AS target, '{k}' AS edge_type, {P.CONFIDENCE[k]}::DOUBLE AS confidence FROM {n}" for k, (n, s, t) in [*_EDGE.items(), *(("calls", c) for c in _CALLS)]) + "))"
NODES_SQL = """nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_regionkey % 10 = 7 AS changed FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_nationkey % 10 = 7 FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_custkey % 10 IN (3, 7) FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_suppkey % 10 = 7 FROM supplier)"""
REACH_SQL = """walk AS (SELECT source AS id, 1 AS distance FROM edges WHERE target = 'region:2' UNION SELECT e.source, w.distance + 1 FROM walk w JOIN edges e ON e.target = w.id WHERE w.distance < 4),
reach AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)"""


@R.add("graph_edges", f"WITH {EDGES_SQL} SELECT * FROM edges")
def graph_edges(spark, d):
    return edges(spark, d)


@R.add("graph_nodes", f"WITH {NODES_SQL} SELECT * FROM nodes")
def graph_nodes(spark, d):
    return nodes(spark, d)


@R.add("fan_in", "SELECT 'part:' || l_partkey AS target, count(DISTINCT l_suppkey) AS fan_in FROM lineitem GROUP BY 1")
def fan_in(spark, d):
    return P.fan_in(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target")))


@R.add("fan_out", "SELECT url AS source, count(DISTINCT h) AS fan_out FROM (SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY 1")
def fan_out(spark, d):
    links = table(spark, d, "pages").select(F.col("url").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return P.fan_out(links)


def reach(spark, d):
    return P.blast_radius(edges(spark, d), spark.createDataFrame([("region:2",), ("region:unknown",)], "id string"))


@R.add("blast_radius", f"WITH RECURSIVE {EDGES_SQL}, {REACH_SQL} SELECT id, CAST(distance AS INT) AS distance, CASE distance WHEN 1 THEN 'direct' WHEN 2 THEN 'one_hop' ELSE 'transitive' END AS reach FROM reach")
def blast_radius(spark, d):
    return reach(spark, d)


@R.add(
    "graph_view",
    f"""WITH RECURSIVE {EDGES_SQL}, {REACH_SQL}, {NODES_SQL}, shown AS (SELECT n.*, distance FROM nodes n LEFT JOIN reach r ON r.id = n.id ORDER BY changed DESC, distance NULLS LAST, n.id LIMIT 40)
SELECT 'node' AS part, id AS a, kind AS b, CAST(distance AS INT) AS n FROM shown UNION ALL SELECT 'edge', source, target, NULL FROM edges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)""",
)
def graph_view(spark, d):
    shown, kept = P.graph_view(nodes(spark, d), edges(spark, d), reach(spark, d), 40)
    return shown.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("distance").alias("n")).unionByName(kept.select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("int").alias("n")))


@R.add(
    "graph_page",
    f"""WITH {EDGES_SQL}, shown AS (SELECT * FROM (SELECT 'customer:' || c_custkey AS id, 0 AS k, -(c_custkey * 7 % 101) AS r FROM customer UNION ALL SELECT 'orders:' || o_orderkey, 1, 0 FROM orders) ORDER BY k, r, id LIMIT 500),
few AS (SELECT * FROM edges ORDER BY source, target, edge_type LIMIT 2000)
SELECT 'node' AS part, id AS a, CASE k WHEN 0 THEN 'file' ELSE 'symbol' END AS b FROM shown UNION ALL SELECT 'edge', source, target FROM few WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)""",
)
def graph_page(spark, d):
    files = table(spark, d, "customer").selectExpr(f"{_key('customer', 'c_custkey')} AS id", "c_custkey * 7 % 101 AS risk")
    shown, kept = P.graph_page(files, table(spark, d, "orders").selectExpr(f"{_key('orders', 'o_orderkey')} AS id"), edges(spark, d), 500)
    return shown.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b")).unionByName(kept.select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b")))


@R.add(
    "resolve_module",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lib.' || p_brand WHEN 1 THEN 'lib' WHEN 2 THEN 'lib.' || p_brand || '.m' || p_partkey ELSE NULL END AS resolved FROM part""",
)
def resolve_module(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "p_brand", "concat('lib.', p_brand, '.m', p_partkey) AS module")
    imports = t.selectExpr("p_partkey", "module", "CASE p_partkey % 4 WHEN 0 THEN '..' WHEN 1 THEN 'lib' WHEN 2 THEN '.' ELSE 'unknown.x' END AS target", "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 2 THEN concat('m', p_partkey) ELSE 'name' END AS name")
    modules = t.select("module").unionByName(t.selectExpr("concat('lib.', p_brand) AS module")).unionByName(t.selectExpr("'lib' AS module"))
    return P.resolve_module(imports, modules).select("p_partkey", "resolved")


_SYM = "concat(p_brand, '.', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS STRING) ELSE '' END)"
_TARGET = f"CASE p_partkey % 3 WHEN 0 THEN {_SYM} WHEN 1 THEN concat('x.', replace(p_name, ' ', '_')) ELSE concat('y.', replace(p_name, ' ', '_'), CAST(p_partkey - 2 AS STRING)) END"


@R.add(
    "resolve_symbol",
    f"""WITH s AS (SELECT DISTINCT {duck(_SYM)} AS id FROM part), u AS (SELECT regexp_extract(id, '[^.]*$') AS last, min(id) AS only FROM s GROUP BY 1 HAVING count(*) = 1), c AS (SELECT p_partkey, {duck(_TARGET)} AS target FROM part)
SELECT p_partkey, target, coalesce(s.id, u.only) AS symbol FROM c LEFT JOIN s ON s.id = target LEFT JOIN u ON u.last = regexp_extract(target, '[^.]*$') WHERE coalesce(s.id, u.only) IS NOT NULL""",
)
def resolve_symbol(spark, d):
    t = table(spark, d, "part")
    return P.resolve_symbol(t.selectExpr("p_partkey", f"{_TARGET} AS target"), t.selectExpr(f"{_SYM} AS id"))


@R.add("resolve_caller", f"WITH s AS (SELECT DISTINCT {duck(_SYM)} AS id FROM part), c AS (SELECT p_partkey, {duck(_TARGET)} AS caller, p_brand AS module FROM part) SELECT p_partkey, CASE WHEN caller IN (SELECT id FROM s) THEN caller ELSE 'module:' || module END AS source FROM c")
def resolve_caller(spark, d):
    t = table(spark, d, "part")
    return P.resolve_caller(t.selectExpr("p_partkey", f"{_TARGET} AS caller", "p_brand AS module"), t.selectExpr(f"{_SYM} AS id")).select("p_partkey", "source")


def _order_symbols(spark, d, current: bool):
    t = table(spark, d, "orders")
    t = t.where("o_orderkey % 10 <> 0") if current else t.where("o_orderkey % 10 <> 1")
    signature = "CASE WHEN o_orderkey % 7 = 0 THEN concat(o_orderpriority, ' new') ELSE o_orderpriority END" if current else "o_orderpriority"
    behaviour = "CASE WHEN o_orderkey % 11 = 0 THEN array(o_orderstatus, 'raise') ELSE array(o_orderstatus) END" if current else "array(o_orderstatus)"
    exported = "o_custkey % 3 = 0" if current else "o_custkey % 2 = 0"
    symbols = t.selectExpr("concat('order.', o_orderkey) AS name", f"{signature} AS signature", f"{behaviour} AS behaviour", f"{exported} AS exported", "1 AS position")
    earlier = t.where("o_orderkey % 4 = 0").selectExpr("concat('order.', o_orderkey) AS name", "'zz an earlier one' AS signature", "array('zz') AS behaviour", "o_custkey % 2 <> 0 AS exported", "0 AS position")
    return symbols.unionByName(earlier)


@R.add(
    "symbol_diff",
    """SELECT 'order.' || o_orderkey AS name, 'impact.public-export-removed' AS rule_id, 'high' AS severity FROM orders WHERE o_orderkey % 10 = 0 AND o_custkey % 2 = 0
UNION ALL SELECT 'order.' || o_orderkey, 'impact.python-signature-changed', CASE WHEN o_custkey % 2 = 0 THEN 'high' ELSE 'medium' END FROM orders WHERE o_orderkey % 10 > 1 AND o_orderkey % 7 = 0
UNION ALL SELECT 'order.' || o_orderkey, 'impact.python-behavior-changed', 'medium' FROM orders WHERE o_orderkey % 10 > 1 AND o_orderkey % 11 = 0""",
)
def symbol_diff(spark, d):
    return P.symbol_diff(_order_symbols(spark, d, False), _order_symbols(spark, d, True))


@R.add("high_fan_in", "SELECT 'orders:' || l_orderkey AS target, count(DISTINCT l_linenumber) AS fan_in FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 3")
def high_fan_in(spark, d):
    changed = table(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr(f"{_key('orders', 'o_orderkey')} AS id")
    return P.high_fan_in(edges(spark, d), changed)


def _routes(spark, d, current: bool):
    t = table(spark, d, "customer")
    t = t.where("c_custkey % 10 <> 0") if current else t.where("c_custkey % 10 <> 1")
    new = lambda test, a, b: f"CASE WHEN {test} THEN {b} ELSE {a} END" if current else a
    routes = t.selectExpr("'GET' AS method", "concat('/c/', c_custkey) AS path", f"{new('c_custkey % 7 = 0', 'c_mktsegment', 'c_name')} AS request", "c_mktsegment AS response", f"{new('c_custkey % 13 = 0', '200', '201')} AS status", f"{new('c_custkey % 5 = 0', 'c_nationkey', 'c_nationkey + 1')} AS depends", "2 AS position")
    return routes.unionByName(routes.where("CAST(substring(path, 4) AS INT) % 4 = 0").withColumn("request", F.lit("zz")).withColumn("position", F.lit(1)))


@R.add(
    "route_diff",
    """WITH c AS (SELECT *, concat_ws('; ', CASE WHEN c_custkey % 7 = 0 THEN 'request models changed' END, CASE WHEN c_custkey % 13 = 0 THEN 'status code changed' END, CASE WHEN c_custkey % 5 = 0 THEN 'dependencies changed' END) AS what FROM customer)
SELECT 'GET' AS method, '/c/' || c_custkey AS path, CASE c_custkey % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS change, CASE c_custkey % 10 WHEN 0 THEN true WHEN 1 THEN false ELSE c_custkey % 7 = 0 OR c_custkey % 13 = 0 END AS breaking,
 CASE c_custkey % 10 WHEN 0 THEN 'route removed' WHEN 1 THEN 'route added' ELSE what END AS explanation FROM c WHERE c_custkey % 10 < 2 OR what <> ''""",
)
def route_diff(spark, d):
    return P.route_diff(_routes(spark, d, False), _routes(spark, d, True))


_SPEC = "concat(CASE WHEN p_size % 2 = 0 THEN '==' ELSE '>=' END, CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING), '.0')"
_NEW_SPEC = "CASE WHEN p_partkey % 7 = 0 THEN concat('==', CAST(p_size + 1 AS STRING), '.0') WHEN p_partkey % 11 = 0 THEN '==0.1' ELSE " + _SPEC + " END"


def packages(spark, d, current: bool):
    t = table(spark, d, "part")
    t = t.where("p_partkey % 10 <> 0") if current else t.where("p_partkey % 10 <> 1")
    return t.selectExpr("'python' AS ecosystem", "concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey AS STRING) END) AS name", f"{_NEW_SPEC if current else _SPEC} AS spec", "p_partkey AS pos")


_DIRECTION = "CASE WHEN len(o) > 0 AND len(n) > 0 AND n > o THEN 'upgraded' WHEN len(o) > 0 AND len(n) > 0 AND n < o THEN 'downgraded' ELSE 'modified' END"
_NUMBERS = "list_transform(list_slice(regexp_extract_all({}, '\\d+'), 1, 3), lambda x: CAST(x AS BIGINT))"


@R.add(
    "dependency_diff",
    f"""WITH p AS (SELECT lower(concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END)) AS name, p_partkey, {duck(_SPEC)} AS s, {duck(_NEW_SPEC)} AS n FROM part),
a AS (SELECT name, arg_max(s, p_partkey) AS old_spec FROM p WHERE p_partkey % 10 <> 1 GROUP BY 1), b AS (SELECT name, arg_max(n, p_partkey) AS new_spec FROM p WHERE p_partkey % 10 <> 0 GROUP BY 1),
j AS (SELECT coalesce(a.name, b.name) AS name, old_spec, new_spec, {_NUMBERS.format("old_spec")} AS o, {_NUMBERS.format("new_spec")} AS n FROM a FULL JOIN b ON a.name = b.name)
SELECT 'python' AS ecosystem, name, old_spec, new_spec, CASE WHEN old_spec IS NULL THEN 'added' WHEN new_spec IS NULL THEN 'removed' ELSE {_DIRECTION} END AS change FROM j WHERE old_spec IS DISTINCT FROM new_spec""",
)
def dependency_diff(spark, d):
    return P.dependency_diff(packages(spark, d, False), packages(spark, d, True))


@R.add("version_direction", f"WITH v AS (SELECT p_partkey, {_NUMBERS.format(duck(_SPEC))} AS o, {_NUMBERS.format(duck(_NEW_SPEC))} AS n FROM part) SELECT p_partkey, {_DIRECTION} AS direction FROM v")
def version_direction(spark, d):
    return table(spark, d, "part").select("p_partkey", X.version_direction(F.expr(_SPEC), F.expr(_NEW_SPEC)).alias("direction"))


@R.add("unpinned_dependencies", f"SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'direct-url' ELSE 'unpinned' END AS rule, CASE WHEN p_partkey % 17 = 0 THEN 'high' ELSE 'medium' END AS severity FROM part WHERE p_partkey % 17 = 0 OR starts_with({duck(_SPEC)}, '>')")
def unpinned_dependencies(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.expr(_SPEC).alias("spec"), (F.col("p_partkey") % 17 == 0).alias("url"))
    return t.where(F.col("url") | X.is_unpinned(F.col("spec"))).select("p_partkey", F.when(F.col("url"), "direct-url").otherwise("unpinned").alias("rule"), F.when(F.col("url"), "high").otherwise("medium").alias("severity"))


@R.add("removed_config_keys", "WITH k AS (SELECT DISTINCT json_extract_string(props, '$.k') || ':' || user_id % 40 AS key, ts < TIMESTAMP '2024-01-15' AS old FROM events) SELECT DISTINCT key FROM k WHERE old AND key NOT IN (SELECT key FROM k WHERE NOT old)")
def removed_config_keys(spark, d):
    k = table(spark, d, "events").select(F.concat(F.get_json_object("props", "$.k"), F.lit(":"), F.col("user_id") % 40).alias("key"), (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).alias("old"))
    return P.removed_keys(k.where("old"), k.where("NOT old"))


@R.add("changed_migrations", f"SELECT {duck(DOC_FILES)} AS path FROM documents WHERE doc_id % 10 <> 0 AND (doc_id % 10 = 1 OR doc_id % 7 = 0)")
def changed_migrations(spark, d):
    t = table(spark, d, "documents")
    return P.changed_files(t.where("doc_id % 10 <> 1").selectExpr(f"{DOC_FILES} AS path", "text"), t.where("doc_id % 10 <> 0").selectExpr(f"{DOC_FILES} AS path", f"{_CHANGED} AS text"))


QUERIES, SQL = R.queries, R.sql
