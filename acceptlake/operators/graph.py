"""Dependency graphs: resolving names, nodes and edges, fan-in and fan-out, the reach of a change, views.

nodes: id, label, kind, path, changed. edges: source, target, edge_type, confidence; the source depends on the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged, unstage

# How sure an edge of each type is.
CONFIDENCE = {"defines": 1.0, "inherits": 0.8, "imports": 1.0, "calls": 0.9}


def resolve_module(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports (module, target, name) with resolved: the absolute module that is meant, null if unknown.

    Leading dots of a target strip as many parts from the importing module; target.name is preferred if it is a module itself.
    """
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    rest = F.regexp_replace("target", r"^\.+", "")
    parts = F.split("module", r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - dots)), ".")
    absolute = F.when(dots > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit("")))).otherwise(F.col("target"))
    rows = imports.withColumn("absolute", absolute).withColumn("deeper", F.concat_ws(".", "absolute", "name"))
    known = lambda c, name: modules.select(F.col("module").alias(c), F.lit(True).alias(name)).distinct()
    rows = rows.join(known("deeper", "a"), "deeper", "left").join(known("absolute", "b"), "absolute", "left")
    return rows.withColumn("resolved", F.when(F.col("a"), F.col("deeper")).when(F.col("b"), F.col("absolute"))).drop("a", "b", "deeper", "absolute")


def resolve_symbol(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (target) with symbol: the exact id, else the only symbol with the same last part; unresolved calls are dropped."""
    exact = symbols.select(F.col("id").alias("target"), F.col("id").alias("exact")).distinct()
    short = symbols.groupBy(F.substring_index("id", ".", -1).alias("last")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("only")).where("n = 1")
    rows = calls.join(exact, "target", "left").withColumn("last", F.substring_index("target", ".", -1)).join(short.select("last", "only"), "last", "left")
    return rows.withColumn("symbol", F.coalesce("exact", "only")).where("symbol IS NOT NULL").drop("exact", "only", "last")


def resolve_caller(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (caller, module) with source: the caller if it is a known symbol, else its module."""
    known = symbols.select(F.col("id").alias("caller"), F.lit(True).alias("there")).distinct()
    return calls.join(known, "caller", "left").withColumn("source", F.when(F.col("there"), F.col("caller")).otherwise(F.concat(F.lit("module:"), "module"))).drop("there")


def graph_nodes(*parts: DataFrame) -> DataFrame:
    """Nodes without repeats: the first of an id stays unless a later one is changed. parts in order, each with seq."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("changed"), "part", "seq"))
    return rows.withColumn("r", first).where("r = 1").drop("r", "part", "seq")


def graph_edges(**parts: DataFrame) -> DataFrame:
    """Edges of each type (source, target) with the type's confidence; no edge to itself, none twice."""
    rows = None
    for kind, part in parts.items():
        part = part.select("source", "target", F.lit(kind).alias("edge_type"), F.lit(CONFIDENCE[kind]).alias("confidence"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("source <> target").dropDuplicates(["source", "target", "edge_type"])


def fan_in(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """target, fan_in: how many different nodes depend on it."""
    rows = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    return rows.groupBy("target").agg(F.count_distinct("source").alias("fan_in"))


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count_distinct("target").alias("fan_out"))


def blast_radius(edges: DataFrame, changed: DataFrame, max_depth: int = 4) -> DataFrame:
    """id, distance, reach of the nodes that depend on a changed one over at most max_depth edges; the changed ones themselves are left out.

    Only nodes that are new in a step are expanded in the next: a step is one join of the frontier with the edges and one anti join with what is
    reached already, and the walk ends when nothing new comes. Changed ids that no edge knows reach nothing.
    """
    back = staged(edges.select("source", "target").distinct(), "back")
    frontier = staged(changed.select("id").distinct().withColumn("distance", F.lit(0)), "reached")
    reached, steps = frontier, [frontier]
    for depth in range(1, max_depth + 1):
        step = back.join(frontier.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id")).distinct()
        frontier = staged(step.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(depth)), "reached")
        steps.append(frontier)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    reach = F.when(F.col("distance") == 1, "direct").when(F.col("distance") == 2, "one_hop").otherwise("transitive")
    out = staged(reached.where("distance > 0").withColumn("reach", reach), "reach")
    unstage(back, *steps)
    return out


def graph_view(nodes: DataFrame, edges: DataFrame, reach: DataFrame, max_nodes: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The first max_nodes nodes (changed first, then by distance and id) with their reach, and the edges between them."""
    rows = nodes.join(reach.select("id", "distance"), "id", "left").withColumn("impacted", F.col("distance").isNotNull())
    shown = rows.orderBy(F.desc("changed"), F.asc_nulls_last("distance"), "id").limit(max_nodes)
    ids = shown.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, kept


def graph_page(files: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Files by risk up to the limit, then symbols; the first 4 * limit edges, of them those with both ends shown."""
    nodes = files.select("id", F.lit(0).alias("kind"), (-F.col("risk")).alias("rank")).unionByName(symbols.select("id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rank")))
    shown = nodes.orderBy("kind", "rank", "id").limit(limit)
    some = edges.orderBy("source", "target", "edge_type").limit(4 * limit)
    ids = shown.select("id")
    return shown.select("id", F.when(F.col("kind") == 0, "file").otherwise("symbol").alias("kind")), some.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def _changed(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _last(df: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], side: str) -> DataFrame:
    """keys and a struct `side` of the fields of the last row of each key: by the column position, or by the fields where there is none."""
    values = F.struct(*fields)
    return df.groupBy(*keys).agg(F.max_by(values, F.struct(*(["position"] if "position" in df.columns else []), *fields)).alias(side))


# Rules of a compared pair of symbols.
SIGNATURE_CHANGED, BEHAVIOR_CHANGED, EXPORT_REMOVED = "impact.python-signature-changed", "impact.python-behavior-changed", "impact.public-export-removed"


def symbol_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Findings of a compared pair of snapshots: symbols (name, signature, behaviour array, exported, position) by name. Of a repeated
    name the last one counts; how severe a change is depends on what was exported before."""
    fields = ("signature", "behaviour", "exported")
    sides = [_last(df.withColumn("behaviour", F.array_sort("behaviour")), ("name",), fields, s) for df, s in ((previous, "p"), (current, "c"))]
    rows = sides[0].join(sides[1], "name", "full")
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    finding = lambda rule, severity: F.struct(F.lit(rule).alias("rule_id"), severity.alias("severity"))
    found = F.array(
        F.when(both & _changed("p.signature", "c.signature"), finding(SIGNATURE_CHANGED, F.when(F.col("p.exported"), "high").otherwise("medium"))),
        F.when(both & _changed("p.behaviour", "c.behaviour"), finding(BEHAVIOR_CHANGED, F.lit("medium"))),
        F.when(F.col("c").isNull() & F.col("p.exported"), finding(EXPORT_REMOVED, F.lit("high"))),
    )
    return rows.select("name", F.inline(F.array_compact(found)))


def high_fan_in(edges: DataFrame, changed: DataFrame, threshold: int = 3) -> DataFrame:
    """Changed symbols that at least threshold nodes call or inherit from."""
    return changed.select(F.col("id").alias("target")).distinct().join(fan_in(edges, ("calls", "inherits")), "target").where(F.col("fan_in") >= threshold)


def route_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Routes (method, path, request, response, status, depends, position) compared by method and path, of a repeated route the last:
    change, breaking, explanation."""
    fields, keys = ("request", "response", "status", "depends"), ("method", "path")
    rows = _last(previous, keys, fields, "p").join(_last(current, keys, fields, "c"), [*keys], "full")
    differ = {f: _changed(f"p.{f}", f"c.{f}") for f in fields}
    texts = {"request": "request models changed", "response": "response model changed", "status": "status code changed", "depends": "dependencies changed"}
    what = F.concat_ws("; ", *[F.when(differ[f], texts[f]) for f in fields])
    change = F.when(F.col("c").isNull(), "removed").when(F.col("p").isNull(), "added").when(what != "", "modified")
    breaking = F.col("c").isNull() | (F.col("p").isNotNull() & (differ["request"] | differ["response"] | differ["status"]))
    text = F.when(F.col("c").isNull(), "route removed").when(F.col("p").isNull(), "route added").otherwise(what)
    return rows.select("method", "path", change.alias("change"), breaking.alias("breaking"), text.alias("explanation")).where("change IS NOT NULL")


def dependency_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Dependencies (ecosystem, name, spec, pos) compared by ecosystem and lower-case name, the last of a repeated name: added, removed, upgraded, downgraded, modified."""
    from ..functions.text import version_direction

    last = lambda df, c: df.groupBy("ecosystem", F.lower("name").alias("name")).agg(F.max_by("spec", "pos").alias(c))
    rows = last(previous, "old_spec").join(last(current, "new_spec"), ["ecosystem", "name"], "full").where(~F.col("old_spec").eqNullSafe(F.col("new_spec")))
    change = F.when(F.col("old_spec").isNull(), "added").when(F.col("new_spec").isNull(), "removed").otherwise(version_direction(F.col("old_spec"), F.col("new_spec")))
    return rows.withColumn("change", change)


def removed_keys(previous: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    return previous.select(key).distinct().join(current.select(key).distinct(), key, "left_anti")


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of current whose text is not that of the previous snapshot (all, if there is none)."""
    old = previous.select("path", F.col("text").alias("old"), F.lit(True).alias("was"))
    return current.join(old, "path", "left").where(F.col("was").isNull() | ~F.col("text").eqNullSafe(F.col("old"))).select("path")
