"""Lookup and neighbourhoods (O-G1 to O-G12, O-J7, O-J8, O-W6, O-W15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import text
from graphloom.functions.shared import settle, stacked
from graphloom.model import Graph
from graphloom.operators.aggregates import in_degree

DEPTH, HOP_CAP, FLOOR = 3, 200, 0.5


def lookup(g: Graph, query: str, file: str = "", fuzzy: int = 2, limit: int = 5) -> DataFrame:
    """O-G1, O-J17: the first tier with a match: exact qualified, exact name, suffix, containment, edit distance.

    The last two text tiers need three characters. A separator-free exact hit brings all symbols of that name along.
    """
    s = g.symbols.join(g.files.select("file_id", "path"), "file_id").where(F.col("path").contains(file))
    q, low = F.lit(query), query.lower()
    ends = [F.lower("qualified").endswith(sep + low) for sep in text.SEPARATORS]
    suffix = ends[0] | ends[1] | ends[2] | ends[3]
    bare = not any(sep in query for sep in text.SEPARATORS)
    tier = F.when(F.col("qualified") == q, 1).when(F.col("name") == q, 1 if bare else 2)
    if len(query) >= 3:
        tier = tier.when(suffix, 3).when(text.contains_folded(F.col("qualified"), query), 4)
    found = s.withColumn("tier", tier.when(text.distance(F.col("name"), F.col("qualified"), query, fuzzy) >= 0, 5)).where("tier is not null")
    if bare:
        exact = found.where(F.col("qualified") == q).limit(1)
        first = F.when(F.lit(exact.isEmpty()) & (F.col("tier") == 1), 2).otherwise(F.col("tier"))
        found = found.withColumn("tier", first)
    best = found.agg(F.min("tier")).first()[0]
    out = found.where(F.col("tier") == best).withColumn("distance", F.when(F.col("tier") == 5, text.distance(F.col("name"), F.col("qualified"), query, fuzzy)).otherwise(0))
    label = F.get(F.array(*map(F.lit, ("exact", "name", "suffix", "contains", "fuzzy"))), F.col("tier") - 1)
    out = out.select("symbol_id", "name", "qualified", "kind", "path", "line_start", label.alias("resolution"), "distance")
    return out.orderBy("distance", "qualified", "symbol_id").limit(limit) if best == 5 else out


def dominant(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """O-W15: the match with five edges or more whose runner-up has two at most and a fifth; no row if there is none."""
    counted = matches.join(in_degree(edges), "symbol_id", "left").withColumn("n", F.coalesce("in_degree", F.lit(0)))
    top = counted.orderBy(F.desc("n"), "symbol_id").limit(2)
    runner = F.coalesce(F.lead("n").over(W.orderBy(F.desc("n"), "symbol_id")), F.lit(0))  # two rows
    ranked = top.withColumns({"next": runner, "rank": F.row_number().over(W.orderBy(F.desc("n"), "symbol_id"))})
    return ranked.where((F.col("rank") == 1) & (F.col("n") >= 5) & (F.col("next") <= 2) & (F.col("n") >= 5 * F.col("next"))).drop("rank", "next", "in_degree")


def at_end(edges: DataFrame, end: str, rows: DataFrame, how: str = "inner") -> DataFrame:
    """edges joined with rows on an end: rows of other ids are left out first, so that many edges of few ends aren't shuffled for it."""
    ids = settle(edges.select(end).distinct(), "ids")  # the optimiser drops a plain distinct() under a semi-join
    few = settle(rows.join(ids, end, "left_semi"), "ends")
    return edges.join(few, end, how)


def neighbourhood(g: Graph, roots: DataFrame, direction: str = "both") -> DataFrame:
    """O-G4: edges of the roots with the other end named; a NULL source is id 0 and an empty name."""
    wanted = roots.select(F.col("symbol_id").alias("root_id")).distinct()
    sides = []
    for e in g.parts:
        named = lambda end: g.symbols.select(F.col("symbol_id").alias(end), F.col("qualified").alias("other"))
        root = lambda end: wanted.select(F.col("root_id").alias(end))
        if direction in ("both", "callees"):
            out = at_end(e.join(root("source_id"), "source_id"), "target_id", named("target_id"))
            sides.append(out.select(F.col("source_id").alias("root_id"), F.col("target_id").alias("other_id"), "kind", "confidence", F.lit("out").alias("side"), "other"))
        if direction in ("both", "callers"):
            into = at_end(e, "target_id", root("target_id")).join(named("source_id"), "source_id", "left")
            sides.append(into.select(F.col("target_id").alias("root_id"), F.coalesce("source_id", F.lit(0)).alias("other_id"), "kind", "confidence", F.lit("in").alias("side"), F.coalesce("other", F.lit("")).alias("other")))
    return stacked(sides)


def bfs(g: Graph, roots: DataFrame, depth: int = DEPTH, direction: str = "both", cap: int = HOP_CAP) -> DataFrame:
    """O-G5, O-W6: symbol_id, hop, truncated. Per hop at most cap new symbols, by discovery order (source, then edge end); a cut hop is the last.

    Temporal edges and the id 0 are left out. The frontier is at most cap rows a hop, so it is broadcast, and each hop reads the graph's own edges.
    """
    e = g.edges.where("kind <> 'temporal'").where("source_id is not null")
    steps = []
    if direction in ("both", "callees"):
        steps.append(e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    if direction in ("both", "callers"):
        steps.append(e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
    adjacent = stacked(steps)
    first = settle(roots.select("symbol_id", F.lit(0).alias("hop"), F.lit(False).alias("truncated")).distinct(), "bfs")
    hops = [frontier := first]
    for hop in range(1, min(depth, DEPTH) + 1):
        near = adjacent.join(F.broadcast(frontier.select(F.col("symbol_id").alias("a"))), "a").groupBy(F.col("b").alias("symbol_id")).agg(F.min("a").alias("a"))
        new = settle(near.where("symbol_id <> 0").join(stacked(hops).select("symbol_id"), "symbol_id", "left_anti").orderBy("a", "symbol_id").limit(cap + 1), "bfs")
        n = new.count()
        frontier = new.orderBy("a", "symbol_id").limit(cap).select("symbol_id", F.lit(hop).alias("hop"), F.lit(n > cap).alias("truncated"))
        hops.append(frontier)
        if not n or n > cap:
            break
    return stacked(hops)


BUCKETS = ("calls", "called_by", "inherits", "inherited_by", "composes", "composed_by", "includes", "imports", "tests", "temporal")


def bucket(kind: Column, side: Column) -> Column:
    """O-G8: the response's list of an edge; calls and references share one, includes and imports both directions, tests inbound only."""
    out = side == "out"
    return (
        F.when(kind.isin("calls", "references"), F.when(out, "calls").otherwise("called_by")).when(kind == "inherits", F.when(out, "inherits").otherwise("inherited_by"))
        .when(kind == "composes", F.when(out, "composes").otherwise("composed_by")).when(kind.isin("includes", "imports", "temporal"), kind).when((kind == "tests") & ~out, "tests")
    )


def categories(near: DataFrame, least: float = FLOOR) -> DataFrame:
    """O-G8, O-G12: per root and bucket the edges shown, those hidden below the floor (calls only), and whether the list is complete."""
    b = near.withColumn("bucket", bucket(F.col("kind"), F.col("side"))).where("bucket is not null")
    hidden = F.col("bucket").isin("calls", "called_by") & (F.col("confidence") < least)
    out = b.groupBy("root_id", "bucket").agg(F.count_if(~hidden).alias("shown"), F.count_if(hidden).alias("hidden"))
    return out.withColumn("completeness", F.when(F.col("hidden") == 0, "complete").otherwise("partial"))


def member_callers(g: Graph, roots: DataFrame, least: float = FLOOR) -> DataFrame:
    """O-G6: per container the callers of its members, itself and its members left out; none if it has three direct usage callers and fewer than five times as many folded."""
    r = roots.select(F.col("symbol_id").alias("root_id"))
    members = g.symbols.select(F.col("symbol_id").alias("member"), F.col("parent_id").alias("root_id")).join(r, "root_id", "left_semi")
    use = g.edges.where(F.col("kind").isin("calls", "references") & (F.col("confidence") >= least) & F.col("source_id").isNotNull()).select("source_id", "target_id")
    folded = use.join(members, use.target_id == members.member).groupBy("root_id", "source_id").agg(F.min("target_id").alias("member"))
    own = members.select("root_id", F.col("member").alias("source_id"))
    folded = folded.where("source_id <> root_id").join(own, ["root_id", "source_id"], "left_anti")
    direct = use.join(r, use.target_id == r.root_id).select("root_id", "source_id").distinct().groupBy("root_id").agg(F.count("*").alias("direct"))
    n = folded.groupBy("root_id").agg(F.count("*").alias("folded"))
    hidden = n.join(direct, "root_id").where("direct >= 3 and folded < 5 * direct").select("root_id")
    return folded.join(hidden, "root_id", "left_anti").select("root_id", F.col("source_id").alias("symbol_id"), "member")


def member_callees(g: Graph, roots: DataFrame) -> DataFrame:
    """O-G7: per container without a usage callee of its own, what its members use."""
    r = roots.select(F.col("symbol_id").alias("root_id"))
    use = g.edges.where(F.col("kind").isin("calls", "references") & F.col("source_id").isNotNull()).select("source_id", "target_id")
    r = r.join(use.select(F.col("source_id").alias("root_id")), "root_id", "left_anti")
    members = g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("parent_id").alias("root_id")).join(r, "root_id", "left_semi")
    folded = use.join(members, "source_id").groupBy("root_id", F.col("target_id").alias("symbol_id")).agg(F.min("source_id").alias("member"))
    return folded.where("symbol_id <> root_id").join(members.select("root_id", F.col("source_id").alias("symbol_id")), ["root_id", "symbol_id"], "left_anti")


def co_changes(g: Graph, roots: DataFrame) -> DataFrame:
    """O-G9: temporal neighbours in both directions, each once, with count and strength."""
    t = g.edges.where("kind = 'temporal'")
    if "co_changes" not in t.columns:
        t = t.withColumn("co_changes", F.lit(None).cast("int"))
    r = roots.select(F.col("symbol_id").alias("root_id"))
    both = t.select(F.col("source_id").alias("root_id"), F.col("target_id").alias("other_id"), "co_changes", "confidence").unionByName(t.select(F.col("target_id").alias("root_id"), F.col("source_id").alias("other_id"), "co_changes", "confidence"))
    return both.join(r, "root_id", "left_semi").groupBy("root_id", "other_id").agg(F.max("co_changes").alias("co_changes"), F.max("confidence").alias("strength"))


def dispatch(g: Graph) -> DataFrame:
    """O-J8: method and the same-named method of an interface that its parent inherits from.

    Bases without a method of their own are left out before any pair of a method and a base is made.
    """
    m = g.symbols.where("kind = 'method' and parent_id is not null").select("symbol_id", "name", "parent_id")
    kin = g.edges.where("kind = 'inherits'").select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("interface_id"))
    other = m.select(F.col("symbol_id").alias("interface_method"), "name", F.col("parent_id").alias("interface_id"))
    met = settle(kin.select("interface_id").distinct().join(other, "interface_id", "left_semi"), "bases")
    kin = kin.join(met, "interface_id", "left_semi").distinct()
    return m.join(kin, "parent_id").join(other, ["interface_id", "name"]).select("symbol_id", "interface_method").distinct()


def inferred_callers(g: Graph, methods: DataFrame, few: int = 3, equivalents: int = 20, rows: int = 50) -> DataFrame:
    """O-G10: for methods with few direct callers, the callers of their equivalents by dispatch, confidence .8, direct ones left out."""
    calls = g.edges.where("kind = 'calls' and source_id is not null").select("source_id", "target_id").distinct()
    wanted = methods.select("symbol_id").distinct().join(calls.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count("*").alias("n")), "symbol_id", "left").where(F.coalesce("n", F.lit(0)) < few).select("symbol_id")
    d = dispatch(g)
    same = d.unionByName(d.select(F.col("interface_method").alias("symbol_id"), F.col("symbol_id").alias("interface_method"))).join(wanted, "symbol_id", "left_semi")
    same = same.withColumn("k", F.row_number().over(W.partitionBy("symbol_id").orderBy("interface_method"))).where(F.col("k") <= equivalents)
    found = same.join(calls, same.interface_method == calls.target_id).groupBy("symbol_id", "source_id").agg(F.min("interface_method").alias("via"))
    found = found.join(calls.select("source_id", F.col("target_id").alias("symbol_id")), ["symbol_id", "source_id"], "left_anti")
    ranked = found.withColumn("k", F.row_number().over(W.partitionBy("symbol_id").orderBy("source_id"))).where(F.col("k") <= rows)
    return ranked.select("symbol_id", F.col("source_id").alias("caller_id"), "via", F.lit(0.8).alias("confidence"))


def also_called_by(g: Graph, roots: DataFrame, most: int = 20) -> DataFrame:
    """O-G11: per root and callee of it the number of its other callers, if there are any and no more than most."""
    calls = g.edges.where("kind = 'calls' and source_id is not null").select("source_id", "target_id").distinct()
    callers = calls.groupBy("target_id").agg((F.count("*") - 1).alias("others")).where(F.col("others").between(1, most))
    own = calls.join(roots.select(F.col("symbol_id").alias("source_id")).distinct(), "source_id", "left_semi").join(callers, "target_id")
    return own.select(F.col("source_id").alias("root_id"), F.col("target_id").alias("callee_id"), "others")


def collapse_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """O-G35: rows whose ids this session has not returned yet."""
    return rows.join(seen.select("symbol_id"), "symbol_id", "left_anti")
