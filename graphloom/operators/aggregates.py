"""Counts and groupings over the graph (O-A rows), grouped scans and joins behind them (O-J, O-U, O-S13 to S15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import paths, text
from graphloom.functions.shared import settle, stacked
from graphloom.model import CONTAINERS, FOLLOWED, Graph

#: Leaf names that say nothing about a project (fixed values).
BUILTIN_LEAVES = ("String", "Integer", "Object", "Array", "Hash", "Error", "Exception", "Map", "Set", "List", "int", "string", "error", "bool")


def totals(g: Graph) -> DataFrame:
    """O-A1: one row of counts, with embedding coverage in whole percent where vectors are given."""
    n = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    out = n(g.files, "files").join(n(g.symbols, "symbols"), "one").join(n(g.edges, "edges"), "one")
    if g.embeddings is None:
        return out.withColumns({"embeddings": F.lit(0).cast("long"), "coverage_percent": F.lit(0).cast("long")}).drop("one")
    out = out.join(n(g.embeddings, "embeddings"), "one").drop("one")
    return out.withColumn("coverage_percent", F.when(F.col("symbols") > 0, F.floor(100 * F.col("embeddings") / F.col("symbols"))).otherwise(0).cast("long"))


def in_degree(edges: DataFrame, kinds: tuple[str, ...] | None = None, least: float | None = None) -> DataFrame:
    """O-A2; with the traversal's kinds and least confidence O-A4 (NULL sources then don't count)."""
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(*kinds) & F.col("source_id").isNotNull())
    if least is not None:
        edges = edges.where(F.col("confidence") >= least)
    return edges.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count("*").alias("in_degree"))


def total_degree(edges: DataFrame) -> DataFrame:
    """O-A3, O-U1: in and out edges per symbol, by union."""
    ends = edges.select(F.col("source_id").alias("symbol_id")).where("symbol_id is not null").unionByName(edges.select(F.col("target_id").alias("symbol_id")))
    return ends.groupBy("symbol_id").agg(F.count("*").alias("degree"))


def languages(g: Graph) -> DataFrame:
    """O-A5: files and symbols per language; a file without symbols counts."""
    joined = g.files.select("file_id", "language").join(g.symbols.select("file_id", "symbol_id"), "file_id", "left")
    per_file = joined.groupBy("language", "file_id").agg(F.count("symbol_id").alias("n"))
    return per_file.groupBy("language").agg(F.count("*").alias("files"), F.sum("n").alias("symbols"))


def namespaces(g: Graph, limit: int = 8) -> DataFrame:
    """O-A6: symbols per namespace prefix, the largest first."""
    per = g.symbols.select("file_id").join(g.files.select("file_id", "path"), "file_id").groupBy(paths.namespace(F.col("path")).alias("namespace")).agg(F.count("*").alias("symbols"))
    return per.orderBy(F.desc("symbols"), "namespace").limit(limit)


def modal(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per key; ties by the value itself. Counts are gathered, never rows."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v")))["v"].alias(name))


def hubs(g: Graph, limit: int = 5) -> DataFrame:
    """O-A7: symbols by the number of files whose edges reach them, containers first, with the modal kind of those edges."""
    reach = g.edges.groupBy(F.col("target_id").alias("symbol_id"), "file_id").agg(F.count("*").alias("n")).groupBy("symbol_id").agg(F.count("*").alias("reach"))
    s = g.symbols.select("symbol_id", "qualified", "kind")
    top = reach.join(s, "symbol_id").orderBy(F.when(F.col("kind").isin(*CONTAINERS), 0).otherwise(1), F.desc("reach"), "symbol_id").limit(limit)
    inbound = g.edges.select(F.col("target_id").alias("symbol_id"), F.col("kind").alias("edge_kind")).join(F.broadcast(top.select("symbol_id")), "symbol_id")  # limit rows
    return top.join(modal(inbound, ["symbol_id"], "edge_kind", "modal_kind"), "symbol_id").select("symbol_id", "qualified", "kind", "reach", "modal_kind")


def key_symbols(g: Graph, prefix: str = "", limit: int = 10, exclude: tuple[str, ...] = BUILTIN_LEAVES) -> DataFrame:
    """O-A8, O-H key types: types by the files that reach them or their children, test files of both sides left out, builtin leaves dropped."""
    types = g.symbols.where(F.col("kind").isin("class", "module", "interface", "type", "struct", "trait"))
    child = g.symbols.where("parent_id is not null").select(F.col("symbol_id").alias("child"), "parent_id")
    direct = g.edges.select("target_id", "file_id")
    through = direct.join(child, direct.target_id == child.child).select(F.col("parent_id").alias("target_id"), "file_id")
    tests = g.files.where(paths.dead_sql_test(F.col("path"))).select("file_id")
    reached = direct.unionByName(through).join(tests, "file_id", "left_anti").distinct().groupBy("target_id").agg(F.count("*").alias("reach"))
    s = types.join(g.files.select("file_id", "path"), "file_id").where(F.col("path").startswith(prefix) & ~paths.dead_sql_test(F.col("path")) & ~text.is_synthetic(F.col("qualified")))
    out = s.join(reached, s.symbol_id == reached.target_id).where(~text.leaf(F.col("qualified")).isin(*exclude))
    return out.orderBy(F.desc("reach"), "symbol_id").limit(limit).select("symbol_id", "qualified", "kind", "path", "reach")


def top_callers(g: Graph, targets: DataFrame, n: int = 3) -> DataFrame:
    """O-W7: at most n callers of each target, by qualified name."""
    calls = g.edges.where("kind = 'calls'").join(targets.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id").distinct()
    named = calls.join(g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("qualified").alias("caller")), "source_id")
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("target_id").orderBy("caller", "source_id")))
    return ranked.where(F.col("rank") <= n).select("target_id", "caller", "rank")


def coupling(g: Graph, least: int = 3, limit: int = 5, domain: str = "") -> DataFrame:
    """O-A9, O-C10: symbols outside the domain by the distinct sources inside that depend on them."""
    side = lambda n: g.symbols.select(F.col("symbol_id").alias(f"{n}_id"), F.col("file_id").alias(f"{n}_file"), F.col("qualified").alias(n)).join(g.files.select(F.col("file_id").alias(f"{n}_file"), F.col("path").alias(f"{n}_path")), f"{n}_file")
    joined = g.edges.where(F.col("kind").isin(*FOLLOWED["coupling"])).select("source_id", "target_id").join(side("source"), "source_id").join(side("target"), "target_id")
    inside = F.col("source_path").contains(domain) & ~F.col("target_path").contains(domain)
    counts = joined.where(inside).select("target", "source_id").distinct().groupBy(F.col("target").alias("qualified")).agg(F.count("*").alias("sources"))
    return counts.where(F.col("sources") >= least).orderBy(F.desc("sources"), "qualified").limit(limit)


def occurrences(g: Graph, names: DataFrame) -> DataFrame:
    """O-A10: for each name, symbols of that name plus edges to such symbols."""
    wanted = g.symbols.select("symbol_id", "name").join(names.select("name").distinct(), "name", "left_semi")
    per_symbol = in_degree(g.edges)
    return wanted.join(per_symbol, "symbol_id", "left").groupBy("name").agg((F.count("*") + F.sum(F.coalesce("in_degree", F.lit(0)))).alias("occurrences"))


def representatives(g: Graph) -> DataFrame:
    """O-A15: a file's class-level symbol first, then the most connected, then the smallest id."""
    s = g.symbols.select("symbol_id", "file_id", "kind").join(total_degree(g.edges), "symbol_id", "left")
    best = F.min(F.struct(F.when(F.col("kind").isin(*CONTAINERS), 0).otherwise(1).alias("c"), (-F.coalesce("degree", F.lit(0))).alias("d"), "symbol_id"))["symbol_id"]
    return s.groupBy("file_id").agg(best.alias("symbol_id"))


def satisfiers(g: Graph) -> DataFrame:
    """O-A17: per interface the distinct symbols, not interfaces, that inherit from it; counted before targets are looked up."""
    kinds = g.symbols.select("symbol_id", "kind")
    source = kinds.where("kind <> 'interface'").select(F.col("symbol_id").alias("source_id"))
    target = kinds.where("kind = 'interface'").select(F.col("symbol_id").alias("interface_id"))
    pairs = g.edges.where("kind = 'inherits'").select("source_id", "target_id").distinct().join(source, "source_id", "left_semi")
    return pairs.groupBy(F.col("target_id").alias("interface_id")).agg(F.count("*").alias("satisfiers")).join(target, "interface_id", "left_semi")


def minimum_key(g: Graph) -> DataFrame:
    """O-A16: per source the smallest interface it inherits from, and the smallest child that leads to it."""
    return g.edges.where("kind = 'inherits'").groupBy("source_id").agg(F.min("target_id").alias("via"))


def profile(g: Graph) -> DataFrame:
    """O-A18: totals, density, primary language, and the size tier; dynamic languages over half make it a large project sooner."""
    lang = languages(g)
    dynamic = F.col("language").isin("ruby", "python", "javascript", "typescript", "php")
    a = lang.agg(F.sum("files").alias("files"), F.sum("symbols").alias("symbols"), F.min(F.struct(-F.col("symbols"), F.col("language").alias("l")))["l"].alias("primary_language"), F.sum(F.when(dynamic, F.col("symbols")).otherwise(0)).alias("dyn")).withColumn("one", F.lit(1))
    e = g.edges.agg(F.count("*").alias("edges")).withColumn("one", F.lit(1))
    out = a.join(e, "one").withColumn("dynamic", 2 * F.col("dyn") > F.col("symbols"))
    tier = F.when(F.col("symbols") < 3000, "small").when(F.col("symbols") >= F.when(F.col("dynamic"), 15000).otherwise(20000), "large").otherwise("medium")
    return out.select("files", "symbols", "edges", F.round(F.col("edges") / F.greatest("symbols", F.lit(1)), 6).alias("density"), "primary_language", "dynamic", tier.alias("tier"))


def counters(events: DataFrame) -> DataFrame:
    """O-A19: usage counters from an event log."""
    return events.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("value"))


def orphans(g: Graph) -> DataFrame:
    """O-A20: edges of which an end doesn't exist (a NULL source is none). Distinct ends are looked up first, then the edges of those that are lost."""
    target, source = (g.edges.select(F.col(end).alias("symbol_id")).distinct() for end in ("target_id", "source_id"))
    lost = settle(target.unionByName(source).distinct().join(g.symbols.select("symbol_id"), "symbol_id", "left_anti").where("symbol_id is not null"), "lost")
    e = g.edges.select("source_id", "target_id", "kind")
    at, by = lost.withColumnRenamed("symbol_id", "target_id"), lost.withColumnRenamed("symbol_id", "source_id")
    placed = e.where("target_id is not null").join(at, "target_id", "left_anti").join(by, "source_id", "left_semi")
    return stacked([x.select("source_id", "target_id", "kind") for x in (e.join(at, "target_id", "left_semi"), placed, e.where("target_id is null"))])


def fingerprint(files: DataFrame) -> DataFrame:
    """O-A21: f<files>@<latest indexing>."""
    return files.agg(F.format_string("f%d@%s", F.count("*"), F.coalesce(F.date_format(F.max("indexed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))).alias("fingerprint"))


def areas(callers: DataFrame) -> DataFrame:
    """O-A22: callers per directory of their file."""
    return callers.groupBy(paths.area(F.col("path")).alias("area")).agg(F.count("*").alias("callers"))


def latency(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """O-A23: p50, p95, p99 by the element at floor(p * n) (the last at most) of the sorted values, from counts per value."""
    counts = df.groupBy(*keys, value.alias("v")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys)
    cum = counts.select(*keys, "v", F.sum("c").over(w.orderBy("v")).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1), F.col("v")))
    return cum.groupBy(*keys).agg(at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def edge_census(edges: DataFrame) -> DataFrame:
    """O-S15: edges by kind with distinct ends and mean confidence."""
    per = edges.groupBy("kind").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return per.join(edges.select("kind", "target_id").distinct().groupBy("kind").agg(F.count("*").alias("targets")), "kind")


def containers(g: Graph) -> DataFrame:
    """O-S15: containers with their path, in (qualified, path, line, id) order."""
    c = g.symbols.where(F.col("kind").isin(*CONTAINERS)).join(g.files.select("file_id", "path"), "file_id", "left")
    return c.select("symbol_id", "qualified", F.coalesce("path", F.lit("")).alias("path"), "line_start").orderBy("qualified", "path", "line_start", "symbol_id")


def query(symbols: DataFrame, name: str = "", kind: str = "", file_id: int = 0, limit: int = -1) -> DataFrame:
    """O-S14: optional predicates, by id; limit below zero is all."""
    for column, wanted in (("name", name), ("kind", kind), ("file_id", file_id)):
        if wanted:
            symbols = symbols.where(F.col(column) == wanted)
    out = symbols.orderBy("symbol_id")
    return out if limit < 0 else out.limit(limit)


def reopenings(symbols: DataFrame) -> DataFrame:
    """O-J11: symbols that share qualified name and kind with another: counts per group and the first id."""
    return symbols.groupBy("qualified", "kind").agg(F.count("*").alias("n"), F.min("symbol_id").alias("first_id")).where("n > 1")


def family(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """O-J3: children and parents of ids, with the relation."""
    wanted = ids.select(F.col("symbol_id").alias("of")).distinct()
    children = symbols.join(wanted, symbols.parent_id == F.col("of")).select("of", "symbol_id", F.lit("child").alias("relation"))
    parents = symbols.join(wanted, symbols.symbol_id == F.col("of")).where("parent_id is not null").select("of", F.col("parent_id").alias("symbol_id"), F.lit("parent").alias("relation"))
    return children.unionByName(parents)


def composers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """O-J12: distinct sources of composes edges into ids."""
    wanted = ids.select(F.col("symbol_id").alias("target_id"))
    return edges.where("kind = 'composes' and source_id is not null").join(wanted, "target_id", "left_semi").select(F.col("source_id").alias("symbol_id")).distinct()


def inbound(g: Graph, ids: DataFrame) -> DataFrame:
    """O-J2, O-S13: inbound edges with their source; a NULL source is kept, as id 0 and an empty name."""
    wanted = ids.select(F.col("symbol_id").alias("target_id"))
    s = g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("qualified").alias("source"))
    e = g.edges.join(wanted, "target_id", "left_semi").join(s, "source_id", "left")
    return e.select("target_id", F.coalesce("source_id", F.lit(0)).cast("long").alias("source_id"), F.coalesce("source", F.lit("")).alias("source"), "kind", "confidence")


def overlapping(symbols: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """O-J9: symbols whose lines meet changed ranges (path, start, end) of their file; an end before its start counts as the start."""
    s = symbols.join(files.select("file_id", "path"), "file_id")
    last = F.greatest("line_end", "line_start")
    return s.join(ranges, (s.path == ranges.path) & (ranges.start <= last) & (F.col("line_start") <= ranges.end)).select("symbol_id").distinct()
