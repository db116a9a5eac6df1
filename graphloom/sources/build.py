"""From source files to a graph: extraction, ids, parents, resolution, derived edges (O-R11 and the index build as a whole)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.shared import settle
from graphloom.model import Graph
from graphloom.operators import derive, store
from graphloom.sources import extractors, manifests


@dataclass(frozen=True)
class Index:
    """The graph with what the dead-code rules ask: harvested names, frameworks; and files that could not be read."""

    graph: Graph
    names: DataFrame
    frameworks: DataFrame
    failures: DataFrame


def _id(*columns: str):
    """Ids are hashes of natural keys: equal in every run, and no ordering is needed to give them."""
    return F.xxhash64(*columns)


def build(files: DataFrame, commits: DataFrame | None = None) -> Index:
    """files: path, content (and length, modified if known). commits: commit_id, path for co-change edges."""
    files = files.withColumn("file_id", _id("path"))
    found = settle(extractors.extract(files), "extracted")
    listing = files.select("file_id", "path", store.content_hash(F.col("content").cast("binary")).alias("hash"), (F.col("modified") if "modified" in files.columns else F.current_timestamp()).cast("timestamp").alias("indexed_at"))
    known = listing.join(found.select("file_id", "language", F.size("symbols").alias("n_symbols")), "file_id")
    rows = extractors.symbols(found).withColumn("symbol_id", _id("file_id", "qualified"))
    first = F.struct("line_start", "line_end", "kind", "name", "visibility", "parent", "docstring", "snippet")
    one = rows.groupBy("symbol_id", "file_id", "qualified").agg(F.min(first).alias("r")).select("symbol_id", "file_id", "qualified", "r.*")
    symbols = settle(one.withColumn("parent_id", F.lit(None).cast("long")).withColumn("name_parts", text.name_parts(F.col("name"), F.col("qualified"))), "symbols")
    bare = Graph(known, symbols, store.empty(files.sparkSession).edges)
    links = derive.parent_links(symbols.where("parent is not null").select("symbol_id", "file_id", F.col("parent").alias("parent_qualified")), bare)
    symbols = settle(symbols.drop("parent_id").join(links, "symbol_id", "left"), "symbols")
    known = settle(known, "files")
    g = Graph(known, symbols, bare.edges)

    raw = extractors.edges(found).withColumn("edge_no", _id("path", "source", "target", "kind", "line"))
    owner = symbols.select("file_id", F.col("qualified").alias("source"), F.col("symbol_id").alias("source_id"), F.coalesce("parent", F.lit("")).alias("source_parent"))
    pending = raw.join(owner, ["file_id", "source"], "left").select(
        "edge_no", "source_id", F.col("file_id").alias("source_file_id"), F.coalesce("source", F.lit("")).alias("source_qualified"), F.coalesce("source_parent", F.lit("")).alias("source_parent"), "target", "kind", F.col("confidence").alias("base"), F.lit("").alias("receiver"), "line"
    )
    pending = settle(pending.dropDuplicates(["edge_no"]), "pending")

    def written(resolved: DataFrame) -> DataFrame:
        return resolved.join(pending.select("edge_no", "line"), "edge_no").select("source_id", "target_id", "kind", "file_id", "line", "confidence", F.lit(None).cast("int").alias("co_changes"))

    types = settle(written(derive.resolve(g, pending.where(F.col("kind").isin("inherits", "includes", "composes")).drop("line"))), "edges")
    closure = derive.ancestry(Graph(known, symbols, types))
    rest = written(derive.resolve(g, pending.where(~F.col("kind").isin("inherits", "includes", "composes")).drop("line"), closure))
    edges = settle(types.unionByName(rest), "edges")
    g = Graph(known, symbols, edges)

    go = symbols.join(known.where("language = 'go'").select("file_id"), "file_id", "left_semi")
    methods = go.where("kind = 'method' and parent_id is not null").withColumn("a", text.arity(F.col("snippet"))).select(F.col("parent_id").alias("owner_id"), "name", "a.params", "a.results", "a.known")
    embeds = edges.where("kind = 'includes'").select(F.col("source_id").alias("outer_id"), F.col("target_id").alias("inner_id"))
    satisfied = derive.satisfaction(methods, embeds, go.where("kind in ('class', 'interface', 'type')").select("symbol_id", "kind"))
    satisfied = satisfied.join(symbols.select(F.col("symbol_id").alias("struct_id"), "file_id"), "struct_id").select(F.col("struct_id").alias("source_id"), F.col("interface_id").alias("target_id"), "kind", "file_id", "confidence")
    more = [satisfied, derive.test_pairs(g), derive.naming_edges(g), derive.mixins(g)]
    every = edges
    for m in more:
        every = every.unionByName(m.withColumn("line", F.lit(None).cast("int")).withColumn("co_changes", F.lit(None).cast("int")))
    if commits is not None:
        every = every.unionByName(derive.temporal(g, commits).withColumn("line", F.lit(None).cast("int")))
    best = F.max(F.struct("confidence", "line", "co_changes"))
    keyed = every.where("source_id is not null").groupBy("source_id", "target_id", "kind", "file_id").agg(best.alias("b")).select("source_id", "target_id", "kind", "file_id", "b.line", "b.confidence", "b.co_changes")
    every = keyed.unionByName(every.where("source_id is null").select(keyed.columns))
    every = every.withColumn("edge_id", _id("source_id", "target_id", "kind", "file_id", "line"))
    return Index(Graph(known, symbols, settle(every, "edges")), settle(extractors.names(found), "names"), manifests.frameworks(files), extractors.failures(found))


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, max_kb: int = 512, commits: DataFrame | None = None) -> Index:
    return build(manifests.tree(spark, root, rules, max_kb), commits)
