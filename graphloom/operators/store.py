"""The graph store: keyed upserts, cascading deletes, versions, lookups (O-S5, O-S8 to S17, O-I4)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions.shared import settle, stacked
from graphloom.model import Graph, replace

FILE_KEY, SYMBOL_KEY, EDGE_KEY = ("path",), ("file_id", "qualified"), ("source_id", "target_id", "kind", "file_id")


def newest(df: DataFrame, key: tuple[str, ...], version: str, null_bypass: str | None = None) -> DataFrame:
    """One row per key, that of the largest version (ties by the row itself). Rows whose null_bypass column is null never collide."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df if null_bypass is None else df.where(F.col(null_bypass).isNotNull())
    kept = keyed.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("v"), row.alias("r")))["r"].alias("r")).select("r.*")
    return kept if null_bypass is None else kept.unionByName(df.where(F.col(null_bypass).isNull()))


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...], id_column: str, null_bypass: str | None = None, version: str | None = None) -> DataFrame:
    """O-S8 to S10: rows of new replace those of old with the same key and keep the old id.

    Of rows of new with one key that of the largest version wins, ties (and all, without a version column) by the largest row: no order
    of partitions counts. The version column isn't stored unless old has it.
    """
    at = F.lit(0) if version is None else F.col(version)
    rest = [c for c in old.columns if c not in key]
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))  # NULL keys never meet
    keyed = F.lit(True) if null_bypass is None else F.col(null_bypass).isNotNull()
    packed = lambda df: df.select(*key, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"))
    kept = packed(old.where(whole & keyed))
    rows = F.struct(*(F.col(f"`{c}`") for c in new.columns))
    named = new.select(*key, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.struct(at.alias("v"), rows.alias("r")).alias("_at")).where(whole & keyed)
    # Old and new rows meet in one aggregate: each is dealt out once, or not at all if both lie by a part of the key already.
    met = kept.select(*key, F.col("_row").alias("_old"), F.lit(None).cast(named.schema["_row"].dataType).alias("_row"), F.lit(None).cast(named.schema["_at"].dataType).alias("_at"))
    met = met.unionByName(named.select(*key, F.lit(None).cast(kept.schema["_row"].dataType).alias("_old"), "_row", "_at"))
    met = met.groupBy(*key).agg(F.collect_list("_old").alias("_old"), F.max(F.when(F.col("_at").isNotNull(), F.struct("_at", "_row")))["_row"].alias("_row"))
    mine = lambda x: F.col("_row").withField(id_column, F.coalesce(x[id_column], F.col(f"_row.{id_column}")))
    many = F.when(F.col("_row").isNull(), F.col("_old")).when(F.size("_old") == 0, F.array("_row")).otherwise(F.transform("_old", mine))
    out = met.select(*key, F.inline(many)).select(*old.columns)
    loose = newest(new.where(~whole & keyed).withColumn("_at", at), key, "_at").unionByName(new.where(~keyed).withColumn("_at", at))
    return out.unionByName(old.where(~(whole & keyed))).unionByName(loose.select(*old.columns))


def upsert_files(g: Graph, rows: DataFrame, version: str | None = None) -> Graph:
    return replace(g, files=upsert(g.files, rows, FILE_KEY, "file_id", version=version))


def upsert_symbols(g: Graph, rows: DataFrame, version: str | None = None) -> Graph:
    return replace(g, symbols=upsert(g.symbols, rows, SYMBOL_KEY, "symbol_id", version=version))


def upsert_edges(g: Graph, rows: DataFrame, version: str | None = None) -> Graph:
    """The kind is part of the key, so kinds are upserted one by one, each in the layout of its own tables."""
    other = ~F.coalesce(F.col("kind").isin(*model.EDGE_KINDS), F.lit(False))
    put = lambda when: upsert(g.edges.where(when), rows.where(when), EDGE_KEY, "edge_id", "source_id", version)
    parts = [put(F.col("kind") == k).withColumn("kind", F.lit(k)) for k in model.EDGE_KINDS]
    return replace(g, edges=stacked([*parts, put(other)]))


def delete_files(g: Graph, gone: DataFrame) -> Graph:
    """O-S11: files with their symbols, edges and vectors; children elsewhere lose their parent."""
    ids = gone.select("file_id").distinct()
    dead = g.symbols.join(ids, "file_id", "left_semi").select("symbol_id")
    symbols = g.symbols.join(ids, "file_id", "left_anti").select(*g.symbols.columns)
    lost = dead.select(F.col("symbol_id").alias("parent_id"), F.lit(True).alias("_lost"))
    symbols = symbols.join(lost, "parent_id", "left").withColumn("parent_id", F.when(F.col("_lost").isNull(), F.col("parent_id"))).select(*g.symbols.columns)
    edges = g.edges.join(ids, "file_id", "left_anti")
    for end in ("source_id", "target_id"):
        edges = edges.join(dead.withColumnRenamed("symbol_id", end), end, "left_anti")
    vectors = g.embeddings and g.embeddings.join(dead, "symbol_id", "left_anti")
    return replace(g, files=g.files.join(ids, "file_id", "left_anti").select(*g.files.columns), symbols=symbols, edges=edges.select(*g.edges.columns), embeddings=vectors)


def stale(tracked: DataFrame, seen: DataFrame) -> DataFrame:
    """O-S12: tracked files that this scan didn't see."""
    return tracked.join(seen.select("path").distinct(), "path", "left_anti")


def content_hash(content: Column) -> Column:
    """O-S5, O-P20: the first eight bytes of SHA-256, in hex."""
    return F.substring(F.sha2(content, 256), 1, 16)


def changed(listing: DataFrame, tracked: DataFrame) -> DataFrame:
    """O-S5: files whose (path, hash) isn't tracked."""
    return listing.join(tracked.select("path", "hash"), ["path", "hash"], "left_anti")


def names(meta: DataFrame, key: str) -> DataFrame:
    """O-S16: the names of a JSON set."""
    return meta.where(F.col("key") == key).select(F.explode(F.from_json("value", "array<string>")).alias("name"))


def union_names(meta: DataFrame, new: DataFrame) -> DataFrame:
    """O-S16, O-R18: key, name rows joined into the JSON sets."""
    old = meta.select("key", F.explode(F.from_json("value", "array<string>")).alias("name"))
    every = old.unionByName(new.select("key", "name")).distinct()
    return every.groupBy("key").agg(F.to_json(F.sort_array(F.collect_list("name"))).alias("value"))


def debt(symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    """O-S17: symbols without a vector."""
    return symbols.select("symbol_id").join(embeddings.select("symbol_id"), "symbol_id", "left_anti")


def read_symbol(g: Graph, ids: DataFrame) -> DataFrame:
    """O-S13: symbols with their path and both edge lists, by edge end."""
    wanted = ids.select("symbol_id").distinct()
    out = g.edges.join(wanted.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_semi").groupBy(F.col("source_id").alias("symbol_id")).agg(F.sort_array(F.collect_list(F.struct("target_id", "kind", "confidence"))).alias("outbound"))
    into = g.edges.join(wanted.withColumnRenamed("symbol_id", "target_id"), "target_id", "left_semi").groupBy(F.col("target_id").alias("symbol_id")).agg(F.sort_array(F.collect_list(F.struct("source_id", "kind", "confidence"))).alias("inbound"))
    s = g.symbols.join(wanted, "symbol_id", "left_semi").join(g.files.select("file_id", "path"), "file_id")
    return s.join(out, "symbol_id", "left").join(into, "symbol_id", "left")


@dataclass(frozen=True)
class Versions:
    """Whole versions of a graph as Parquet folders below root; a version is current once its marker is written."""

    spark: SparkSession
    root: str

    def write(self, g: Graph, version: int) -> None:
        for name in ("files", "symbols", "edges"):
            getattr(g, name).write.parquet(f"{self.root}/v={version}/{name}")
        self.spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{self.root}/_versions")

    def latest(self) -> int:
        return self.spark.read.parquet(f"{self.root}/_versions").agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> Graph:
        v = self.latest() if version is None else version
        return Graph(*(self.spark.read.parquet(f"{self.root}/v={v}/{name}") for name in ("files", "symbols", "edges")))


def pinned(g: Graph) -> Graph:
    """The graph as tables in the shared folder: for traversals over a graph that is itself a query, which each hop would run anew."""
    return replace(g, files=settle(g.files, "files"), symbols=settle(g.symbols, "symbols"), edges=settle(g.edges, "edges"))


def empty(spark: SparkSession) -> Graph:
    made = [spark.createDataFrame([], s) for s in (model.FILES, model.SYMBOLS, model.EDGES, model.KEY_VALUES, model.EMBEDDINGS)]
    return Graph(*made)
