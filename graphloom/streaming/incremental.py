"""Streams and incremental maintenance (O-I rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.model import Graph
from graphloom.operators import store

#: A change feed's rows: path, op (changed or removed), ts.
FEED = "path string, op string, ts timestamp"


def batches(feed: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """O-I2: changed and removed paths of every burst: a session window over all paths, closed by a quiet gap. A path that was changed isn't removed.

    The single key is what the operation is: one burst is one batch. Its state holds each path's last operation only.
    """
    last = feed.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), F.lit(1).alias("all")).agg(F.collect_set(F.when(F.col("op") == "changed", F.col("path"))).alias("changed"), F.collect_set(F.when(F.col("op") == "removed", F.col("path"))).alias("gone"))
    return last.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.sort_array("changed").alias("changed"), F.sort_array(F.array_except("gone", "changed")).alias("removed"))


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """O-I2 per key: sessions by event time."""
    w = events.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("started"))
    return w.select(key, "started", "events")


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """O-I10: counts and sums per window and type; late is the watermark of a stream."""
    df = events.withWatermark("ts", late) if late else events
    out = df.groupBy(F.window(F.col("ts"), size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("started"), "event_type", "events", "total")


def last_operations(feed: DataFrame) -> DataFrame:
    """O-I3: path, op: what happened last to every path. feed: path, op, ts."""
    return feed.groupBy("path").agg(F.max_by("op", "ts").alias("op"))


def follow(feed: DataFrame, apply: Callable[[list[str], list[str]], None], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """O-I1, O-I3: each micro-batch's last operation per path goes to apply(changed, removed); Spark's checkpoint keeps one writer and restarts (O-I8).

    A micro-batch is a burst of editing: its paths are few, which is what reaches the driver.
    """

    def run(df: DataFrame, _: int) -> None:
        last = last_operations(df).collect()
        if last:
            apply(sorted(r.path for r in last if r.op == "changed"), sorted(r.path for r in last if r.op == "removed"))

    writer = feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def applied(g: Graph, changed: Graph, removed: DataFrame) -> Graph:
    """O-I4, T18: a file's rows are replaced whole: all rows of removed and changed paths go, those of changed files come in."""
    gone = g.files.join(removed.select("path").unionByName(changed.files.select("path")).distinct(), "path", "left_semi")
    left = store.delete_files(g, gone)
    return Graph(left.files.unionByName(changed.files), left.symbols.unionByName(changed.symbols), left.edges.unionByName(changed.edges), g.meta, left.embeddings)


def branch_switch(status: DataFrame) -> DataFrame:
    """O-I5: path, op of `git diff --name-status` lines; a rename removes one path and changes another. status: line."""
    parts = F.split("line", "\t")
    code = F.substring(F.get(parts, 0), 1, 1)
    ops = F.when(code == "R", F.array(F.struct(F.get(parts, 1).alias("path"), F.lit("removed").alias("op")), F.struct(F.get(parts, 2).alias("path"), F.lit("changed").alias("op")))).otherwise(F.array(F.struct(F.get(parts, 1).alias("path"), F.when(code == "D", "removed").otherwise("changed").alias("op"))))
    return status.where("line <> ''").select(F.inline(ops))


def drifted(listing: DataFrame, tracked: DataFrame) -> DataFrame:
    """O-I6: listed files modified after they were indexed, or not indexed at all. listing: path, modified; tracked: path, indexed_at."""
    joined = listing.join(tracked.select("path", "indexed_at"), "path", "left")
    return joined.where(F.col("indexed_at").isNull() | (F.col("modified") > F.col("indexed_at")))


def repair(count: int) -> str:
    """O-I6: what to do about so many drifted files (fixed limits)."""
    return "none" if count == 0 else "inline" if count <= 8 else "reconcile" if count <= 64 else "report"


def freshness(listing: DataFrame, tracked: DataFrame) -> DataFrame:
    """O-I7: stale files, files, newest change and oldest indexing."""
    stale = drifted(listing, tracked).agg(F.count("*").alias("stale")).withColumn("one", F.lit(1))
    seen = listing.agg(F.count("*").alias("files"), F.max("modified").alias("newest")).withColumn("one", F.lit(1))
    done = tracked.agg(F.min("indexed_at").alias("indexed_at")).withColumn("one", F.lit(1))
    return stale.join(seen, "one").join(done, "one").drop("one")


def deferred_vectors(symbols: DataFrame, embeddings: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """O-I9: embeddings with those that were owed."""
    owed = symbols.join(store.debt(symbols, embeddings), "symbol_id", "left_semi")
    return embeddings.unionByName(embed(owed))
