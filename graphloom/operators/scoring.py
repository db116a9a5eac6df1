"""Benchmark scores (O-X rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed weights.
WEIGHTS = {"keyword": 0.10, "judge": 0.55, "grounding": 0.15, "efficiency": 0.20}


def fairness(rows: DataFrame) -> DataFrame:
    """O-X1: the weighted sum; null without a judge's score."""
    return rows.withColumn("score", F.round(sum((F.lit(w) * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0)), 6))


def gold(claimed: DataFrame, wanted: DataFrame) -> DataFrame:
    """O-X2: precision, recall and F1 of claimed files per task."""
    both = claimed.distinct().withColumn("c", F.lit(1)).join(wanted.distinct().withColumn("g", F.lit(1)), ["task", "file"], "full")
    n = both.groupBy("task").agg(F.count_if(F.col("c").isNotNull() & F.col("g").isNotNull()).alias("hit"), F.count("c").alias("claimed"), F.count("g").alias("gold"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return n.select("task", share(F.col("hit"), F.col("claimed")).alias("precision"), share(F.col("hit"), F.col("gold")).alias("recall"), share(2 * F.col("hit"), F.when(F.col("hit") > 0, F.col("claimed") + F.col("gold")).otherwise(0)).alias("f1"))


def grounding(cited: DataFrame, listing: DataFrame) -> DataFrame:
    """O-X3: citations (task, path, line) whose file exists and has the line."""
    joined = cited.join(listing, "path", "left")
    return joined.groupBy("task").agg(F.count("*").alias("citations"), F.count_if(F.col("lines").isNotNull() & F.col("line").between(1, F.col("lines"))).alias("grounded"))


def variance(rows: DataFrame, digits: int = 6) -> DataFrame:
    """O-X4: runs, mean and sample deviation per scenario."""
    return rows.groupBy("scenario").agg(F.count("*").alias("runs"), F.round(F.avg("score"), digits).alias("mean"), F.round(F.stddev_samp("score"), digits).alias("deviation"))
