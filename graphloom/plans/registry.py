"""Registered queries of the analytics engine and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as gr
from graphloom.plans import cases_core, cases_fixture, cases_graph, cases_more, cases_source, cases_text
from graphloom.sources import projection

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (cases_core, cases_graph, cases_fixture, cases_text, cases_more, cases_source):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who uses each interface and function, by kind, with counts and confidence."""
    g = projection.graph(spark, sf_dir)
    roots = g.symbols.where(F.col("kind").isin("interface", "function")).select("symbol_id")
    return gr.categories(gr.neighbourhood(g, roots, "callers"))
