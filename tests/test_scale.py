"""What a query must not do as tables grow: caps, stored pairs, collected rows, work dealt to a few tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import aggregates, blast, conventions, dead, derive, graph, search, store, vector
from graphloom.plans import cases_core, cases_more, cases_source
from graphloom.sources import projection

SYMBOLS = "symbol_id long, file_id long, name string, qualified string, kind string, visibility string, parent_id long, line_start int, line_end int"
EDGES = "source_id long, target_id long, kind string, file_id long, confidence double"
SF = "/root/testdata/sf0.001"


def make(spark, symbols, edges, files=((1, "a.go", "go"),)):
    s = spark.createDataFrame(symbols, "symbol_id long, kind string, name string, parent_id long")
    s = s.select("symbol_id", F.lit(1).cast("long").alias("file_id"), "name", F.col("name").alias("qualified"), "kind", F.lit("public").alias("visibility"), "parent_id", F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    e = spark.createDataFrame(edges, "source_id long, target_id long, kind string").withColumns({"file_id": F.lit(1).cast("long"), "confidence": F.lit(1.0)})
    return Graph(spark.createDataFrame(list(files), "file_id long, path string, language string"), s, e)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def fresh(monkeypatch):
    """A store without graphs, and the names of what is written."""
    names, real = [], projection.settle
    monkeypatch.setattr(projection, "_STORED", {})
    monkeypatch.setattr(projection, "settle", lambda df, name: names.append(name) or real(df, name))
    return names


def test_files_alone_are_stored(spark, fresh):
    """a question about files doesn't write symbols and edges."""
    assert cases_core.QUERIES["S12_stale"](spark, SF).count() and fresh == ["files"]


def test_symbols_without_edges(spark, fresh):
    """nor does one about symbols, F24: nor one about the variant's symbols."""
    assert cases_more.QUERIES["A13_distinct_files"](spark, SF).count() and "files" in fresh and set(fresh) <= {"files", "symbols"}
    assert cases_more.QUERIES["H1_entry_points"](spark, SF).count() and set(fresh) <= {"files", "symbols"}


def test_pairs_are_not_stored(spark, fresh):
    """pairs of customers and suppliers are neither written with the graph nor by a traversal."""
    cases_more.QUERIES["G16_choice"](spark, SF).count()
    assert "edges" not in fresh and {"calls", "chain", "uses"} <= set(fresh)


def test_carriers_have_no_cap(spark):
    """neither the number of carriers nor the level is cut."""
    n = 2100
    wide = make(spark, [(i, "class", f"C{i}", None) for i in range(1, n + 1)], [(i, 1, "composes") for i in range(2, n + 1)])
    assert blast.carriers(wide, wide.symbols.where("symbol_id = 1")).count() == n
    deep = make(spark, [(i, "class", f"C{i}", None) for i in range(1, 25)], [*((i + 1, i, "composes") for i in range(1, 24)), (1, 24, "composes")])
    assert blast.carriers(deep, deep.symbols.where("symbol_id = 1")).agg(F.max("level")).first()[0] == 23


def test_dispatch_leaves_out_bases_without_methods(spark, monkeypatch):
    """pairs are made for bases with methods alone."""
    rows, real = {}, graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: rows.setdefault(name, df.collect()) and False or real(df, name))
    symbols = [(1, "class", "A", None), (2, "interface", "I", None), (3, "interface", "J", None), (4, "method", "m", 1), (5, "method", "m", 2)]
    g = make(spark, symbols, [(1, 2, "inherits"), (1, 3, "inherits"), (1, 3, "inherits")])
    assert [tuple(r) for r in graph.dispatch(g).collect()] == [(4, 5)]
    assert [tuple(r) for r in rows["bases"]] == [(2,)]


def test_upsert_deals_rows_out_once(spark):
    """old and new rows meet in one aggregate; duplicates of old, NULL keys and the newest version stay as they were."""
    schema = "symbol_id long, file_id long, qualified string, name string"
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "y"), (3, 1, "b", "z"), (4, 1, None, "n")], schema)
    new = spark.createDataFrame([(9, 1, "a", "new", 2), (8, 1, "a", "old", 1), (7, 1, "c", "more", 1), (6, 1, None, "null", 1)], schema + ", version int")
    out = store.upsert(old, new, store.SYMBOL_KEY, "symbol_id", version="version")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, "a", "new"), (2, 1, "a", "new"), (3, 1, "b", "z"), (4, 1, None, "n"), (7, 1, "c", "more"), (6, 1, None, "null")], key=str)
    assert "Join" not in plan(out)


def test_sources_are_dealt_out(spark, tmp_path):
    """many files of a small table are read in many tasks."""
    spark.range(5000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = cases_source.sources(spark, str(tmp_path), *cases_source.TEMPLATES)
    assert files.rdd.getNumPartitions() >= 3 and files.count() == 5000 * len(cases_source.TEMPLATES)


def test_pairs_stay_where_their_source_lies(spark):
    """pairs are counted without being shuffled."""
    g = projection.graph(spark, SF)
    out = aggregates.satisfiers(g)
    assert out.count() and "hashpartitioning(source_id" not in plan(out)


def test_orphans_look_up_distinct_ends(spark):
    """edges themselves aren't joined with the symbols."""
    g = make(spark, [(1, "class", "A", None), (2, "class", "B", None)], [(1, 2, "calls"), (1, 3, "calls"), (4, 2, "calls"), (4, 3, "calls"), (None, 2, "tests"), (None, 3, "tests")])
    out = aggregates.orphans(g)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, 3, "calls"), (4, 2, "calls"), (4, 3, "calls"), (None, 3, "tests")]))
    assert "SortMergeJoin" not in plan(out)


def test_candidates_meet_distinct_targets(spark, monkeypatch):
    """an anti-join holds each target once."""
    rows, real = {}, dead.settle
    monkeypatch.setattr(dead, "settle", lambda df, name: (rows.setdefault(name, df.count()), real(df, name))[1])
    g = make(spark, [(1, "class", "A", None), (2, "class", "B", None)], [(1, 2, "calls")] * 50)
    out = dead.candidates(g)
    assert [r.symbol_id for r in out.collect()] == [1]
    assert rows == {"targets": 1}


def test_ancestry_writes_inner_pairs_alone(spark, monkeypatch):
    """pairs whose ancestor has no ancestors are never written."""
    rows, real = [], derive.settle
    monkeypatch.setattr(derive, "settle", lambda df, name: (rows.append((name, df.count())), real(df, name))[1])
    g = make(spark, [(1, "class", "A", None)], [*((i, 100 + j, "inherits") for i in range(10) for j in range(10)), (200, 201, "inherits"), (201, 202, "includes"), (202, 200, "inherits")])
    found = {(r.symbol_id, r.ancestor_id): r.depth for r in derive.ancestry(g).collect()}
    assert len(found) == 106 and found[200, 202] == 2 and found[3, 107] == 1
    assert max(n for name, n in rows if name != "ids") <= 6


def test_neighbourhood_by_parts(spark):
    """the pairs' own side is joined where it lies; an edge is shuffled for neither end of few ids."""
    g = projection.graph(spark, SF)
    kin = Graph(g.files, g.symbols, lambda: [e for e in g.parts if e.where("kind = 'inherits'").limit(1).count()])
    text = plan(graph.neighbourhood(kin, kin.symbols))
    assert "SortMergeJoin [target_id" not in text and "hashpartitioning(target_id" not in text


def test_examples_are_gathered_for_readers_alone(spark):
    """without examples asked for, no rank is made."""
    found = conventions.inheritance(projection.graph(spark, SF))
    assert "Window" in plan(found) and "Window" not in plan(found.select("description", "instances", "total"))


def test_mixins_shuffle_lists(spark):
    """pairs are made after the exchange."""
    symbols = [(1, "class", "A", None), (2, "function", "m", None), (3, "class", "P", None)]
    g = make(spark, symbols, [(1, 2, "calls"), (2, 3, "composes"), (2, 1, "composes")])
    out = derive.mixins(g)
    assert [(r.source_id, r.target_id) for r in out.collect()] == [(1, 3)]
    text = plan(out)
    assert text.index("Generate explode") < text.index("REPARTITION_BY_NUM") and "Exchange" not in text.split("Generate explode")[0]


def test_contexts_cut_each_part_before_they_meet(spark):
    """lists are cut where the pairs lie."""
    g = projection.graph(spark, SF)
    assert plan(search.context(g)).count("Window") > 1


def test_queries_stay_in_the_tasks(spark, monkeypatch):
    """no query reaches the driver, and results are those of brute force, ties by id."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    calls, real = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (calls.append(1), real(self))[1])
    out = vector.nearest_all(df, df.where("vec_id % 7 = 0"), "vec_id", "embedding", 5, block=4)
    assert not calls
    monkeypatch.undo()
    got = {(r.query, r["rank"]): r.id for r in out.collect()}
    y = x.astype(np.float32).astype(np.float64)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    assert got == {(q, k + 1): int(i) for q in range(0, 60, 7) for k, i in enumerate(np.lexsort((np.arange(60), -sim[q]))[:5])}
