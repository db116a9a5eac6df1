"""The store's contract, behaviour by behaviour, and the feed across restarts."""

from datetime import datetime

import pytest

from graphloom import model
from graphloom.model import Graph
from graphloom.operators import aggregates, dead, derive, store
from graphloom.streaming import incremental

AT = datetime(2026, 1, 1)


def file(i, path, language="go", hash_="h", n=1):
    return (i, path, language, hash_, n, AT)


def symbol(i, f, name, qualified, kind="function", parent=None, doc=None, complexity=None):
    return (i, f, name, qualified, kind, "public", "", parent, 1, 9, doc, complexity, None, None)


def edge(i, source, target, kind="calls", f=1, confidence=1.0, line=None):
    return (i, source, target, kind, f, line, confidence, None)


@pytest.fixture
def empty(spark):
    return store.empty(spark)


def files(spark, *rows):
    return spark.createDataFrame(list(rows), model.FILES)


def symbols(spark, *rows):
    return spark.createDataFrame(list(rows), model.SYMBOLS)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), model.EDGES)


def test_file_round_trip(spark, empty):
    assert tuple(store.upsert_files(empty, files(spark, file(1, "a.go"))).files.first()) == file(1, "a.go")


def test_file_upsert_keeps_the_id_and_overwrites_fields(spark, empty):
    g = store.upsert_files(empty, files(spark, file(1, "a.go")))
    g = store.upsert_files(g, files(spark, file(9, "a.go", "ruby", "h2", 5)))
    assert [tuple(r) for r in g.files.collect()] == [file(1, "a.go", "ruby", "h2", 5)]


def test_upserts_go_by_version_not_by_order(spark, empty):
    rows = [(*file(k, "a.go", "go", f"h{k}"), v) for k, v in ((1, 3), (2, 9), (3, 5))]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, model.FILES + ", version int").repartition(parts)
        g = store.upsert_files(empty, df, "version")
        assert [r.hash for r in g.files.collect()] == ["h2"] and "version" not in g.files.columns


def test_symbol_round_trip_and_nulls(spark, empty):
    row = symbol(1, 1, "f", "p.f", parent=None, doc=None, complexity=None)
    assert tuple(store.upsert_symbols(empty, symbols(spark, row)).symbols.first()) == row


def test_symbol_upsert_is_idempotent(spark, empty):
    g = store.upsert_symbols(empty, symbols(spark, symbol(1, 1, "f", "p.f")))
    for _ in range(2):
        g = store.upsert_symbols(g, symbols(spark, symbol(7, 1, "f", "p.f", "method", doc="d", complexity=3)))
    assert [tuple(r) for r in g.symbols.collect()] == [symbol(1, 1, "f", "p.f", "method", doc="d", complexity=3)]


def test_equal_names_in_other_files_are_other_symbols(spark, empty):
    g = store.upsert_symbols(empty, symbols(spark, symbol(1, 1, "f", "p.f"), symbol(2, 2, "f", "p.f")))
    assert {r.symbol_id for r in g.symbols.collect()} == {1, 2}


def test_edge_round_trip(spark, empty):
    rows = [edge(1, 1, 2, line=4), edge(2, None, 2, "imports")]
    assert {tuple(r) for r in store.upsert_edges(empty, edges(spark, *rows)).edges.collect()} == set(rows)


def test_edge_upsert_is_idempotent_and_file_level_edges_never_collide(spark, empty):
    g = store.upsert_edges(empty, edges(spark, edge(1, 1, 2, confidence=0.5), edge(2, None, 2)))
    g = store.upsert_edges(g, edges(spark, edge(8, 1, 2, confidence=0.9), edge(9, None, 2)))
    assert {(r.edge_id, r.source_id, r.confidence) for r in g.edges.collect()} == {(1, 1, 0.9), (2, None, 1.0), (9, None, 1.0)}


def test_reading_what_is_not_there(spark, empty):
    g = Graph(files(spark, file(1, "a.go")), symbols(spark, symbol(1, 1, "f", "p.f")), empty.edges)
    assert store.read_symbol(g, spark.createDataFrame([(5,)], "symbol_id long")).count() == 0
    r = store.read_symbol(g, spark.createDataFrame([(1,)], "symbol_id long")).first()
    assert (r.path, r.outbound, r.inbound) == ("a.go", None, None)


def test_scans(spark, empty):
    assert aggregates.query(empty.symbols).count() == 0
    g = Graph(
        files(spark, file(1, "a.go"), file(2, "b.rb", "ruby")),
        symbols(spark, symbol(1, 1, "f", "p.f"), symbol(2, 1, "T", "p.T", "class"), symbol(3, 2, "f", "g.f", "method")), empty.edges,
    )
    ids = lambda **k: [r.symbol_id for r in aggregates.query(g.symbols, **k).collect()]
    assert ids() == [1, 2, 3] and ids(kind="class") == [2] and ids(file_id=2) == [3] and ids(name="f") == [1, 3] and ids(limit=2) == [1, 2]


def test_stored_versions_outlive_the_session_objects(spark, tmp_path):
    versions = store.Versions(spark, tmp_path.as_uri())
    g = store.empty(spark)
    versions.write(store.upsert_files(g, files(spark, file(1, "a.go"))), 1)
    versions.write(store.upsert_files(g, files(spark, file(1, "a.go"), file(2, "b.go"))), 2)
    again = store.Versions(spark, tmp_path.as_uri())
    assert again.latest() == 2 and again.read().files.count() == 2 and again.read(1).files.count() == 1


def test_a_feed_goes_on_where_it_stopped(spark, tmp_path):
    """Batches are applied once, over a restart too, and one writer holds the checkpoint."""
    feed, seen = tmp_path / "feed", []
    write = lambda name, rows: spark.createDataFrame(rows, incremental.FEED).coalesce(1).write.mode("append").parquet(str(feed))
    write("a", [("x.go", "changed", AT), ("y.go", "changed", AT), ("y.go", "removed", AT.replace(hour=1))])

    def run():
        stream = spark.readStream.schema(incremental.FEED).parquet(str(feed))
        q = incremental.follow(stream, lambda changed, removed: seen.append((changed, removed)), str(tmp_path / "checkpoint"))
        q.awaitTermination(60)
        assert q.exception() is None

    run()
    run()
    assert seen == [(["x.go"], ["y.go"])]
    write("b", [("y.go", "changed", AT.replace(hour=2))])
    run()
    assert seen[1:] == [(["y.go"], [])]


def test_shared_tables_can_be_cleaned(spark, tmp_path):
    from graphloom.functions import shared

    df = shared.settle(spark.range(3).toDF("a"), "t")
    path = df.inputFiles()[0]
    assert spark.sparkContext.applicationId in path and df.count() == 3
    assert shared.stacked([df, df]).count() == 6


def test_bulk_commits_are_dealt_and_lose_no_pair(spark):
    rows = [(c, f"d{i % 3}/f{i}.rb") for c in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "commit_id long, path string")
    for block in (1000, 7, 1):
        pairs = {(r.a, r.b): r.pairs for r in derive.co_changes(df, block=block).collect()}
        names = sorted({p for _, p in rows})
        assert pairs == {(a, b): 3 for a in names for b in names if a < b and a.split("/")[0] != b.split("/")[0]}


VOICED = [
    ("rust", "method", "add", "private", {"trait_methods"}, "rust_trait_impl"), ("rust", "function", "t", "private", {"test_symbols"}, "rust_test"), ("rust", "function", "c_api", "public", {"exports"}, "rust_ffi"), ("rust", "constant", "K", "private", {"exports"}, "rust_used"),
    ("rust", "method", "fmt", "private", set(), "rust_derive"), ("rust", "function", "open", "public", set(), "rust_pub"), ("rust", "function", "gone", "private", set(), None), ("rust", "function", "kept", "private", {"allow_dead"}, "rust_allow_dead"),
    ("typescript", "class", "View", "public", set(), "ts_exported"), ("typescript", "function", "f", "public", {"default_exports"}, "ts_default_export"), ("typescript", "method", "m", "private", set(), "ts_method"), ("typescript", "type", "T", "private", set(), "ts_type"), ("typescript", "function", "g", "private", set(), None),
    ("javascript", "function", "g", "private", set(), "js_dynamic"), ("python", "method", "__len__", "public", set(), "py_dunder"), ("python", "function", "page", "public", {"routes"}, "py_route"), ("python", "function", "_h", "private", set(), None), ("python", "constant", "LIMIT", "public", set(), "py_constant"),
    ("java", "method", "run", "public", {"annotated"}, "ls_annotated"), ("java", "method", "walk", "private", set(), None), ("php", "method", "magic", "private", set(), "ls_dynamic"), ("kotlin", "method", "m", "private", set(), "ls_unvalidated"), ("csharp", "method", "M", "public", set(), "ls_public_no_framework"),
    ("go", "function", "init", "private", set(), "go_init"), ("go", "function", "Open", "public", set(), "go_exported"), ("go", "method", "m", "private", {"interface_methods"}, "go_interface"), ("ruby", "method", "call", "public", set(), "ruby_service_call"), ("cobol", "function", "f", "private", set(), "core_no_language_voice"),
]


def test_voices(spark):
    """What each language's voice says about symbols of which these names were harvested."""
    assert len({(v[0], v[2]) for v in VOICED}) == len(VOICED)
    g = Graph(
        spark.createDataFrame([(i, f"src/f{i}.x", v[0]) for i, v in enumerate(VOICED)], "file_id long, path string, language string"),
        spark.createDataFrame([(i, i, v[2], f"Q{i}.{v[2]}", v[1], v[3], None, 1, 2) for i, v in enumerate(VOICED)], "symbol_id long, file_id long, name string, qualified string, kind string, visibility string, parent_id long, line_start int, line_end int"),
        spark.createDataFrame([], "source_id long, target_id long, kind string, file_id long, confidence double"),
    )
    harvest = [(v[0], s, v[2]) for v in VOICED for s in v[4]] + [(x, *r) for x in {v[0] for v in VOICED} for r in (("mentions", "other"), ("harvest", ""))]
    names, frameworks = spark.createDataFrame(harvest, "language string, set string, name string"), spark.createDataFrame([("Gin",)], "name string")
    got = {r.symbol_id: (r.reason, r.verdict) for r in dead.verdicts(dead.facts(g, g.symbols.join(g.files, "file_id"), names, frameworks)).collect()}
    assert got == {i: (v[5], "dead" if v[5] is None else "possibly_dead") for i, v in enumerate(VOICED)}
