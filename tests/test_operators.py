"""Operators on small graphs: edge kinds, nulls, caps and ties that the projected tables don't have."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import text
from graphloom.model import Graph
from graphloom.operators import aggregates, blast, conventions, dead, derive, graph, present, search, status, store, vector
from graphloom.sources import extractors, manifests
from graphloom.streaming import incremental

FILES = "file_id long, path string, language string"
SYMBOLS = "symbol_id long, file_id long, name string, qualified string, kind string, visibility string, parent_id long, line_start int, line_end int"
EDGES = "edge_id long, source_id long, target_id long, kind string, file_id long, confidence double, co_changes int"


def make(spark, files, symbols, edges, **more):
    s = [(i, f, n, q, k, v, p, i, i + 2) for i, f, n, q, k, v, p in symbols]
    e = [(i, *x[:5], x[5] if len(x) > 5 else None) for i, x in enumerate(edges, 1)]
    return Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(e, EDGES), **more)


@pytest.fixture(scope="module")
def shop(spark):
    files = [(1, "app/order.rb", "ruby"), (2, "app/cart.rb", "ruby"), (3, "spec/order_spec.rb", "ruby"), (4, "app/views/x.html.erb", "erb"), (5, "lib/pay.go", "go"), (6, "lib/pay_test.go", "go")]
    symbols = [
        (1, 1, "Order", "Order", "class", "public", None), (2, 1, "total", "Order#total", "method", "public", 1), (3, 1, "hidden", "Order#hidden", "method", "private", 1), (4, 2, "Cart", "Cart", "class", "public", None),
        (5, 2, "sum", "Cart#sum", "method", "public", 4), (6, 3, "OrderSpec", "OrderSpec", "class", "public", None), (7, 5, "Pay", "pay.Pay", "function", "public", None), (8, 5, "help", "pay.help", "function", "private", None), (9, 6, "TestPay", "pay.TestPay", "function", "public", None),
        (10, 2, "Payable", "Payable", "module", "public", None), (11, 5, "Payer", "pay.Payer", "interface", "public", None), (12, 5, "Pay", "pay.Payer.Pay", "method", "public", 11), (13, 5, "Card", "pay.Card", "class", "public", None), (14, 5, "Pay", "pay.Card.Pay", "method", "private", 13),
        (15, 5, "route", "route:/x", "function", "public", None),
    ]
    edges = [
        (5, 2, "calls", 2, 1.0), (2, 3, "calls", 1, 0.4), (6, 1, "tests", 3, 0.8), (None, 2, "calls", 4, 0.9), (None, 2, "calls", 4, 0.9), (4, 1, "temporal", 2, 0.5, 4), (1, 10, "includes", 1, 1.0), (9, 7, "calls", 6, 1.0), (13, 11, "inherits", 5, 0.9), (7, 12, "calls", 5, 1.0),
        (4, 1, "composes", 2, 1.0), (None, 1, "imports", 2, 1.0),
    ]
    return make(spark, files, symbols, edges)


def ids(df, column="symbol_id"):
    return sorted(r[column] for r in df.collect())


def test_every_edge_kind_is_followed_or_exempt():
    for consumer, kinds in model.FOLLOWED.items():
        assert sorted([*kinds, *model.EXEMPT[consumer]]) == sorted(model.EDGE_KINDS), consumer


def test_priorities_cover_the_rules():
    assert {r.code for r in dead.RULES} | {"core_name_mentioned", "core_no_harvest", "core_no_language_voice"} == set(dead.PRIORITY)
    assert len(dead.PRIORITY) == 51


def test_null_sources(shop):
    near = graph.neighbourhood(shop, shop.symbols.where("symbol_id = 2"), "callers").collect()
    assert sorted((r.other_id, r.other) for r in near) == [(0, ""), (0, ""), (5, "Cart#sum")]
    assert ids(graph.bfs(shop, shop.symbols.where("symbol_id = 2"), 1, "callers")) == [2, 5]
    assert ids(blast.view_reached(shop, shop.symbols)) == [2]


def test_categories_hide_unsure_calls(shop):
    got = {(r.root_id, r.bucket): (r.shown, r.hidden, r.completeness) for r in graph.categories(graph.neighbourhood(shop, shop.symbols)).collect()}
    assert got[2, "calls"] == (0, 1, "partial") and got[2, "called_by"] == (3, 0, "complete") and got[1, "tests"] == (1, 0, "complete") and (6, "tests") not in got


def test_blast(shop):
    reached = blast.reach(shop, shop.symbols.where("symbol_id = 1"), blast.TOOL)
    got = {r.symbol_id: (r.hop, r.kind) for r in reached.collect()}
    assert got[1][0] == got[2][0] == got[3][0] == 0
    assert got[4] == (1, "composes") and got[5] == (1, "calls") and got[6] == (1, "tests")
    risk = blast.risk(blast.affected(shop, reached)).first()
    assert (risk.direct, risk.risk, risk.in_tests) == (3, "medium", 1)
    assert [r.path for r in blast.affected_tests(shop, reached).collect()] == ["spec/order_spec.rb"]
    assert blast.importers(shop, blast.reach(shop, shop.symbols.where("symbol_id = 1"), blast.Options(0))).first().paths == ["app/cart.rb"]
    assert {r.group for r in blast.groups(blast.affected(shop, reached), shop).collect()} == {"via_composition"}


def test_blast_fan_in_tree(spark):
    n, b = 1024, 8
    g = make(spark, [(1, "a.go", "go")], [(i, 1, f"f{i}", f"f{i}", "function", "public", None) for i in range(1, n + 1)], [(i, (i - 2) // b + 1, "calls", 1, 1.0) for i in range(2, n + 1)])
    reached = blast.reach(g, g.symbols.where("symbol_id = 1"))
    assert {r.hop: r["count"] for r in reached.groupBy("hop").count().collect()} == {0: 1, 1: 8, 2: 64, 3: 500}
    assert reached.where("hop = 3").agg(F.max("symbol_id")).first()[0] <= 585


def test_dispatch_and_folds(shop):
    assert [tuple(r) for r in graph.dispatch(shop).collect()] == [(14, 12)]
    assert [(r.symbol_id, r.caller_id, r.via) for r in graph.inferred_callers(shop, shop.symbols.where("symbol_id = 14")).collect()] == [(14, 7, 12)]
    assert [(r.root_id, r.symbol_id) for r in graph.member_callers(shop, shop.symbols.where("symbol_id = 1")).collect()] == [(1, 5)]
    assert [(r.root_id, r.other_id, r.co_changes) for r in graph.co_changes(shop, shop.symbols.where("symbol_id = 1")).collect()] == [(1, 4, 4)]


def test_lookup_tiers(shop):
    kind = lambda q: {r.resolution for r in graph.lookup(shop, q).collect()}
    assert kind("Order#total") == {"exact"} and kind("Pay") == {"name"} and kind("TOTAL") == {"suffix"} and kind("rder#tot") == {"contains"} and kind("Ordr#totl") == {"fuzzy"} and kind("zzzzzzzz") == set()
    assert ids(graph.lookup(shop, "Order")) == [1]


def test_dead(shop, spark):
    names = spark.createDataFrame([("ruby", "harvest", ""), ("ruby", "mentions", "total"), ("go", "mentions", "x")], "language string, set string, name string")
    found = dead.unreferenced(shop)
    assert ids(found) == [4, 6, 7, 8]
    known = dead.facts(shop, dead.candidates(shop), names, spark.createDataFrame([("Rails",)], "name string"))
    verdict = {r.symbol_id: (r.verdict, r.reason) for r in dead.verdicts(known).collect()}
    assert verdict[8] == ("dead", None) and verdict[5] == ("possibly_dead", "ruby_public_method") and verdict[4] == ("possibly_dead", "ruby_class") and 15 not in verdict
    assert dead.alive_by_interface(shop).collect()[0].parent_id == 13


def test_store_conformance(spark):
    g = store.empty(spark)
    a = spark.createDataFrame([(1, "a.rb", "ruby", "h1", 1, None)], model.FILES)
    g = store.upsert_files(g, a)
    g = store.upsert_files(g, spark.createDataFrame([(9, "a.rb", "go", "h2", 2, None), (2, "b.rb", "ruby", "h", 0, None)], model.FILES))
    assert {(r.file_id, r.path, r.hash) for r in g.files.collect()} == {(1, "a.rb", "h2"), (2, "b.rb", "h")}
    edge = lambda i, s, c: (i, s, 2, "calls", 1, 3, c, None)
    g = store.upsert_edges(g, spark.createDataFrame([edge(1, 1, 0.5), edge(2, None, 0.5), edge(3, None, 0.5)], model.EDGES))
    g = store.upsert_edges(g, spark.createDataFrame([edge(7, 1, 0.9), edge(8, None, 0.5)], model.EDGES))
    assert sorted((r.source_id or 0, r.confidence) for r in g.edges.collect()) == [(0, 0.5)] * 3 + [(1, 0.9)]
    assert g.edges.where("source_id = 1").first().edge_id == 1


def test_delete_cascades_and_orphans_children(shop):
    left = store.delete_files(shop, shop.files.where("file_id = 2"))
    assert 4 not in ids(left.symbols) and left.edges.where("source_id in (4, 5) or target_id in (4, 5)").count() == 0
    moved = Graph(shop.files, shop.symbols.withColumn("parent_id", F.when(F.col("symbol_id") == 7, 4).otherwise(F.col("parent_id"))), shop.edges)
    assert store.delete_files(moved, shop.files.where("file_id = 2")).symbols.where("symbol_id = 7").first().parent_id is None


def test_versions(spark, shop, tmp_path):
    v = store.Versions(spark, tmp_path.as_uri())
    v.write(shop, 1)
    v.write(store.delete_files(shop, shop.files.where("file_id = 1")), 2)
    assert v.latest() == 2 and v.read().files.count() == 5 and v.read(1).files.count() == 6


def test_resolution_tiers(spark):
    files = [(1, "a/x.rb", "ruby"), (2, "a/y.rb", "ruby"), (3, "spec/z_spec.rb", "ruby"), (4, "m.py", "python")]
    symbols = [
        (1, 1, "Base", "Shop::Base", "class", "public", None), (2, 1, "run", "Shop::Base#run", "method", "public", 1), (3, 2, "User", "Shop::User", "class", "public", None), (4, 2, "go", "Shop::User#go", "method", "public", 3), (5, 3, "only_test", "only_test", "function", "public", None), (6, 4, "run", "m.run", "function", "public", None), (9, 4, "stop", "stop", "function", "public", None), (10, 1, "stop", "Shop::Base#stop", "method", "public", 1),
        (7, 1, "twin", "A#twin", "method", "public", None), (8, 2, "twin", "B#twin", "method", "public", None),
    ]
    g = make(spark, files, symbols, [(3, 1, "inherits", 2, 1.0)])
    pend = "edge_no long, source_id long, source_file_id long, source_qualified string, source_parent string, target string, kind string, base double, receiver string"
    rows = [(1, 4, 2, "Shop::User#go", "Shop::User", "Base", "inherits", 1.0, ""), (2, 4, 2, "Shop::User#go", "Shop::User", "run", "calls", 1.0, ""), (3, 4, 2, "Shop::User#go", "Shop::User", "only_test", "calls", 1.0, ""), (4, 4, 2, "Shop::User#go", "Shop::User", "twin", "calls", 1.0, ""), (5, 4, 2, "x", "", "self.run", "calls", 0.5, ""), (6, 4, 2, "x", "", "nowhere", "imports", 1.0, ""), (7, 4, 2, "Shop::User#go", "Shop::User", "stop", "calls", 1.0, "")]
    got = {r.edge_no: (r.target_id, r.confidence, r.tier) for r in derive.resolve(g, spark.createDataFrame(rows, pend), derive.ancestry(g)).collect()}
    assert got[1] == (1, 1.0, 2) and got[4] == (8, 0.3, 4) and 3 not in got and 6 not in got
    assert got[2] == (2, 1.0, 3)
    assert 7 not in got  # an exact name that the gates reject ends the search


def test_satisfaction(spark):
    kinds = spark.createDataFrame([(1, "interface"), (2, "interface"), (3, "class"), (4, "class"), (5, "interface"), (6, "class")], "symbol_id long, kind string")
    m = lambda o, n, p=0, r=0, k=True: (o, n, p, r, k)
    methods = spark.createDataFrame([m(1, "Read", 1, 2), m(2, "Close", 0, 1), m(3, "Read", 1, 2), m(3, "Close", 0, 1), m(4, "Read", 9, 9), m(6, "Close", 0, 0, False)], "owner_id long, name string, params int, results int, known boolean")
    embeds = spark.createDataFrame([(2, 1), (4, 3)], "outer_id long, inner_id long")
    got = {(r.interface_id, r.struct_id) for r in derive.satisfaction(methods, embeds, kinds).collect()}
    assert got == {(1, 3), (2, 3)}


def test_derived_pairs(spark, shop):
    got = {(r.source_id, r.target_id) for r in derive.test_pairs(shop).collect()}
    assert (6, 1) in got and (6, 2) in got and (9, 7) in got and (9, 8) in got
    g = make(spark, [(1, "a.rb", "ruby")], [(1, 1, "Order", "Order", "class", "public", None), (2, 1, "OrdersController", "OrdersController", "class", "public", None), (3, 1, "OrderService", "OrderService", "class", "public", None)], [])
    assert {(r.source_id, r.target_id) for r in derive.naming_edges(g).collect()} == {(2, 1), (3, 1)}
    commits = spark.createDataFrame([(c, p) for c in range(4) for p in ("app/order.rb", "lib/pay.go")] + [(9, "app/order.rb")], "commit_id long, path string")
    t = derive.temporal(shop, commits).collect()
    assert {(r.source_id, r.target_id, r.co_changes, r.confidence) for r in t} == {(1, 11, 4, 0.8), (11, 1, 4, 0.8)}


def test_import_paths(spark):
    pending = spark.createDataFrame([(1, "ex.org/a/b/pkg"), (2, "ex.org/a"), (3, "other.org/x")], "edge_no long, import_path string")
    modules = spark.createDataFrame([("ex.org/a", "."), ("ex.org/a/b", "sub"), ("dup.org", "x"), ("dup.org", "y")], "module string, dir string")
    files = spark.createDataFrame([("sub/pkg/f.go",)], "path string")
    got = {r.edge_no: (r.dir, r.external, r.known) for r in derive.import_path(pending, modules, files).collect()}
    assert got[1] == ("sub/pkg", False, True) and got[3] == (None, True, False)


def test_conventions(spark):
    files = [(i, f"app/services/s{i}.rb", "ruby") for i in range(1, 7)] + [(9, "app/models/concerns/payable.rb", "ruby")]
    symbols = [(i, i, f"Thing{i}Service", f"Thing{i}Service", "class", "public", None) for i in range(1, 7)] + [(10 + i, i, "call", f"Thing{i}Service#call", "method", "public", i) for i in range(1, 7)] + [(30, 9, "Payable", "Payable", "module", "public", None), (31, 9, "Base", "Base", "class", "public", None)]
    g = make(spark, files, symbols, [(i, 31, "inherits", i, 1.0) for i in range(1, 7)] + [(i, 30, "includes", i, 1.0) for i in range(1, 5)])
    found = {r.description: r for r in conventions.detect(g).collect()}
    assert found["classes inherit from Base"].instances == 6 and found["classes use *Service"].examples == [f"Thing{i}Service" for i in range(1, 6)]
    assert conventions.service_objects(g).count() == 6 and [r.includers for r in conventions.concerns(g).collect()] == [4]
    assert "classes inherit from Base (6)" in conventions.summary(conventions.detect(g))


def test_search(spark, shop):
    assert search.shape("getURL") == "identifier" and search.shape("how is the order made") == "natural_language" and search.shape("find get_order now") == "mixed" and search.shape("order total") == "mixed"
    assert search.expand("HandleHTTPRequest") == ["HandleHTTPRequest", "handle http request"] and search.weights("natural_language", 0.1) == (0.5, 0.5) and search.weights("identifier", 0.1) == (0.7, 0.3) and search.weights("identifier", 0.9, False) == (1.0, 0.0)
    top = search.search(shop, "Order total", search.Options(limit=3)).collect()
    assert top[0].qualified in ("Order#total", "Order") and all(r.qualified != "route:/x" for r in top)
    assert search.about_tests("test for it") and not search.about_tests("latest inspect")


def test_vectors_skip_other_dimensions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [0.6, 0.8])], "symbol_id long, vector array<float>")
    got = [(r.id, r.similarity) for r in vector.nearest(v, "symbol_id", "vector", [1.0, 0.0], 5).collect()]
    assert got == [(1, 1.0), (4, 0.6), (2, 0.0)]


def test_plans(spark, shop):
    plan = dead.candidates(shop)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan
    top = aggregates.hubs(shop)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top


def test_presentation(spark):
    lists, layers, cut = present.trimmed({"a": list(range(50)), "b": [1]}, [[1], [2]], lambda x, y: sum(map(len, x.values())) + 10 * len(y), 30)
    assert cut and not layers and len(lists["a"]) + 1 <= 30
    assert present.canonical({"q": "x", "query": "y", "hops": 2}) == {"query": "y", "max_hops": 2}
    p = present.Preset.of({"hops": 2}, {"GRAPHLOOM_WATCH": "off", "GRAPHLOOM_IGNORE": "a,b"})
    assert (p.hops, p.watch, p.ignore, p.cap) == (2, False, ("a", "b"), 200)
    md = present.markdown([("One", ["x" * 20] * 3), ("Two", ["y" * 50] * 9), ("Three", ["z"])], 40)
    assert md.startswith("## One") and "…" in md and md.endswith("Omitted: Two, Three")
    assert json.loads(present.to_json(spark.createDataFrame([(1, None)], "a int, b array<int>")).first().json) == {"a": 1, "b": []}
    assert status.common_prefix("app/a.rb", "app/b.rb") == "app/"


def test_extractors(spark):
    found = extractors.extract(spark.createDataFrame([*extractors.EXAMPLES, (99, "bad.py", "def ("), (98, "x.txt", "no")], "file_id long, path string, content string"))
    s = {(r.language, r.qualified): (r.kind, r.visibility) for r in extractors.symbols(found).collect()}
    assert s["go", "Cart.Add"] == ("method", "public") and s["go", "check"] == ("function", "private") and s["ruby", "Order#secret"] == ("method", "private") and s["typescript", "Cart.total"] == ("method", "private") and s["rust", "Cart::add"] == ("method", "private")
    for language in ("java", "kotlin", "scala", "csharp", "php", "cpp"):
        assert any(k[0] == language and v[0] == "class" for k, v in s.items()) and any(k[0] == language and v[0] == "method" for k, v in s.items()), language
    e = {(r.language, r.source, r.target, r.kind) for r in extractors.edges(found).collect()}
    assert ("ruby", "Order", "ApplicationRecord", "inherits") in e and ("ruby", "Order", "Payable", "includes") in e and ("ruby", "Order", "LineItem", "composes") in e and ("go", "Cart.Add", "check", "calls") in e and ("erb", None, "partial:cart/row", "calls") in e and ("erb", None, "Users::ListItemController", "calls") in e
    assert ("java", "Cart", "Base", "inherits") in e and ("php", "Cart", "Payable", "includes") in e
    assert extractors.failures(found).count() == 1


def test_tree(spark, tmp_path):
    for path, content in {"a.go": "package a", "sub/b.rb": "x", ".git/c": "x", "gen.go": "// Code generated by x. DO NOT EDIT.\n", "big.py": "x" * 3000, "skip.log": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    got = sorted(r.path for r in manifests.tree(spark, str(tmp_path), ["*.log"], 2).collect())
    assert got == ["a.go", "sub/b.rb"]


def test_git_log(spark):
    log = "\x01abc\n\na.rb\nb.rb\n\x01def\n\na.rb\n"
    assert sorted(tuple(r) for r in manifests.commits(spark.createDataFrame([(log,)], "log string")).collect()) == [("abc", "a.rb"), ("abc", "b.rb"), ("def", "a.rb")]


def test_streams(spark, tmp_path):
    feed = [("a", "changed", "2024-01-01 00:00:00"), ("b", "removed", "2024-01-01 00:00:00.5"), ("a", "removed", "2024-01-01 00:00:00.7"), ("c", "changed", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(feed, "path string, op string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = [(r.changed, r.removed) for r in incremental.batches(df).orderBy("start").collect()]
    assert got == [(["a"], ["b"]), (["c"], [])]
    df.write.parquet(str(tmp_path / "feed"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
    incremental.follow(stream, lambda changed, removed: seen.append((changed, removed)), str(tmp_path / "ck")).awaitTermination()
    assert sorted(x for c, _ in seen for x in c) == ["c"] and sorted(x for _, r in seen for x in r) == ["a", "b"]
    lines = spark.createDataFrame([("M\ta.rb",), ("R100\tb.rb\tc.rb",), ("D\td.rb",)], "line string")
    assert sorted((r.path, r.op) for r in incremental.branch_switch(lines).collect()) == [("a.rb", "changed"), ("b.rb", "removed"), ("c.rb", "changed"), ("d.rb", "removed")]


def test_incremental_replaces_whole_files(spark, shop):
    changed = Graph(spark.createDataFrame([(2, "app/cart.rb", "ruby")], FILES), shop.symbols.where("symbol_id = 4"), shop.edges.limit(0))
    after = incremental.applied(shop, changed, spark.createDataFrame([("lib/pay.go",)], "path string"))
    assert sorted(r.path for r in after.files.collect()) == sorted(["app/order.rb", "app/cart.rb", "spec/order_spec.rb", "app/views/x.html.erb", "lib/pay_test.go"])
    assert ids(after.symbols.where("file_id = 2")) == [4]


def test_retention(spark):
    symbols = [(1, 1, "Conn", "Conn", "class", "public", None), (2, 1, "Pool", "Pool", "class", "public", None), (3, 1, "App", "App", "class", "public", None), (4, 1, "Closer", "Closer", "interface", "public", None), (5, 1, "Holder", "Holder", "class", "public", None)]
    g = make(spark, [(1, "a.go", "go")], symbols, [(2, 1, "composes", 1, 1.0), (3, 2, "composes", 1, 1.0), (2, 4, "inherits", 1, 0.9), (5, 4, "composes", 1, 1.0), (4, 1, "composes", 1, 1.0)])
    found = blast.carriers(g, g.symbols.where("symbol_id = 1"))
    assert {r.symbol_id: r.chain for r in found.collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3]}
    assert [(r.symbol_id, r.via, r.carrier) for r in blast.laundered(g, found).collect()] == [(5, 4, 2)]


def test_text_functions():
    assert text.decompose_text("HTTPSHandler") == "https handler" and text.decompose_text("JSONAPIURL") == "json api url" and text.decompose_text("get_user-Name") == "get user name"
    vocabulary = {"[CLS]": 1, "[SEP]": 2, "[UNK]": 3, "play": 4, "##ing": 5, "!": 6}
    assert text.wordpieces("Playing! zz", vocabulary) == [1, 4, 5, 6, 3, 2]
