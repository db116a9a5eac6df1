"""Queries over small literal graphs, for edge kinds, nulls and languages that the projected tables don't have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import blast, conventions, dead, derive, graph

QUERIES, ORACLE_SQL = {}, {}

FILE_ROWS = [(1, "app/order.rb", "ruby"), (2, "app/cart.rb", "ruby"), (3, "spec/order_spec.rb", "ruby"), (4, "app/views/x.html.erb", "erb"), (5, "lib/pay.go", "go"), (6, "lib/pay_test.go", "go"), (7, "app/models/concerns/payable.rb", "ruby"), (8, "web/use.ts", "typescript"), (9, "tests/FooTest.php", "php")]
SYMBOL_ROWS = [
    (1, 1, "Order", "Order", "class", "public", None), (2, 1, "total", "Order#total", "method", "public", 1), (3, 1, "before_save", "Order#before_save", "method", "private", 1), (4, 2, "Cart", "Cart", "class", "public", None), (5, 2, "sum", "Cart#sum", "method", "public", 4), (6, 3, "OrderSpec", "OrderSpec", "class", "public", None),
    (7, 5, "Pay", "pay.Pay", "function", "public", None), (8, 5, "help", "pay.help", "function", "private", None), (9, 6, "TestPay", "pay.TestPay", "function", "public", None), (10, 7, "Payable", "Payable", "module", "public", None), (11, 5, "Payer", "pay.Payer", "interface", "public", None), (12, 5, "Pay", "pay.Payer.Pay", "method", "public", 11),
    (13, 5, "Card", "pay.Card", "class", "public", None), (14, 5, "Pay", "pay.Card.Pay", "method", "private", 13), (15, 5, "Cents", "pay.Cents", "type", "public", None), (16, 8, "useCart", "useCart", "function", "public", None), (17, 2, "OrdersController", "OrdersController", "class", "public", None), (18, 5, "router", "pay.router", "function", "private", None),
    (19, 5, "auth", "pay.auth", "function", "private", None), (20, 9, "FooTest", "FooTest", "class", "public", None), (21, 2, "Wallet", "Wallet", "class", "public", None), (22, 2, "active", "Order.active", "method", "public", 1),
]
EDGE_ROWS = [
    (5, 2, "calls", 2, 1.0, None), (None, 2, "calls", 4, 0.9, None), (6, 1, "tests", 3, 0.8, None), (4, 1, "temporal", 2, 0.5, 4), (1, 10, "includes", 1, 1.0, None), (4, 10, "includes", 2, 1.0, None), (21, 10, "includes", 2, 1.0, None), (9, 7, "calls", 6, 1.0, None), (13, 11, "inherits", 5, 0.9, None),
    (7, 12, "calls", 5, 1.0, None), (4, 1, "composes", 2, 1.0, None), (None, 1, "imports", 8, 1.0, None), (18, 19, "calls", 5, 1.0, None), (4, 22, "calls", 2, 1.0, None), (4, 2, "calls", 2, 1.0, None), (21, 11, "composes", 2, 1.0, None), (13, 1, "composes", 5, 1.0, None),
]


def shop(spark: SparkSession) -> Graph:
    symbols = [(i, f, n, q, k, v, p, i, i + 2) for i, f, n, q, k, v, p in SYMBOL_ROWS]
    return Graph(
        spark.createDataFrame(FILE_ROWS, "file_id long, path string, language string"),
        spark.createDataFrame(symbols, "symbol_id long, file_id long, name string, qualified string, kind string, visibility string, parent_id long, line_start int, line_end int"),
        spark.createDataFrame(EDGE_ROWS, "source_id long, target_id long, kind string, file_id long, confidence double, co_changes int"),
    )


def values(columns: str, *rows: tuple) -> str:
    literal = lambda v: "NULL" if v is None else f"{v}::BIGINT" if type(v) is int else f"{v}::DOUBLE" if type(v) is float else repr(v)
    shown = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) t({columns})" if rows else f"SELECT {', '.join(f'NULL AS {c}' for c in columns.split(', '))} WHERE FALSE"


def case(name: str, columns: str, *rows: tuple):
    def put(f: Callable[[Graph, SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(shop(spark), spark).select(*columns.split(", "))
            return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})

        QUERIES[name] = run
        ORACLE_SQL[name] = values(columns, *rows)
        return f

    return put


@case("G9_co_changes", "other_id, co_changes, strength", (4, 4, 0.5))
def _(g, spark):
    return graph.co_changes(g, g.symbols.where("symbol_id = 1")).withColumn("co_changes", F.col("co_changes").cast("int"))


@case("G10_inferred_callers", "symbol_id, caller_id, via, confidence", (14, 7, 12, 0.8))
def _(g, spark):
    return graph.inferred_callers(g, g.symbols.where("symbol_id = 14"))


@case("J8_dispatch", "symbol_id, interface_method", (14, 12))
def _(g, spark):
    return graph.dispatch(g)


@case("G6_folded_callers", "symbol_id, member", (4, 2), (5, 2))
def _(g, spark):
    return graph.member_callers(g, g.symbols.where("symbol_id = 1"))


@case("G14_seeds", "seed, symbol_id", (1, 1), (1, 2), (1, 3), (1, 22))
def _(g, spark):
    return blast.seeds(g, g.symbols.where("symbol_id = 1"))


@case("G23_affected_tests", "seed, path", (1, "spec/order_spec.rb"))
def _(g, spark):
    return blast.affected_tests(g, blast.reach(g, g.symbols.where("symbol_id = 1"), blast.TOOL))


@case("G24_importers", "seed, importers", (1, 1))
def _(g, spark):
    return blast.importers(g, blast.reach(g, g.symbols.where("symbol_id = 1"), blast.TOOL))


@case("G25_view_reach", "symbol_id", (2,))
def _(g, spark):
    return blast.view_reached(g, g.symbols)


@case("G29_laundered", "symbol_id, via, carrier", (21, 11, 13))
def _(g, spark):
    return blast.laundered(g, blast.carriers(g, g.symbols.where("symbol_id = 1")))


@case("G31_chains", "symbol_id, level, chain", (1, 0, "1"), (4, 1, "1>4"), (13, 1, "1>13"))
def _(g, spark):
    return blast.carriers(g, g.symbols.where("symbol_id = 1")).withColumn("chain", F.array_join("chain", ">"))


@case("G19_without_members", "symbol_id", (7,))
def _(g, spark):
    rows = blast.affected(g, blast.reach(g, g.symbols.where("symbol_id in (11, 12)"), blast.Options(1, 0.5)))
    return blast.without_members(rows, g).where("seed = 12").select("symbol_id")


@case("D2_alive_by_interface", "parent_id, name", (13, "Pay"))
def _(g, spark):
    return dead.alive_by_interface(g)


@case("D4_entry_points", "symbol_id", (9,), (20,))
def _(g, spark):
    s = g.symbols.join(g.files, "file_id")
    return s.where(dead.is_entry_point(F.col("name"), F.col("path")) & (F.col("symbol_id").isin(9, 20, 1, 16)))


@case("D9_rails_verdicts", "symbol_id, reason", (17, "rails_routing"), (3, "rails_callback"), (4, "ruby_class"))
def _(g, spark):
    none = spark.createDataFrame([("ruby", "harvest", "")], "language string, set string, name string")
    found = dead.candidates(g).where("symbol_id in (3, 4, 17)")
    return dead.verdicts(dead.facts(g, found, none, spark.createDataFrame([("Rails",)], "name string")))


@case("D10_go_verdicts", "symbol_id, verdict, reason", (8, "dead", None), (15, "possibly_dead", "go_exported"), (18, "possibly_dead", "core_name_mentioned"))
def _(g, spark):
    names = spark.createDataFrame([("go", "mentions", "router")], "language string, set string, name string")
    return dead.verdicts(dead.facts(g, dead.candidates(g).where("symbol_id in (8, 15, 18)"), names, spark.createDataFrame([("Gin",)], "name string")))


@case("C11_concerns", "symbol_id, name, includers", (10, "Payable", 3))
def _(g, spark):
    return conventions.concerns(g)


@case("C12_callbacks", "name, classes", ("before_save", 1))
def _(g, spark):
    return conventions.callbacks(g)


@case("C13_scopes", "symbol_id, scopes", (1, 2))
def _(g, spark):
    return conventions.scopes(g)


@case("C14_hooks", "symbol_id, name", (16, "useCart"))
def _(g, spark):
    return conventions.hooks(g)


@case("C16_go_aliases", "symbol_id, name", (15, "Cents"))
def _(g, spark):
    return conventions.go_aliases(g)


@case("C17_go_middleware", "name, symbol_id", ("auth", 19))
def _(g, spark):
    return conventions.go_middleware(g)


@case("C18_php_tests", "style, files", ("class", 1))
def _(g, spark):
    return conventions.php_tests(g)


@case("C20_dedupe", "category, description, instances", ("naming", "a", 3), ("naming", "b (x)", 3), ("naming", "b (y)", 4))
def _(g, spark):
    rows = [("naming", "a", 3, 4, 0.75, ["x"]), ("naming", "a", 3, 4, 0.75, ["x"]), ("naming", "b", 3, 4, 0.75, ["x"]), ("naming", "b", 4, 5, 0.8, ["y"])]
    return conventions.deduped(spark.createDataFrame(rows, "category string, description string, instances long, total long, strength double, examples array<string>"))


@case("C19_significance", "base, significance", ("ApplicationRecord", 0), ("Shop::Base", 2), ("Base", 1))
def _(g, spark):
    rows = spark.createDataFrame([("ApplicationRecord",), ("Shop::Base",), ("Base",)], "base string")
    return rows.withColumn("significance", conventions.significance(F.col("base"), F.lit("ruby")))


@case("R13_parent_links", "symbol_id, parent_id", (100, 1), (101, 4))
def _(g, spark):
    children = spark.createDataFrame([(100, 1, "Order"), (101, 1, "Cart"), (102, 5, "Order")], "symbol_id long, file_id long, parent_qualified string")
    return derive.parent_links(children, g)


@case("R14_satisfaction", "interface_id, struct_id", (1, 3), (1, 4), (2, 3), (2, 4))
def _(g, spark):
    kinds = spark.createDataFrame([(1, "interface"), (2, "interface"), (3, "class"), (4, "class"), (5, "interface")], "symbol_id long, kind string")
    methods = spark.createDataFrame([(1, "Read", 1, 2, True), (2, "Close", 0, 1, True), (3, "Read", 1, 2, True), (3, "Close", 0, 1, True)], "owner_id long, name string, params int, results int, known boolean")
    return derive.satisfaction(methods, spark.createDataFrame([(2, 1), (4, 3)], "outer_id long, inner_id long"), kinds)


@case("R15_test_pairs", "source_id, target_id", (6, 1), (6, 2), (6, 3), *((9, t) for t in (7, 8, 11, 12, 13, 14, 15, 18, 19)))
def _(g, spark):
    return derive.test_pairs(g)


@case("R16_naming_edges", "source_id, target_id, confidence", (17, 1, 0.6))
def _(g, spark):
    return derive.naming_edges(g)


@case("R17_temporal_edges", "source_id, target_id, co_changes", (1, 11, 3), (11, 1, 3))
def _(g, spark):
    return derive.temporal(g, spark.createDataFrame([(c, p) for c in range(3) for p in ("app/order.rb", "lib/pay.go")], "commit_id long, path string"))


@case("R9_import_paths", "edge_no, dir, external", (1, "sub/pkg", False), (2, None, True))
def _(g, spark):
    pending = spark.createDataFrame([(1, "ex.org/a/b/pkg"), (2, "other.org/x")], "edge_no long, import_path string")
    return derive.import_path(pending, spark.createDataFrame([("ex.org/a", "."), ("ex.org/a/b", "sub")], "module string, dir string"), spark.createDataFrame([("sub/pkg/f.go",)], "path string"))


@case("R10_composed_models", "edge_no, symbol_id", (1, 7))
def _(g, spark):
    found = spark.createDataFrame([(1, 7, "shop.models"), (1, 8, "shop.views"), (2, 9, "shop.models"), (2, 10, "shop.models")], "edge_no long, symbol_id long, module string")
    return derive.composed_models(found, spark.createDataFrame([("shop.models",)], "module string"))


@case("W15_dominant", "symbol_id", (2,))
def _(g, spark):
    edges = spark.createDataFrame([(i, 2) for i in range(10)] + [(1, 7), (2, 7)], "source_id long, target_id long")
    return graph.dominant(g.symbols.where("symbol_id in (2, 7)").select("symbol_id"), edges)
