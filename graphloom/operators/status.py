"""Status, summary and health of an index (O-H rows, O-Q8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.model import EDGE_KINDS, SYMBOL_KINDS, Graph
from graphloom.operators.aggregates import fingerprint, in_degree, languages, orphans, totals
from graphloom.operators.store import debt

#: O-H5: noise patterns; O-H1: files that programs start from (fixed values).
NOISE = {"vendored": "%/vendor/%", "generated": "%generated%", "fixtures": "%/fixtures/%", "migrations": "%/migrate/%", "tests": "%test%"}
ENTRY_FILES = ("main.go", "main.py", "app.py", "manage.py", "index.js", "index.ts", "server.js", "main.rs", "config.ru", "Main.java")
EXPECTED = ("go", "ruby", "python", "typescript", "javascript", "java", "rust", "php", "kotlin", "scala", "csharp", "c", "cpp", "erb")


def entry_points(g: Graph) -> DataFrame:
    """O-H1: main functions, and the first symbol of files that programs start from."""
    s = g.symbols.join(g.files.select("file_id", "path"), "file_id")
    main = s.where(F.col("name").isin("main", "Main") & (F.col("kind") == "function"))
    known = s.where(F.element_at(F.split("path", "/"), -1).isin(*ENTRY_FILES)).groupBy("path").agg(F.min(F.struct("line_start", "symbol_id"))["symbol_id"].alias("symbol_id"))
    return main.select("symbol_id", "path").unionByName(known.select("symbol_id", "path")).distinct()


def sources(g: Graph, limit: int = 5) -> DataFrame:
    """O-H2: symbols that use others and that nobody calls or references, by out-degree."""
    out = g.edges.where("source_id is not null").groupBy(F.col("source_id").alias("symbol_id")).agg(F.count("*").alias("out_degree"))
    used = g.edges.where(F.col("kind").isin("calls", "references")).select(F.col("target_id").alias("symbol_id"))
    return out.join(used, "symbol_id", "left_anti").join(g.symbols.select("symbol_id", "qualified"), "symbol_id").orderBy(F.desc("out_degree"), "symbol_id").limit(limit)


def hubs(g: Graph, limit: int = 5, least: float = 0.5) -> DataFrame:
    """O-H3: symbols by callers of that confidence at least."""
    n = in_degree(g.edges, ("calls",), least)
    return n.join(g.symbols.select("symbol_id", "qualified"), "symbol_id").orderBy(F.desc("in_degree"), "symbol_id").limit(limit)


def main_areas(g: Graph, limit: int = 8) -> DataFrame:
    """O-H4: directories by symbols, with their dominant kind (ties by name)."""
    per = g.symbols.join(g.files.select("file_id", paths.area(F.col("path")).alias("area")), "file_id").groupBy("area", "kind").agg(F.count("*").alias("n"))
    return per.groupBy("area").agg(F.sum("n").alias("symbols"), F.min(F.struct(-F.col("n"), F.col("kind").alias("k")))["k"].alias("dominant_kind")).orderBy(F.desc("symbols"), "area").limit(limit)


def noise(g: Graph) -> DataFrame:
    """O-H5: files per noise pattern."""
    one = g.files.agg(*(F.count_if(F.concat(F.lit("/"), "path").ilike(p)).alias(k) for k, p in NOISE.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(k).alias("files")) for k in NOISE))).alias("x")).select("x.*")


def common_prefix(first: str, last: str) -> str:
    """O-H5: of sorted paths the first and last have what all have in common."""
    n = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
    return first[:n]


def test_areas(g: Graph) -> DataFrame:
    """O-H6: directories of test files."""
    return g.files.where(paths.blast_test(F.col("path"))).groupBy(paths.area(F.col("path")).alias("area")).agg(F.count("*").alias("files"))


def reading_path(g: Graph) -> DataFrame:
    """O-H6: entry points first, then hubs."""
    a = entry_points(g).join(g.symbols.select("symbol_id", "qualified"), "symbol_id").select(F.lit(1).alias("step"), "qualified")
    return a.unionByName(hubs(g).select(F.lit(2).alias("step"), "qualified"))


def report(g: Graph) -> dict[str, DataFrame]:
    """O-H1: the parts of the status response."""
    out = {"totals": totals(g), "languages": languages(g), "entry_points": entry_points(g), "hubs": hubs(g)}
    return out | ({"fingerprint": fingerprint(g.files)} if "indexed_at" in g.files.columns else {})


def doctor(g: Graph) -> DataFrame:
    """O-H7, O-A20: problem, n of every check; zero is healthy."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    checks = [
        n(orphans(g), "orphan_edges"), n(g.files.where(~F.col("language").isin(*EXPECTED)), "unknown_languages"), n(g.symbols.where(~F.col("kind").isin(*SYMBOL_KINDS)), "unknown_symbol_kinds"),
        n(g.edges.where(~F.col("kind").isin(*EDGE_KINDS)), "unknown_edge_kinds"), n(g.symbols.join(g.files.select("file_id"), "file_id", "left_anti"), "symbols_without_file"),
        n(g.edges.where(~F.col("confidence").between(0, 1)), "bad_confidence"),
    ]
    if g.embeddings is not None:
        checks.append(n(debt(g.symbols, g.embeddings), "embedding_debt"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def health(files: Column, symbols: Column, stale: Column, debt_: Column) -> Column:
    """O-H8."""
    return F.when(files == 0, "empty").when(stale > 0, "stale").when(symbols == 0, "no_symbols").when(debt_ > 0, "embedding").otherwise("ready")


def symbol_shaped(pattern: Column) -> Column:
    """O-Q8: whether a searched pattern looks like a symbol rather than prose or a regular expression."""
    return pattern.rlike(r"^[A-Za-z_][A-Za-z0-9_]*((::|[.#])[A-Za-z_][A-Za-z0-9_?!]*)*$") & pattern.rlike(r"[A-Z_]|::|[.#]")
