"""Conventions: grouped patterns of a codebase (O-C rows, O-A12, O-A13, O-W13, O-W14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import paths, text
from graphloom.functions.shared import settle
from graphloom.model import CONTAINERS, Graph
from graphloom.operators.aggregates import coupling, in_degree
from graphloom.operators.graph import at_end

LEAST, EXAMPLES = 3, 5
CATEGORIES = ("inheritance", "naming", "structure", "composition", "testing", "design-pattern", "architecture", "framework", "key-types", "external")
#: Fixed values of the detectors.
ENTRY_VERBS = ("call", "execute", "perform", "run", "invoke", "handle", "process")
RAILS_CALLBACKS = ("before_save", "after_save", "before_create", "after_create", "before_destroy", "after_destroy", "before_update", "after_update", "before_validation", "after_validation", "after_commit", "before_action", "after_action", "around_action")
FRAMEWORK_BASES = ("ApplicationRecord", "ApplicationController", "ActiveRecord::Base", "ApplicationJob", "ApplicationMailer", "Model", "Controller")
TEST_PATTERNS = ((r"_test\.go$", "*_test.go"), (r"_spec\.rb$", "*_spec.rb"), (r"_test\.rb$", "*_test.rb"), (r"(^|/)test_[^/]*\.py$", "test_*.py"), (r"\.test\.[jt]sx?$", "*.test.*"), (r"\.spec\.[jt]sx?$", "*.spec.*"), (r"Test\.(java|kt|php)$", "*Test"))


def emit(rows: DataFrame, keys: list[str], totals: DataFrame | int, total_keys: list[str], category: str, describe: Column, unit: str = "symbol_id", least: int = LEAST) -> DataFrame:
    """O-A12, O-A13: distinct units per key, those of least or more, with strength against the total; the first examples by name.

    Units are made distinct and counted per key before anything is gathered; examples are the few smallest, by rank.
    """
    per = rows.select(*keys, unit, "name", "path").groupBy(*keys, unit).agg(F.min(F.struct("name", "path")).alias("x"))
    counts = per.groupBy(*keys).agg(F.count("*").alias("instances"))
    ranked = per.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("x", unit))).where(F.col("k") <= EXAMPLES)
    few = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("x.name")).alias("examples"))
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    found = counts.where(known & (F.col("instances") >= least)).join(few, keys, "left")  # each has examples: left out where nobody reads them
    found = found.withColumn("total", F.lit(totals).cast("long")) if isinstance(totals, int) else found.join(totals, total_keys)
    strength = F.round(F.col("instances") / F.col("total"), 6)
    return found.where("total > 0").select(F.lit(category).alias("category"), describe.alias("description"), "instances", "total", strength.alias("strength"), "examples")


def _symbols(g: Graph, domain: str = "") -> DataFrame:
    """O-C24: symbols with path, synthetic ones and those outside the domain left out."""
    s = g.symbols.join(g.files.select("file_id", "path", "language"), "file_id").where(~text.is_synthetic(F.col("qualified")))
    return s.where(F.col("path").contains(domain)) if domain else s


def _ends(g: Graph, kinds: tuple[str, ...], domain: str = "") -> DataFrame:
    """Edges with both ends' names and the source's place; edges count by their own file."""
    s = _symbols(g, domain)
    source = s.select(F.col("symbol_id").alias("source_id"), F.col("symbol_id"), "name", "kind", "path", "language")
    target = g.symbols.select(F.col("symbol_id").alias("target_id"), F.col("name").alias("target"), F.col("kind").alias("target_kind"))
    return at_end(g.edges.where(F.col("kind").isin(*kinds) & F.col("source_id").isNotNull()).select("source_id", "target_id", F.col("kind").alias("edge_kind")), "target_id", target).join(source, "source_id")


def _of_kind(g: Graph, domain: str, keys: list[str]) -> DataFrame:
    return _symbols(g, domain).where(~paths.search_test(F.col("path"))).groupBy(*keys).agg(F.count("*").alias("total"))


def inheritance(g: Graph, domain: str = "") -> DataFrame:
    """O-C1: (base, kind) over inherits edges outside tests; structural satisfaction in Go isn't inheritance."""
    rows = _ends(g, ("inherits",), domain).where(~paths.search_test(F.col("path")) & ~((F.col("language") == "go") & (F.col("target_kind") == "interface")))
    return emit(rows, ["target", "kind"], _of_kind(g, domain, ["kind"]), ["kind"], "inheritance", F.concat_ws(" ", text.plural(F.col("kind")), F.lit("inherit from"), F.col("target")))


def naming(g: Graph, domain: str = "") -> DataFrame:
    """O-C2: (kind, suffix) of top-level symbols; a suffix is a word of three letters or more."""
    top = _symbols(g, domain).where("parent_id is null").where(~paths.search_test(F.col("path")))
    rows = top.withColumn("suffix", text.suffix(F.col("name"))).where(F.col("suffix").rlike(r"^_?\p{L}{3,}$"))
    return emit(rows, ["kind", "suffix"], top.groupBy("kind").agg(F.count("*").alias("total")), ["kind"], "naming", F.concat_ws(" ", text.plural(F.col("kind")), F.lit("use"), F.concat(F.lit("*"), F.col("suffix"))))


def file_naming(g: Graph, domain: str = "") -> DataFrame:
    """O-C3: (kind, file suffix), counting files."""
    rows = _symbols(g, domain).where("parent_id is null").withColumn("suffix", paths.file_suffix(F.col("path"))).where("suffix <> ''")
    totals = _symbols(g, domain).where("parent_id is null").select("kind", "file_id").distinct().groupBy("kind").agg(F.count("*").alias("total"))
    return emit(rows, ["kind", "suffix"], totals, ["kind"], "naming", F.concat_ws(" ", F.lit("files of"), text.plural(F.col("kind")), F.lit("end in"), F.col("suffix")), unit="file_id")


def structure(g: Graph, domain: str = "") -> DataFrame:
    """O-C4: (kind, directory)."""
    rows = _symbols(g, domain).where("parent_id is null").withColumn("directory", paths.area(F.col("path")))
    totals = rows.groupBy("kind").agg(F.count("*").alias("total"))
    return emit(rows, ["kind", "directory"], totals, ["kind"], "structure", F.concat_ws(" ", text.plural(F.col("kind")), F.lit("live in"), F.concat(F.col("directory"), F.lit("/"))))


def composition(g: Graph, domain: str = "") -> DataFrame:
    """O-C5: (part, kind) over includes and composes edges; all serializers are one part; Go embeds."""
    rows = _ends(g, ("includes", "composes"), domain).where(~paths.search_test(F.col("path")))
    rows = rows.withColumn("part", F.when(F.col("target").endswith("Serializer"), "*Serializer").otherwise(F.col("target"))).withColumn("verb", F.when(F.col("language") == "go", "embed").when(F.col("edge_kind") == "includes", "include").otherwise("compose"))
    return emit(rows, ["part", "kind", "verb"], _of_kind(g, domain, ["kind"]), ["kind"], "composition", F.concat_ws(" ", text.plural(F.col("kind")), F.col("verb"), F.col("part")))


def testing(g: Graph, domain: str = "") -> DataFrame:
    """O-C6: classes of test-file names over the files of tests edges, or over test paths where there are none."""
    files = g.files.where(F.col("path").contains(domain))
    marked = g.edges.where("kind = 'tests'").join(g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("file_id").alias("f")), "source_id").select(F.col("f").alias("file_id")).distinct()
    tests = files.join(marked, "file_id", "left_semi")
    if marked.isEmpty():
        tests = files.where(paths.wire_test(F.col("path")))
    pattern = reduce(lambda c, p: c.when(F.col("path").rlike(p[0]), p[1]), TEST_PATTERNS, F.when(F.lit(False), "")).otherwise("other")
    rows = tests.withColumns({"pattern": pattern, "name": F.element_at(F.split("path", "/"), -1), "one": F.lit(1)})
    totals = tests.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return emit(rows, ["pattern", "one"], totals, ["one"], "testing", F.concat_ws(" ", F.lit("test files are named"), F.col("pattern")), unit="file_id")


def key_types(g: Graph, surfaced: DataFrame, limit: int = 8) -> DataFrame:
    """O-C7: types by inbound edges whose name no earlier detector has shown. surfaced: name."""
    types = g.symbols.where(F.col("kind").isin(*CONTAINERS)).join(surfaced.select("name").distinct(), "name", "left_anti")
    return types.join(in_degree(g.edges), "symbol_id").orderBy(F.desc("in_degree"), "symbol_id").limit(limit).select("symbol_id", "name", "kind", "in_degree")


def service_objects(g: Graph) -> DataFrame:
    """O-C8: classes of one or two methods of which one is an entry verb."""
    verb = F.lower("name").isin(*ENTRY_VERBS)
    per = g.symbols.where(F.col("kind").isin("function", "method") & F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("symbol_id")).agg(F.count("*").alias("methods"), F.bool_or(verb).alias("entry"))
    return g.symbols.where(F.col("kind").isin("class", "struct")).join(per.where("methods <= 2 and entry"), "symbol_id").select("symbol_id", "name", "methods")


def layer_calls(g: Graph) -> DataFrame:
    """from, to, calls of layers that differ."""
    place = g.symbols.select("symbol_id", "file_id").join(g.files.select("file_id", paths.layer(F.col("path")).alias("layer")), "file_id").where("layer <> ''").select("symbol_id", "layer")
    e = g.edges.where("kind = 'calls' and source_id is not null").select("source_id", "target_id")
    a = e.join(place.select(F.col("symbol_id").alias("source_id"), F.col("layer").alias("from")), "source_id").join(place.select(F.col("symbol_id").alias("target_id"), F.col("layer").alias("to")), "target_id")
    return a.where("from <> to").groupBy("from", "to").agg(F.count("*").alias("calls"))


def layer_boundaries(g: Graph) -> DataFrame:
    """O-C9: layer pairs with three calls or more one way and none back."""
    counts = layer_calls(g)
    back = counts.select(F.col("to").alias("from"), F.col("from").alias("to"))
    return counts.where(F.col("calls") >= LEAST).join(back, ["from", "to"], "left_anti")


def external(g: Graph, domain: str) -> DataFrame:
    """O-C10: what a domain depends on outside itself."""
    return coupling(g, LEAST, 5, domain).select(F.lit("external").alias("category"), F.concat(F.lit("depends on "), F.col("qualified")).alias("description"), F.col("sources").alias("instances"), F.lit(0.8).alias("strength"))


def concerns(g: Graph) -> DataFrame:
    """O-C11: modules under concern paths with three includers or more."""
    m = g.symbols.where("kind = 'module'").join(g.files.where(F.col("path").contains("/concerns/")).select("file_id"), "file_id", "left_semi")
    uses = g.edges.where("kind = 'includes' and source_id is not null").select("source_id", "target_id").distinct().groupBy(F.col("target_id").alias("symbol_id")).agg(F.count("*").alias("includers"))
    return m.join(uses, "symbol_id").where(F.col("includers") >= LEAST).select("symbol_id", "name", "includers")


def callbacks(g: Graph) -> DataFrame:
    """O-C12: callback-named methods by the distinct classes that have them."""
    m = g.symbols.where(F.col("name").isin(*RAILS_CALLBACKS) & F.col("parent_id").isNotNull()).select("name", "parent_id").distinct()
    return m.groupBy("name").agg(F.count("*").alias("classes"))


def scopes(g: Graph) -> DataFrame:
    """O-C13: Ruby classes with two methods or more that a class symbol calls."""
    ruby = g.files.where(F.col("path").endswith(".rb")).select("file_id")
    callers = g.symbols.where("kind = 'class'").join(ruby, "file_id", "left_semi").select(F.col("symbol_id").alias("source_id"))
    called = g.edges.where("kind = 'calls'").join(callers, "source_id", "left_semi").select(F.col("target_id").alias("symbol_id")).distinct()
    m = g.symbols.where("kind = 'method' and parent_id is not null").join(called, "symbol_id", "left_semi")
    return m.groupBy(F.col("parent_id").alias("symbol_id")).agg(F.count("*").alias("scopes")).where("scopes >= 2")


def hooks(g: Graph) -> DataFrame:
    """O-C14: functions named use[A-Z] in JavaScript and TypeScript."""
    return _symbols(g).where((F.col("kind") == "function") & F.col("name").rlike("^use[A-Z]") & F.col("path").rlike(r"\.[jt]sx?$")).select("symbol_id", "name", "path")


def go_interfaces(g: Graph) -> DataFrame:
    """O-C15: Go interfaces with two implementors or more."""
    go = g.files.where(F.col("path").endswith(".go")).select("file_id")
    uses = g.edges.where("kind = 'inherits' and source_id is not null").select("source_id", "target_id").distinct().groupBy(F.col("target_id").alias("symbol_id")).agg(F.count("*").alias("implementors")).where("implementors >= 2")
    return g.symbols.where("kind = 'interface'").join(go, "file_id", "left_semi").join(uses, "symbol_id").select("symbol_id", "name", "implementors")


def go_aliases(g: Graph) -> DataFrame:
    """O-C16."""
    return _symbols(g).where((F.col("kind") == "type") & F.col("path").endswith(".go")).select("symbol_id", "name", "path")


def go_middleware(g: Graph) -> DataFrame:
    """O-C17: functions called from symbols named like a router, each name once."""
    routers = g.symbols.where(F.lower("name").rlike("route|router|mux|server")).select(F.col("symbol_id").alias("source_id"))
    called = g.edges.where("kind = 'calls'").join(routers, "source_id", "left_semi").select(F.col("target_id").alias("symbol_id")).distinct()
    return _symbols(g).where((F.col("kind") == "function") & F.col("path").endswith(".go")).join(called, "symbol_id", "left_semi").groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))


def php_tests(g: Graph) -> DataFrame:
    """O-C18: PHP test files with and without a class."""
    files = g.files.where(F.col("path").endswith(".php") & paths.blast_test(F.col("path")))
    boxed = g.symbols.where("kind = 'class'").select("file_id").distinct().withColumn("c", F.lit(True))
    return files.join(boxed, "file_id", "left").groupBy(F.when(F.col("c"), "class").otherwise("function").alias("style")).agg(F.count("*").alias("files"))


def significance(base: Column, language: Column) -> Column:
    """O-C19: framework bases say little, namespaced ones of a project much."""
    return F.when(base.isin(*FRAMEWORK_BASES), 0).when((language == "ruby") & base.contains("::"), 2).otherwise(1)


def kept(found: DataFrame, domain: str = "", strength: float = 0.0, instances: int = 5, ratio: float = 0.10) -> DataFrame:
    """O-C21: prevalent ones; those with an example in the domain and of the least strength, if asked."""
    out = found.where(((F.col("instances") >= instances) | (F.col("strength") >= ratio)) & (F.col("strength") >= strength))
    return out.where(F.exists("examples", lambda x: x.contains(domain))) if domain else out


def ordered(found: DataFrame) -> DataFrame:
    """O-W13: by category, then significance where given, strength and description."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    keys = [rank, *([F.desc("significance")] if "significance" in found.columns else []), F.desc("strength"), "description"]
    return found.orderBy(*keys)


def deduped(found: DataFrame) -> DataFrame:
    """O-C20: one row per category, description and population; different populations under one description are told apart by their first example."""
    one = found.groupBy("category", "description", F.hash("instances", "total", "examples").alias("p")).agg(F.min(F.struct("instances", "total", "strength", "examples")).alias("r"))
    n = F.count("*").over(W.partitionBy("category", "description"))
    named = one.withColumn("description", F.when(n > 1, F.concat_ws(" ", "description", F.concat(F.lit("("), F.coalesce(F.get("r.examples", 0), F.lit("")), F.lit(")")))).otherwise(F.col("description")))
    return named.select("category", "description", "r.*")


def labels(rows: DataFrame) -> DataFrame:
    """O-C22, O-C23: name, qualified, path -> label: the name if it is the only one, else the qualified name, else with its path."""
    once = lambda c, n: rows.groupBy(c).agg(F.count("*").alias(n))
    counted = rows.join(once("name", "by_name"), "name", "left").join(once("qualified", "by_qualified"), "qualified", "left")
    label = F.when(F.col("by_name") == 1, F.col("name")).when(F.col("by_qualified") == 1, F.col("qualified")).otherwise(F.concat_ws(" @ ", "qualified", "path"))
    return counted.select(*rows.columns, label.alias("label"))


def best_examples(rows: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """O-W14, O-C22: name, path once each, by their most depended on symbol, then name and path; the first n."""
    counted = rows.join(in_degree(edges), "symbol_id", "left").groupBy("name", "path").agg(F.max(F.coalesce("in_degree", F.lit(0))).alias("edges"))
    return counted.orderBy(F.desc("edges"), "name", "path").limit(n)


def summary(found: DataFrame) -> str:
    """O-C25: the three labels without dots of most instances. Three rows reach the driver."""
    top = found.where(~F.col("description").contains(".")).orderBy(F.desc("instances"), "description").limit(3).collect()
    return "; ".join(f"{r.description} ({r.instances})" for r in top)


def _count(g: Graph, domain: str, condition: Column | str) -> DataFrame:
    """one, total: how many symbols of the domain fulfil the condition."""
    return _symbols(g, domain).where(condition).agg(F.count("*").alias("total")).withColumn("one", F.lit(1))


def _row(rows: DataFrame, total: DataFrame, category: str, description: str, least: int = LEAST) -> DataFrame:
    """A single convention of what rows (symbol_id, name) hold, in the common form."""
    placed = rows.select("symbol_id", "name").withColumns({"path": F.lit(""), "one": F.lit(1)})
    return emit(placed, ["one"], total, ["one"], category, F.lit(description), least=least)


def design_patterns(g: Graph, domain: str = "") -> DataFrame:
    """O-C8 as a convention, against the classes that have callables."""
    inside = _symbols(g, domain).select("symbol_id")
    boxes = g.symbols.where(F.col("kind").isin("function", "method") & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("symbol_id")).distinct()
    total = _symbols(g, domain).where(F.col("kind").isin("class", "struct")).join(boxes, "symbol_id", "left_semi").agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return _row(service_objects(g).join(inside, "symbol_id", "left_semi"), total, "design-pattern", "classes are service objects with one entry method")


def architecture(g: Graph, domain: str = "") -> DataFrame:
    """O-C9 as conventions, against all calls between layers."""
    inside = g.symbols.join(g.files.where(F.col("path").contains(domain)).select("file_id"), "file_id", "left_semi")
    part = Graph(g.files, inside, g.edges)
    found, total = layer_calls(part), F.sum("calls").over(W.partitionBy())  # one row per pair of layers
    back = found.select(F.col("to").alias("from"), F.col("from").alias("to"))
    one = found.withColumn("total", total).where(F.col("calls") >= LEAST).join(back, ["from", "to"], "left_anti")
    description = F.concat(F.lit("layer "), F.col("from"), F.lit("/ depends on "), F.col("to"), F.lit("/, never back"))
    return one.select(F.lit("architecture").alias("category"), description.alias("description"), F.col("calls").alias("instances"), "total", F.round(F.col("calls") / F.col("total"), 6).alias("strength"), F.array(F.concat("from", F.lit("/")), F.concat("to", F.lit("/"))).alias("examples"))


def idioms(g: Graph, domain: str = "") -> DataFrame:
    """O-C11 to O-C18 as conventions."""
    inside = _symbols(g, domain)
    here = lambda rows: rows.join(inside.select("symbol_id"), "symbol_id", "left_semi")
    classes = lambda: _count(g, domain, "kind = 'class'")
    named = inside.select("symbol_id", "name")
    with_callbacks = inside.where(F.col("name").isin(*RAILS_CALLBACKS) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("symbol_id")).distinct().join(named, "symbol_id")
    parts = [
        _row(with_callbacks, classes(), "framework", "classes use lifecycle callbacks"),
        _row(scopes(g).join(named, "symbol_id"), classes(), "framework", "classes define query scopes"),
        _row(here(hooks(g)), _count(g, domain, "kind = 'function'"), "framework", "functions are hooks named use*"),
        _row(here(go_aliases(g)), _count(g, domain, F.col("kind").isin(*CONTAINERS) & F.col("path").endswith(".go")), "framework", "types are aliases in Go"),
        _row(here(go_middleware(g)), _count(g, domain, (F.col("kind") == "function") & F.col("path").endswith(".go")), "framework", "functions are middleware of routers"),
    ]
    each = lambda rows, n, text_, total: rows.crossJoin(F.broadcast(total)).select(  # noqa: E731 (one row of a total)
        F.lit("framework").alias("category"), F.concat(F.col("name"), F.lit(text_)).alias("description"), F.col(n).alias("instances"), "total", F.round(F.col(n) / F.col("total"), 6).alias("strength"), F.array("name").alias("examples")
    )
    parts.append(each(here(concerns(g)), "includers", " is a concern of several classes", _count(g, domain, "kind = 'module'").drop("one").where("total > 0")))
    parts.append(each(here(go_interfaces(g)), "implementors", " is an interface of several types", _count(g, domain, F.col("kind").isin(*CONTAINERS) & F.col("path").endswith(".go")).drop("one").where("total > 0")))
    styles = php_tests(Graph(g.files.where(F.col("path").contains(domain)), g.symbols, g.edges))
    total = F.sum("files").over(W.partitionBy())  # two rows
    parts.append(styles.withColumn("total", total).where(F.col("files") >= LEAST).select(F.lit("framework").alias("category"), F.concat(F.lit("PHP tests are written in "), F.col("style"), F.lit(" style")).alias("description"), F.col("files").alias("instances"), "total", F.round(F.col("files") / F.col("total"), 6).alias("strength"), F.array("style").alias("examples")))
    return reduce(DataFrame.unionByName, parts)


def key_type_row(g: Graph, surfaced: DataFrame, domain: str = "", limit: int = 8) -> DataFrame:
    """O-C7 as a convention: the most depended on types that no earlier detector has shown."""
    part = Graph(g.files, _symbols(g, domain).select(*g.symbols.columns), g.edges)
    top = key_types(part, surfaced, limit).agg(F.count("*").alias("instances"), F.sort_array(F.collect_list(F.struct((-F.col("in_degree")).alias("d"), "symbol_id", "name"))).alias("t"))
    total = part.symbols.where(F.col("kind").isin(*CONTAINERS)).agg(F.count("*").alias("total"))
    return top.crossJoin(total).where("instances > 0").select(F.lit("key-types").alias("category"), F.lit("types that most depends on").alias("description"), "instances", "total", F.lit(1.0).alias("strength"), F.col("t.name").alias("examples"))  # a row each


def detect(g: Graph, domain: str = "", strength: float = 0.0) -> DataFrame:
    """O-C24: all detectors in the common form, deduplicated, filtered and ordered as the tool does; external ones with a domain only."""
    first = reduce(DataFrame.unionByName, (f(g, domain) for f in (inheritance, naming, file_naming, structure, composition, testing, design_patterns, idioms, architecture)))
    first = settle(first, "conventions")
    shown = g.symbols.where(F.col("kind").isin(*CONTAINERS)).select("name").distinct()
    said = first.where(F.col("category").isin("inheritance", "composition")).select(F.regexp_extract("description", r"^\S+ (?:inherit from|include|compose|embed) (.*)$", 1).alias("name")).distinct()
    parts = [first, key_type_row(g, shown.join(said, "name", "left_semi"), domain)]
    if domain:
        parts.append(external(g, domain).select("category", "description", "instances", F.col("instances").alias("total"), "strength", F.array(F.regexp_replace("description", "^depends on ", "")).alias("examples")))
    return ordered(kept(deduped(reduce(DataFrame.unionByName, parts)), domain, strength))
