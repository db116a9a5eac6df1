"""Unreferenced symbols with explained verdicts (O-D rows, O-J5, O-J6, O-J10).

Candidates come from anti-joins. Reasons to doubt a candidate are rows of a rule table: a code, the languages it speaks for, and a condition
over the candidate's columns and the name sets harvested for its language. The reason of lowest priority number wins, earlier rules on ties;
without any, a symbol is dead only if its language is spoken for, was harvested, and never mentions the name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import paths, text
from graphloom.functions.shared import settle
from graphloom.model import FOLLOWED, SYMBOL_KINDS, Graph

#: Prefixes of qualified names that are never candidates, and reason codes by priority (fixed values).
NOT_CANDIDATES = ("ruby-core:", "route:", "django-related:", "laravel-binding:", "laravel-listen:", "laravel-middleware:")
PRIORITIES = {
    15: "core_name_mentioned core_no_harvest",
    20: "go_init py_dunder rails_callback rails_routing rust_test",
    25: "py_django py_route ruby_service_call ruby_value_object rust_module ts_framework_route",
    30: "core_reflection go_cgo go_interface ls_annotated ls_interface_method py_decorator rails_concern rust_ffi rust_trait_impl rust_used ts_decorator ts_method",
    35: "ruby_module_mixin rust_derive ts_type",
    40: "go_generated ls_dynamic rust_allow_dead ts_jsx",
    45: "go_const ls_reflective_type",
    48: "ts_default_export",
    50: "core_exported_api go_exported py_all_export rust_pub ts_exported",
    55: "ls_public_no_framework py_class py_constant ruby_class ruby_constant ruby_module",
    58: "ls_unvalidated",
    60: "js_dynamic py_public ruby_public_method",
    70: "core_no_language_voice",
}
PRIORITY = {code: p for p, codes in PRIORITIES.items() for code in codes.split()}
#: Entry-point names, callbacks and verbs (fixed values).
RUNNER_NAMES, BUILDERS = ("it", "describe", "specify"), ("initialize", "__init__", "constructor")
CALLBACKS = (
    "before_action after_action around_action before_create after_create before_save after_save before_destroy after_destroy before_update after_update before_validation after_validation "
    "after_commit included class_methods before_commit after_rollback"
).split()
DERIVED = "clone fmt eq ne cmp partial_cmp hash default serialize deserialize".split()
SERVICE_VERBS = ("call",)
LANGSPEC = ("java", "kotlin", "scala", "csharp", "php", "c", "cpp")


def candidates(g: Graph, skip_test_references: bool = True, language: str = "", domain: str = "") -> DataFrame:
    """O-D1, O-J5, O-J6: symbols to which no edge of the reachability kinds leads; references from test files don't count if asked so."""
    e = g.edges.where(F.col("kind").isin(*FOLLOWED["dead"]))
    if skip_test_references:
        e = e.join(g.files.where(paths.dead_sql_test(F.col("path"))).select("file_id"), "file_id", "left_anti")
    s = g.symbols.where(F.col("kind").isin(*SYMBOL_KINDS) & ~text.is_synthetic(F.col("qualified"), NOT_CANDIDATES)).join(g.files.select("file_id", "path", "language"), "file_id")
    s = s.where(~F.col("path").ilike("%.d.ts"))
    if language:
        s = s.where(F.col("language") == language)
    if domain:
        s = s.where(F.col("path").ilike(f"%{domain}%"))
    targets = settle(e.select(F.col("target_id").alias("symbol_id")).distinct(), "targets")  # the optimiser drops a plain distinct() here
    return s.join(targets, "symbol_id", "left_anti")


def alive_by_interface(g: Graph) -> DataFrame:
    """O-D2, O-J10: (parent_id, name) of methods whose interface's method is called."""
    m = g.symbols.where("kind = 'method' and parent_id is not null").select("symbol_id", "name", F.col("parent_id").alias("interface_id"))
    called = m.join(g.edges.where("kind = 'calls'").select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_semi").select("interface_id", "name").distinct()
    kin = g.edges.where("kind = 'inherits' and source_id is not null").select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("interface_id"))
    interfaces = g.symbols.where("kind = 'interface'").select(F.col("symbol_id").alias("interface_id"))
    return kin.join(interfaces, "interface_id", "left_semi").join(called, "interface_id").select("parent_id", "name").distinct()


def live_containers(g: Graph, found: DataFrame) -> DataFrame:
    """O-D3: classes and modules with a child that is no candidate."""
    child = g.symbols.where("parent_id is not null").select("symbol_id", "parent_id").join(found.select("symbol_id"), "symbol_id", "left_anti")
    box = g.symbols.where(F.col("kind").isin("class", "module")).select("symbol_id")
    return box.join(child.select(F.col("parent_id").alias("symbol_id")), "symbol_id", "left_semi")


def is_entry_point(name: Column, path: Column) -> Column:
    """O-D4: program, test and construction entries, and anything in a test or fixture file."""
    runner = paths.starts_any(name, ("Test", "test_", "Benchmark")) | name.isin(*RUNNER_NAMES)
    return name.isin("main", "Main") | runner | name.isin(*BUILDERS) | paths.dead_test(path)


def unreferenced(g: Graph, skip_test_references: bool = True, language: str = "", domain: str = "") -> DataFrame:
    """O-D1 to O-D5: candidates less interface implementors, live containers, entry points, and children of dead containers."""
    found = settle(candidates(g, skip_test_references, language, domain), "candidates")
    found = found.join(alive_by_interface(g), ["parent_id", "name"], "left_anti")
    found = found.join(live_containers(g, found), "symbol_id", "left_anti")
    tested = g.edges.where("kind = 'tests'").join(g.symbols.where("kind <> 'constant'").select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi")
    found = found.where(~is_entry_point(F.col("name"), F.col("path"))).join(tested.select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_anti")
    found = settle(found, "candidates")
    box = found.where(F.col("kind").isin("class", "module")).select(F.col("symbol_id").alias("parent_id"))
    return found.join(box, "parent_id", "left_anti")


@dataclass(frozen=True)
class Rule:
    code: str
    languages: tuple[str, ...]
    when: Callable[[], Column]


def _has(*sets: str) -> Column:
    return F.arrays_overlap("_sets", F.array(*map(F.lit, sets)))


def _public() -> Column:
    return F.col("visibility") == "public"


def _open() -> Column:
    return _public() | (F.coalesce("visibility", F.lit("")) == "")


def _kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _api() -> Column:
    """O-D8: a library's public callable or type."""
    return F.col("_library") & _public() & _kind("function", "method", "class", "type", "interface")


_TS, _ANY = ("typescript", "javascript"), ()
#: O-D8 to O-D14. Order matters among equal priorities; a language's later rules hold only where its earlier ones don't.
RULES = [
    Rule("core_reflection", _ANY, lambda: _has("dispatch")),
    Rule("core_exported_api", _ANY, _api),
    Rule("ruby_value_object", ("ruby",), lambda: _kind("method") & F.col("_value_object")),
    Rule("ruby_service_call", ("ruby",), lambda: _kind("method") & F.col("name").isin(*SERVICE_VERBS)),
    Rule("ruby_module_mixin", ("ruby",), lambda: _kind("method") & F.col("_included_parent")),
    Rule("ruby_public_method", ("ruby",), lambda: _kind("method", "function") & _open()),
    Rule("ruby_class", ("ruby",), lambda: _kind("class")),
    Rule("ruby_module", ("ruby",), lambda: _kind("module")),
    Rule("ruby_constant", ("ruby",), lambda: _kind("constant")),
    Rule("rails_concern", ("ruby",), lambda: F.col("_rails") & _kind("method") & F.col("_concern_parent")),
    Rule("rails_routing", ("ruby",), lambda: F.col("_rails") & ((_kind("class") & F.col("name").endswith("Controller")) | (_kind("method") & ~F.coalesce("visibility", F.lit("")).isin("private", "protected") & F.col("qualified").rlike("Controller[#.][^#.]*$")))),
    Rule("rails_callback", ("ruby",), lambda: F.col("_rails") & F.col("name").isin(*CALLBACKS)),
    Rule("go_init", ("go",), lambda: _kind("function") & (F.col("name") == "init")),
    Rule("go_interface", ("go",), lambda: _kind("method") & _has("interface_methods")),
    Rule("go_cgo", ("go",), lambda: _has("cgo_exports")),
    Rule("go_generated", ("go",), lambda: F.col("path").rlike(r"(\.pb|_gen|\.gen|_generated|zz_generated[^/]*)\.go$")),
    Rule("go_exported", ("go",), lambda: _public() & ~_api()),
    Rule("go_const", ("go",), lambda: ~_public() & ~_kind("function", "method", "type", "class", "interface")),
    Rule("py_dunder", ("python",), lambda: F.col("name").rlike("^__.+__$")),
    Rule("py_route", ("python",), lambda: _has("routes")),
    Rule("py_django", ("python",), lambda: _has("django")),
    Rule("py_decorator", ("python",), lambda: _has("decorated")),
    Rule("py_all_export", ("python",), lambda: _has("all_exports")),
    Rule("py_class", ("python",), lambda: _kind("class")),
    Rule("py_constant", ("python",), lambda: _kind("constant")),
    Rule("py_public", ("python",), lambda: (_kind("function", "method") & _open()) | ~_kind("function", "method", "class", "constant")),
    Rule("rust_allow_dead", ("rust",), lambda: _has("allow_dead")),
    Rule("rust_test", ("rust",), lambda: _has("test_symbols")),
    Rule("rust_used", ("rust",), lambda: _has("exports") & _kind("constant")),
    Rule("rust_ffi", ("rust",), lambda: _has("exports") & ~_kind("constant")),
    Rule("rust_trait_impl", ("rust",), lambda: _kind("method") & _has("trait_methods", "interface_methods")),
    Rule("rust_derive", ("rust",), lambda: _kind("method") & F.col("name").isin(*DERIVED)),
    Rule("rust_module", ("rust",), lambda: _kind("module")),
    Rule("rust_pub", ("rust",), lambda: _public() & ~_api()),
    Rule("ts_decorator", _TS, lambda: _has("decorated")),
    Rule("ts_framework_route", _TS, lambda: _public() & F.col("path").rlike(r"(^|/)(pages/.*|app/(.*/)?(page|layout|route|loading|error|template|not-found))\.[jt]sx?$")),
    Rule("ts_jsx", _TS, lambda: _public() & _kind("function", "class") & F.col("name").rlike("^[A-Z]") & F.col("path").rlike(r"\.[jt]sx$")),
    Rule("ts_default_export", _TS, lambda: _public() & ~_api() & _has("default_exports")),
    Rule("ts_exported", _TS, lambda: _public() & ~_api() & ~_has("default_exports")),
    Rule("js_dynamic", ("javascript",), lambda: ~_public()),
    Rule("ts_method", ("typescript",), lambda: ~_public() & _kind("method")),
    Rule("ts_type", ("typescript",), lambda: ~_public() & _kind("interface", "type", "module")),
    Rule("ls_annotated", LANGSPEC, lambda: _has("annotated")),
    Rule("ls_interface_method", LANGSPEC, lambda: _kind("method") & _has("interface_methods")),
    Rule("ls_public_no_framework", LANGSPEC, lambda: (_open() & ~_api()) | (~_open() & _kind("function", "method") & (F.col("visibility") != "private"))),
    Rule("ls_reflective_type", LANGSPEC, lambda: ~_open() & ~_kind("function", "method")),
    Rule("ls_dynamic", ("php",), lambda: _kind("function", "method") & (F.col("visibility") == "private")),
    Rule("ls_unvalidated", tuple(x for x in LANGSPEC if x not in ("php", "java")), lambda: _kind("function", "method") & (F.col("visibility") == "private")),
]
SPOKEN = tuple(sorted({x for r in RULES for x in r.languages}))
#: Rules of a language in which the first that holds is the only one raised (its voice says one thing); the core and framework voices are their own.
VOICES = ("core", "rails", "ruby", "go", "py", "rust", "ts", "ls")


def facts(g: Graph, found: DataFrame, names: DataFrame, frameworks: DataFrame) -> DataFrame:
    """O-D6: candidates with what the rules ask. names: language, set, name (set 'mentions' and 'harvest' included); frameworks: name."""
    per_name = names.where("set not in ('mentions', 'harvest')").groupBy("language", "name").agg(F.collect_set("set").alias("_sets"))
    mentioned = names.where("set = 'mentions'").select("language", "name").distinct().withColumn("_mentioned", F.lit(True))
    harvested = names.where("set in ('mentions', 'harvest')").groupBy("language").agg((F.count_if(F.col("set") == "mentions") == 0).alias("_none"))
    included = g.edges.where("kind = 'includes'").join(g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("name").alias("includer")), "source_id", "left")
    mixin = included.groupBy(F.col("target_id").alias("parent_id")).agg(F.coalesce(F.bool_or(F.col("includer").endswith("Controller")), F.lit(False)).alias("_concern"))
    value = g.symbols.where("kind = 'class'").select(F.col("symbol_id").alias("parent_id"), F.col("name").rlike("(Result|Value|Response|Outcome)$").alias("_value"))
    out = found.join(per_name, ["language", "name"], "left").join(mentioned, ["language", "name"], "left").join(harvested, "language", "left").join(mixin, "parent_id", "left").join(value, "parent_id", "left")
    rails = not frameworks.where("name = 'Rails'").isEmpty()
    library = frameworks.isEmpty() and g.symbols.where("name in ('main', 'Main') and kind = 'function'").isEmpty()
    return out.withColumns({
        "_sets": F.coalesce("_sets", F.array().cast("array<string>")), "_mentioned": F.coalesce("_mentioned", F.lit(False)), "_included_parent": F.col("_concern").isNotNull(), "_concern_parent": F.coalesce("_concern", F.lit(False)),
        "_value_object": F.coalesce("_value", F.lit(False)), "_rails": F.lit(rails), "_library": F.lit(library),
    })


def verdicts(known: DataFrame) -> DataFrame:
    """O-D7: symbol_id, qualified, kind, path, language, verdict, reason."""
    raised = []
    for voice in VOICES:
        rules = [r for r in RULES if r.code.partition("_")[0] in ((voice, "js") if voice == "ts" else (voice,))]
        says = F.when(F.lit(False), F.lit(None).cast("struct<p:int,o:int,code:string>"))
        for r in rules:
            hand = F.struct(F.lit(PRIORITY[r.code]).alias("p"), F.lit(RULES.index(r)).alias("o"), F.lit(r.code).alias("code"))
            says = says.when((F.col("language").isin(*r.languages) if r.languages else F.lit(True)) & F.coalesce(r.when(), F.lit(False)), hand)
        raised.append(says)
    best = F.array_min(F.array_compact(F.array(*raised)))["code"]
    gate = F.when(~F.col("language").isin(*SPOKEN), "core_no_language_voice").when(F.col("_none").isNull(), "core_no_harvest").when(F.col("_none") | F.col("_mentioned"), "core_name_mentioned")
    out = known.withColumn("reason", F.coalesce(best, gate)).withColumn("verdict", F.when(F.col("reason").isNull(), "dead").otherwise("possibly_dead"))
    return out.select("symbol_id", "qualified", "kind", "path", "line_start", "language", "verdict", "reason")


def grouped(found: DataFrame) -> DataFrame:
    """O-D15: possibly dead ones by reason, most removable reason first."""
    priority = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    per = found.where("verdict = 'possibly_dead'").groupBy("reason").agg(F.count("*").alias("symbols"), F.min("qualified").alias("first"))
    return per.withColumn("priority", priority[F.col("reason")]).orderBy(F.desc("priority"), "reason")


def shown(found: DataFrame, limit: int = 100) -> DataFrame:
    """O-W12: dead ones all stay; of the others, by reason, as many as are left of the limit. limit - dead rows at most are ranked."""
    dead = found.where("verdict = 'dead'")
    left = max(0, limit - dead.count())
    priority = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    rest = found.where("verdict <> 'dead'").withColumn("_p", priority[F.col("reason")]).orderBy(F.desc("_p"), "reason", "path", "line_start", "symbol_id").limit(left).drop("_p")
    return dead.unionByName(rest)


def precision(found: DataFrame, oracle: DataFrame) -> DataFrame:
    """O-D16, O-Q13: dead verdicts against another tool's (path, name): agreed, false alarms, missed."""
    dead = found.where("verdict = 'dead'").select("path", text.leaf(F.col("qualified")).alias("name")).distinct()
    both = dead.withColumn("ours", F.lit(1)).join(oracle.select("path", "name").distinct().withColumn("theirs", F.lit(1)), ["path", "name"], "full")
    return both.agg(F.count_if(F.col("ours").isNotNull() & F.col("theirs").isNotNull()).alias("agreed"), F.count_if(F.col("theirs").isNull()).alias("false_dead"), F.count_if(F.col("ours").isNull()).alias("missed"))


def ranks(found: DataFrame) -> DataFrame:
    """Dead ones in (path, line) order within their file."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy("line_start", "symbol_id")))
