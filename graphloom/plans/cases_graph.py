"""Queries over the projected graph: neighbourhoods, impact, dead code, conventions, derived edges (2.8 to 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.model import CONTAINERS
from graphloom.operators import blast as bl
from graphloom.operators import conventions as cv
from graphloom.operators import dead as dd
from graphloom.operators import derive as dv
from graphloom.operators import graph as gr
from graphloom.plans.cases_core import AREA, TEST_LIKE
from graphloom.sources import projection as pj

QUERIES, ORACLE_SQL = {}, {}


def case(name: str, sql: str | None = None, extra: str = "", variant: bool = False):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f((pj.variant if variant else pj.graph)(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {pj.VARIANT_SQL if variant else pj.SQL}{extra} {sql}"
        return f

    return put


_BUCKET = """CASE WHEN e.kind IN ('calls','references') THEN CASE WHEN side = 'out' THEN 'calls' ELSE 'called_by' END WHEN e.kind = 'inherits' THEN CASE WHEN side = 'out' THEN 'inherits' ELSE 'inherited_by' END
 WHEN e.kind = 'composes' THEN CASE WHEN side = 'out' THEN 'composes' ELSE 'composed_by' END END"""
_NEAR = ", near AS (SELECT source_id AS root_id, target_id AS other_id, kind, confidence, 'out' AS side FROM edges UNION ALL SELECT target_id, source_id, kind, confidence, 'in' FROM edges)"


@case("G4_neighbourhood", "SELECT root_id, other_id, e.kind, confidence, side, qualified AS other FROM near e JOIN symbols ON symbol_id = other_id", _NEAR)
def _(g, spark, sf):
    return gr.neighbourhood(g, g.symbols)


@case(
    "G8_categories",
    f"SELECT root_id, {_BUCKET} AS bucket, count(*) FILTER (NOT (e.kind IN ('calls','references') AND confidence < 0.95)) AS shown, count(*) FILTER (e.kind IN ('calls','references') AND confidence < 0.95) AS hidden, CASE WHEN count(*) FILTER (e.kind IN ('calls','references') AND confidence < 0.95) = 0 THEN 'complete' ELSE 'partial' END AS completeness FROM near e GROUP BY 1, 2",
    _NEAR,
)
def _(g, spark, sf):
    return gr.categories(gr.neighbourhood(g, g.symbols), 0.95)


@case("G1_lookup", "SELECT symbol_id, name, qualified, s.kind, path, line_start, 'suffix' AS resolution, 0 AS distance FROM symbols s JOIN files USING (file_id) WHERE ends_with(lower(qualified), '001#order13') AND FALSE UNION ALL SELECT symbol_id, name, qualified, s.kind, path, line_start, 'name', 0 FROM symbols s JOIN files USING (file_id) WHERE name = 'order13'")
def _(g, spark, sf):
    return gr.lookup(g, "order13")


@case("J17_fuzzy", "SELECT symbol_id, name, qualified, s.kind, path, line_start, 'fuzzy' AS resolution, levenshtein(lower(qualified), 'suplier#00000007')::INT AS distance FROM symbols s JOIN files USING (file_id) WHERE levenshtein(lower(qualified), 'suplier#00000007') <= 2 ORDER BY distance, qualified, symbol_id LIMIT 5")
def _(g, spark, sf):
    return gr.lookup(g, "Suplier#00000007")


def _hops(n: int, seeds: str = "x.symbol_id = 3000000007", least: float = 0.5, frontier: int = 500) -> str:
    """Reverse steps unrolled from one seed, with the visited set and the frontier's cap."""
    parts = [f", e AS (SELECT source_id, target_id, kind, confidence FROM edges WHERE confidence >= 0.1), fan AS (SELECT target_id, count(*) AS fan FROM e GROUP BY 1), r0 AS (SELECT s.symbol_id, 0 AS hop, 1.0::DOUBLE AS c, NULL::VARCHAR AS kind, NULL::BIGINT AS via FROM symbols s JOIN symbols x ON {seeds} AND s.qualified = x.qualified AND s.kind = x.kind), v0 AS (SELECT * FROM r0)"]
    for k in range(1, n + 1):
        parts.append(
            f", s{k} AS (SELECT source_id AS symbol_id, e.kind, round(r.c * confidence * CASE e.kind WHEN 'inherits' THEN 0.7 WHEN 'composes' THEN 0.5 ELSE 1 END, 12) AS c, target_id FROM e JOIN r{k - 1} r ON target_id = r.symbol_id)"
            f", b{k} AS (SELECT symbol_id, {k} AS hop, c, kind, target_id AS via FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY c DESC, target_id, kind) AS n FROM s{k} WHERE c >= CASE WHEN kind IN ('inherits','composes') THEN {min(0.2, least)} ELSE {least} END) WHERE n = 1 AND symbol_id NOT IN (SELECT symbol_id FROM v{k - 1}))"
            f", r{k} AS (SELECT b.* FROM b{k} b LEFT JOIN fan ON fan.target_id = b.symbol_id QUALIFY row_number() OVER (ORDER BY c DESC, coalesce(fan, 0) DESC, symbol_id) <= {frontier})"
            f", v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM r{k})"
        )
    return "".join(parts)


@case("G13_blast_reach", "SELECT symbol_id, hop, round(c, 6) AS confidence FROM v3", _hops(3))
def _(g, spark, sf):
    return bl.reach(g, g.symbols.where("symbol_id = 3000000007"), bl.ENGINE).select("symbol_id", "hop", F.round("confidence", 6).alias("confidence"))


@case(
    "G20_blast_risk",
    "SELECT 3000000007::BIGINT AS seed, count(*) FILTER (hop = 1) AS direct, count(*) FILTER (hop > 1) AS indirect, count(*) FILTER (ends_with(path, '_test.go')) AS in_tests, count(*) AS total, CASE WHEN count(*) FILTER (hop = 1) >= 10 THEN 'high' WHEN count(*) FILTER (hop = 1) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM v3 JOIN symbols USING (symbol_id) JOIN files USING (file_id) WHERE hop > 0",
    _hops(3),
)
def _(g, spark, sf):
    return bl.risk(bl.affected(g, bl.reach(g, g.symbols.where("symbol_id = 3000000007"), bl.ENGINE)))


@case(
    "W5_blast_capped",
    "SELECT symbol_id, hop, row_number() OVER (ORDER BY ends_with(path, '_test.go'), c DESC, (hop <= 1) DESC, coalesce(fan, 0) DESC, symbol_id)::INT AS rank FROM v2 JOIN symbols s USING (symbol_id) JOIN files USING (file_id) LEFT JOIN (SELECT target_id, count(*) AS fan FROM edges GROUP BY 1) ON target_id = symbol_id WHERE hop > 0 QUALIFY rank <= 100",
    _hops(2),
)
def _(g, spark, sf):
    rows = bl.affected(g, bl.reach(g, g.symbols.where("symbol_id = 3000000007"), bl.Options(2)))
    return bl.capped(rows, g.edges, 100).select("symbol_id", "hop", "rank")


@case(
    "G5_bfs",
    "SELECT symbol_id, min(hop) AS hop FROM b GROUP BY 1",
    ", b AS (SELECT 1000000005::BIGINT AS symbol_id, 0 AS hop UNION SELECT CASE WHEN e.source_id = b.symbol_id THEN e.target_id ELSE e.source_id END, hop + 1 FROM b JOIN edges e ON e.source_id = b.symbol_id OR e.target_id = b.symbol_id WHERE hop < 2 AND e.kind <> 'temporal')",
)
def _(g, spark, sf):
    return gr.bfs(g, g.symbols.where("symbol_id = 1000000005"), 2, cap=1_000_000).select("symbol_id", "hop")


_CONTAINERS = "kind IN ('class','module','interface','type')"
_FOLD = f""", m AS (SELECT s.symbol_id AS member, s.parent_id AS root_id FROM symbols s JOIN symbols r ON r.symbol_id = s.parent_id WHERE r.{_CONTAINERS}),
 u AS (SELECT source_id, target_id FROM edges WHERE kind IN ('calls','references') AND confidence >= 0.5),
 f AS (SELECT root_id, source_id AS symbol_id, min(target_id) AS member FROM u JOIN m ON target_id = member GROUP BY 1, 2),
 k AS (SELECT * FROM f WHERE symbol_id <> root_id AND (root_id, symbol_id) NOT IN (SELECT (root_id, member) FROM m)),
 d AS (SELECT target_id AS root_id, count(DISTINCT source_id) AS direct FROM u GROUP BY 1)"""


@case("G6_member_callers", "SELECT k.* FROM k WHERE root_id NOT IN (SELECT root_id FROM (SELECT root_id, count(*) AS n FROM k GROUP BY 1) JOIN d USING (root_id) WHERE direct >= 3 AND n < 5 * direct)", _FOLD, variant=True)
def _(g, spark, sf):
    return gr.member_callers(g, g.symbols.where(F.col("kind").isin(*CONTAINERS)))


@case(
    "G7_member_callees",
    "SELECT root_id, target_id AS symbol_id, min(source_id) AS member FROM edges JOIN m ON source_id = member WHERE kind IN ('calls','references') AND target_id <> root_id AND root_id NOT IN (SELECT source_id FROM edges WHERE kind IN ('calls','references')) AND (root_id, target_id) NOT IN (SELECT (root_id, member) FROM m) GROUP BY 1, 2",
    _FOLD,
)
def _(g, spark, sf):
    return gr.member_callees(g, g.symbols.where(F.col("kind").isin(*CONTAINERS)))


@case("G11_also_called_by", "SELECT source_id AS root_id, target_id AS callee_id, n - 1 AS others FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'calls') JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM edges WHERE kind = 'calls' GROUP BY 1) USING (target_id) WHERE n BETWEEN 2 AND 21")
def _(g, spark, sf):
    return gr.also_called_by(g, g.symbols)


@case(
    "G28_carriers",
    "SELECT symbol_id, min(level) AS level FROM c GROUP BY 1",
    ", c AS (SELECT 1000000003::BIGINT AS symbol_id, 0 AS level UNION SELECT source_id, level + 1 FROM c JOIN edges ON target_id = symbol_id AND kind IN ('composes','includes'))",
)
def _(g, spark, sf):
    return bl.carriers(g, g.symbols.where("symbol_id = 1000000003")).select("symbol_id", "level")


@case("G30_junk_interfaces", "SELECT symbol_id FROM symbols WHERE FALSE")
def _(g, spark, sf):
    return bl.junk_interfaces(g)


@case("G22_groups", "SELECT DISTINCT target_id AS seed, source_id AS symbol_id, 'via_composition' AS \"group\" FROM edges WHERE kind = 'composes' AND target_id = 1000000003")
def _(g, spark, sf):
    rows = bl.affected(g, bl.reach(g, g.symbols.where("symbol_id = 1000000003"), bl.Options(1, 0.3, 200)))
    return bl.groups(rows, g)


@case("G27_parents", "SELECT DISTINCT 3000000007::BIGINT AS seed, parent_id AS symbol_id FROM v1 JOIN symbols USING (symbol_id) WHERE hop > 0 AND parent_id IS NOT NULL AND parent_id NOT IN (SELECT symbol_id FROM v1)", _hops(1))
def _(g, spark, sf):
    return bl.parents(bl.affected(g, bl.reach(g, g.symbols.where("symbol_id = 3000000007"), bl.Options(1, 0.5, 200))), g)


@case(
    "G33_diff",
    """SELECT symbol_id, count(*) AS seeds FROM (SELECT seed, symbol_id FROM (SELECT x.symbol_id AS seed, e.source_id AS symbol_id, max(confidence) AS c FROM symbols x JOIN symbols s ON s.qualified = x.qualified AND s.kind = x.kind JOIN edges e ON target_id = s.symbol_id
 WHERE x.symbol_id BETWEEN 3000000001 AND 3000000005 AND confidence >= 0.5 GROUP BY 1, 2) LEFT JOIN (SELECT target_id, count(*) AS fan FROM edges GROUP BY 1) ON target_id = symbol_id QUALIFY row_number() OVER (PARTITION BY seed ORDER BY c DESC, coalesce(fan, 0) DESC, symbol_id) <= 500) GROUP BY 1""",
)
def _(g, spark, sf):
    rows = bl.affected(g, bl.reach(g, g.symbols.where("symbol_id between 3000000001 and 3000000005"), bl.Options(1)))
    return bl.merged(rows, bl.risk(rows))[0].select("symbol_id", "seeds")


_CAND = f""", refs AS (SELECT target_id FROM edges e WHERE kind IN ('calls','composes','includes','inherits','references') AND NOT EXISTS (FROM files f WHERE f.file_id = e.file_id AND ({TEST_LIKE.format('f.path')}))),
 cand AS (SELECT s.*, f.path, f.language FROM symbols s JOIN files f USING (file_id) WHERE symbol_id NOT IN (SELECT target_id FROM refs)),
 live AS (SELECT DISTINCT parent_id AS symbol_id FROM symbols WHERE parent_id IS NOT NULL AND symbol_id NOT IN (SELECT symbol_id FROM cand)),
 kept AS (SELECT * FROM cand WHERE NOT (kind IN ('class','module') AND symbol_id IN (FROM live)) AND NOT contains(path, '_test.') AND name NOT IN ('main','Main')),
 rolled AS (SELECT * FROM kept WHERE parent_id IS NULL OR parent_id NOT IN (SELECT symbol_id FROM kept WHERE kind IN ('class','module')))"""


@case("D1_candidates", "SELECT symbol_id, qualified, kind, path, language FROM cand", _CAND)
def _(g, spark, sf):
    return dd.candidates(g).select("symbol_id", "qualified", "kind", "path", "language")


@case("D3_live_containers", "SELECT symbol_id FROM live", _CAND)
def _(g, spark, sf):
    return dd.live_containers(g, dd.candidates(g))


@case("D5_unreferenced", "SELECT symbol_id, qualified, kind FROM rolled", _CAND)
def _(g, spark, sf):
    return dd.unreferenced(g).select("symbol_id", "qualified", "kind")


_VERDICT = _CAND + """, judged AS (SELECT symbol_id, language, CASE
 WHEN language = 'go' AND visibility = 'public' THEN 'go_exported'
 WHEN language = 'ruby' AND kind = 'class' THEN 'ruby_class' WHEN language = 'ruby' AND kind IN ('method','function') AND visibility = 'public' THEN 'ruby_public_method'
 WHEN language = 'python' AND kind = 'class' THEN 'py_class' WHEN language = 'python' AND (visibility = 'public' OR kind = 'interface') THEN 'py_public'
 WHEN language = 'typescript' AND visibility = 'public' THEN 'ts_exported' WHEN language = 'typescript' AND kind = 'method' THEN 'ts_method'
 WHEN language = 'java' AND visibility = 'public' THEN 'ls_public_no_framework'
 WHEN language IN ('ruby','python','java') AND name IN ('order1','order2','order3') THEN 'core_name_mentioned' WHEN language = 'go' THEN 'core_no_harvest' END AS reason FROM rolled)"""


def _names(g):
    """Mentions of order1 to order3 in every language but Go, which was not harvested."""
    mentions = g.symbols.where("name in ('order1', 'order2', 'order3')").select("name").distinct()
    langs = g.files.where("language <> 'go'").select("language").distinct()
    return langs.join(mentions.withColumn("set", F.lit("mentions")), F.col("set").isNotNull())


@case("D7_verdicts", "SELECT language, CASE WHEN reason IS NULL THEN 'dead' ELSE 'possibly_dead' END AS verdict, reason, count(*) AS n FROM judged GROUP BY ALL", _VERDICT)
def _(g, spark, sf):
    known = dd.facts(g, dd.unreferenced(g), _names(g), spark.createDataFrame([("Gin",)], "name string"))
    return dd.verdicts(known).groupBy("language", "verdict", "reason").agg(F.count("*").alias("n"))


@case("D15_grouped", "SELECT reason, count(*) AS symbols FROM judged WHERE reason IS NOT NULL GROUP BY 1", _VERDICT)
def _(g, spark, sf):
    known = dd.facts(g, dd.unreferenced(g), _names(g), spark.createDataFrame([("Gin",)], "name string"))
    return dd.grouped(dd.verdicts(known)).select("reason", "symbols")


@case(
    "C1_inheritance",
    f"""SELECT 'inheritance' AS category, CASE s.kind WHEN 'class' THEN 'classes' ELSE s.kind || 's' END || ' inherit from ' || t.name AS description, count(DISTINCT source_id) AS instances,
 (SELECT count(*) FROM symbols x JOIN files y USING (file_id) WHERE x.kind = s.kind AND NOT contains(y.path, '_test.')) AS total
 FROM edges e JOIN symbols s ON source_id = s.symbol_id JOIN files f ON f.file_id = s.file_id JOIN symbols t ON target_id = t.symbol_id
 WHERE e.kind = 'inherits' AND NOT contains(f.path, '_test.') AND NOT (f.language = 'go' AND t.kind = 'interface') GROUP BY t.name, s.kind HAVING count(DISTINCT source_id) >= 3""",
)
def _(g, spark, sf):
    return cv.inheritance(g).select("category", "description", "instances", "total")


@case("C4_structure", f"SELECT CASE kind WHEN 'class' THEN 'classes' ELSE kind || 's' END || ' live in ' || {AREA.format('path')} || '/' AS description, count(*) AS instances, sum(count(*)) OVER (PARTITION BY kind)::BIGINT AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS strength FROM symbols JOIN files USING (file_id) WHERE parent_id IS NULL GROUP BY kind, {AREA.format('path')} QUALIFY instances >= 3")
def _(g, spark, sf):
    return cv.structure(g).select("description", "instances", "total", "strength")


@case("C5_composition", "SELECT CASE s.kind WHEN 'class' THEN 'classes' END || CASE WHEN f.language = 'go' THEN ' embed ' ELSE ' compose ' END || t.name AS description, count(DISTINCT source_id) AS instances FROM edges e JOIN symbols s ON source_id = s.symbol_id JOIN files f ON f.file_id = s.file_id JOIN symbols t ON target_id = t.symbol_id WHERE e.kind = 'composes' AND NOT contains(f.path, '_test.') GROUP BY t.name, s.kind, CASE WHEN f.language = 'go' THEN ' embed ' ELSE ' compose ' END HAVING count(DISTINCT source_id) >= 3")
def _(g, spark, sf):
    return cv.composition(g).select("description", "instances")


@case("C3_file_naming", "SELECT 'files of ' || CASE kind WHEN 'class' THEN 'classes' ELSE kind || 's' END || ' end in ' || regexp_extract(path, '(_[^_/]*[.][^/.]+)$', 1) AS description, count(DISTINCT file_id) AS instances FROM symbols JOIN files USING (file_id) WHERE parent_id IS NULL AND regexp_matches(path, '_[^_/]*[.][^/.]+$') GROUP BY kind, regexp_extract(path, '(_[^_/]*[.][^/.]+)$', 1) HAVING count(DISTINCT file_id) >= 3")
def _(g, spark, sf):
    return cv.file_naming(g).select("description", "instances")


@case("C6_testing", "SELECT 'testing' AS category, 'test files are named *_test.go' AS description, count(*) AS instances, count(*) AS total FROM files WHERE contains(path, '_test.')")
def _(g, spark, sf):
    return cv.testing(g).select("category", "description", "instances", "total")


@case(
    "C7_key_types",
    "SELECT symbol_id, name, s.kind, count(*) AS in_degree FROM symbols s JOIN edges ON target_id = symbol_id WHERE s.kind IN ('class','module','interface','type') AND name NOT IN (SELECT t.name FROM edges e JOIN symbols t ON t.symbol_id = e.target_id WHERE e.kind = 'composes' GROUP BY 1 HAVING count(DISTINCT source_id) >= 3) GROUP BY ALL ORDER BY in_degree DESC, symbol_id LIMIT 8",
)
def _(g, spark, sf):
    shown = g.edges.where("kind = 'composes'").groupBy("target_id").agg(F.countDistinct("source_id").alias("n")).where("n >= 3")
    return cv.key_types(g, shown.join(g.symbols, F.col("target_id") == F.col("symbol_id")).select("name"))


@case("C8_service_objects", "SELECT s.symbol_id, s.name, count(*) AS methods FROM symbols s JOIN symbols m ON m.parent_id = s.symbol_id WHERE s.kind = 'class' GROUP BY ALL HAVING count(*) <= 2 AND bool_or(m.name = 'call')")
def _(g, spark, sf):
    return cv.service_objects(g)


_LAYER = ", l AS (SELECT symbol_id, split_part(path, '/', 2) AS layer FROM symbols JOIN files USING (file_id)), c AS (SELECT a.layer AS \"from\", b.layer AS \"to\", count(*) AS calls FROM edges e JOIN l a ON source_id = a.symbol_id JOIN l b ON target_id = b.symbol_id WHERE e.kind = 'calls' AND a.layer <> b.layer GROUP BY ALL)"


@case("C9_layers", "SELECT * FROM c WHERE calls >= 3 AND NOT EXISTS (FROM c d WHERE d.\"from\" = c.\"to\" AND d.\"to\" = c.\"from\")", _LAYER)
def _(g, spark, sf):
    return cv.layer_boundaries(g)


@case("C15_go_interfaces", "SELECT symbol_id, name, count(DISTINCT source_id) AS implementors FROM symbols s JOIN edges e ON target_id = symbol_id WHERE s.kind = 'interface' AND e.kind = 'inherits' GROUP BY ALL HAVING count(DISTINCT source_id) >= 2")
def _(g, spark, sf):
    return cv.go_interfaces(g)


_CO = ", f AS (SELECT commit_id, path, split_part(path, '/', 1) AS d FROM commits), n AS (SELECT path, count(*) AS n FROM f GROUP BY 1)"


@case(
    "R17_co_changes",
    "SELECT a.path AS a, b.path AS b, count(*) AS pairs, round(count(*) / greatest(max(x.n), max(y.n)), 6) AS strength FROM f a JOIN f b ON a.commit_id = b.commit_id AND a.path < b.path AND a.d <> b.d JOIN n x ON x.path = a.path JOIN n y ON y.path = b.path GROUP BY 1, 2 HAVING count(*) >= 3",
    f", {pj.COMMITS_SQL}{_CO}",
)
def _(g, spark, sf):
    return dv.co_changes(pj.commits(spark, sf))


@case("R12_mixins", "SELECT DISTINCT a.source_id, b.target_id, 'composes' AS kind FROM edges a JOIN symbols s ON a.source_id = s.symbol_id AND s.kind = 'class' JOIN edges b ON b.source_id = a.target_id AND b.kind = 'composes' WHERE a.kind = 'calls' AND a.source_id <> b.target_id")
def _(g, spark, sf):
    return dv.mixins(g).select("source_id", "target_id", "kind")


@case("R5_ancestry", "SELECT symbol_id, ancestor_id, min(depth) AS depth FROM a GROUP BY 1, 2", ", a AS (SELECT source_id AS symbol_id, target_id AS ancestor_id, 1 AS depth FROM edges WHERE kind IN ('inherits','includes') UNION SELECT symbol_id, target_id, depth + 1 FROM a JOIN edges ON source_id = ancestor_id AND kind IN ('inherits','includes') WHERE depth < 16)")
def _(g, spark, sf):
    return dv.ancestry(g)


_RESOLVED = """, p AS (SELECT source_id, target_id, e.file_id, f.language, contains(path, '_test.') AS t, s.qualified AS target FROM edges e JOIN files f USING (file_id) JOIN symbols s ON s.symbol_id = e.target_id WHERE e.kind = 'references')
, c AS (SELECT p.source_id, p.target_id AS was, r.symbol_id, row_number() OVER (PARTITION BY p.source_id, p.target_id ORDER BY (r.file_id <> p.file_id), r.symbol_id) AS k, count(*) OVER (PARTITION BY p.source_id, p.target_id) AS n FROM p JOIN symbols r ON r.qualified = p.target JOIN files g ON g.file_id = r.file_id WHERE g.language = p.language AND (p.t OR NOT contains(g.path, '_test.')))"""


@case("R2_resolve", "SELECT source_id, symbol_id AS target_id, CASE WHEN n = 1 THEN 1.0 ELSE 0.8 END AS confidence, n > 1 AS ambiguous FROM c WHERE k = 1", _RESOLVED)
def _(g, spark, sf):
    e = g.edges.where("kind = 'references'").join(g.symbols.select(F.col("symbol_id").alias("target_id"), F.col("qualified").alias("target")), "target_id")
    pending = e.select(
        F.xxhash64("source_id", "target_id").alias("edge_no"), "source_id", F.col("file_id").alias("source_file_id"), F.lit("x").alias("source_qualified"), F.lit("").alias("source_parent"), "target", "kind", F.lit(1.0).alias("base"), F.lit("").alias("receiver")
    )
    return dv.resolve(g, pending).select("source_id", "target_id", "confidence", "ambiguous")


@case("O5_dispatch", "SELECT DISTINCT m.symbol_id, i.symbol_id AS interface_method FROM symbols m JOIN edges e ON e.source_id = m.parent_id AND e.kind = 'inherits' JOIN symbols i ON i.parent_id = e.target_id AND i.name = m.name AND i.kind = 'method' WHERE m.kind = 'method'")
def _(g, spark, sf):
    return gr.dispatch(g)
