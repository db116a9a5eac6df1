"""Queries over the projected graph and its variant: the parts of resolution, impact, search, conventions and dead-code analysis, one each."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.api import Tools
from graphloom.functions import paths, text
from graphloom.functions.shared import stacked
from graphloom.model import CONTAINERS, EDGE_KINDS
from graphloom.operators import aggregates as ag
from graphloom.operators import blast as bl
from graphloom.operators import conventions as cv
from graphloom.operators import dead as dd
from graphloom.operators import derive as dv
from graphloom.operators import fulltext as ft
from graphloom.operators import graph as gr
from graphloom.operators import present, search, status, store, vector
from graphloom.plans.cases_core import AREA
from graphloom.plans.cases_graph import _CAND, _hops
from graphloom.sources import projection as pj

QUERIES, ORACLE_SQL = {}, {}
LEAF = r"regexp_extract({0}, '(?s)^(?:.*(?:::|[#.\\]))?(.*?)$', 1)"
CONTAINED = "('class','module','interface','type')"


def case(name: str, sql: str | None = None, extra: str = "", variant: bool = False):
    """As in cases_graph; variant asks for the graph with scopes, suffixes and interface methods."""

    def put(f):
        def run(spark, sf_dir):
            g = (pj.variant if variant else pj.graph)(spark, sf_dir)
            return f(g, spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {pj.VARIANT_SQL if variant else pj.SQL}{extra} {sql}"
        return f

    return put


# --- Joins and sets ----------------------------------------------------------------------------------------------------------------


@case("J1_symbol_files", "SELECT symbol_id, path FROM symbols JOIN files USING (file_id)")
def _(g, spark, sf):
    return present.hydrate(g.symbols, g.files).select("symbol_id", "path")


@case("J2_inbound_sources", "SELECT target_id AS root_id, coalesce(source_id, 0) AS other_id, e.kind, coalesce(qualified, '') AS other FROM edges e LEFT JOIN symbols ON symbol_id = source_id")
def _(g, spark, sf):
    return gr.neighbourhood(g, g.symbols, "callers").select("root_id", "other_id", "kind", "other")


@case(
    "J4_read_by_ids",
    f"SELECT symbol_id, path, coalesce(o.n, 0)::INT AS outbound, coalesce(i.n, 0)::INT AS inbound FROM symbols s JOIN files USING (file_id) LEFT JOIN (SELECT source_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1) o USING (symbol_id) LEFT JOIN (SELECT target_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1) i USING (symbol_id) WHERE s.kind IN {CONTAINED}",
)
def _(g, spark, sf):
    found = store.read_symbol(g, g.symbols.where(F.col("kind").isin(*CONTAINERS)))
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(c)
    return found.select("symbol_id", "path", n("outbound"), n("inbound"))


_DEAD_KINDS = "('calls','composes','includes','inherits','references')"


@case("J5_not_exists", f"SELECT symbol_id FROM symbols s WHERE NOT EXISTS (FROM edges e WHERE e.target_id = s.symbol_id AND e.kind IN {_DEAD_KINDS})")
def _(g, spark, sf):
    return dd.candidates(g, skip_test_references=False).select("symbol_id")


@case("J6_nested_not_exists", f"SELECT symbol_id FROM symbols s WHERE NOT EXISTS (FROM edges e WHERE e.target_id = s.symbol_id AND e.kind IN {_DEAD_KINDS} AND NOT EXISTS (FROM files f WHERE f.file_id = e.file_id AND contains(f.path, '_test.')))")
def _(g, spark, sf):
    return dd.candidates(g).select("symbol_id")


@case("J7_adjacency", "SELECT symbol_id, min(hop)::INT AS hop FROM (SELECT 2000000001 AS symbol_id, 0 AS hop UNION ALL SELECT source_id, 1 FROM edges WHERE target_id = 2000000001) GROUP BY 1")
def _(g, spark, sf):
    return gr.bfs(g, g.symbols.where("symbol_id = 2000000001"), 1, "callers", cap=1_000_000).select("symbol_id", "hop")


@case(
    "J10_alive_by_interface",
    "SELECT DISTINCT k.source_id AS parent_id, m.name FROM symbols m JOIN edges c ON c.target_id = m.symbol_id AND c.kind = 'calls' JOIN symbols i ON i.symbol_id = m.parent_id AND i.kind = 'interface' JOIN edges k ON k.target_id = i.symbol_id AND k.kind = 'inherits' WHERE m.kind = 'method'",
    variant=True,
)
def _(g, spark, sf):
    return dd.alive_by_interface(g)


_CO = f", {pj.COMMITS_SQL}, f AS (SELECT commit_id, path, split_part(path, '/', 1) AS d FROM commits), n AS (SELECT path, count(*) AS n FROM f GROUP BY 1), p AS (SELECT a.path AS a, b.path AS b, count(*) AS pairs FROM f a JOIN f b ON a.commit_id = b.commit_id AND a.path < b.path AND a.d <> b.d GROUP BY 1, 2)"


@case("J13_pairs", "SELECT * FROM p", _CO)
def _(g, spark, sf):
    return dv.co_changes(pj.commits(spark, sf), 1, block=2).select("a", "b", "pairs")


@case("A14_co_change_strength", "SELECT p.*, round(pairs / greatest(x.n, y.n), 6) AS strength FROM p JOIN n x ON x.path = a JOIN n y ON y.path = b WHERE pairs >= 2", _CO)
def _(g, spark, sf):
    return dv.co_changes(pj.commits(spark, sf), 2)


_MET = """, m AS (SELECT DISTINCT parent_id AS owner, name FROM symbols WHERE kind = 'method'), i AS (SELECT owner, m.name FROM m JOIN symbols ON symbol_id = owner AND kind = 'interface' WHERE m.name IN ('order1','order3')), c AS (SELECT owner, m.name FROM m JOIN symbols ON symbol_id = owner AND kind = 'class'), need AS (SELECT owner, count(*) AS n FROM i GROUP BY 1)"""


@case("J15_set_containment", "SELECT i.owner AS interface_id, c.owner AS struct_id FROM i JOIN c USING (name) JOIN need ON need.owner = i.owner GROUP BY 1, 2, n HAVING count(*) = n", _MET, variant=True)
def _(g, spark, sf):
    owned = g.symbols.where("kind = 'method' and parent_id is not null").select(F.col("parent_id").alias("owner_id"), "name", F.lit(0).alias("params"), F.lit(0).alias("results"), F.lit(False).alias("known")).distinct()
    few = owned.where(F.col("owner_id") < pj.SUPPLIER).unionByName(owned.where((F.col("owner_id") >= pj.SUPPLIER) & F.col("name").isin("order1", "order3")))
    return dv.satisfaction(few, spark.createDataFrame([], "outer_id long, inner_id long"), g.symbols.select("symbol_id", "kind")).select("interface_id", "struct_id")


@case("J16_cross_expand", "SELECT DISTINCT parent_id AS source_id, b.target_id FROM edges a JOIN symbols ON symbol_id = a.source_id AND symbols.kind = 'method' JOIN edges b ON b.source_id = a.target_id AND b.kind = 'references' WHERE a.kind = 'calls'")
def _(g, spark, sf):
    """Classes call what their methods call, and parts compose what they refer to: each class takes over the parts' collaborators."""
    owner = g.symbols.where("kind = 'method'").select(F.col("symbol_id").alias("source_id"), F.col("parent_id").alias("owner"))
    calls = g.edges.where("kind = 'calls'").join(owner, "source_id").withColumn("source_id", F.col("owner")).select(*g.edges.columns)
    parts = g.edges.where("kind = 'references'").withColumn("kind", F.lit("composes"))
    return dv.mixins(type(g)(g.files, g.symbols, calls.unionByName(parts))).select("source_id", "target_id")


@case("U1_union_all", "SELECT symbol_id, count(*) AS degree FROM (SELECT source_id AS symbol_id FROM edges WHERE source_id IS NOT NULL UNION ALL SELECT target_id FROM edges) GROUP BY 1", variant=True)
def _(g, spark, sf):
    return ag.total_degree(g.edges)


@case("U3_difference", "SELECT symbol_id FROM symbols WHERE symbol_id NOT IN (SELECT target_id FROM edges WHERE kind = 'composes')")
def _(g, spark, sf):
    return gr.collapse_seen(g.symbols, g.edges.where("kind = 'composes'").select(F.col("target_id").alias("symbol_id"))).select("symbol_id")


@case("G35_seen", "SELECT symbol_id, hop FROM v1 WHERE hop > 0 AND symbol_id % 2 = 1", _hops(1))
def _(g, spark, sf):
    reached = bl.reach(g, g.symbols.where("symbol_id = 3000000007"), bl.Options(1)).where("hop > 0")
    return gr.collapse_seen(reached, g.symbols.where("symbol_id % 2 = 0")).select("symbol_id", "hop")


# --- Name resolution ---------------------------------------------------------------------------------------------------------------


@case("R1_references", f"SELECT symbol_id, {LEAF.format('qualified')} AS leaf, contains(path, '_test.go') AS is_test, {AREA.format('path')} AS dir, language FROM symbols JOIN files USING (file_id)", variant=True)
def _(g, spark, sf):
    return dv.references(g).select("symbol_id", "leaf", "is_test", "dir", "language")


def _pending(e, target, kind: str, scope=None, base: float = 1.0):
    """Edges of the graph as references that are still to be resolved by their written name."""
    return e.select(
        F.xxhash64("source_id", "target_id").alias("edge_no"), "source_id", F.col("file_id").alias("source_file_id"), (scope if scope is not None else F.lit("x")).alias("source_qualified"), F.lit("").alias("source_parent"), target.alias("target"), F.lit(kind).alias("kind"),
        F.lit(base).alias("base"), F.lit("").alias("receiver"),
    )


_PLACE = ", r AS (SELECT s.*, path, language, contains(path, '_test.go') AS is_test FROM symbols s JOIN files USING (file_id))"
_NAMED = """, p AS (SELECT DISTINCT source_id, target_id, e.file_id, f.language, contains(f.path, '_test.go') AS t, s.name AS target FROM edges e JOIN files f USING (file_id) JOIN symbols s ON s.symbol_id = e.target_id WHERE e.kind = 'calls' AND s.kind = 'method')
, n AS (SELECT name, language, is_test, count(*) AS n, min(symbol_id) AS least FROM r GROUP BY ALL)
, c AS (SELECT source_id, p.target_id, file_id, target, sum(n) AS n, min(least) AS least FROM p JOIN n ON n.name = target AND n.language = p.language AND (t OR NOT is_test) GROUP BY ALL)
, near AS (SELECT name, file_id, min(symbol_id) AS near FROM symbols GROUP BY ALL)"""


@case("R6_leaf", "SELECT source_id, coalesce(near, least) AS target_id, CASE WHEN n = 1 THEN 0.8 ELSE 0.3 END AS confidence, n > 1 AS ambiguous, 4 AS tier FROM c LEFT JOIN near ON near.name = target AND near.file_id = c.file_id", _PLACE + _NAMED)
def _(g, spark, sf):
    methods = g.symbols.where("kind = 'method'").select(F.col("symbol_id").alias("target_id"), F.col("name").alias("written"))
    return dv.resolve(g, _pending(g.edges.where("kind = 'calls'").join(methods, "target_id"), F.col("written"), "calls")).select("source_id", "target_id", "confidence", "ambiguous", "tier")


_QUALIFIED = """, p AS (SELECT source_id, target_id, e.file_id, s.qualified AS target FROM edges e JOIN symbols s ON s.symbol_id = e.target_id WHERE e.kind = 'references')
, q AS (SELECT qualified, count(*) AS n, min(symbol_id) AS least FROM symbols GROUP BY 1), near AS (SELECT qualified, file_id, min(symbol_id) AS near FROM symbols GROUP BY ALL)"""


@case("R3_qualified", "SELECT source_id, coalesce(near, least) AS target_id, CASE WHEN n = 1 THEN 1.0 ELSE 0.8 END AS confidence, 1 AS tier FROM p JOIN q ON qualified = target LEFT JOIN near ON near.qualified = target AND near.file_id = p.file_id", _QUALIFIED)
def _(g, spark, sf):
    named = g.symbols.select(F.col("symbol_id").alias("target_id"), F.col("qualified").alias("written"))
    return dv.resolve(g, _pending(g.edges.where("kind = 'references'").join(named, "target_id"), F.col("written"), "imports")).select("source_id", "target_id", "confidence", "tier")


@case("R4_lexical", "SELECT e.source_id, e.target_id, 0.9 AS confidence, 2 AS tier FROM edges e JOIN r s ON s.symbol_id = e.source_id JOIN r t ON t.symbol_id = e.target_id WHERE e.kind = 'composes' AND s.file_id = t.file_id", _PLACE, variant=True)
def _(g, spark, sf):
    s = g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("qualified").alias("scope"), F.col("file_id").alias("own"))
    t = g.symbols.select(F.col("symbol_id").alias("target_id"), F.col("name").alias("written"), F.col("file_id").alias("there"))
    e = g.edges.where("kind = 'composes'").join(s, "source_id").join(t, "target_id").where("own = there")
    return dv.resolve(g, _pending(e, F.col("written"), "composes", F.col("scope"), 0.9)).select("source_id", "target_id", "confidence", "tier")


@case("R7_gates", "SELECT p.source_id, count(*) AS allowed FROM p JOIN r ON r.qualified = target AND r.language = p.language AND (p.t OR NOT r.is_test) GROUP BY 1", _PLACE + ", p AS (SELECT source_id, e.file_id, f.language, contains(f.path, '_test.go') AS t, s.qualified AS target FROM edges e JOIN files f USING (file_id) JOIN symbols s ON s.symbol_id = e.target_id WHERE e.kind = 'references')")
def _(g, spark, sf):
    named = g.symbols.select(F.col("symbol_id").alias("target_id"), F.col("qualified").alias("written"))
    return dv.resolve(g, _pending(g.edges.where("kind = 'references'").join(named, "target_id"), F.col("written"), "references")).groupBy("source_id").agg(F.count("*").alias("allowed"))


@case("R8_pick_best", "SELECT coalesce(near, least) AS target_id, count(*) AS edges FROM c LEFT JOIN near ON near.name = target AND near.file_id = c.file_id GROUP BY 1", _PLACE + _NAMED)
def _(g, spark, sf):
    methods = g.symbols.where("kind = 'method'").select(F.col("symbol_id").alias("target_id"), F.col("name").alias("written"))
    return dv.resolve(g, _pending(g.edges.where("kind = 'calls'").join(methods, "target_id"), F.col("written"), "calls")).groupBy("target_id").agg(F.count("*").alias("edges"))


@case("J14_name_lookup", "SELECT target, count(*) AS edges, sum(n)::BIGINT AS candidates FROM c GROUP BY 1", _PLACE + _NAMED)
def _(g, spark, sf):
    methods = g.symbols.where("kind = 'method'").select(F.col("symbol_id").alias("target_id"), F.col("name").alias("target"))
    e = g.edges.where("kind = 'calls'").join(methods, "target_id").join(g.files.select("file_id", "language", paths.resolver_test(F.col("path")).alias("t")), "file_id").select("source_id", "target", "language", "t", "target_id").distinct()
    counted = dv.references(g).groupBy(F.col("leaf").alias("target"), "language", "is_test").agg(F.count("*").alias("n"))
    return e.join(counted, ["target", "language"]).where("t or not is_test").groupBy("target").agg(F.countDistinct("source_id", "target_id").alias("edges"), F.sum("n").alias("candidates"))


@case(
    "R11_tiers",
    "SELECT 1 AS tier, count(*) AS edges FROM p JOIN q ON qualified = target UNION ALL SELECT 4, count(*) FROM c2",
    _QUALIFIED + _PLACE + _NAMED.replace(", p AS", ", p2 AS", 1).replace(" FROM p ", " FROM p2 ").replace("p.", "p2.").replace(", c AS", ", c2 AS").replace(", near AS", ", near2 AS"),
)
def _(g, spark, sf):
    named = g.symbols.select(F.col("symbol_id").alias("target_id"), "qualified", "name", F.col("kind").alias("k"))
    e = g.edges.join(named, "target_id")
    first = _pending(e.where("kind = 'references'"), F.col("qualified"), "imports")
    last = _pending(e.where("kind = 'calls' and k = 'method'"), F.col("name"), "calls").withColumn("edge_no", F.col("edge_no") + 1)
    return dv.resolve(g, first.unionByName(last)).groupBy("tier").agg(F.count("*").alias("edges"))


@case("R18_name_sets", "SELECT language, kind AS \"set\", string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM symbols JOIN files USING (file_id) WHERE kind IN ('method','interface') GROUP BY ALL")
def _(g, spark, sf):
    harvest = g.symbols.where("kind in ('method', 'interface')").join(g.files, "file_id").select("language", F.col("kind").alias("set"), "name")
    return dv.name_sets(harvest).select("language", "set", F.array_join("names", ",").alias("names"))


# --- Impact ------------------------------------------------------------------------------------------------------------------------

_WIDE = _hops(3, "x.symbol_id = 2000000007", 0.3)
_SEED = "symbol_id = 2000000007"


@case("G15_decay", "SELECT symbol_id, hop, kind, round(c, 6) AS confidence FROM v3 WHERE hop > 0", _WIDE)
def _(g, spark, sf):
    return bl.reach(g, g.symbols.where(_SEED), bl.Options(3, 0.3)).where("hop > 0").select("symbol_id", "hop", "kind", F.round("confidence", 6).alias("confidence"))


@case("G16_choice", "SELECT symbol_id, via, kind FROM v2 WHERE hop > 0", _WIDE)
def _(g, spark, sf):
    return bl.reach(g, g.symbols.where(_SEED), bl.Options(2, 0.3)).where("hop > 0").select("symbol_id", "via", "kind")


@case("G17_first_hop", "SELECT hop, count(*) AS symbols, count(DISTINCT symbol_id) AS once FROM v3 GROUP BY 1", _WIDE)
def _(g, spark, sf):
    return bl.reach(g, g.symbols.where(_SEED), bl.Options(3, 0.3)).groupBy("hop").agg(F.count("*").alias("symbols"), F.countDistinct("symbol_id").alias("once"))


_TIER = "CASE WHEN v.kind IN ('calls','temporal','references') THEN 1 WHEN v.kind = 'tests' THEN 3 ELSE 2 END"


@case("G18_partition", "SELECT symbol_id, hop <= 1 AS direct FROM v3 WHERE hop > 0", _WIDE)
def _(g, spark, sf):
    return bl.affected(g, bl.reach(g, g.symbols.where(_SEED), bl.Options(3, 0.3))).select("symbol_id", "direct")


@case("G21_tiers", f"SELECT {_TIER} AS tier, count(*) AS symbols FROM v3 v WHERE hop > 0 GROUP BY 1", _WIDE)
def _(g, spark, sf):
    return bl.affected(g, bl.reach(g, g.symbols.where(_SEED), bl.Options(3, 0.3))).groupBy("tier").agg(F.count("*").alias("symbols"))


@case("G26_reconciled", "SELECT g AS \"group\", count(*) AS symbols FROM (SELECT symbol_id, 'subclasses' AS g FROM v3 WHERE hop > 0 AND kind = 'inherits' UNION ALL SELECT DISTINCT source_id, 'via_composition' FROM edges WHERE kind = 'composes' AND target_id = 2000000007) GROUP BY 1", _WIDE)
def _(g, spark, sf):
    rows = bl.affected(g, bl.reach(g, g.symbols.where(_SEED), bl.Options(3, 0.3)))
    return bl.groups(rows, g).groupBy("group").agg(F.count("*").alias("symbols"))


@case("G34_segments", "SELECT contains(path, '_test.') AS is_test, count(*) AS symbols FROM v3 JOIN symbols USING (symbol_id) JOIN files USING (file_id) WHERE hop > 0 GROUP BY 1", _WIDE)
def _(g, spark, sf):
    return bl.affected(g, bl.reach(g, g.symbols.where(_SEED), bl.Options(3, 0.3))).groupBy("is_test").agg(F.count("*").alias("symbols"))


@case("W4_frontier", "SELECT symbol_id, hop FROM v3", _hops(3, frontier=50))
def _(g, spark, sf):
    return bl.reach(g, g.symbols.where("symbol_id = 3000000007"), bl.Options(3, 0.5, 100, 50)).select("symbol_id", "hop")


_LAUNDER = """, c0 AS (SELECT 1000000003::BIGINT AS symbol_id UNION SELECT source_id FROM edges JOIN c0 ON target_id = symbol_id AND edges.kind IN ('composes','includes')),
 via AS (SELECT target_id AS via, min(source_id) AS carrier FROM edges e JOIN c0 ON source_id = symbol_id JOIN files f ON f.file_id = e.file_id WHERE e.kind = 'inherits' AND NOT contains(path, '_test.') GROUP BY 1),
 hold AS (SELECT source_id AS symbol_id, min(target_id) AS via FROM edges JOIN via ON target_id = via.via WHERE kind = 'references' GROUP BY 1)"""


@case("G32_retained_order", "SELECT symbol_id, via, row_number() OVER (ORDER BY contains(path, '_test.'), symbol_id)::INT AS rank FROM hold JOIN symbols USING (symbol_id) JOIN files USING (file_id) WHERE symbol_id NOT IN (SELECT symbol_id FROM c0)", _LAUNDER)
def _(g, spark, sf):
    held = g.edges.withColumn("kind", F.when(F.col("kind") == "references", "composes").when(F.col("kind") == "composes", "includes").otherwise(F.col("kind")))
    found = bl.carriers(g, g.symbols.where("symbol_id = 1000000003"))
    return bl.laundered(type(g)(g.files, g.symbols, held), found).select("symbol_id", "via", "rank")


@case("G12_completeness", "SELECT target_id AS root_id, 'called_by' AS bucket, count(*) FILTER (confidence < 0.92) AS hidden, CASE WHEN count(*) FILTER (confidence < 0.92) = 0 THEN 'complete' ELSE 'partial' END AS completeness FROM edges WHERE kind IN ('calls','references') GROUP BY 1")
def _(g, spark, sf):
    return gr.categories(gr.neighbourhood(g, g.symbols, "callers"), 0.92).where("bucket = 'called_by'").select("root_id", "bucket", "hidden", "completeness")


def _capped(hops: int, cap: int) -> str:
    """Steps both ways from one symbol, each cut at cap; a cut hop is the last."""
    out = ", adj AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges), h0 AS (SELECT 3000000007::BIGINT AS symbol_id, 0 AS hop, FALSE AS truncated), all0 AS (FROM h0)"
    for k in range(1, hops + 1):
        out += f", n{k} AS (SELECT b AS symbol_id, min(a) AS a FROM adj JOIN h{k - 1} ON a = symbol_id WHERE NOT truncated AND b NOT IN (SELECT symbol_id FROM all{k - 1}) GROUP BY 1), h{k} AS (SELECT symbol_id, {k} AS hop, (SELECT count(*) FROM n{k}) > {cap} AS truncated FROM n{k} ORDER BY a, symbol_id LIMIT {cap}), all{k} AS (FROM all{k - 1} UNION ALL FROM h{k})"
    return out


@case("W6_hop_cap", "FROM all2", _capped(2, 50))
def _(g, spark, sf):
    return gr.bfs(g, g.symbols.where("symbol_id = 3000000007"), 2, cap=50)


@case("G5_bfs_capped", "FROM all3", _capped(3, 200))
def _(g, spark, sf):
    return gr.bfs(g, g.symbols.where("symbol_id = 3000000007"))


@case("W15_dominant_none", "SELECT symbol_id FROM symbols WHERE FALSE")
def _(g, spark, sf):
    return gr.dominant(gr.lookup(g, "order13"), g.edges).select("symbol_id")


@case("G2_choices", "SELECT symbol_id, coalesce(n, 0) AS uses FROM symbols LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) ON target_id = symbol_id WHERE name = 'order13' ORDER BY uses DESC, symbol_id LIMIT 10")
def _(g, spark, sf):
    return Tools(g).graph("order13").choices.select("symbol_id", F.coalesce("in_degree", F.lit(0)).alias("uses"))


@case("G3_not_found", "SELECT 'Search by meaning for the nearest symbols.' AS hint")
def _(g, spark, sf):
    return spark.createDataFrame([(h,) for h in Tools(g).graph("zzqqxx").hints], "hint string")


# --- Search ------------------------------------------------------------------------------------------------------------------------


@case("T3_expand", "SELECT * FROM (VALUES ('HandleHTTPRequest', 0, 'HandleHTTPRequest'), ('HandleHTTPRequest', 1, 'handle http request'), ('where is the order made', 0, 'where is the order made'), ('where is the order made', 1, 'where is the')) t(query, k, sub)")
def _(g, spark, sf):
    return spark.createDataFrame([(q, k, s) for q in ("HandleHTTPRequest", "where is the order made") for k, s in enumerate(search.expand(q))], "query string, k int, sub string")


@case("T4_shape", "SELECT * FROM (VALUES ('getURL','identifier'),('how is the order made','natural_language'),('find get_order now','mixed'),('order total','mixed'),('Foo::Bar','identifier'),('what is it','natural_language')) t(query, shape)")
def _(g, spark, sf):
    return spark.createDataFrame([(q, search.shape(q)) for q in ("getURL", "how is the order made", "find get_order now", "order total", "Foo::Bar", "what is it")], "query string, shape string")


@case("T7_weights", "SELECT * FROM (VALUES ('mixed',0.9::DOUBLE,0.5::DOUBLE,0.5::DOUBLE),('identifier',0.7,0.5,0.5),('identifier',0.5,0.6,0.4),('identifier',0.1,0.7,0.3),('natural_language',0.1,0.5,0.5)) t(shape, confidence, keyword, vector)")
def _(g, spark, sf):
    asked = (("mixed", 0.9), ("identifier", 0.7), ("identifier", 0.5), ("identifier", 0.1), ("natural_language", 0.1))
    return spark.createDataFrame([(f, c, *search.weights(f, c)) for f, c in asked], "shape string, confidence double, keyword double, vector double")


_FUSED = "SELECT symbol_id AS id, round(1.0 / (61 + symbol_id % 50), 12) AS score FROM symbols WHERE kind IN ('class','interface')"


def _fused(g):
    return g.symbols.where("kind in ('class', 'interface')").select(F.col("symbol_id").alias("id"), F.round(1.0 / (61 + F.col("symbol_id") % 50), 12).alias("score"), F.lit("keyword").alias("source"))


def _ranked(demoted: str = "1.0", tested: str = "CASE WHEN contains(path, '_test.') THEN 0.2 ELSE 1.0 END") -> str:
    return f""", u AS ({_FUSED}), w AS (SELECT id, u.score * CASE WHEN contains(path, '_test.go') THEN 0.3 ELSE 1.0 END * {demoted} AS score, path FROM u JOIN symbols ON symbol_id = id JOIN files USING (file_id)),
 z AS (SELECT id, path, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM w), d AS (SELECT target_id, count(*) AS n FROM edges GROUP BY 1),
 k AS (SELECT id, round(score * (1 + 0.05 * log2(1 + coalesce(n, 0))) * {tested}, 6) AS score, coalesce(n, 0) AS "references" FROM z LEFT JOIN d ON target_id = id)"""


@case("T13_centrality", "SELECT * FROM k", _ranked())
def _(g, spark, sf):
    return search.rank(_fused(g), g, "order", {}, 0, "identifier").select("id", "score", "references")


@case("W3_min_max", "SELECT count(*) AS rows, min(score) AS low, max(score) AS high FROM z", _ranked())
def _(g, spark, sf):
    flat = type(g)(g.files, g.symbols, g.edges.where("false"))
    scored = search.rank(_fused(g), flat, "tests of order", {}, 0, "identifier")
    return scored.agg(F.count("*").alias("rows"), F.min("score").alias("low"), F.max("score").alias("high"))


@case("T14_test_demotion", "SELECT id, score FROM k", _ranked(tested="1.0"))
def _(g, spark, sf):
    return search.rank(_fused(g), g, "test order", {}, 0, "identifier").select("id", "score")


@case("T12_generic_terms", "SELECT id, score FROM k", _ranked("CASE WHEN name = 'C7Building' OR ends_with(qualified, '::C7Building') THEN 1.0 ELSE 0.3 END"), variant=True)
def _(g, spark, sf):
    return search.rank(_fused(g), g, "C7Building order", {"order": 10**9, "c7": 10**9, "building": 10**9}, 1000, "mixed").select("id", "score")


_BASE = "b AS (SELECT symbol_id AS id, round((symbol_id % 97) / 100.0, 6) AS score, parent_id FROM symbols WHERE kind = 'method')"


def _methods(g):
    s = g.symbols.where("kind = 'method'").join(g.files.select("file_id", "path"), "file_id")
    return s.select(F.col("symbol_id").alias("id"), "name", "qualified", "kind", "file_id", "parent_id", "path", F.round((F.col("symbol_id") % 97) / 100.0, 6).alias("score"), F.lit("keyword").alias("source"), F.lit(0).cast("long").alias("references"))


@case(
    "T15_enrich",
    "SELECT id, round(score + CASE WHEN id IN (SELECT target_id FROM c) THEN 0.15 ELSE 0 END, 6) AS score FROM b UNION ALL SELECT target_id, 0.05 FROM c WHERE target_id NOT IN (SELECT id FROM b)",
    f", {_BASE}, t AS (SELECT id FROM b ORDER BY score DESC, id LIMIT 3), c AS (SELECT DISTINCT target_id FROM edges JOIN t ON source_id = id WHERE kind = 'calls')",
)
def _(g, spark, sf):
    return search.enrich(_methods(g), g).select("id", F.round("score", 6).alias("score"))


@case(
    "T16_promote",
    "SELECT id, score FROM b WHERE parent_id NOT IN (SELECT parent_id FROM u) UNION ALL SELECT parent_id, score FROM u",
    f", {_BASE}, t AS (SELECT * FROM b ORDER BY score DESC, id LIMIT 2000), u AS (SELECT parent_id, max(score) AS score FROM t GROUP BY 1 HAVING count(*) >= 2)",
)
def _(g, spark, sf):
    return search.promote(_methods(g), g, 2000).select("id", "score")


@case("T17_finish", f"SELECT id, score FROM b WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 40", f", {_BASE}")
def _(g, spark, sf):
    return search.finish(_methods(g), 40, 0.5).select("id", "score")


@case("T18_hydrate", f"SELECT id, path, qualified FROM b JOIN symbols ON symbol_id = id JOIN files USING (file_id)", f", {_BASE}")
def _(g, spark, sf):
    return present.hydrate(_methods(g).drop("path"), g.files).select("id", "path", "qualified")


@case("T22_bodies", "SELECT symbol_id, array_to_string(list_transform(range(line_start, line_start + 10), lambda x: 'line ' || x), chr(10)) AS snippet FROM symbols WHERE kind IN ('function','method') AND line_start >= 1")
def _(g, spark, sf):
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1100)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    rows = search.with_bodies(g.symbols.where("kind in ('function', 'method') and line_start >= 1"), g.files.select("file_id", content.alias("content")))
    return rows.select("symbol_id", "snippet")


# --- Conventions -------------------------------------------------------------------------------------------------------------------

_PLAIN = "NOT contains(path, '_test.')"
_KINDS = "CASE kind WHEN 'class' THEN 'classes' ELSE kind || 's' END"


@case(
    "C2_naming",
    f"SELECT 'classes use *' || suffix AS description, count(*) AS instances, max(total) AS total, round(count(*) / max(total), 6) AS strength FROM (SELECT regexp_extract(name, '([A-Z][a-z]*)$', 1) AS suffix, count(*) OVER () AS total FROM symbols JOIN files USING (file_id) WHERE kind = 'class' AND {_PLAIN}) GROUP BY suffix HAVING count(*) >= 3",
    variant=True,
)
def _(g, spark, sf):
    return cv.naming(g).select("description", "instances", "total", "strength")


@case(
    "A12_groups",
    f"SELECT kind, language, count(*) AS instances, max(total) AS total FROM (SELECT s.kind, language, count(*) OVER (PARTITION BY s.kind) AS total FROM symbols s JOIN files USING (file_id)) GROUP BY ALL HAVING count(*) >= 3",
)
def _(g, spark, sf):
    rows = g.symbols.join(g.files.select("file_id", "path", "language"), "file_id")
    found = cv.emit(rows, ["kind", "language"], rows.groupBy("kind").agg(F.count("*").alias("total")), ["kind"], "naming", F.concat_ws("\t", "kind", "language"))
    return found.select(F.split("description", "\t")[0].alias("kind"), F.split("description", "\t")[1].alias("language"), "instances", "total")


@case("A13_distinct_files", "SELECT s.kind, count(DISTINCT file_id) AS instances, (SELECT count(*) FROM files) AS total FROM symbols s GROUP BY 1 HAVING count(DISTINCT file_id) >= 3")
def _(g, spark, sf):
    rows = g.symbols.join(g.files.select("file_id", "path"), "file_id")
    return cv.emit(rows, ["kind"], g.files.count(), [], "naming", F.col("kind"), unit="file_id").select(F.col("description").alias("kind"), "instances", "total")


@case("C10_external", "SELECT 'external' AS category, 'depends on ' || t.qualified AS description, count(DISTINCT source_id) AS instances, 0.8::DOUBLE AS strength FROM edges e JOIN symbols s ON s.symbol_id = source_id JOIN files f ON f.file_id = s.file_id JOIN symbols t ON t.symbol_id = target_id JOIN files h ON h.file_id = t.file_id WHERE e.kind IN ('calls','composes','inherits','includes') AND contains(f.path, 'asia') AND NOT contains(h.path, 'asia') GROUP BY t.qualified HAVING count(DISTINCT source_id) >= 3 ORDER BY instances DESC, t.qualified LIMIT 5")
def _(g, spark, sf):
    return cv.external(g, "asia")


_STRUCTURE = f", st AS (SELECT {_KINDS} || ' live in ' || {AREA.format('path')} || '/' AS description, count(*) AS instances, sum(count(*)) OVER (PARTITION BY kind)::BIGINT AS total FROM symbols JOIN files USING (file_id) WHERE parent_id IS NULL GROUP BY kind, {AREA.format('path')} QUALIFY instances >= 3)"


@case("C21_filters", "SELECT description, instances FROM st WHERE (instances >= 5 OR instances / total >= 0.1) AND round(instances / total, 6) >= 0.04", _STRUCTURE)
def _(g, spark, sf):
    return cv.kept(cv.structure(g), strength=0.04).select("description", "instances")


@case("W13_order", "SELECT description, instances, row_number() OVER (ORDER BY round(instances / total, 6) DESC, description)::INT AS rank FROM st QUALIFY rank <= 10", _STRUCTURE)
def _(g, spark, sf):
    best = cv.ordered(cv.structure(g)).limit(10).select("description", "instances").collect()
    return spark.createDataFrame([(r.description, r.instances, k + 1) for k, r in enumerate(best)], "description string, instances long, rank int")


@case("C25_summary", "SELECT string_agg(description || ' (' || instances || ')', '; ' ORDER BY instances DESC, description) AS summary FROM (FROM st ORDER BY instances DESC, description LIMIT 3)", _STRUCTURE)
def _(g, spark, sf):
    return spark.createDataFrame([(cv.summary(cv.structure(g)),)], "summary string")


@case("C22_edge_counts", "SELECT name, path, max(coalesce(n, 0)) AS edges FROM symbols JOIN files USING (file_id) LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) ON target_id = symbol_id GROUP BY ALL ORDER BY edges DESC, name, path LIMIT 20")
def _(g, spark, sf):
    return cv.best_examples(g.symbols.join(g.files.select("file_id", "path"), "file_id"), g.edges, 20)


@case("W14_representatives", "SELECT name, path, max(coalesce(n, 0)) AS edges FROM symbols JOIN files USING (file_id) LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) ON target_id = symbol_id WHERE kind = 'class' GROUP BY ALL ORDER BY edges DESC, name, path LIMIT 3")
def _(g, spark, sf):
    return cv.best_examples(g.symbols.where("kind = 'class'").join(g.files.select("file_id", "path"), "file_id"), g.edges)


@case("C23_labels", "SELECT symbol_id, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN name WHEN count(*) OVER (PARTITION BY qualified) = 1 THEN qualified ELSE qualified || ' @ ' || path END AS label FROM symbols JOIN files USING (file_id)")
def _(g, spark, sf):
    return cv.labels(g.symbols.join(g.files.select("file_id", "path"), "file_id")).select("symbol_id", "label")


@case("C26_instance_snippets", "SELECT path, 2 AS at, array_to_string(string_split(text, chr(10))[1:4], chr(10)) AS snippet FROM (SELECT 'd' || lpad(doc_id::VARCHAR, 9, '0') AS path, text FROM documents WHERE len(string_split(text, chr(10))) >= 2) ORDER BY path LIMIT 10")
def _(g, spark, sf):
    docs = pj.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text")
    lines = ft.lines(docs, "path", "text")
    return present.snippets(lines.where("line = 2"), lines)


_DETECT = f""", place AS (SELECT s.*, path, language, contains(path, '_test.') AS t FROM symbols s JOIN files USING (file_id)), per AS (SELECT kind, count(*) AS total FROM place WHERE NOT t GROUP BY 1),
 inh AS (SELECT 'inheritance' AS category, {_KINDS.replace('kind', 's.kind')} || ' inherit from ' || x.name AS description, count(DISTINCT source_id) AS instances, max(total) AS total, x.name AS said FROM edges e JOIN place s ON source_id = s.symbol_id JOIN symbols x ON target_id = x.symbol_id JOIN per ON per.kind = s.kind WHERE e.kind = 'inherits' AND NOT s.t AND NOT (language = 'go' AND x.kind = 'interface') GROUP BY x.name, s.kind),
 com AS (SELECT 'composition' AS category, {_KINDS.replace('kind', 's.kind')} || CASE WHEN language = 'go' THEN ' embed ' ELSE ' compose ' END || x.name AS description, count(DISTINCT source_id) AS instances, max(total) AS total, x.name AS said FROM edges e JOIN place s ON source_id = s.symbol_id JOIN symbols x ON target_id = x.symbol_id JOIN per ON per.kind = s.kind WHERE e.kind = 'composes' AND NOT s.t GROUP BY x.name, s.kind, language = 'go'),
 top AS (SELECT *, contains(path, '_test.go') AS tested FROM place WHERE parent_id IS NULL), fil AS (SELECT 'naming' AS category, 'files of ' || {_KINDS} || ' end in _test.go' AS description, count(DISTINCT file_id) FILTER (tested) AS instances, count(DISTINCT file_id) AS total, NULL AS said FROM top GROUP BY kind),
 tes AS (SELECT 'testing' AS category, 'test files are named *_test.go' AS description, count(*) AS instances, count(*) AS total, NULL AS said FROM files WHERE contains(path, '_test.')),
 gos AS (SELECT 'framework' AS category, name || ' is an interface of several types' AS description, count(DISTINCT source_id) AS instances, (SELECT count(*) FROM symbols WHERE kind IN {CONTAINED}) AS total, NULL AS said FROM symbols s JOIN edges e ON target_id = symbol_id WHERE s.kind = 'interface' AND e.kind = 'inherits' GROUP BY symbol_id, name HAVING count(DISTINCT source_id) >= 2),
 lay AS (SELECT split_part(a.path, '/', 2) AS f, split_part(b.path, '/', 2) AS g, count(*) AS n FROM edges e JOIN place a ON source_id = a.symbol_id JOIN place b ON target_id = b.symbol_id WHERE e.kind = 'calls' AND f <> g GROUP BY ALL),
 arc AS (SELECT 'architecture' AS category, 'layer ' || f || '/ depends on ' || g || '/, never back' AS description, n AS instances, (SELECT sum(n) FROM lay)::BIGINT AS total, NULL AS said FROM lay x WHERE n >= 3 AND NOT EXISTS (FROM lay y WHERE y.f = x.g AND y.g = x.f)),
 sto AS (SELECT 'structure' AS category, description, instances, total, NULL AS said FROM st),
 every AS (SELECT * FROM (FROM inh UNION ALL FROM com UNION ALL FROM fil UNION ALL FROM tes) WHERE instances >= 3 UNION ALL FROM gos UNION ALL FROM arc UNION ALL FROM sto),
 best AS (SELECT symbol_id FROM symbols s JOIN edges ON target_id = symbol_id WHERE s.kind IN {CONTAINED} AND name NOT IN (SELECT said FROM every WHERE said IS NOT NULL) GROUP BY 1 ORDER BY count(*) DESC, symbol_id LIMIT 8)"""


@case(
    "C24_detect",
    f"SELECT category, description, instances, total, round(instances / total, 6) AS strength FROM every WHERE instances >= 5 OR instances / total >= 0.1 UNION ALL SELECT 'key-types', 'types that most depends on', count(*), (SELECT count(*) FROM symbols WHERE kind IN {CONTAINED}), 1.0 FROM best HAVING count(*) > 0",
    _STRUCTURE + _DETECT,
)
def _(g, spark, sf):
    return cv.detect(g).select("category", "description", "instances", "total", "strength")


# --- Dead-code voices --------------------------------------------------------------------------------------------------------------

_CORE = _CAND + """, judged AS (SELECT symbol_id, CASE WHEN visibility = 'public' THEN 'core_exported_api' WHEN language = 'ruby' AND kind = 'class' THEN 'ruby_class' WHEN language = 'python' AND kind NOT IN ('function','method','class') THEN 'py_public'
 WHEN language = 'typescript' AND kind = 'method' THEN 'ts_method' WHEN language = 'go' THEN 'core_no_harvest' END AS reason FROM rolled)"""


def _harvested(g, spark, rows, languages):
    """Mentions and other sets by hand; each language was harvested and mentions at least one name."""
    return spark.createDataFrame([*rows, *((x, "mentions", "zzz") for x in languages)], "language string, set string, name string")


@case("D8_core_voice", "SELECT symbol_id, reason FROM judged WHERE reason IS NOT NULL", _CORE)
def _(g, spark, sf):
    none = spark.createDataFrame([], "name string")
    return dd.verdicts(dd.facts(g, dd.unreferenced(g), _harvested(g, spark, [], ("ruby", "python", "typescript", "java")), none)).where("reason is not null").select("symbol_id", "reason")


_SWAP = {"go": "rust", "ruby": "javascript", "python": "kotlin", "typescript": "php", "java": "csharp"}
_SETS = [("rust", "allow_dead", "order3"), ("rust", "test_symbols", "order2"), ("rust", "exports", "order1"), ("rust", "trait_methods", "order4"), ("javascript", "decorated", "order1"), ("javascript", "default_exports", "order2"), ("kotlin", "annotated", "order1"), ("php", "interface_methods", "order2"), ("csharp", "annotated", "order3")]
_LANGUAGE = "CASE language " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SWAP.items()) + " END"


def _voices(g, spark):
    swapped = F.create_map(*(F.lit(x) for kv in _SWAP.items() for x in kv))[F.col("language")]
    other = store.pinned(type(g)(g.files.withColumn("language", swapped), g.symbols, g.edges))
    found = dd.unreferenced(other)
    return dd.verdicts(dd.facts(other, found, _harvested(other, spark, _SETS, _SWAP.values()), spark.createDataFrame([("Gin",)], "name string")))


_SPOKEN = _CAND + f""", said AS (SELECT symbol_id, name, kind, visibility, {_LANGUAGE} AS lang FROM rolled), judged AS (SELECT symbol_id, lang AS language, CASE
 WHEN lang = 'rust' THEN CASE WHEN name = 'order3' THEN 'rust_allow_dead' WHEN name = 'order2' THEN 'rust_test' WHEN name = 'order1' THEN 'rust_ffi' WHEN name = 'order4' AND kind = 'method' THEN 'rust_trait_impl' WHEN visibility = 'public' THEN 'rust_pub' END
 WHEN lang = 'javascript' THEN CASE WHEN name = 'order1' THEN 'ts_decorator' WHEN visibility = 'public' AND name = 'order2' THEN 'ts_default_export' WHEN visibility = 'public' THEN 'ts_exported' ELSE 'js_dynamic' END
 WHEN lang = 'kotlin' AND name = 'order1' THEN 'ls_annotated' WHEN lang = 'csharp' AND name = 'order3' THEN 'ls_annotated' WHEN lang = 'php' AND name = 'order2' AND kind = 'method' THEN 'ls_interface_method'
 WHEN visibility = 'public' THEN 'ls_public_no_framework' WHEN kind NOT IN ('function','method') THEN 'ls_reflective_type' WHEN lang = 'php' THEN 'ls_dynamic' ELSE 'ls_unvalidated' END AS reason FROM said)"""


@case("D11_rust_voice", "SELECT symbol_id, reason FROM judged WHERE language = 'rust' AND reason IS NOT NULL", _SPOKEN)
def _(g, spark, sf):
    return _voices(g, spark).where("language = 'rust' and reason is not null").select("symbol_id", "reason")


@case("D12_script_voice", "SELECT symbol_id, reason FROM judged WHERE language = 'javascript' AND reason IS NOT NULL", _SPOKEN)
def _(g, spark, sf):
    return _voices(g, spark).where("language = 'javascript' and reason is not null").select("symbol_id", "reason")


@case("D14_curly_voice", "SELECT symbol_id, language, reason FROM judged WHERE language IN ('kotlin','php','csharp') AND reason IS NOT NULL", _SPOKEN)
def _(g, spark, sf):
    return _voices(g, spark).where("language in ('kotlin', 'php', 'csharp') and reason is not null").select("symbol_id", "language", "reason")


@case(
    "D13_python_voice",
    "SELECT symbol_id, CASE WHEN name = 'order1' THEN 'py_route' WHEN name = 'order2' THEN 'py_django' WHEN name = 'order3' THEN 'py_decorator' WHEN name = 'order4' THEN 'py_all_export' WHEN kind = 'class' THEN 'py_class' WHEN visibility = 'public' OR kind NOT IN ('function','method','class') THEN 'py_public' END AS reason FROM rolled WHERE language = 'python' AND (visibility = 'public' OR name IN ('order1','order2','order3','order4'))",
    _CAND,
)
def _(g, spark, sf):
    sets = [("python", "routes", "order1"), ("python", "django", "order2"), ("python", "decorated", "order3"), ("python", "all_exports", "order4")]
    known = dd.facts(g, dd.unreferenced(g, language="python"), _harvested(g, spark, sets, ("python",)), spark.createDataFrame([("Gin",)], "name string"))
    return dd.verdicts(known).where("reason is not null").select("symbol_id", "reason")


@case("D6_facts", "SELECT language, name IN ('order1') AS mentioned, count(*) AS symbols FROM rolled GROUP BY ALL", _CAND)
def _(g, spark, sf):
    langs = g.files.select("language").distinct().select("language", F.lit("mentions").alias("set"), F.lit("order1").alias("name"))
    known = dd.facts(g, dd.unreferenced(g), langs, spark.createDataFrame([("Gin",)], "name string"))
    return known.groupBy("language", F.col("_mentioned").alias("mentioned")).agg(F.count("*").alias("symbols"))


@case("W12_shared_limit", "SELECT symbol_id, reason FROM (SELECT symbol_id, reason, path, line_start FROM judged JOIN (SELECT symbol_id, path, line_start FROM rolled) USING (symbol_id) WHERE language = 'php') ORDER BY CASE reason WHEN 'ls_public_no_framework' THEN -55 WHEN 'ls_dynamic' THEN -40 WHEN 'ls_interface_method' THEN -30 END, reason, path, line_start, symbol_id LIMIT 100", _SPOKEN)
def _(g, spark, sf):
    return dd.shown(_voices(g, spark).where("language = 'php'"), 100).select("symbol_id", "reason")


@case("D16_precision", f"SELECT (SELECT count(*) FROM a JOIN b USING (path, name)) AS agreed, (SELECT count(*) FROM a ANTI JOIN b USING (path, name)) AS false_dead, (SELECT count(*) FROM b ANTI JOIN a USING (path, name)) AS missed", _SPOKEN + f", a AS (SELECT DISTINCT path, {LEAF.format('qualified')} AS name FROM rolled JOIN judged USING (symbol_id) WHERE reason IS NULL), b AS (SELECT DISTINCT path, name FROM rolled WHERE kind = 'method')")
def _(g, spark, sf):
    found = _voices(g, spark)
    theirs = dd.unreferenced(g).where("kind = 'method'").select("path", "name")
    return dd.precision(found, theirs)


@case("Q13_dead_oracle", "SELECT (SELECT count(*) FROM a JOIN b USING (path, name)) AS agreed, (SELECT count(*) FROM a ANTI JOIN b USING (path, name)) AS false_dead, (SELECT count(*) FROM b ANTI JOIN a USING (path, name)) AS missed", _SPOKEN + f", a AS (SELECT DISTINCT path, {LEAF.format('qualified')} AS name FROM rolled JOIN judged USING (symbol_id) WHERE reason IS NULL), b AS (SELECT DISTINCT path, name FROM rolled JOIN judged USING (symbol_id) WHERE visibility = 'private')")
def _(g, spark, sf):
    found = _voices(g, spark)
    theirs = dd.unreferenced(g).where("visibility = 'private'").select("path", "name")
    return dd.precision(found, theirs)


# --- Store, status, presentation ---------------------------------------------------------------------------------------------------


@case("S9_upsert_symbols", "SELECT symbol_id, CASE WHEN kind = 'class' THEN 'new' ELSE name END AS name, file_id, qualified FROM symbols UNION ALL SELECT symbol_id + 5000000000, name, file_id, qualified || '!' FROM symbols WHERE kind = 'interface'")
def _(g, spark, sf):
    fresh = g.symbols.where("kind = 'class'").withColumns({"symbol_id": F.col("symbol_id") + 9_000_000_000, "name": F.lit("new"), "version": F.lit(2)})
    older = fresh.withColumns({"name": F.lit("old"), "version": F.lit(1)})
    more = g.symbols.where("kind = 'interface'").withColumns({"symbol_id": F.col("symbol_id") + 5_000_000_000, "qualified": F.concat("qualified", F.lit("!")), "version": F.lit(1)})
    return store.upsert_symbols(g, fresh.unionByName(older).unionByName(more), "version").symbols.select("symbol_id", "name", "file_id", "qualified")


@case("S10_upsert_edges", "SELECT source_id, target_id, kind, CASE WHEN kind = 'composes' THEN 0.25 ELSE confidence END AS confidence FROM edges UNION ALL SELECT 0, target_id, kind, 0.5 FROM edges WHERE kind = 'inherits'")
def _(g, spark, sf):
    e = g.edges.withColumn("edge_id", F.xxhash64("source_id", "target_id", "kind"))
    again = e.where("kind = 'composes'").withColumn("confidence", F.lit(0.25))
    loose = e.where("kind = 'inherits'").withColumns({"source_id": F.lit(None).cast("long"), "confidence": F.lit(0.5)})
    return store.upsert_edges(type(g)(g.files, g.symbols, e), again.unionByName(loose)).edges.select(F.coalesce("source_id", F.lit(0)).alias("source_id"), "target_id", "kind", "confidence")


@case("H1_entry_points", "SELECT symbol_id, path FROM (SELECT symbol_id, path, row_number() OVER (PARTITION BY path ORDER BY line_start, symbol_id) AS k FROM symbols JOIN files USING (file_id) WHERE ends_with(path, '/main.go')) WHERE k = 1", variant=True)
def _(g, spark, sf):
    return status.entry_points(g)


@case("Q6_view_signal", "SELECT DISTINCT target_id AS symbol_id FROM edges JOIN files USING (file_id) WHERE kind IN ('calls','references') AND file_id % 2 = 0")
def _(g, spark, sf):
    views = g.files.withColumn("path", F.when(F.col("file_id") % 2 == 0, F.concat("path", F.lit(".erb"))).otherwise(F.col("path")))
    return bl.view_reached(type(g)(views, g.symbols, g.edges), g.symbols)


@case("Q11_path_hydration", "SELECT source_id, target_id, kind, path FROM edges JOIN files USING (file_id)")
def _(g, spark, sf):
    return present.hydrate(g.edges, g.files).select("source_id", "target_id", "kind", "path")


@case("Q8_symbol_shaped", r"SELECT symbol_id, regexp_matches(qualified, '^[A-Za-z_][A-Za-z0-9_]*((::|[.#])[A-Za-z_][A-Za-z0-9_?!]*)*$') AND regexp_matches(qualified, '[A-Z_]|::|[.#]') AS shaped FROM symbols", variant=True)
def _(g, spark, sf):
    return g.symbols.select("symbol_id", status.symbol_shaped(F.col("qualified")).alias("shaped"))


@case("Q5_caveats", "SELECT file_id, 'Calls through getattr may be missing.' AS caveat FROM files WHERE language = 'python'")
def _(g, spark, sf):
    ext = F.create_map(*(F.lit(x) for kv in {"python": ".py", "go": ".go", "java": ".java", "typescript": ".ts", "ruby": ".go"}.items() for x in kv))
    return g.files.select("file_id", present.caveat(F.concat(F.lit("a/b"), ext[F.col("language")])).alias("caveat")).where("caveat is not null")


@case("Q12_warnings", "SELECT kind, count(*) AS n, string_agg(name, ',' ORDER BY name) FILTER (k <= 20) AS messages FROM (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) AS k FROM symbols WHERE kind IN ('interface','class')) GROUP BY 1")
def _(g, spark, sf):
    rows = g.symbols.where("kind in ('interface', 'class')").select("kind", F.col("name").alias("message"))
    return present.warnings(rows).select("kind", "n", F.array_join("messages", ",").alias("messages"))


@case("P7_receiver", "SELECT symbol_id, CASE WHEN symbol_id % 2 = 0 THEN qualified || '#' || name ELSE qualified || '::' || name END AS target FROM symbols WHERE kind = 'method'")
def _(g, spark, sf):
    written = F.concat(F.when(F.col("symbol_id") % 2 == 0, F.lit("self.")).otherwise(F.lit("Self::")), F.col("name"))
    return g.symbols.where("kind = 'method'").select("symbol_id", text.rewrite_receiver(written, F.col("qualified")).alias("target"))


@case("P2_name_parts", r"SELECT symbol_id, CASE WHEN a = b THEN a ELSE a || ' ' || b END AS parts FROM (SELECT symbol_id, lower(trim(regexp_replace(name, '(::|[./_ -])+', ' ', 'g'))) AS a, lower(trim(regexp_replace(qualified, '(::|[./_ -])+', ' ', 'g'))) AS b FROM symbols)")
def _(g, spark, sf):
    return g.symbols.select("symbol_id", text.name_parts(F.col("name"), F.col("qualified")).alias("parts"))


@case("P5_contains", "SELECT symbol_id FROM symbols WHERE contains(lower(qualified), '0001#order1')")
def _(g, spark, sf):
    return g.symbols.where(text.contains_folded(F.col("qualified"), "0001#ORDER1")).select("symbol_id")


@case("P13_layer", "SELECT file_id, split_part(path, '/', 2) AS layer FROM files", variant=True)
def _(g, spark, sf):
    return g.files.select("file_id", paths.layer(F.col("path")).alias("layer"))


@case("P14_namespace", "SELECT file_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS namespace FROM files", variant=True)
def _(g, spark, sf):
    return g.files.select("file_id", paths.namespace(F.col("path")).alias("namespace"))


@case("P15_area", f"SELECT file_id, {AREA.format('path')} AS area FROM files", variant=True)
def _(g, spark, sf):
    return g.files.select("file_id", paths.area(F.col("path")).alias("area"))


@case("W2_top_k", "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, id LIMIT 37")
def _(g, spark, sf):
    vectors = pj.table(spark, sf, "embeddings")
    return vector.nearest(vectors, "vec_id", "embedding", list(vectors.where("vec_id = 7").first().embedding), 37)


# --- The tool surface --------------------------------------------------------------------------------------------------------------


@case("Q1_verbs", "SELECT root_id, bucket, shown FROM (SELECT 2000000003::BIGINT AS root_id, CASE kind WHEN 'inherits' THEN 'inherited_by' ELSE 'called_by' END AS bucket, count(*) FILTER (kind = 'inherits' OR confidence >= 0.5) AS shown FROM edges WHERE target_id = 2000000003 GROUP BY 1, 2)")
def _(g, spark, sf):
    return Tools(g).call("graph", name="Supplier#000000003").parts["categories"].select("root_id", "bucket", "shown")


@case(
    "Q2_parameters",
    "SELECT symbol_id FROM v1 JOIN symbols USING (symbol_id) JOIN files USING (file_id) LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) d ON d.target_id = symbol_id WHERE hop = 1 QUALIFY row_number() OVER (ORDER BY contains(path, '_test.'), c DESC, coalesce(n, 0) DESC, symbol_id) <= 200",
    _hops(1, "x.symbol_id = 2000000003", 0.75),
)
def _(g, spark, sf):
    return Tools(g).call("blast", target="Supplier#000000003", hops=1, confidence=0.75).parts["callers"].select("symbol_id")


@case("Q9_engine_assembly", "SELECT count(*) AS hybrid FROM symbols WHERE FALSE")
def _(g, spark, sf):
    """Without vectors or a model search is keyword-only."""
    return Tools(g).search("order13").parts["results"].where("source in ('vector', 'hybrid')").agg(F.count("*").alias("hybrid"))


@case("Q10_configuration", "SELECT * FROM (VALUES ('embeddings', 'False'), ('max_file_kb', '64'), ('ignore', 'vendor/,dist/')) t(name, value)")
def _(g, spark, sf):
    p = present.Preset.of({"ignore": "vendor/,dist/"}, {"GRAPHLOOM_EMBEDDINGS": "0", "GRAPHLOOM_MAX_FILE_KB": "64"})
    return spark.createDataFrame([("embeddings", str(p.embeddings)), ("max_file_kb", str(p.max_file_kb)), ("ignore", ",".join(p.ignore))], "name string, value string")


@case("S26_conformance", "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, TRUE AS same_ids, 0::BIGINT AS missing")
def _(g, spark, sf):
    """Writing the whole graph again leaves every row and id as it was."""
    e = g.edges.withColumn("edge_id", F.xxhash64("source_id", "target_id", "kind", "file_id"))
    again = store.upsert_symbols(g, g.symbols.withColumn("symbol_id", F.col("symbol_id") + 10**12)).symbols
    links = store.upsert_edges(type(g)(g.files, g.symbols, e), e.withColumn("edge_id", F.col("edge_id") + 1)).edges
    counts = again.agg(F.count("*").alias("symbols"), (F.max("symbol_id") < 10**12).alias("same_ids"))
    own = lambda df, k, side: df.where(F.col("kind") == k).select(*store.EDGE_KEY, "edge_id", F.lit(side).alias("side"))
    sides = [own(e, k, 0).unionByName(own(links, k, 1)).groupBy(*store.EDGE_KEY, "edge_id").agg(F.max("side").alias("side"), F.sum(F.col("side")).alias("edges")) for k in EDGE_KINDS]
    found = stacked(sides).agg(F.count_if(F.col("side") == 0).alias("missing"), F.sum("edges").alias("edges"))
    return counts.crossJoin(found).select("symbols", "edges", "same_ids", "missing")  # a row each
