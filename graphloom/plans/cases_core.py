"""Queries over the projected graph: counts, joins, ranks (sections 2.1 to 2.6 and 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import paths
from graphloom.operators import aggregates as ag
from graphloom.operators import present, status, store
from graphloom.sources import projection as pj

QUERIES, ORACLE_SQL = {}, {}


def case(name: str, sql: str | None = None, graph: bool = True):
    """Registers f(graph, spark, sf_dir) (graph None if not asked for) with its SQL over files, symbols and edges."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(pj.graph(spark, sf_dir) if graph else None, spark, sf_dir)
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {pj.SQL} {sql}" if graph else sql
        return f

    return put


AREA = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
TEST_LIKE = " OR ".join(f"{{0}} ILIKE '{p}'" for p in paths.LIKE_PATTERNS)


@case("A1_totals", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS embeddings, 0::BIGINT AS coverage_percent")
def _(g, spark, sf):
    return ag.totals(g)


@case("A2_in_degree", "SELECT target_id AS symbol_id, count(*) AS in_degree FROM edges GROUP BY 1")
def _(g, spark, sf):
    return ag.in_degree(g.edges)


@case("A3_total_degree", "SELECT symbol_id, count(*) AS degree FROM (SELECT source_id AS symbol_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1")
def _(g, spark, sf):
    return ag.total_degree(g.edges)


@case("A4_traversal_degree", "SELECT target_id AS symbol_id, count(*) AS in_degree FROM edges WHERE kind IN ('calls','inherits','includes','tests','composes','temporal','references') AND source_id IS NOT NULL AND confidence >= 0.9 GROUP BY 1")
def _(g, spark, sf):
    return ag.in_degree(g.edges, ag.FOLLOWED["blast"], 0.9)


@case("A5_languages", "SELECT language, count(DISTINCT f.file_id) AS files, count(symbol_id) AS symbols FROM files f LEFT JOIN symbols s USING (file_id) GROUP BY 1")
def _(g, spark, sf):
    return ag.languages(g)


@case("A6_namespaces", "SELECT split_part(path,'/',1) || '/' || split_part(path,'/',2) AS namespace, count(*) AS symbols FROM symbols JOIN files USING (file_id) GROUP BY 1 ORDER BY symbols DESC, namespace LIMIT 8")
def _(g, spark, sf):
    return ag.namespaces(g)


_HUBS = """, reach AS (SELECT target_id AS symbol_id, count(DISTINCT file_id) AS reach FROM edges GROUP BY 1),
top AS (SELECT symbol_id, qualified, kind, reach FROM reach JOIN symbols USING (symbol_id) ORDER BY CASE WHEN kind IN ('class','module','interface','type') THEN 0 ELSE 1 END, reach DESC, symbol_id LIMIT 5),
k AS (SELECT target_id, e.kind AS k, count(*) AS n FROM edges e JOIN top ON target_id = top.symbol_id GROUP BY ALL)
SELECT symbol_id, qualified, kind, reach, (SELECT k FROM k WHERE target_id = symbol_id ORDER BY n DESC, k LIMIT 1) AS modal_kind FROM top"""


@case("A7_hubs", _HUBS)
def _(g, spark, sf):
    return ag.hubs(g)


@case(
    "A8_key_symbols",
    f""", r AS (SELECT target_id, file_id FROM edges UNION ALL SELECT parent_id, e.file_id FROM edges e JOIN symbols s ON e.target_id = s.symbol_id WHERE parent_id IS NOT NULL),
 n AS (SELECT target_id, count(DISTINCT file_id) AS reach FROM r JOIN files f USING (file_id) WHERE NOT ({TEST_LIKE.format('f.path')}) GROUP BY 1)
 SELECT symbol_id, qualified, kind, path, reach FROM symbols s JOIN files f USING (file_id) JOIN n ON n.target_id = s.symbol_id
 WHERE kind IN ('class','module','interface','type') AND NOT ({TEST_LIKE.format('f.path')}) ORDER BY reach DESC, symbol_id LIMIT 10""",
)
def _(g, spark, sf):
    return ag.key_symbols(g)


@case(
    "W7_top_callers",
    """, c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'calls' AND target_id BETWEEN 3000000000 AND 3999999999),
 r AS (SELECT target_id, qualified AS caller, row_number() OVER (PARTITION BY target_id ORDER BY qualified, source_id)::INT AS rank FROM c JOIN symbols ON symbol_id = source_id) SELECT * FROM r WHERE rank <= 3""",
)
def _(g, spark, sf):
    return ag.top_callers(g, g.symbols.where("kind = 'function'"))


@case(
    "A9_coupling",
    """SELECT t.qualified, count(DISTINCT source_id) AS sources FROM edges e JOIN symbols s ON e.source_id = s.symbol_id JOIN files sf ON sf.file_id = s.file_id JOIN symbols t ON e.target_id = t.symbol_id JOIN files tf ON tf.file_id = t.file_id
 WHERE e.kind IN ('calls','composes','inherits','includes') AND contains(sf.path, 'asia/') AND NOT contains(tf.path, 'asia/') GROUP BY 1 HAVING count(DISTINCT source_id) >= 3 ORDER BY sources DESC, qualified LIMIT 5""",
)
def _(g, spark, sf):
    return ag.coupling(g, domain="asia/")


@case(
    "A10_occurrences",
    "SELECT name, count(DISTINCT symbol_id) + count(target_id) AS occurrences FROM symbols LEFT JOIN edges ON target_id = symbol_id WHERE symbol_id BETWEEN 4000000000 AND 4999999999 GROUP BY 1",
)
def _(g, spark, sf):
    return ag.occurrences(g, g.symbols.where("kind = 'method'").select("name"))


@case(
    "A15_representatives",
    """, d AS (SELECT symbol_id, count(*) AS n FROM (SELECT source_id AS symbol_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1)
 SELECT file_id, symbol_id FROM (SELECT file_id, symbol_id, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN kind IN ('class','module','interface','type') THEN 0 ELSE 1 END, coalesce(n,0) DESC, symbol_id) AS k FROM symbols LEFT JOIN d USING (symbol_id)) WHERE k = 1""",
)
def _(g, spark, sf):
    return ag.representatives(g)


@case("A16_minimum_key", "SELECT source_id, min(target_id) AS via FROM edges WHERE kind = 'inherits' GROUP BY 1")
def _(g, spark, sf):
    return ag.minimum_key(g)


@case("A17_satisfiers", "SELECT target_id AS interface_id, count(DISTINCT source_id) AS satisfiers FROM edges e JOIN symbols s ON source_id = s.symbol_id JOIN symbols t ON target_id = t.symbol_id WHERE e.kind = 'inherits' AND s.kind <> 'interface' AND t.kind = 'interface' GROUP BY 1")
def _(g, spark, sf):
    return ag.satisfiers(g)


@case(
    "A18_profile",
    """, l AS (SELECT language, count(DISTINCT f.file_id) AS files, count(symbol_id) AS symbols FROM files f LEFT JOIN symbols s USING (file_id) GROUP BY 1),
 a AS (SELECT sum(files)::BIGINT AS files, sum(symbols)::BIGINT AS symbols, (SELECT language FROM l ORDER BY symbols DESC, language LIMIT 1) AS primary_language, sum(CASE WHEN language IN ('ruby','python','javascript','typescript','php') THEN symbols ELSE 0 END) * 2 > sum(symbols) AS dynamic FROM l)
 SELECT files, symbols, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / greatest(symbols, 1), 6) AS density, primary_language, dynamic,
 CASE WHEN symbols < 3000 THEN 'small' WHEN symbols >= CASE WHEN dynamic THEN 15000 ELSE 20000 END THEN 'large' ELSE 'medium' END AS tier FROM a""",
)
def _(g, spark, sf):
    return ag.profile(g)


@case("A19_counters", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1", graph=False)
def _(g, spark, sf):
    return ag.counters(pj.table(spark, sf, "events"))


@case("A20_orphans", "SELECT source_id, target_id, kind FROM edges WHERE target_id NOT IN (SELECT symbol_id FROM symbols WHERE symbol_id % 1000 <> 7) OR source_id NOT IN (SELECT symbol_id FROM symbols WHERE symbol_id % 1000 <> 7)")
def _(g, spark, sf):
    from dataclasses import replace

    return ag.orphans(replace(g, symbols=g.symbols.where("symbol_id % 1000 <> 7")))


@case("A21_fingerprint", "SELECT 'f' || count(*) || '@' || strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS fingerprint FROM orders", graph=False)
def _(g, spark, sf):
    return ag.fingerprint(pj.table(spark, sf, "orders").select(F.col("o_orderdate").alias("indexed_at")))


@case("A22_areas", f"SELECT {AREA.format('path')} AS area, count(*) AS callers FROM symbols JOIN files USING (file_id) GROUP BY 1")
def _(g, spark, sf):
    return ag.areas(g.symbols.join(g.files, "file_id"))


@case(
    "A23_latency",
    """, n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT event_type, max(value) FILTER (k = least(floor(0.5*n), n-1)) AS p50, max(value) FILTER (k = least(floor(0.95*n), n-1)) AS p95, max(value) FILTER (k = least(floor(0.99*n), n-1)) AS p99 FROM n GROUP BY 1""",
)
def _(g, spark, sf):
    return ag.latency(pj.table(spark, sf, "events"), ["event_type"], F.col("value"))


@case("S13_inbound", "SELECT target_id, source_id, qualified AS source, e.kind, confidence FROM edges e JOIN symbols ON symbol_id = source_id WHERE target_id BETWEEN 2000000000 AND 2000000010")
def _(g, spark, sf):
    return ag.inbound(g, g.symbols.where("symbol_id between 2000000000 and 2000000010"))


@case("S14_query", "SELECT * FROM symbols WHERE name = 'order7' AND kind = 'method' AND file_id = 3 ORDER BY symbol_id LIMIT 20")
def _(g, spark, sf):
    return ag.query(g.symbols, "order7", "method", 3, 20)


@case("S15_edge_census", "SELECT kind, count(*) AS edges, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT target_id) AS targets FROM edges GROUP BY 1")
def _(g, spark, sf):
    return ag.edge_census(g.edges)


@case("S15_containers", "SELECT symbol_id, qualified, path, line_start FROM symbols JOIN files USING (file_id) WHERE kind IN ('class','module','interface','type')")
def _(g, spark, sf):
    return ag.containers(g)


@case("J3_family", "SELECT parent_id AS of, symbol_id, 'child' AS relation FROM symbols WHERE parent_id BETWEEN 1000000001 AND 1000000100 UNION ALL SELECT symbol_id, parent_id, 'parent' FROM symbols WHERE symbol_id BETWEEN 4000000001 AND 4000000100 AND parent_id IS NOT NULL")
def _(g, spark, sf):
    return ag.family(g.symbols, g.symbols.where("symbol_id between 1000000001 and 1000000100 or symbol_id between 4000000001 and 4000000100"))


@case("J9_overlap", f", c AS (SELECT path, file_id * 10 AS start, file_id * 10 + 3 AS e FROM files) SELECT DISTINCT symbol_id FROM symbols s JOIN files f USING (file_id) JOIN c ON c.path = f.path AND c.start <= greatest(line_end, line_start) AND line_start <= c.e")
def _(g, spark, sf):
    ranges = g.files.select("path", (F.col("file_id") * 10).alias("start"), (F.col("file_id") * 10 + 3).alias("end"))
    return ag.overlapping(g.symbols, g.files, ranges)


@case("J11_reopenings", "SELECT qualified, kind, count(*) AS n, min(symbol_id) AS first_id FROM symbols GROUP BY ALL HAVING count(*) > 1")
def _(g, spark, sf):
    return ag.reopenings(g.symbols)


@case("J12_composers", "SELECT DISTINCT source_id AS symbol_id FROM edges WHERE kind = 'composes' AND target_id BETWEEN 1000000001 AND 1000000050")
def _(g, spark, sf):
    return ag.composers(g.edges, g.symbols.where("symbol_id between 1000000001 and 1000000050"))


@case("S5_content_hash", "SELECT doc_id AS file_id, left(sha256(text), 16) AS hash FROM documents", graph=False)
def _(g, spark, sf):
    return pj.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), store.content_hash(F.col("text").cast("binary")).alias("hash"))


@case("S5_changed", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0", graph=False)
def _(g, spark, sf):
    docs = pj.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), store.content_hash(F.col("text").cast("binary")).alias("hash"))
    return store.changed(docs, docs.where("doc_id % 7 <> 0")).select("doc_id")


@case(
    "S8_upsert",
    "SELECT f.file_id, f.path, CASE WHEN f.file_id % 3 = 0 THEN 'go' ELSE f.language END AS language FROM files f UNION ALL SELECT 100 + n_nationkey, 'new/' || n_nationkey || '.go', 'go' FROM nation WHERE n_nationkey < 5",
)
def _(g, spark, sf):
    more = pj.table(spark, sf, "nation").where("n_nationkey < 5").select((F.col("n_nationkey") + 100).cast("long").alias("file_id"), F.concat(F.lit("new/"), F.col("n_nationkey").cast("string"), F.lit(".go")).alias("path"), F.lit("go").alias("language"))
    new = g.files.where("file_id % 3 = 0").select((F.col("file_id") + 500).alias("file_id"), "path", F.lit("go").alias("language")).unionByName(more)
    return store.upsert_files(g, new).files


@case(
    "S11_cascade",
    """, gone AS (SELECT file_id FROM files WHERE file_id < 5), dead AS (SELECT symbol_id FROM symbols WHERE file_id IN (FROM gone)),
 e AS (SELECT * FROM edges WHERE file_id NOT IN (FROM gone) AND source_id NOT IN (FROM dead) AND target_id NOT IN (FROM dead))
 SELECT kind, count(*) AS edges, sum(target_id % 1000)::BIGINT AS digest FROM e GROUP BY 1""",
)
def _(g, spark, sf):
    left = store.delete_files(g, g.files.where("file_id < 5"))
    return left.edges.groupBy("kind").agg(F.count("*").alias("edges"), F.sum(F.col("target_id") % 1000).alias("digest"))


@case("S12_stale", "SELECT file_id, path, language FROM files WHERE file_id % 4 = 1")
def _(g, spark, sf):
    return store.stale(g.files, g.files.where("file_id % 4 <> 1")).select("file_id", "path", "language")


@case("S16_meta", "SELECT event_type AS key, '[' || string_agg(DISTINCT '\"u' || user_id % 10 || '\"', ',' ORDER BY '\"u' || user_id % 10 || '\"') || ']' AS value FROM events GROUP BY 1", graph=False)
def _(g, spark, sf):
    new = pj.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("name"))
    return store.union_names(spark.createDataFrame([("click", '["u1"]')], "key string, value string").join(new.select("key"), "key", "left_semi"), new)


@case("S17_debt", "SELECT doc_id AS symbol_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)", graph=False)
def _(g, spark, sf):
    vectors = pj.table(spark, sf, "embeddings").select(F.col("vec_id").alias("symbol_id"))
    return store.debt(pj.table(spark, sf, "documents").select(F.col("doc_id").alias("symbol_id")), vectors)


@case(
    "W8_round_robin",
    f""", a AS (SELECT symbol_id, path, {AREA.format('path')} AS area, ends_with(path, '_test.go') AS is_test FROM symbols JOIN files USING (file_id) WHERE kind = 'interface'),
 b AS (SELECT *, count(*) OVER (PARTITION BY area) AS size, row_number() OVER (PARTITION BY area ORDER BY is_test, symbol_id)::INT AS turn FROM a) SELECT symbol_id, area, size, turn FROM b ORDER BY turn, size DESC, area LIMIT 60""",
)
def _(g, spark, sf):
    rows = g.symbols.where("kind = 'interface'").join(g.files, "file_id").withColumn("is_test", paths.blast_test(F.col("path")))
    return present.round_robin(rows.select("symbol_id", "path", "is_test")).select("symbol_id", "area", "size", "turn")


@case("W9_span_by_file", "SELECT symbol_id, path, row_number() OVER (PARTITION BY path ORDER BY symbol_id) > 1 AS again FROM symbols JOIN files USING (file_id) WHERE kind = 'interface'")
def _(g, spark, sf):
    rows = g.symbols.where("kind = 'interface'").join(g.files, "file_id").withColumn("rank", F.col("symbol_id"))
    return present.span_by_file(rows).select("symbol_id", "path", "again")


@case("W10_page", "SELECT symbol_id, qualified, 70::INT AS next_offset FROM symbols WHERE kind = 'class' ORDER BY qualified, symbol_id LIMIT 20 OFFSET 50")
def _(g, spark, sf):
    return present.page(g.symbols.where("kind = 'class'").select("symbol_id", "qualified"), ["qualified", "symbol_id"], 50, 20)


@case("W11_budget", "SELECT symbol_id, used FROM (SELECT symbol_id, sum(length(qualified)) OVER (ORDER BY qualified, symbol_id)::BIGINT AS used FROM symbols WHERE kind = 'interface') WHERE used <= 800")
def _(g, spark, sf):
    return present.within_budget(g.symbols.where("kind = 'interface'").select("symbol_id", "qualified"), ["qualified", "symbol_id"], F.length("qualified"), 800).select("symbol_id", "used")


@case("S23_json", "SELECT '{\"file_id\":' || file_id || ',\"path\":\"' || path || '\",\"tags\":[]}' AS json FROM files")
def _(g, spark, sf):
    rows = g.files.select("file_id", "path", F.lit(None).cast(T.ArrayType(T.StringType())).alias("tags"))
    return present.to_json(rows)


@case("H2_sources", "SELECT e.source_id AS symbol_id, count(*) AS out_degree, qualified FROM edges e JOIN symbols ON symbol_id = e.source_id WHERE NOT EXISTS (FROM edges x WHERE x.target_id = e.source_id AND x.kind IN ('calls','references')) GROUP BY ALL ORDER BY out_degree DESC, symbol_id LIMIT 5")
def _(g, spark, sf):
    return status.sources(g)


@case("H3_hubs", "SELECT target_id AS symbol_id, count(*) AS in_degree, qualified FROM edges e JOIN symbols ON symbol_id = target_id WHERE e.kind = 'calls' AND confidence >= 0.5 GROUP BY ALL ORDER BY in_degree DESC, symbol_id LIMIT 5")
def _(g, spark, sf):
    return status.hubs(g)


@case("H4_main_areas", f", c AS (SELECT {AREA.format('path')} AS area, kind, count(*) AS n FROM symbols JOIN files USING (file_id) GROUP BY ALL) SELECT area, sum(n)::BIGINT AS symbols, (SELECT kind FROM c d WHERE d.area = c.area ORDER BY n DESC, kind LIMIT 1) AS dominant_kind FROM c GROUP BY area ORDER BY symbols DESC, area LIMIT 8")
def _(g, spark, sf):
    return status.main_areas(g)


@case("H5_noise", " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER ('/' || path ILIKE '{p}') AS files FROM files" for k, p in status.NOISE.items()))
def _(g, spark, sf):
    return status.noise(g)


@case("H6_test_areas", f"SELECT {AREA.format('path')} AS area, count(*) AS files FROM files WHERE ends_with(path, '_test.go') GROUP BY 1")
def _(g, spark, sf):
    return status.test_areas(g)


@case("H7_doctor", "SELECT unnest(['orphan_edges','unknown_languages','unknown_symbol_kinds','unknown_edge_kinds','symbols_without_file','bad_confidence']) AS problem, 0::BIGINT AS n")
def _(g, spark, sf):
    return status.doctor(g)


@case("H8_health", "SELECT file_id, CASE WHEN file_id = 0 THEN 'empty' WHEN file_id % 5 > 0 THEN 'stale' WHEN file_id % 3 = 0 THEN 'no_symbols' WHEN file_id % 2 > 0 THEN 'embedding' ELSE 'ready' END AS health FROM files")
def _(g, spark, sf):
    f = F.col("file_id")
    return g.files.select("file_id", status.health(f, f % 3, f % 5, f % 2).alias("health"))


@case("S23_edge_kinds", "SELECT kind, count(*) AS n FROM edges GROUP BY 1")
def _(g, spark, sf):
    return g.edges.groupBy("kind").agg(F.count("*").alias("n"))
