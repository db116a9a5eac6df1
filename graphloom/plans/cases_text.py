"""Queries over documents, embeddings, pages, events (2.2, 2.7, 2.12, 2.13, 2.15)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import fulltext as ft
from graphloom.operators import present, scoring, search, vector
from graphloom.sources import extractors, manifests
from graphloom.sources import projection as pj
from graphloom.streaming import incremental

QUERIES, ORACLE_SQL = {}, {}


def case(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


#: Names and paths that the projection can't give, for scalar functions on both sides.
NAMES = ("HandleHTTPRequest", "user_auth_token", "getURL", "a::b::CopyPaymentLink", "HTTPSAPIGateway", "x", "", "snake_Case-Mixed.name", "MyServiceController", "Foo#bar", "App.Models.User", "UserSerializer", "order_items", "categories", "boxes")
PATHS = ("app/models/user.rb", "spec/models/user_spec.rb", "a/b/c/d.go", "x_test.go", "contest/x.go", "src/__tests__/a.ts", "lib/latest.rb", "test/a.py", "pkg/testdata/f.go", "src/main/FooTest.java", "tests/test_a.py", "README.md", "src/a.spec.ts", "a/fixtures/b.rb")


def _values(spark: SparkSession, column: str, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _sql_values(column: str, values: tuple[str, ...]) -> str:
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {column})"


def _table(column: str, rows: dict[str, object]) -> str:
    """An oracle that spells out the expected value of each input."""
    shown = ", ".join(f"({k!r}, {v!r})" for k, v in rows.items())
    return f"SELECT * FROM (VALUES {shown}) t({column}, result)"


@case("P1_decompose", _table("name", dict(zip(NAMES, ("handle http request", "user auth token", "get url", "a b copy payment link", "https api gateway", "x", "", "snake case mixed name", "my service controller", "foo#bar", "app models user", "user serializer", "order items", "categories", "boxes"), strict=True))))
def _(spark, sf):
    return _values(spark, "name", NAMES).select("name", text.decompose(F.col("name")).alias("result"))


@case("P3_split_token", _table("name", dict(zip(NAMES, ("handle http request", "user auth token", "get url", "a::b::copy payment link", "httpsapi gateway", "x", "", "snake case mixed name", "my service controller", "foo#bar", "app models user", "user serializer", "order items", "categories", "boxes"), strict=True))))
def _(spark, sf):
    return _values(spark, "name", NAMES).select("name", F.array_join(text.split_token(F.col("name")), " ").alias("result"))


@case("P6_leaf", f"SELECT name, regexp_extract(name, '([^:#.\\\\]*)$', 1) AS leaf FROM {_sql_values('name', NAMES)}")
def _(spark, sf):
    return _values(spark, "name", NAMES).select("name", text.leaf(F.col("name")).alias("leaf"))


@case("P8_distance", f"SELECT name, CASE WHEN levenshtein(lower(name), 'boxs') <= 2 THEN levenshtein(lower(name), 'boxs') ELSE -1 END::INT AS distance FROM {_sql_values('name', ('boxes', 'box', 'foxes', 'bx', 'order'))}")
def _(spark, sf):
    return _values(spark, "name", ("boxes", "box", "foxes", "bx", "order")).select("name", text.distance(F.col("name"), F.col("name"), "boxs").alias("distance"))


@case("P9_sql_test_paths", f"SELECT path, ({' OR '.join(f'path ILIKE {p!r}' for p in paths.LIKE_PATTERNS)}) AS is_test FROM {_sql_values('path', PATHS)}")
def _(spark, sf):
    return _values(spark, "path", PATHS).select("path", paths.dead_sql_test(F.col("path")).alias("is_test"))


@case("P9_search_test_paths", f"SELECT path, (starts_with(path, 'test/') OR starts_with(path, 'spec/') OR {' OR '.join(f'contains(path, {p!r})' for p in paths.SEARCH_PARTS)}) AS is_test FROM {_sql_values('path', PATHS)}")
def _(spark, sf):
    return _values(spark, "path", PATHS).select("path", paths.search_test(F.col("path")).alias("is_test"))


_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_SEARCH = f"(starts_with(path, 'test/') OR starts_with(path, 'spec/') OR {' OR '.join(f'contains(path, {p!r})' for p in paths.SEARCH_PARTS)})"
_DEAD = " OR ".join([f"contains(path, {p!r})" for p in paths.DEAD_DIR_PARTS + paths.FIXTURE_PARTS] + [f"starts_with(path, {p!r})" for p in paths.DEAD_DIR_STARTS + paths.FIXTURE_STARTS] + [f"ends_with(path, {p!r})" for p in paths.TEST_ENDS])
_BLAST = rf"regexp_matches(path, '(^|/)(tests?|specs?|__tests__)/') OR regexp_matches({_BASE}, '(_test|_spec|[.]test|[.]spec)[.][A-Za-z]+$') OR regexp_matches({_BASE}, '^test_.*[.]py$')"
_RESOLVER = rf"regexp_matches(path, '(^|/)(test|tests|spec|__tests__)/') OR regexp_matches({_BASE}, '(_test[.]go|_spec[.]rb|_test[.]rb|_test[.]py|[.](test|spec)[.][jt]sx?)$') OR starts_with({_BASE}, 'test_')"


@case("P9_other_test_paths", f"SELECT path, ({_DEAD}) AS dead, ({_BLAST}) AS blast, ({_RESOLVER}) AS resolver, ({_SEARCH} OR ends_with(path, 'Test.java') OR ends_with(path, 'Tests.java') OR ends_with(path, 'Test.kt')) AS wire FROM {_sql_values('path', PATHS)}")
def _(spark, sf):
    p = F.col("path")
    return _values(spark, "path", PATHS).select("path", paths.dead_test(p).alias("dead"), paths.blast_test(p).alias("blast"), paths.resolver_test(p).alias("resolver"), paths.wire_test(p).alias("wire"))


@case("P10_synthetic", "SELECT q AS qualified, regexp_matches(q, '^(route|i18n|partial|ruby-core):') AS synthetic FROM (SELECT unnest(['route:/x', 'i18n:a.b', 'Foo', 'partial:_x', 'ruby-core:puts', 'xroute:']) AS q)")
def _(spark, sf):
    return _values(spark, "qualified", ("route:/x", "i18n:a.b", "Foo", "partial:_x", "ruby-core:puts", "xroute:")).select("qualified", text.is_synthetic(F.col("qualified")).alias("synthetic"))


@case("P12_path_parts", f"SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS area, CASE len(string_split(path, '/')) WHEN 1 THEN '.' WHEN 2 THEN split_part(path, '/', 1) ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS namespace, CASE WHEN len(string_split(path, '/')) < 2 THEN '' WHEN len(string_split(path, '/')) >= 4 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE string_split(path, '/')[-2] END AS layer FROM {_sql_values('path', PATHS)}")
def _(spark, sf):
    p = F.col("path")
    return _values(spark, "path", PATHS).select("path", paths.area(p).alias("area"), paths.namespace(p).alias("namespace"), paths.layer(p).alias("layer"))


@case("P11_suffix", _table("name", {"UserSerializer": "Serializer", "order_items": "_items", "x": "", "User": "", "getURL": "L", "MyServiceController": "Controller"}))
def _(spark, sf):
    return _values(spark, "name", ("UserSerializer", "order_items", "x", "User", "getURL", "MyServiceController")).select("name", text.suffix(F.col("name")).alias("result"))


@case("P16_inflect", "SELECT * FROM (VALUES ('category','categories'),('box','boxes'),('class','classes'),('order','orders'),('day','days')) t(word, plural)")
def _(spark, sf):
    return _values(spark, "word", ("category", "box", "class", "order", "day")).select("word", text.plural(F.col("word")).alias("plural"))


@case("P16_singular", "SELECT * FROM (VALUES ('categories','category'),('boxes','box'),('classes','class'),('orders','order'),('glass','glass')) t(word, singular)")
def _(spark, sf):
    return _values(spark, "word", ("categories", "boxes", "classes", "orders", "glass")).select("word", text.singular(F.col("word")).alias("singular"))


@case("P17_role_prefix", "SELECT name, regexp_extract(name, '^(.+)(Controller|Serializer|Policy|Decorator|Presenter|Service|Job|Worker|Mailer|Form|Validator)$', 1) AS prefix FROM " + _sql_values("name", NAMES))
def _(spark, sf):
    return _values(spark, "name", NAMES).select("name", text.role_prefix(F.col("name")).alias("prefix"))


_CONTINUED = "h[2 * {0} - 1] IN ('8', '9', 'A', 'B')"


@case(
    "P18_capped",
    f"SELECT doc_id, CASE WHEN n <= 2048 THEN n ELSE 3 + CASE WHEN NOT {_CONTINUED.format(2049)} THEN 2048 WHEN NOT {_CONTINUED.format(2048)} THEN 2047 WHEN NOT {_CONTINUED.format(2047)} THEN 2046 ELSE 2045 END END::INT AS bytes FROM (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS h FROM documents)",
)
def _(spark, sf):
    return pj.table(spark, sf, "documents").select("doc_id", F.octet_length(text.byte_capped(F.col("text"), F.lit(2048))).alias("bytes"))


@case("P19_arity", "SELECT * FROM (VALUES ('func (r *T) Read(p []byte) (n int, err error)', 1, 2, TRUE), ('func New() *T', 0, 1, TRUE), ('Close()', 0, 0, TRUE), ('Map(f func(int, int) int, xs ...int)', 2, 0, TRUE), ('broken(', 0, 0, FALSE)) t(signature, params, results, known)")
def _(spark, sf):
    signatures = ("func (r *T) Read(p []byte) (n int, err error)", "func New() *T", "Close()", "Map(f func(int, int) int, xs ...int)", "broken(")
    return _values(spark, "signature", signatures).withColumn("a", text.arity(F.col("signature"))).select("signature", "a.params", "a.results", "a.known")


@case("P21_wire_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = floor(l_discount) THEN printf('%.1f', l_discount) ELSE l_discount::VARCHAR END AS confidence, printf('%.2f', l_tax) AS score FROM lineitem")
def _(spark, sf):
    return pj.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.wire_confidence(F.col("l_discount")).alias("confidence"), text.wire_score(F.col("l_tax")).alias("score"))


@case("P22_token_estimate", "SELECT n_nationkey, (strlen('{\"n_name\":\"' || n_name || '\"}') // 4)::BIGINT AS tokens FROM nation")
def _(spark, sf):
    return pj.table(spark, sf, "nation").select("n_nationkey", text.token_estimate(F.struct("n_name")).alias("tokens"))


@case("E19_stimulus", "SELECT * FROM (VALUES ('users--list-item','Users::ListItemController'),('chat','ChatController')) t(name, controller)")
def _(spark, sf):
    return _values(spark, "name", ("users--list-item", "chat")).select("name", text.stimulus(F.col("name")).alias("controller"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_TERMS = ("reeder", "whan", "thinly", "the")
_TF = f"w AS (SELECT doc_id, lang, {_WORDS} AS w FROM documents), t AS (SELECT unnest({list(_TERMS)!r}) AS term), m AS (SELECT doc_id, lang, len(w) AS n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, t), d AS (SELECT term, count(*) AS df FROM m WHERE tf > 0 GROUP BY 1)"
_BM25 = f"""WITH {_TF}, c AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w)
SELECT doc_id AS id, round(sum(greatest(ln((c.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * m.n / a))), 6) AS score FROM m JOIN d USING (term), c WHERE tf > 0 AND {{0}} GROUP BY 1 ORDER BY score DESC, id LIMIT 50"""


@case("T1_bm25", _BM25.replace("{0}", "TRUE"))
def _(spark, sf):
    return ft.bm25(pj.table(spark, sf, "documents"), "doc_id", ["text"], list(_TERMS), 50)


@case("T1_bm25_language", _BM25.replace("{0}", "lang = 'fr'"))
def _(spark, sf):
    return ft.bm25(pj.table(spark, sf, "documents"), "doc_id", ["text"], list(_TERMS), 50, F.col("lang") == "fr")


@case("A11_document_frequency", f"WITH {_TF} SELECT term, df FROM d")
def _(spark, sf):
    return ft.document_frequency(pj.table(spark, sf, "documents"), "doc_id", ["text"], list(_TERMS))


@case("T1_postings", f"WITH w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents) SELECT id, len(w)::INT AS len, t.term, count(*) AS tf FROM w, unnest(w) t(term) GROUP BY ALL")
def _(spark, sf):
    return ft.postings(pj.table(spark, sf, "documents"), "doc_id", ["text"])


@case("T1_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' of the ')")
def _(spark, sf):
    return pj.table(spark, sf, "documents").where(ft.has_phrase(F.col("text"), ["of", "the"])).select("doc_id")


@case("T2_substring", "SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'token = ') ORDER BY id LIMIT 30")
def _(spark, sf):
    return ft.substring(pj.table(spark, sf, "documents"), "doc_id", "text", "TOKEN = ", 30)


_LINES = "l AS (SELECT 'd' || doc_id AS path, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


@case("T9_grep_word", f"WITH {_LINES} SELECT path, count(*) AS lines, min(line)::INT AS line, arg_min(text, line) AS text FROM l WHERE contains(lower(text), 'thinly') GROUP BY 1 ORDER BY path LIMIT 20")
def _(spark, sf):
    return ft.grep(pj.table(spark, sf, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), "path", "text", "thinly", 20)


@case("T9_grep_words", f"WITH {_LINES} SELECT path, count(*) AS lines, min(line)::INT AS line, arg_min(text, line) AS text FROM l WHERE contains(lower(text), 'thinly') OR contains(lower(text), 'reeder') GROUP BY 1 ORDER BY lines DESC, path LIMIT 20")
def _(spark, sf):
    return ft.grep(pj.table(spark, sf, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), "path", "text", "thinly reeder", 20)


_SIM = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)"


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(pj.table(spark, sf, "embeddings").where("vec_id = 3").first().embedding)


@case("T5_vector_search", f"WITH {_SIM} SELECT * FROM s ORDER BY similarity DESC, id LIMIT 20")
def _(spark, sf):
    return vector.nearest(pj.table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 20)


@case("T6_confidence", f"WITH {_SIM} SELECT avg(similarity) AS confidence FROM (SELECT * FROM s ORDER BY similarity DESC, id LIMIT 3)")
def _(spark, sf):
    return vector.confidence(vector.nearest(pj.table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 20))


@case("J18_batched_vectors", "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q), 6) DESC, vec_id)::INT AS rank FROM embeddings, q) SELECT * FROM s WHERE rank <= 5")
def _(spark, sf):
    vectors = pj.table(spark, sf, "embeddings")
    return vector.nearest_all(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, block=8)


_K = _BM25.replace("{0}", "TRUE").replace("WITH", "", 1)


@case(
    "T8_fusion",
    f"""WITH k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (WITH {_K})), {_SIM}, v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS r FROM (SELECT * FROM s ORDER BY similarity DESC, id LIMIT 50))
 SELECT id, round(coalesce(0.6 / (61 + k.r), 0) + coalesce(0.4 / (61 + v.r), 0), 12) AS score, CASE WHEN k.r IS NULL THEN 'vector' WHEN v.r IS NULL THEN 'keyword' ELSE 'hybrid' END AS source FROM k FULL JOIN v USING (id)""",
)
def _(spark, sf):
    keyword = search.ranked(ft.bm25(pj.table(spark, sf, "documents"), "doc_id", ["text"], list(_TERMS), 50), "score")
    near = search.ranked(vector.nearest(pj.table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 50), "similarity")
    return search.fuse(keyword, near, 0.6, 0.4)


@case("T11_path_weight", _table("path", dict(zip(PATHS, (1.1, 0.3, 1.0, 0.3, 1.0, 0.3, 1.1, 0.3, 0.3, 0.3, 1.0, 1.0, 0.3, 0.3), strict=True))).replace("1.0)", "1.0::DOUBLE)"))
def _(spark, sf):
    return _values(spark, "path", PATHS).select("path", search.path_weight(F.col("path")).alias("result"))


@case("T10_kind_weight", "SELECT * FROM (VALUES ('module','Foo',0.5::DOUBLE),('module','TestFoo',0.15),('class','MockX',0.3),('class','Foo',1.0)) t(kind, name, weight)")
def _(spark, sf):
    rows = spark.createDataFrame([("module", "Foo"), ("module", "TestFoo"), ("class", "MockX"), ("class", "Foo")], "kind string, name string")
    return rows.withColumn("weight", search.kind_weight(F.col("kind"), F.col("name")))


_SEARCH_SQL = f"""WITH {pj.SQL}, k AS (SELECT symbol_id AS id, row_number() OVER (ORDER BY symbol_id) - 1 AS r FROM symbols WHERE name = 'order13' QUALIFY r < 50),
 w AS (SELECT id, 1.0 / (61 + r) * CASE WHEN contains(path, '_test.go') THEN 0.3 ELSE 1.0 END AS score, path, parent_id FROM k JOIN symbols ON symbol_id = id JOIN files USING (file_id)),
 z AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS n FROM w), d AS (SELECT target_id, count(*) AS uses FROM edges GROUP BY 1),
 b AS (SELECT id, parent_id, round(n * (1 + 0.05 * log2(1 + coalesce(uses, 0))) * CASE WHEN contains(path, '_test.') AND n > 0 THEN 0.2 ELSE 1.0 END, 6) AS score, 'keyword' AS source, coalesce(uses, 0) AS refs FROM z LEFT JOIN d ON target_id = id),
 c AS (SELECT DISTINCT target_id FROM edges WHERE kind = 'calls' AND source_id IN (SELECT id FROM b ORDER BY score DESC, id LIMIT 3)),
 e AS (SELECT id, parent_id, score + CASE WHEN id IN (SELECT target_id FROM c) THEN 0.15 ELSE 0 END AS score, source, refs FROM b UNION ALL SELECT symbol_id, parent_id, 0.05, 'graph', 0 FROM c JOIN symbols ON symbol_id = target_id WHERE target_id NOT IN (SELECT id FROM b)),
 t AS (SELECT * FROM e ORDER BY score DESC, id LIMIT 10), u AS (SELECT parent_id, max(score) AS score, max(source) AS source FROM t WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
 f AS (SELECT id, score, source, refs FROM e WHERE parent_id IS NULL OR parent_id NOT IN (SELECT parent_id FROM u) UNION ALL SELECT parent_id, score, source, 0 FROM u WHERE parent_id NOT IN (SELECT id FROM t))
 SELECT id, qualified, kind, round(score, 6) AS score, source, refs AS "references" FROM f JOIN symbols ON symbol_id = id ORDER BY f.score DESC, id LIMIT 10"""


@case("T19_search", _SEARCH_SQL)
def _(spark, sf):
    return search.search(pj.graph(spark, sf), "order13").select("id", "qualified", "kind", F.round("score", 6).alias("score"), "source", "references")


_CONTEXT_SQL = f"""WITH {pj.SQL}, near AS (SELECT DISTINCT source_id AS symbol_id, CASE e.kind WHEN 'inherits' THEN 0 WHEN 'composes' THEN 1 ELSE 4 END AS o, name FROM edges e JOIN symbols t ON t.symbol_id = target_id WHERE e.kind IN ('inherits','composes','calls')),
 fit AS (SELECT *, sum(strlen(name) + 2) OVER (PARTITION BY symbol_id, o ORDER BY name) AS used FROM near), l AS (SELECT symbol_id, o, CASE o WHEN 0 THEN 'inherits: ' WHEN 1 THEN 'composes: ' ELSE 'calls: ' END || string_agg(name, ', ' ORDER BY name) AS line FROM fit WHERE used <= 800 GROUP BY symbol_id, o),
 h AS (SELECT s.symbol_id, 'File: ' || path || chr(10) || kind || ' ' || qualified AS t, max(line) FILTER (o = 0) AS a, max(line) FILTER (o = 1) AS b, max(line) FILTER (o = 4) AS c FROM symbols s JOIN files USING (file_id) LEFT JOIN l USING (symbol_id) GROUP BY s.symbol_id, path, kind, qualified),
 h0 AS (SELECT symbol_id, b, c, CASE WHEN a IS NOT NULL AND strlen(t) + strlen(a) + 1 <= 800 THEN t || chr(10) || a ELSE t END AS t FROM h), h1 AS (SELECT symbol_id, c, CASE WHEN b IS NOT NULL AND strlen(t) + strlen(b) + 1 <= 800 THEN t || chr(10) || b ELSE t END AS t FROM h0)
 SELECT symbol_id, CASE WHEN c IS NOT NULL AND strlen(t) + strlen(c) + 1 <= 800 THEN t || chr(10) || c ELSE t END AS text FROM h1"""


@case("T20_context", _CONTEXT_SQL)
def _(spark, sf):
    return search.context(pj.graph(spark, sf))


@case("S18_frameworks", "SELECT 'Rails' AS name UNION ALL SELECT 'Gin' UNION ALL SELECT 'React' UNION ALL SELECT 'Django'")
def _(spark, sf):
    rows = [("Gemfile", "gem 'rails', '~> 7'"), ("go.mod", "module example.org/x\nrequire github.com/gin-gonic/gin v1.9"), ("package.json", '{"dependencies": {"react": "18"}}'), ("requirements.txt", "Django==5.0\nrequests"), ("vendor/Gemfile", "gem 'sinatra'")]
    return manifests.frameworks(spark.createDataFrame(rows, "path string, content string"))


@case("S19_go_modules", "SELECT 'example.org/x' AS module, '.' AS dir UNION ALL SELECT 'example.org/y', 'sub/y'")
def _(spark, sf):
    return manifests.go_modules(spark.createDataFrame([("go.mod", "module example.org/x\n\ngo 1.22"), ("sub/y/go.mod", "// c\nmodule example.org/y"), ("a.go", "module no")], "path string, content string"))


@case("S21_diff_hunks", "SELECT * FROM (VALUES ('a.go', 3, 4), ('a.go', 10, 10), ('b.rb', 7, 8)) t(path, start, \"end\")")
def _(spark, sf):
    diff = "diff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -1,2 +3,2 @@\n+x\n@@ -9 +10 @@\n+y\ndiff --git a/b.rb b/b.rb\n--- a/b.rb\n+++ b/b.rb\n@@ -5,2 +7,0 @@\n-z\n"
    return manifests.diff_ranges(spark.createDataFrame([(diff,)], "diff string"))


@case("S2_ignore", "SELECT * FROM (VALUES ('a.log', TRUE), ('keep.log', FALSE), ('build/x.o', TRUE), ('src/build/x.o', TRUE), ('docs/a.md', FALSE), ('src/x1.tmp', TRUE), ('src/xa.tmp', FALSE)) t(path, ignored)")
def _(spark, sf):
    rules = ["*.log", "!keep.log", "build/", "/docs/*.txt", "src/x[0-9].tmp"]
    return _values(spark, "path", ("a.log", "keep.log", "build/x.o", "src/build/x.o", "docs/a.md", "src/x1.tmp", "src/xa.tmp")).select("path", manifests.ignored(F.col("path"), rules).alias("ignored"))


@case("S4_generated", "SELECT * FROM (VALUES ('a', TRUE), ('b', FALSE), ('c', TRUE), ('d', FALSE)) t(path, generated)")
def _(spark, sf):
    rows = [("a", "// Code generated by x. DO NOT EDIT.\npackage a"), ("b", "package b\n// Code generated by x. DO NOT EDIT."), ("c", "﻿/* license\n text */\n\n// Code generated by y. DO NOT EDIT.\npackage c"), ("d", "// Code generated, edit freely\npackage d")]
    return spark.createDataFrame(rows, "path string, content string").select("path", manifests.generated(F.col("content")).alias("generated"))


_SOURCE = '"""Doc."""\nimport os\n\nclass Base:\n    pass\n\nclass User(Base):\n    """A user."""\n    LIMIT = 3\n\n    def save(self):\n        return helper(self.name)\n\ndef helper(x):\n    return os.path.join(x)\n\ndef _private():\n    helper(1)\n'


@case("E5_python_symbols", "SELECT * FROM (VALUES ('Base','Base','class','public'),('User','User','class','public'),('LIMIT','User.LIMIT','constant','public'),('save','User.save','method','public'),('helper','helper','function','public'),('_private','_private','function','private')) t(name, qualified, kind, visibility)")
def _(spark, sf):
    found = extractors.extract(spark.createDataFrame([(1, "m.py", _SOURCE)], "file_id long, path string, content string"))
    return extractors.symbols(found).select("name", "qualified", "kind", "visibility")


@case("E5_python_edges", "SELECT * FROM (VALUES ('User','Base','inherits'),('User.save','helper','calls'),('helper','os.path.join','calls'),('_private','helper','calls')) t(source, target, kind)")
def _(spark, sf):
    found = extractors.extract(spark.createDataFrame([(1, "m.py", _SOURCE)], "file_id long, path string, content string"))
    return extractors.edges(found).where("kind <> 'imports'").select("source", "target", "kind")


@case("I2_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, k")
def _(spark, sf):
    return incremental.sessions(pj.table(spark, sf, "events"), "ts", "user_id", "30 minutes")


@case("I10_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return incremental.tumbling(pj.table(spark, sf, "events"), "1 hour")


@case("I6_drift", "SELECT o_orderkey AS path FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderkey % 2 = 0")
def _(spark, sf):
    listing = pj.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    tracked = pj.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit("1998-01-01").cast("timestamp_ntz").alias("indexed_at"))
    return incremental.drifted(listing, tracked).select("path")


@case("X1_fairness", "SELECT o_orderkey AS task, round(0.10 * 0.5 + 0.55 * (o_orderkey % 11) / 10 + 0.15 * (o_orderkey % 5) / 4 + 0.20 * (o_orderkey % 3) / 2, 6) AS score FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0")
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = pj.table(spark, sf, "orders").select(k.alias("task"), F.lit(0.5).alias("keyword"), F.when(k % 7 != 0, (k % 11) / 10).alias("judge"), ((k % 5) / 4).alias("grounding"), ((k % 3) / 2).alias("efficiency"))
    return scoring.fairness(rows).select("task", "score")


@case("X2_gold", "WITH g AS (SELECT DISTINCT l_orderkey AS task, l_partkey AS file FROM lineitem WHERE l_quantity > 10), c AS (SELECT DISTINCT l_orderkey AS task, l_partkey AS file FROM lineitem WHERE l_quantity < 40), n AS (SELECT coalesce(g.task, c.task) AS task, count(*) FILTER (g.file IS NOT NULL AND c.file IS NOT NULL) AS hit, count(c.file) AS claimed, count(g.file) AS gold FROM g FULL JOIN c ON g.task = c.task AND g.file = c.file GROUP BY 1) SELECT task, round(CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END, 6) AS precision, round(CASE WHEN gold > 0 THEN hit / gold ELSE 0 END, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * hit / (claimed + gold) ELSE 0 END, 6) AS f1 FROM n")
def _(spark, sf):
    l = pj.table(spark, sf, "lineitem")  # noqa: E741
    rows = lambda w: l.where(w).select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("file"))
    return scoring.gold(rows("l_quantity < 40"), rows("l_quantity > 10"))


@case("X3_grounding", "SELECT l_orderkey AS task, count(*) AS citations, count(*) FILTER (p_partkey IS NOT NULL AND l_linenumber BETWEEN 1 AND p_size) AS grounded FROM lineitem LEFT JOIN (FROM part WHERE p_partkey % 5 > 0) ON l_partkey = p_partkey GROUP BY 1")
def _(spark, sf):
    cited = pj.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"))
    listing = pj.table(spark, sf, "part").where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("lines"))
    return scoring.grounding(cited, listing)


@case("X4_variance", "SELECT o_custkey AS scenario, count(*) AS runs, round(avg(floor(o_totalprice)), 2) AS mean, round(stddev_samp(floor(o_totalprice)), 2) AS deviation FROM orders GROUP BY 1")
def _(spark, sf):
    return scoring.variance(pj.table(spark, sf, "orders").select(F.col("o_custkey").alias("scenario"), F.floor("o_totalprice").alias("score")), 2)


@case("S25_snippets", f"""WITH {_LINES}, s AS (SELECT DISTINCT 'd' || doc_id AS path, 2 AS "at" FROM documents WHERE doc_id BETWEEN 10 AND 19) SELECT l.path, "at", string_agg(text, chr(10) ORDER BY line) AS snippet FROM l JOIN s ON l.path = s.path AND line BETWEEN "at" - 2 AND "at" + 2 GROUP BY ALL""")
def _(spark, sf):
    docs = pj.table(spark, sf, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    sites = docs.where("doc_id between 10 and 19").select("path", F.lit(2).alias("line"))
    return present.snippets(sites, ft.lines(docs, "path", "text"))
