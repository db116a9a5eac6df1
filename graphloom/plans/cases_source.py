"""Queries over generated sources, listings and feeds: extractors, trees, history, incremental maintenance, text functions.

Sources are written from the tables by a template per language, one file a part; what an extractor must find in them follows from the
template and the part's key alone, so SQL states it without reading any source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.model import Graph
from graphloom.operators import present, search, store
from graphloom.operators import fulltext as ft
from graphloom.sources import extractors as ex
from graphloom.sources import manifests
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


# --- Extractors --------------------------------------------------------------------------------------------------------------------

#: Language: extension, source, symbols (name, qualified, kind, visibility, parent or '', first line, last line), edges (source or '', target, kind, line, confidence). {k} is the part's key.
TEMPLATES = {
    "go": (
        "go", "package shop\n\n// Box{k} holds items.\ntype Box{k} struct {\n\tn int\n}\n\nfunc (b *Box{k}) Get() int {\n\treturn help{k}(1)\n}\n\nfunc help{k}(n int) int {\n\treturn n\n}\n",
        [("Box{k}", "Box{k}", "class", "public", "", 4, 6), ("Get", "Box{k}.Get", "method", "public", "Box{k}", 8, 10), ("help{k}", "help{k}", "function", "private", "", 12, 14)],
        [("Box{k}.Get", "help{k}", "calls", 9, 1.0)],
    ),
    "ruby": (
        "rb", "class Order{k} < Base\n  include Payable\n  has_many :line_items\n\n  def total\n    add{k}(1)\n  end\n\n  private\n\n  def hidden{k}\n    2\n  end\nend\n",
        [("Order{k}", "Order{k}", "class", "public", "", 1, 14), ("total", "Order{k}#total", "method", "public", "Order{k}", 5, 7), ("hidden{k}", "Order{k}#hidden{k}", "method", "private", "Order{k}", 11, 13)],
        [("Order{k}", "Base", "inherits", 1, 1.0), ("Order{k}", "Payable", "includes", 2, 1.0), ("Order{k}", "LineItem", "composes", 3, 0.9), ("Order{k}#total", "add{k}", "calls", 6, 1.0)],
    ),
    "typescript": (
        "ts", "import { sum } from './math'\n\nexport class Cart{k} extends Base {\n  private total(): number {\n    return sum{k}(1)\n  }\n}\n\nexport interface Shape{k} {\n}\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 3, 7), ("total", "Cart{k}.total", "method", "private", "Cart{k}", 4, 6), ("Shape{k}", "Shape{k}", "interface", "public", "", 9, 10)],
        [("", "./math", "imports", 1, 1.0), ("Cart{k}", "Base", "inherits", 3, 1.0), ("Cart{k}.total", "sum{k}", "calls", 5, 1.0)],
    ),
    "python": (
        "py", "import os\n\nclass Box{k}(Base):\n    '''Holds items.'''\n    LIMIT = 3\n\n    def get(self):\n        return help{k}(1)\n\n    def _hidden(self):\n        return self.get()\n\ndef help{k}(n):\n    b = Box{k}()\n    return b.get()\n",
        [("Box{k}", "Box{k}", "class", "public", "", 3, 11), ("LIMIT", "Box{k}.LIMIT", "constant", "public", "Box{k}", 5, 5), ("get", "Box{k}.get", "method", "public", "Box{k}", 7, 8), ("_hidden", "Box{k}._hidden", "method", "private", "Box{k}", 10, 11), ("help{k}", "help{k}", "function", "public", "", 13, 15)],
        [("", "os", "imports", 1, 1.0), ("Box{k}", "Base", "inherits", 3, 1.0), ("Box{k}.get", "help{k}", "calls", 8, 1.0), ("Box{k}._hidden", "Box{k}.get", "calls", 11, 1.0), ("help{k}", "Box{k}", "calls", 14, 1.0), ("help{k}", "Box{k}.get", "calls", 15, 1.0)],
    ),
    "rust": (
        "rs", "use std::fmt;\n\npub struct Cart{k} {\n    n: u32,\n}\n\nimpl Shop for Cart{k} {\n    fn add(&self) {\n        check{k}(1);\n    }\n}\n\nfn check{k}(n: u32) {\n}\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 3, 5), ("add", "Cart{k}::add", "method", "private", "Cart{k}", 8, 10), ("check{k}", "check{k}", "function", "private", "", 13, 14)],
        [("", "std::fmt", "imports", 1, 1.0), ("Cart{k}", "Shop", "inherits", 7, 1.0), ("Cart{k}::add", "check{k}", "calls", 9, 1.0)],
    ),
    "php": (
        "php", "<?php\nclass Cart{k} extends Base {\n    use Payable;\n    public function total() {\n        return sum{k}(1);\n    }\n    private function hidden() {\n        return 2;\n    }\n}\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 2, 10), ("total", "Cart{k}\\total", "method", "public", "Cart{k}", 4, 6), ("hidden", "Cart{k}\\hidden", "method", "private", "Cart{k}", 7, 9)],
        [("Cart{k}", "Base", "inherits", 2, 1.0), ("Cart{k}", "Payable", "includes", 3, 1.0), ("Cart{k}\\total", "sum{k}", "calls", 5, 1.0)],
    ),
    "csharp": (
        "cs", "using System;\n\npublic class Cart{k} : Base {\n    private int Total() {\n        return Sum{k}(1);\n    }\n}\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 3, 7), ("Total", "Cart{k}.Total", "method", "private", "Cart{k}", 4, 6)],
        [("", "System", "imports", 1, 1.0), ("Cart{k}", "Base", "inherits", 3, 1.0), ("Cart{k}.Total", "Sum{k}", "calls", 5, 1.0)],
    ),
    "java": (
        "java", "import java.util.List;\n\npublic class Cart{k} extends Base {\n    @Override\n    public int total() {\n        return sum{k}(1);\n    }\n}\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 3, 8), ("total", "Cart{k}.total", "method", "public", "Cart{k}", 5, 7)],
        [("", "java.util.List", "imports", 1, 1.0), ("Cart{k}", "Base", "inherits", 3, 1.0), ("Cart{k}.total", "sum{k}", "calls", 6, 1.0)],
    ),
    "kotlin": (
        "kt", "class Cart{k} : Base() {\n    fun total(): Int {\n        return sum{k}(1)\n    }\n}\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 1, 5), ("total", "Cart{k}.total", "method", "public", "Cart{k}", 2, 4)],
        [("Cart{k}", "Base", "inherits", 1, 1.0), ("Cart{k}.total", "sum{k}", "calls", 3, 1.0)],
    ),
    "scala": (
        "scala", "class Cart{k} extends Base {\n  def total(): Int = {\n    sum{k}(1)\n  }\n}\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 1, 5), ("total", "Cart{k}.total", "method", "public", "Cart{k}", 2, 4)],
        [("Cart{k}", "Base", "inherits", 1, 1.0), ("Cart{k}.total", "sum{k}", "calls", 3, 1.0)],
    ),
    "c": (
        "c", "#include <stdio.h>\n\nstatic int total{k}(int n) {\n    return sum{k}(n);\n}\n",
        [("total{k}", "total{k}", "function", "private", "", 3, 5)],
        [("", "stdio.h", "imports", 1, 1.0), ("total{k}", "sum{k}", "calls", 4, 1.0)],
    ),
    "cpp": (
        "cpp", "class Cart{k} : public Base {\npublic:\n    int total() {\n        return sum{k}(1);\n    }\n};\n",
        [("Cart{k}", "Cart{k}", "class", "public", "", 1, 6), ("total", "Cart{k}::total", "method", "public", "Cart{k}", 3, 5)],
        [("Cart{k}", "Base", "inherits", 1, 1.0), ("Cart{k}::total", "sum{k}", "calls", 4, 1.0)],
    ),
}
VIEW = "<div data-controller=\"users--list-item{k}\">\n<%= render 'cart/row{k}' %>\n<%= link_to t('cart.title{k}'), cart{k}_path %>\n<%= helper{k}(1) %>\n</div>\n"
VIEW_EDGES = [("Users::ListItem{k}Controller", "calls", 1), ("partial:cart/row{k}", "calls", 2), ("i18n:cart.title{k}", "references", 3), ("route:cart{k}", "calls", 3), ("helper{k}", "calls", 4)]


def _filled(template: str):
    """A template with the part's key in place of its blanks, as a column."""
    pieces = template.split("{k}")
    return F.concat(*(x for k, p in enumerate(pieces) for x in ([F.col("p_partkey").cast("string")] if k else []) + [F.lit(p)]))


#: Generated files of a task.
FILES = 10_000


def sources(spark, sf, *languages):
    """file_id, path, content: for each part a file of each language. Keys are dealt out by their count, since a small table makes many files."""
    part = pj.table(spark, sf, "part").select("p_partkey")
    part = part.repartition(max(1, -(-part.count() * len(languages) // FILES)), "p_partkey")
    made = [F.struct(F.col("p_partkey").alias("file_id"), F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit("." + TEMPLATES[x][0])).alias("path"), _filled(TEMPLATES[x][1]).alias("content")) for x in languages]
    return part.select(F.inline(F.array(*made)))


def _literal(rows) -> str:
    shown = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(shown(v) for v in r) + ")" for r in rows) + ")"


_K = "replace({0}, '{{k}}', p_partkey::VARCHAR)"


def _symbols_sql(*languages: str, columns: str = "language, path, name, qualified, kind, visibility, parent, line_start, line_end") -> str:
    rows = [(x, TEMPLATES[x][0], *r) for x in languages for r in TEMPLATES[x][2]]
    return f"SELECT {columns} FROM (SELECT language, 'src/p' || p_partkey || '.' || ext AS path, {_K.format('n')} AS name, {_K.format('q')} AS qualified, kind, visibility, {_K.format('o')} AS parent, a::INT AS line_start, z::INT AS line_end FROM part, {_literal(rows)} t(language, ext, n, q, kind, visibility, o, a, z))"


def _edges_sql(*languages: str, where: str = "TRUE") -> str:
    rows = [(x, TEMPLATES[x][0], *r) for x in languages for r in TEMPLATES[x][3]]
    return f"SELECT * FROM (SELECT language, 'src/p' || p_partkey || '.' || ext AS path, {_K.format('s')} AS source, {_K.format('t')} AS target, kind, l::INT AS line, c AS confidence FROM part, {_literal(rows)} t(language, ext, s, t, kind, l, c)) WHERE {where}"


def _symbols(spark, sf, *languages):
    return ex.symbols(ex.extract(sources(spark, sf, *languages))).select("language", "path", "name", "qualified", "kind", "visibility", F.coalesce("parent", F.lit("")).alias("parent"), "line_start", "line_end")


def _edges(spark, sf, *languages):
    return ex.edges(ex.extract(sources(spark, sf, *languages))).select("language", "path", F.coalesce("source", F.lit("")).alias("source"), "target", "kind", "line", "confidence")


ROWS = {"E1_go": ("go",), "E2_ruby": ("ruby",), "E4_typescript": ("typescript",), "E5_python_files": ("python",), "E6_rust": ("rust",), "E7_php": ("php",), "E8_csharp": ("csharp",), "E9_curly": ("java", "kotlin", "scala", "c", "cpp")}
for _name, _languages in ROWS.items():
    QUERIES[f"{_name}_symbols"] = lambda spark, sf, x=_languages: _symbols(spark, sf, *x)
    QUERIES[f"{_name}_edges"] = lambda spark, sf, x=_languages: _edges(spark, sf, *x)
    ORACLE_SQL[f"{_name}_symbols"], ORACLE_SQL[f"{_name}_edges"] = _symbols_sql(*_languages), _edges_sql(*_languages)


@case("E3_templates", f"SELECT p_partkey AS file_id, {_K.format('t')} AS target, kind, l::INT AS line FROM part, {_literal(VIEW_EDGES)} v(t, kind, l)")
def _(spark, sf):
    views = pj.table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.lit("app/views/x.html.erb").alias("path"), _filled(VIEW).alias("content"))
    return ex.edges(ex.extract(views)).select("file_id", "target", "kind", "line")


@case("E18_embedded", "SELECT p_partkey AS file_id, 'helper' || p_partkey AS target, 4::INT AS line FROM part")
def _(spark, sf):
    views = pj.table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.lit("app/views/x.html.erb").alias("path"), _filled(VIEW).alias("content"))
    return ex.edges(ex.extract(views)).where("target not like '%:%'").select("file_id", "target", "line")


_ALL = tuple(TEMPLATES)


@case("S6_registry", "SELECT language, count(*) AS files FROM (" + _symbols_sql(*_ALL, columns="DISTINCT language, path") + ") GROUP BY 1")
def _(spark, sf):
    more = sources(spark, sf, *_ALL).unionByName(spark.createDataFrame([(0, "notes.unknown", "x"), (0, "Makefile", "all:")], "file_id long, path string, content string"))
    return ex.extract(more).groupBy("language").agg(F.count("*").alias("files"))


@case("S7_parse_rows", "SELECT path, count(*) AS symbols, arg_min(qualified, (length(qualified), line_start)) AS first FROM (" + _symbols_sql("python", "ruby") + ") GROUP BY 1 UNION ALL SELECT 'broken.py', 0, NULL")
def _(spark, sf):
    """A file that can't be read has no symbols; the others' come by the length of their qualified names."""
    broken = spark.createDataFrame([(-1, "broken.py", "def (:")], "file_id long, path string, content string")
    found = ex.extract(sources(spark, sf, "python", "ruby").unionByName(broken))
    return found.select("path", F.size("symbols").cast("long").alias("symbols"), F.get("symbols", 0)["qualified"].alias("first"))


@case("E10_mentions", "SELECT 'go' AS language, name FROM (SELECT unnest(['help' || p_partkey, 'n', 'int', 'return', 'package', 'shop']) AS name FROM part) GROUP BY name")
def _(spark, sf):
    return ex.names(ex.extract(sources(spark, sf, "go"))).where("set = 'mentions'").select("language", "name")


@case("E11_bare_names", _edges_sql("python", "ruby", "go", where="kind = 'calls'"))
def _(spark, sf):
    return _edges(spark, sf, "python", "ruby", "go").where("kind = 'calls'")


@case("E12_local_types", _edges_sql("python", where="source LIKE 'help%' AND target LIKE '%.get'"))
def _(spark, sf):
    return _edges(spark, sf, "python").where("source like 'help%' and target like '%.get'")


@case("E13_docstrings", "SELECT 'src/p' || p_partkey || '.py' AS path, 'Holds items.' AS docstring FROM part UNION ALL SELECT 'src/p' || p_partkey || '.go', 'Box' || p_partkey || ' holds items.' FROM part")
def _(spark, sf):
    return ex.symbols(ex.extract(sources(spark, sf, "python", "go"))).where("docstring is not null").select("path", "docstring")


@case("E14_visibility", "SELECT language, visibility, count(*) AS symbols FROM (" + _symbols_sql(*_ALL) + ") GROUP BY ALL")
def _(spark, sf):
    return _symbols(spark, sf, *_ALL).groupBy("language", "visibility").agg(F.count("*").alias("symbols"))


@case("E15_constants", _symbols_sql("python", columns="path, qualified") + " WHERE kind = 'constant'")
def _(spark, sf):
    return _symbols(spark, sf, "python").where("kind = 'constant'").select("path", "qualified")


@case("E16_reflective", "SELECT 'python' AS language, 'f' || p_partkey AS name FROM part UNION ALL SELECT 'ruby', 'g' || p_partkey FROM part")
def _(spark, sf):
    part = pj.table(spark, sf, "part")
    py = part.select(F.col("p_partkey").alias("file_id"), F.lit("a.py").alias("path"), _filled("getattr(x, 'f{k}')()\n").alias("content"))
    rb = part.select(F.col("p_partkey").alias("file_id"), F.lit("a.rb").alias("path"), _filled("x.public_send(:g{k})\n").alias("content"))
    return ex.names(ex.extract(py.unionByName(rb))).where("set = 'dispatch'").select("language", "name")


@case("E17_annotations", "SELECT 'java' AS language, 'annotated' AS \"set\", 'total' AS name UNION ALL SELECT 'python', 'routes', 'page' || p_partkey FROM part")
def _(spark, sf):
    py = pj.table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.lit("a.py").alias("path"), _filled("@app.route('/x')\ndef page{k}():\n    pass\n").alias("content"))
    return ex.names(ex.extract(sources(spark, sf, "java").unionByName(py))).where("set in ('annotated', 'routes')").select("language", "set", "name")


# --- Trees, history ----------------------------------------------------------------------------------------------------------------


def _listing(spark, sf):
    """Documents as files: every eleventh in a dot folder, every seventh in a vendored one."""
    d, i = pj.table(spark, sf, "documents"), F.col("doc_id")
    folder = F.when(i % 11 == 0, ".git/").when(i % 7 == 0, "vendor/").otherwise(F.concat("source", F.lit("/")))
    return d.select(F.concat(folder, F.lit("d"), i.cast("string"), F.lit(".txt")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), F.coalesce("text", F.lit("")).alias("content"))


_PATH = "CASE WHEN doc_id % 11 = 0 THEN '.git/' WHEN doc_id % 7 = 0 THEN 'vendor/' ELSE source || '/' END || 'd' || doc_id || '.txt'"


@case("S1_tree", f"SELECT {_PATH} AS path, strlen(coalesce(text, '')) AS length FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0")
def _(spark, sf):
    return manifests.kept(_listing(spark, sf), ["vendor/"], 1 << 20).select("path", "length")


@case("S3_size", f"SELECT {_PATH} AS path FROM documents WHERE doc_id % 11 <> 0 AND strlen(coalesce(text, '')) <= 2048")
def _(spark, sf):
    return manifests.kept(_listing(spark, sf), None, 2).select("path")


@case("S20_git_log", "SELECT DISTINCT l_orderkey::VARCHAR AS commit_id, 'lib/p' || l_partkey || '.rb' AS path FROM lineitem")
def _(spark, sf):
    paths = F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("lib/p"), F.col("l_partkey").cast("string"), F.lit(".rb")))), "\n")
    log = pj.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("\x01"), F.col("l_orderkey").cast("string"), F.lit("\n\n"), paths, F.lit("\n")).alias("log"))
    return manifests.commits(log.select("log"))


@case("S22_grep", "SELECT 'd' || doc_id AS path, count(*) AS lines, min(i)::INT AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE contains(lower(l), 'token') GROUP BY 1 ORDER BY path LIMIT 1000000")
def _(spark, sf):
    docs = pj.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    return ft.grep(docs, "path", "text", "token", 1_000_000).select("path", "lines", "line")


@case("S24_markdown", "SELECT '## A' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || chr(10) || 'Omitted: B' AS text")
def _(spark, sf):
    return spark.createDataFrame([(present.markdown([("A", ["one", "two"]), ("B", ["x" * 50])], 6),)], "text string")


@case("P20_hashes", "SELECT doc_id, sha256(coalesce(text, ''))[1:16] AS hash FROM documents")
def _(spark, sf):
    return pj.table(spark, sf, "documents").select("doc_id", store.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


# --- Text, mathematics, JSON -------------------------------------------------------------------------------------------------------


@case("P4_sanitizer", "SELECT * FROM (VALUES ('getURL foo', 'geturl'), ('getURL foo', 'foo'), ('getURL foo', 'get url foo'), ('a-b', 'a b'), ('\"x\" OR *', 'x'), ('\"x\" OR *', 'or')) t(query, phrase)")
def _(spark, sf):
    return spark.createDataFrame([(q, " ".join(p)) for q in ("getURL foo", "a-b", '"x" OR *') for p in ft.query_terms(q)], "query string, phrase string")


@case("P23_wordpieces", "SELECT * FROM (VALUES ('unhappy cat', '2,5,6,7,3'), ('dog', '2,1,3'), ('cats!', '2,7,8,9,3')) t(text, ids)")
def _(spark, sf):
    vocabulary = {"[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "un": 5, "##happy": 6, "cat": 7, "##s": 8, "!": 9}
    return spark.createDataFrame([(t, ",".join(map(str, text.wordpieces(t, vocabulary)))) for t in ("unhappy cat", "dog", "cats!")], "text string, ids string")


@case("P24_json_sets", "SELECT event_type AS key, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS names FROM events GROUP BY 1")
def _(spark, sf):
    rows = pj.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("name")).distinct()
    half = store.union_names(spark.createDataFrame([], "key string, value string"), rows.where("name like '%1'"))
    meta = store.union_names(half, rows.where("name not like '%1'"))
    read = [store.names(meta, k).withColumn("key", F.lit(k)) for k in ("view", "signup", "click", "error", "purchase")]
    every = read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3]).unionByName(read[4])
    return every.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@case("P25_mathematics", "SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS dot, round(log2(1 + vec_id), 6) AS boost FROM embeddings")
def _(spark, sf):
    x = F.col("embedding")
    dot = F.aggregate(F.zip_with(x, x, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return pj.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(dot, 4).alias("dot"), F.round(F.log2(1 + F.col("vec_id")), 6).alias("boost"))


_BM = """(WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), m AS (SELECT doc_id, len(w) AS n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (SELECT unnest([TERMS]) AS term)),
 d AS (SELECT term, count(*) AS df FROM m WHERE tf > 0 GROUP BY 1), c AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w)
 SELECT doc_id AS id, round(sum(greatest(ln((c.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * m.n / a))), 6) AS score FROM m JOIN d USING (term), c WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, id LIMIT 50)"""


def _bm(*terms: str) -> str:
    return _BM.replace("TERMS", ", ".join(map(repr, terms)))


@case("W1_rank_positions", f"SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT - 1 AS rank FROM {_bm('reeder', 'the')}")
def _(spark, sf):
    return search.ranked(ft.bm25(pj.table(spark, sf, "documents"), "doc_id", ["text"], ["reeder", "the"], 50), "score")


@case("T8b_merge", f"SELECT id, round(sum(r), 12) AS score, 'keyword' AS source FROM (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS r FROM {_bm('reeder', 'the')} UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM {_bm('whan')}) GROUP BY 1")
def _(spark, sf):
    docs = pj.table(spark, sf, "documents")
    return search.merge([ft.bm25(docs, "doc_id", ["text"], t, 50).withColumn("source", F.lit("keyword")) for t in (["reeder", "the"], ["whan"])])


@case("U2_keyed_union", f"WITH k AS (FROM {_bm('thinly')}) SELECT id, score FROM k UNION ALL SELECT id, 1.0 FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE contains(lower(text), 'the ') AND doc_id NOT IN (SELECT id FROM k)) WHERE r <= 50 - (SELECT count(*) FROM k)")
def _(spark, sf):
    counts = ft.counted(pj.table(spark, sf, "documents"), "doc_id", ["text"], ["thinly"], (F.col("text"),))
    return search.keyword_leg(counts, ["thinly"], "text", "The ", ["thinly"], ft.statistics(counts, ["thinly"]), 50, 50)


# --- Incremental maintenance -------------------------------------------------------------------------------------------------------


@case("I4_applied", f"WITH {pj.SQL} SELECT symbol_id, name FROM symbols WHERE file_id % 3 = 0 UNION ALL SELECT symbol_id, 'again' FROM symbols WHERE file_id % 3 = 1 AND kind = 'class'")
def _(spark, sf):
    """Files of one residue are removed, those of another replaced by their classes alone."""
    g = pj.graph(spark, sf)
    fresh = Graph(g.files.where("file_id % 3 = 1"), g.symbols.where("file_id % 3 = 1 and kind = 'class'").withColumn("name", F.lit("again")), g.edges.where("false"))
    return incremental.applied(g, fresh, g.files.where("file_id % 3 = 2").select("path")).symbols.select("symbol_id", "name")


@case("I5_branch_switch", "SELECT 'n' || n_nationkey AS path, CASE WHEN n_nationkey % 3 = 1 THEN 'removed' ELSE 'changed' END AS op FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT 'old' || n_nationkey, 'removed' FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 'new' || n_nationkey, 'changed' FROM nation WHERE n_nationkey % 3 = 2")
def _(spark, sf):
    k, i = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    line = F.when(k % 3 == 0, F.concat(F.lit("M\tn"), i)).when(k % 3 == 1, F.concat(F.lit("D\tn"), i)).otherwise(F.concat(F.lit("R100\told"), i, F.lit("\tnew"), i))
    return incremental.branch_switch(pj.table(spark, sf, "nation").select(line.alias("line")))


_SEEN = "listing AS (SELECT user_id::VARCHAR AS path, max(ts) AS modified FROM events GROUP BY 1), tracked AS (SELECT user_id::VARCHAR AS path, min(ts) AS indexed_at FROM events WHERE user_id % 2 = 0 GROUP BY 1)"


def _feeds(spark, sf):
    e = pj.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), "user_id", "ts")
    return e.groupBy("path").agg(F.max("ts").alias("modified")), e.where("user_id % 2 = 0").groupBy("path").agg(F.min("ts").alias("indexed_at"))


@case("I7_freshness", f"WITH {_SEEN} SELECT (SELECT count(*) FROM listing LEFT JOIN tracked USING (path) WHERE indexed_at IS NULL OR modified > indexed_at) AS stale, (SELECT count(*) FROM listing) AS files, (SELECT max(modified) FROM listing) = (SELECT max(ts) FROM events) AS newest")
def _(spark, sf):
    found = incremental.freshness(*_feeds(spark, sf))
    last = pj.table(spark, sf, "events").agg(F.max("ts").alias("last"))
    return found.crossJoin(last).select("stale", "files", (F.col("newest") == F.col("last")).alias("newest"))  # a row each


@case("I9_deferred_vectors", "SELECT vec_id AS symbol_id, CASE WHEN vec_id % 3 = 0 THEN 64 ELSE 2 END::INT AS dimensions FROM embeddings")
def _(spark, sf):
    e = pj.table(spark, sf, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.col("embedding").alias("vector"))
    embed = lambda owed: owed.select("symbol_id", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>").alias("vector"))
    return incremental.deferred_vectors(e.select("symbol_id"), e.where("symbol_id % 3 = 0"), embed).select("symbol_id", F.size("vector").alias("dimensions"))


@case("I3_last_operation", "SELECT path, CASE WHEN c > 0 THEN 'changed' ELSE 'removed' END AS op FROM (SELECT user_id::VARCHAR AS path, arg_max(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, (ts, event_id)) AS c FROM events GROUP BY 1)")
def _(spark, sf):
    feed = pj.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "removed").otherwise("changed").alias("op"), F.struct("ts", "event_id").alias("ts"))
    return incremental.last_operations(feed)


@case("Q3_aliases", "SELECT * FROM (VALUES ('limit', '5'), ('query', 'x'), ('max_hops', '2')) t(name, value)")
def _(spark, sf):
    return spark.createDataFrame([(k, str(v)) for k, v in present.canonical({"q": "y", "query": "x", "n": 5, "hops": 2}).items()], "name string, value string")


@case("Q4_presets", "SELECT * FROM (VALUES ('hops', '7'), ('watch', 'False'), ('cap', '200')) t(name, value)")
def _(spark, sf):
    p = present.Preset.of({"hops": 7}, {"GRAPHLOOM_WATCH": "no", "GRAPHLOOM_HOPS": "2"})
    return spark.createDataFrame([(k, str(getattr(p, k))) for k in ("hops", "watch", "cap")], "name string, value string")


@case("Q7_next_steps", "SELECT * FROM (VALUES (0, 'Search by meaning for the nearest symbols.'), (20, 'Lower min_confidence to see 3 more.'), (20, 'Ask for the impact before changing this.')) t(total, hint)")
def _(spark, sf):
    return spark.createDataFrame([(t, h) for t, n in ((0, 0), (20, 3)) for h in present.next_steps(t, n, False)], "total int, hint string")
