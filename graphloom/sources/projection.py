"""The driver's star schema as a property graph, in Spark and in the SQL that results are held against.

Nations are files, customers classes, suppliers interfaces, parts functions and orders methods of their customers; lines and keys give the
edges. Every id is arithmetic on keys, so both sides agree without any ordering. The graph is stored once per application and folder, each
relation when it is first asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.shared import settle
from graphloom.model import Graph

LANGUAGES = ("go", "ruby", "python", "typescript", "java")
CUSTOMER, SUPPLIER, PART, ORDER = (k * 1_000_000_000 for k in (1, 2, 3, 4))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    word = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    name = F.when(F.col("n_nationkey") % 5 == 4, "node_test.go").otherwise("node.go")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("file_id"),
        F.concat_ws("/", word("r_name"), word("n_name"), name).alias("path"),
        F.get(F.array(*map(F.lit, LANGUAGES)), F.col("r_regionkey").cast("int")).alias("language"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, part, orders = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part", "orders"))

    def rows(df: DataFrame, base: int, key: str, file, name, qualified, kind: str, visibility, parent) -> DataFrame:
        line = (F.col(key) % 1000).cast("int")
        return df.select(
            (F.col(key) + base).alias("symbol_id"), file.cast("long").alias("file_id"), name.alias("name"), qualified.alias("qualified"), F.lit(kind).alias("kind"),
            visibility.alias("visibility"), parent.cast("long").alias("parent_id"), line.alias("line_start"), (line + 9).alias("line_end"),
        )

    public, none = F.lit("public"), F.lit(None)
    owned = orders.join(customer.select("c_custkey", "c_name", "c_nationkey"), orders.o_custkey == customer.c_custkey)
    method = F.concat(F.lit("order"), (F.col("o_orderkey") % 97).cast("string"))
    unioned = [
        rows(customer, CUSTOMER, "c_custkey", F.col("c_nationkey"), F.col("c_name"), F.col("c_name"), "class", public, none),
        rows(supplier, SUPPLIER, "s_suppkey", F.col("s_nationkey"), F.col("s_name"), F.col("s_name"), "interface", public, none),
        rows(part, PART, "p_partkey", F.col("p_partkey") % 25, F.col("p_name"), F.col("p_name"), "function", public, none),
        rows(owned, ORDER, "o_orderkey", F.col("c_nationkey"), method, F.concat_ws("#", "c_name", method), "method", F.when(F.col("o_orderstatus") == "F", "private").otherwise("public"), F.col("o_custkey") + CUSTOMER),
    ]
    return unioned[0].unionByName(unioned[1]).unionByName(unioned[2]).unionByName(unioned[3])


#: Pairs of a customer and a supplier that a task makes: so many at most, about, and no fewer for the sake of more tasks.
PAIRS, FEW = 1 << 23, 1 << 19


def kin(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """source_id, target_id, file_id: customers and suppliers of a nation and last digit.

    The pairs grow with the product of the two tables, so they are never stored: each reader has them from the tables. The customers are
    dealt by source_id into as many tasks as the counted pairs need, whatever the size of their table.
    """
    cell = lambda df, key, nation: df.groupBy(F.col(nation).alias("n"), (F.col(key) % 10).alias("d"))
    mine, theirs = cell(customer, "c_custkey", "c_nationkey").agg(F.count("*").alias("a")), cell(supplier, "s_suppkey", "s_nationkey").agg(F.count("*").alias("b"))
    pairs = mine.join(theirs, ["n", "d"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    source = customer.select((F.col("c_custkey") + CUSTOMER).alias("source_id"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 10).alias("d"), F.col("c_nationkey").cast("long").alias("file_id"))
    target = supplier.select((F.col("s_suppkey") + SUPPLIER).alias("target_id"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 10).alias("d"))
    tasks = max(1, -(-pairs // PAIRS), min(3 * customer.sparkSession.sparkContext.defaultParallelism, pairs // FEW))
    return source.repartition(tasks, "source_id").join(target, ["n", "d"]).select("source_id", "target_id", "file_id")


def edges(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Edges that need a join or an aggregate over lines or orders are stored, one table a kind; the others come from their tables."""
    customer, supplier, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    rows = lambda df, source, target, file, confidence: df.select(source.alias("source_id"), target.alias("target_id"), file.cast("long").alias("file_id"), confidence.cast("double").alias("confidence"))
    nations = customer.select("c_custkey", "c_nationkey")
    calls = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.round(1 - F.max("l_discount"), 2).alias("conf"))
    calls = calls.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(nations, F.col("o_custkey") == F.col("c_custkey"))
    uses = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    parts = customer.where(F.floor(F.col("c_custkey") / 10) > 0)
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    chain = orders.select("o_orderkey", "o_custkey", before.alias("p")).where("p is not null").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    all_ = [
        ("calls", settle(rows(calls, F.col("l_orderkey") + ORDER, F.col("l_partkey") + PART, F.col("c_nationkey"), F.col("conf")), "calls")),
        ("calls", settle(rows(chain, F.col("o_orderkey") + ORDER, F.col("p") + ORDER, F.col("c_nationkey"), F.lit(1.0)), "chain")),
        ("references", settle(rows(uses, F.col("l_partkey") + PART, F.col("l_suppkey") + SUPPLIER, F.col("l_partkey") % 25, F.when(F.col("n") > 1, 0.8).otherwise(0.5)), "uses")),
        ("inherits", kin(customer, supplier).withColumn("confidence", F.lit(0.9))),
        ("composes", rows(parts, F.col("c_custkey") + CUSTOMER, F.floor(F.col("c_custkey") / 10) + CUSTOMER, F.col("c_nationkey"), F.lit(0.9))),
    ]
    return [df.select("source_id", "target_id", F.lit(kind).alias("kind"), "file_id", "confidence") for kind, df in all_]


#: Stored graphs of this process by application, folder and name: an index is built once and asked many times.
_STORED: dict[tuple[str, str, str], Graph] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, files: Callable[[], DataFrame], symbols: Callable[[], DataFrame], edges: Callable[[], list[DataFrame]]) -> Graph:
    """A graph whose files and symbols are written, and whose edges are made, at the first question for them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = Graph(cache(lambda: settle(files(), "files")), cache(lambda: settle(symbols(), "symbols")), cache(edges))
    return _STORED[key]


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The stored graph of a folder's tables."""
    return stored(spark, sf_dir, "graph", lambda: files(spark, sf_dir), lambda: symbols(spark, sf_dir), lambda: edges(spark, sf_dir))


def variant(spark: SparkSession, sf_dir: str) -> Graph:
    """The same graph with what it lacks: class names with suffixes, qualified names in scopes, methods of interfaces, and entry files.

    Classes are named after their market segment and qualified by their directory; methods of even keys belong to one of ten interfaces; every
    fifth file is a main.go.
    """
    g = graph(spark, sf_dir)
    return stored(spark, sf_dir, "variant", lambda: _variant_files(g), lambda: _variant_symbols(spark, sf_dir, g), lambda: g.parts)


def _variant_files(g: Graph) -> DataFrame:
    return g.files.withColumn("path", F.when(F.col("file_id") % 5 == 0, F.replace("path", F.lit("node.go"), F.lit("main.go"))).otherwise(F.col("path")))


def _variant_symbols(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    scope = F.replace(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"), F.lit("::"))
    segment = table(spark, sf_dir, "customer").select((F.col("c_custkey") + CUSTOMER).alias("owner"), F.initcap(F.lower("c_mktsegment")).alias("segment"), F.col("c_custkey").alias("key"))
    owner = F.when(F.col("kind") == "class", F.col("symbol_id")).when(F.col("kind") == "method", F.col("parent_id"))
    s = g.symbols.withColumn("owner", owner).join(segment, "owner", "left").join(_variant_files(g).select("file_id", scope.alias("scope")), "file_id")
    named = F.concat(F.lit("C"), F.col("key").cast("string"), F.col("segment"))
    full = F.concat_ws("::", "scope", named)
    s = s.withColumns({
        "name": F.when(F.col("kind") == "class", named).otherwise(F.col("name")),
        "qualified": F.when(F.col("kind") == "class", full).when(F.col("kind") == "method", F.concat_ws("#", full, "name")).otherwise(F.col("qualified")),
        "parent_id": F.when((F.col("kind") == "method") & (F.col("symbol_id") % 2 == 0), SUPPLIER + F.col("parent_id") % 10).otherwise(F.col("parent_id")),
    })
    return s.select(*g.symbols.columns)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_id, path, dir: an order is a commit, a supplier's nation the directory of its file."""
    supplier, lineitem = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    joined = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("l_orderkey").alias("commit_id"), F.format_string("d%02d/f%d.rb", F.col("s_nationkey").cast("int"), F.col("s_suppkey")).alias("path")).distinct()


#: Common table expressions for the oracles: files, symbols, edges.
SQL = f"""
files AS (
  SELECT n_nationkey::BIGINT AS file_id, lower(replace(r_name,' ','_')) || '/' || lower(replace(n_name,' ','_')) || '/' || CASE WHEN n_nationkey % 5 = 4 THEN 'node_test.go' ELSE 'node.go' END AS path,
    (['go','ruby','python','typescript','java'])[r_regionkey + 1] AS language
  FROM nation JOIN region ON n_regionkey = r_regionkey),
symbols AS (
  SELECT c_custkey + {CUSTOMER} AS symbol_id, c_nationkey::BIGINT AS file_id, c_name AS name, c_name AS qualified, 'class' AS kind, 'public' AS visibility, CAST(NULL AS BIGINT) AS parent_id, (c_custkey % 1000)::INT AS line_start, (c_custkey % 1000 + 9)::INT AS line_end FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey, s_name, s_name, 'interface', 'public', NULL, (s_suppkey % 1000)::INT, (s_suppkey % 1000 + 9)::INT FROM supplier
  UNION ALL SELECT p_partkey + {PART}, p_partkey % 25, p_name, p_name, 'function', 'public', NULL, (p_partkey % 1000)::INT, (p_partkey % 1000 + 9)::INT FROM part
  UNION ALL SELECT o_orderkey + {ORDER}, c_nationkey, 'order' || (o_orderkey % 97), c_name || '#order' || (o_orderkey % 97), 'method', CASE WHEN o_orderstatus = 'F' THEN 'private' ELSE 'public' END, o_custkey + {CUSTOMER}, (o_orderkey % 1000)::INT, (o_orderkey % 1000 + 9)::INT
    FROM orders JOIN customer ON o_custkey = c_custkey),
edges AS (
  SELECT l_orderkey + {ORDER} AS source_id, l_partkey + {PART} AS target_id, 'calls' AS kind, c_nationkey::BIGINT AS file_id, conf AS confidence
    FROM (SELECT l_orderkey, l_partkey, round(1 - max(l_discount), 2) AS conf FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey + {ORDER}, p + {ORDER}, 'calls', c_nationkey, 1.0 FROM (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) JOIN customer ON o_custkey = c_custkey WHERE p IS NOT NULL
  UNION ALL SELECT l_partkey + {PART}, l_suppkey + {SUPPLIER}, 'references', l_partkey % 25, CASE WHEN count(*) > 1 THEN 0.8 ELSE 0.5 END FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT c_custkey + {CUSTOMER}, s_suppkey + {SUPPLIER}, 'inherits', c_nationkey, 0.9 FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10
  UNION ALL SELECT c_custkey + {CUSTOMER}, c_custkey // 10 + {CUSTOMER}, 'composes', c_nationkey, 0.9 FROM customer WHERE c_custkey // 10 > 0)
"""
#: The same for variant(); edges are as they are.
VARIANT_SQL = f"""{SQL.replace('files AS (', 'plain_files AS (', 1).replace('symbols AS (', 'plain_symbols AS (', 1)},
files AS (SELECT file_id, CASE WHEN file_id % 5 = 0 THEN replace(path, 'node.go', 'main.go') ELSE path END AS path, language FROM plain_files),
symbols AS (SELECT symbol_id, file_id, CASE WHEN kind = 'class' THEN cname ELSE name END AS name, CASE kind WHEN 'class' THEN scope || '::' || cname WHEN 'method' THEN scope || '::' || cname || '#' || name ELSE qualified END AS qualified, kind, visibility,
  CASE WHEN kind = 'method' AND symbol_id % 2 = 0 THEN {SUPPLIER} + parent_id % 10 ELSE parent_id END AS parent_id, line_start, line_end
  FROM (SELECT s.*, 'C' || c_custkey || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS cname, replace(regexp_replace(path, '/[^/]*$', ''), '/', '::') AS scope
    FROM plain_symbols s JOIN files USING (file_id) LEFT JOIN customer ON c_custkey + {CUSTOMER} = CASE WHEN s.kind = 'class' THEN s.symbol_id WHEN s.kind = 'method' THEN s.parent_id END))
"""
COMMITS_SQL = "commits AS (SELECT DISTINCT l_orderkey AS commit_id, printf('d%02d/f%d.rb', s_nationkey, s_suppkey) AS path FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
