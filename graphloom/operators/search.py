"""Hybrid retrieval: query shape, fusion, ranking passes, enrichment (O-T3 to O-T19, O-W1, O-W3, O-Q9)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import paths, text
from graphloom.functions.shared import settle, stacked
from graphloom.model import Graph
from graphloom.operators import fulltext, vector
from graphloom.operators.aggregates import in_degree
from graphloom.operators.graph import at_end

RRF = 60
#: Fixed values of the ranking passes.
MODULE, TEST_NAME, TEST_PATH, BOOST, GENERIC, GENERIC_SHARE, CENTRALITY, TEST_FINAL = 0.5, 0.3, 0.3, 1.1, 0.3, 0.05, 0.05, 0.2
TEST_PREFIXES = ("Test", "Mock", "Fake", "Stub")
LOW_SEGMENTS = (
    "db/migrate/", "db/post_migrate/", "script/", "scripts/", "/test/", "/tests/", "/spec/", "/mock/", "/mocks/", "/fixture/", "/fixtures/", "/generated/", "/testdata/",
    "_test.rb", "_spec.rb", "_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "Test.java", "Test.kt", "_test.py", "/__tests__/",
)
LOW_STARTS, HIGH_STARTS, GENERATED = ("spec/", "test/"), ("app/", "lib/", "src/"), 0.4
TEST_WORDS = frozenset("test tests testing spec specs mock mocks mocked".split())
HIDDEN = ("turbo-channel:", "importmap:", "route:", "ruby-core:", "django-related:", "laravel-binding:")
_TRIM = ".,;:?!()\"'`"


def expand(query: str) -> list[str]:
    """O-T3: the query, its identifiers parted, its first three words if it has four or more."""
    words = query.split()
    parted = " ".join(w for t in words for w in text.split_token_text(t))
    out = [query]
    if parted and parted != query.lower():
        out.append(parted)
    short = " ".join(words[:3])
    if len(words) >= 4 and short not in (query, parted):
        out.append(short)
    return out[:3]


def shape(query: str) -> str:
    """O-T4: identifier, natural_language or mixed."""
    words = query.split()
    if len(words) <= 1:
        return "identifier"
    marked = [bool(re.search(r"_|::|(?<=.)[/.](?=.)|[a-z][A-Z]|[A-Z]{2,}[a-z]", w)) for w in words]
    if all(marked):
        return "identifier"
    if any(marked):
        return "mixed"
    sentence = "?" in query or len(words) >= 4 or any(w.lower().strip(_TRIM) in text.STOPWORDS for w in words)
    return "natural_language" if sentence else "mixed"


def weights(form: str, confidence: float, has_vectors: bool = True) -> tuple[float, float]:
    """O-T7: keyword and vector weight."""
    if not has_vectors:
        return 1.0, 0.0
    if form == "mixed":
        return 0.5, 0.5
    keyword, vec = (0.5, 0.5) if confidence >= 0.6 else (0.6, 0.4) if confidence >= 0.4 else (0.7, 0.3)
    return (0.5, 0.5) if form == "natural_language" and vec < 0.5 else (keyword, vec)


def terms(query: str) -> list[str]:
    """Distinct lower-case words of the query and of its identifiers."""
    return list(dict.fromkeys(w for t in query.split() for w in [t.strip(_TRIM).lower(), *text.split_token_text(t)] if w))


def ranked(hits: DataFrame, score: str) -> DataFrame:
    """O-W1: id, rank (from 0). hits hold as many rows as the candidate limit."""
    return hits.select("id", (F.row_number().over(W.orderBy(F.desc(score), "id")) - 1).alias("rank"))


def fuse(keyword: DataFrame, vectors: DataFrame | None, keyword_weight: float, vector_weight: float) -> DataFrame:
    """O-T8: id, score, source of two ranked legs, by reciprocal ranks."""
    k = keyword.select("id", (F.lit(keyword_weight) / (RRF + F.col("rank") + 1)).alias("k"))
    if vectors is None or not vector_weight:
        return k.select("id", F.col("k").alias("score"), F.lit("keyword").alias("source"))
    v = vectors.select("id", (F.lit(vector_weight) / (RRF + F.col("rank") + 1)).alias("v"))
    both = k.join(v, "id", "full")
    source = F.when(F.col("k").isNull(), "vector").when(F.col("v").isNull(), "keyword").otherwise("hybrid")
    return both.select("id", F.round(F.coalesce("k", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), 12).alias("score"), source.alias("source"))


def merge(lists: list[DataFrame]) -> DataFrame:
    """O-T8b, O-U2: lists of (id, score, source) of several sub-queries by a second fusion of weight one; sources that differ are hybrid."""
    parts = [x.select("id", "source", (1.0 / (RRF + F.row_number().over(W.orderBy(F.desc("score"), "id")))).alias("r")) for x in lists]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id").agg(F.round(F.sum("r"), 12).alias("score"), F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("hybrid").alias("source"))


def _lower(score: Column, factor) -> Column:
    """A demotion never lifts a score."""
    return F.when(score <= 0, score).otherwise(score * factor)


def kind_weight(kind: Column, name: Column) -> Column:
    """O-T10."""
    return F.when(kind == "module", MODULE).otherwise(1.0) * F.when(paths.starts_any(name, TEST_PREFIXES), TEST_NAME).otherwise(1.0)


def path_weight(path: Column) -> Column:
    """O-T11: the first rule that holds."""
    out = F.when(paths.starts_any(path, LOW_STARTS), TEST_PATH)
    for s in LOW_SEGMENTS:
        out = out.when(path.contains(s), GENERATED if s == "/generated/" else TEST_PATH)
    return out.when(paths.starts_any(path, HIGH_STARTS), BOOST).otherwise(1.0)


def specific(query: str, frequency: dict[str, int], total: int) -> list[str]:
    """O-T12: terms that less than a twentieth of the rows have; none if all are generic, and then nothing is demoted."""
    return [t for t in terms(query) if total <= 0 or frequency.get(t, 0) < GENERIC_SHARE * total]


def mentions(columns: list[Column], words: list[str]) -> Column:
    own = reduce(F.concat, [F.concat(F.split(F.lower(c), r"\s+"), F.flatten(F.transform(F.split(c, r"\s+"), text.split_token))) for c in columns])
    return F.arrays_overlap(own, F.array(*map(F.lit, words)))


def about_tests(query: str) -> bool:
    return not TEST_WORDS.isdisjoint(re.findall(r"[^\W_]+", query.lower()))


def rank(fused: DataFrame, g: Graph, query: str, frequency: dict[str, int], total: int, form: str) -> DataFrame:
    """O-T19 up to the sort: hydrate, kind, path, generic, normalise, centrality, tests."""
    s = g.symbols.select(F.col("symbol_id").alias("id"), "name", "qualified", "kind", "file_id", "parent_id").join(g.files.select("file_id", "path"), "file_id")
    df = s.join(F.broadcast(fused), "id")  # the candidate limit of rows
    score = _lower(F.col("score"), kind_weight(F.col("kind"), F.col("name")))
    score = score * path_weight(F.col("path"))
    words = specific(query, frequency, total) if form != "identifier" else []
    if words:
        score = F.when((F.col("source") == "keyword") & ~mentions([F.col("name"), F.col("qualified")], words), _lower(score, GENERIC)).otherwise(score)
    df = df.withColumn("score", score)
    all_rows = W.partitionBy()  # the candidate limit of rows
    low, high = F.min("score").over(all_rows), F.max("score").over(all_rows)
    df = df.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    df = df.join(in_degree(g.edges.join(F.broadcast(fused.select(F.col("id").alias("target_id"))), "target_id", "left_semi")).withColumnRenamed("symbol_id", "id"), "id", "left")
    df = df.withColumn("score", F.col("score") * (1 + CENTRALITY * F.log2(1 + F.coalesce("in_degree", F.lit(0)))))
    if not about_tests(query):
        test = paths.starts_any(F.col("name"), TEST_PREFIXES) | paths.search_test(F.col("path"))
        df = df.withColumn("score", F.when(test, _lower(F.col("score"), TEST_FINAL)).otherwise(F.col("score")))
    return df.withColumn("score", F.round("score", 6)).withColumn("references", F.coalesce("in_degree", F.lit(0))).drop("in_degree")


def enrich(df: DataFrame, g: Graph, top: int = 3, lift: float = 0.15, floor: float = 0.05) -> DataFrame:
    """O-T15: callees of the best few: those present rise, others come in at a low score."""
    best = df.orderBy(F.desc("score"), "id").limit(top).select(F.col("id").alias("source_id"))
    callees = g.edges.where("kind = 'calls'").join(F.broadcast(best), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    lifted = df.join(callees.withColumn("c", F.lit(True)), "id", "left").withColumn("score", F.when(F.col("c"), F.col("score") + lift).otherwise(F.col("score"))).drop("c")
    s = g.symbols.select(F.col("symbol_id").alias("id"), "name", "qualified", "kind", "file_id", "parent_id").join(g.files.select("file_id", "path"), "file_id")
    new = callees.join(df.select("id"), "id", "left_anti").join(s, "id").withColumns({"score": F.lit(floor), "source": F.lit("graph"), "references": F.lit(0).cast("long")})
    return lifted.unionByName(new.select(*lifted.columns))


def promote(df: DataFrame, g: Graph, limit: int) -> DataFrame:
    """O-T16: two of the best or more with one parent that isn't there give way to it, at the better one's score."""
    best = df.orderBy(F.desc("score"), "id").limit(limit)
    up = best.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"), F.max("score").alias("score"), F.max("source").alias("source")).where("n >= 2")
    up = up.join(best.select("id"), "id", "left_anti").select("id", "score", "source")
    s = g.symbols.select(F.col("symbol_id").alias("id"), "name", "qualified", "kind", "file_id", "parent_id").join(g.files.select("file_id", "path"), "file_id")
    parents = s.join(F.broadcast(up), "id").withColumn("references", F.lit(0).cast("long"))  # half the limit of rows
    rest = df.join(up.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return rest.unionByName(parents.select(*rest.columns))


def finish(df: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """O-T17."""
    return df.where((F.col("score") >= least) & ~text.is_synthetic(F.col("qualified"), HIDDEN)).orderBy(F.desc("score"), "id").limit(limit)


def keyword_leg(counts: DataFrame, terms_: list[str], column: str, query: str, plain: list[str], known: fulltext.Statistics, wanted: int, few: int = 5) -> DataFrame:
    """O-U2: id, score: keyword hits, and where they are few, rows that contain the query and aren't among them. counts keep the column."""
    hits = settle(fulltext.scored(counts, terms_, plain, known, wanted), "hits")
    n = hits.count()
    if n >= few:
        return hits
    rest = counts.join(hits.select("id"), "id", "left_anti")
    return hits.unionByName(fulltext.substring(rest, "id", column, query, wanted - n))


@dataclass(frozen=True)
class Options:
    limit: int = 10
    language: str = ""
    least: float = 0.0


def search(g: Graph, query: str, options: Options = Options(), embed=None) -> DataFrame:
    """The whole tool: sub-queries, two legs each, fusion, ranking, enrichment, promotion, final cut. embed: text -> vector, if there is a model."""
    wanted, form = max(5 * options.limit, 50), shape(query)
    docs = g.symbols.join(g.files.select("file_id", "language"), "file_id")
    columns = ["name", "qualified"]
    asked = {q: sorted({t for p in fulltext.query_terms(q) for t in p}) for q in expand(query)}
    every = sorted({*terms(query), *(t for p in asked.values() for t in p)})
    index = fulltext.counted(docs, "symbol_id", columns, every, (F.col("language"), F.col("qualified")))
    known = fulltext.statistics(index, every)
    total, frequency = known.rows, known.frequency
    where = F.col("language") == options.language if options.language else None
    counts = index if where is None else index.where(where)
    lists = []
    for k, (q, plain) in enumerate(asked.items()):
        hits = keyword_leg(counts, every, "qualified", q, plain, known, wanted)
        leg, confidence = None, 0.0
        if embed is not None and g.embeddings is not None:
            near = settle(vector.nearest(g.embeddings, "symbol_id", "vector", embed(q), wanted), "near")
            confidence = vector.confidence(near).first()[0]
            leg = ranked(near, "similarity")
        a, b = weights(form if k == 0 else "natural_language", confidence, leg is not None)
        lists.append(fuse(ranked(hits, "score"), leg, a, b))
    fused = settle(lists[0] if len(lists) == 1 else merge(lists), "fused")
    best = settle(rank(fused, g, query, frequency, total, form), "ranked")
    return finish(promote(settle(enrich(best, g), "enriched"), g, options.limit), options.limit, options.least)


def context(g: Graph, budget: int = 800) -> DataFrame:
    """O-T20: the text that stands for a symbol in embedding: file, kind and name, then its neighbours by kind, whole entries while they fit."""
    titles = {("inherits", "out"): "inherits", ("composes", "out"): "composes", ("includes", "out"): "includes", ("includes", "in"): "included by", ("calls", "out"): "calls"}
    s = g.symbols.select("symbol_id", "qualified", "kind", "file_id").join(g.files.select("file_id", "path"), "file_id")
    order = reduce(lambda c, kv: c.when((F.col("kind") == kv[1][0]) & (F.col("side") == kv[1][1]), kv[0]), enumerate(titles), F.when(F.lit(False), -1))
    w = W.partitionBy("symbol_id", "o").orderBy("other_name")

    def fitting(near: DataFrame) -> DataFrame:
        """What fits of each list. A name that doesn't fit among some of a list's names doesn't fit among all of them."""
        return near.distinct().withColumn("used", F.sum(F.octet_length("other_name") + 2).over(w)).where(F.col("used") <= budget).drop("used")

    parts = []
    for e in g.parts:
        for side, own, other in (("out", "source_id", "target_id"), ("in", "target_id", "source_id")):
            kinds = [k for k, s_ in titles if s_ == side]
            rows = e.where(F.col("kind").isin(*kinds) & F.col("source_id").isNotNull()).withColumn("side", F.lit(side)).select("source_id", "target_id", order.alias("o"))
            near = at_end(rows, other, g.symbols.select(F.col("symbol_id").alias(other), F.col("name").alias("other_name")))
            parts.append(fitting(near.select(F.col(own).alias("symbol_id"), "o", "other_name")))
    near = fitting(stacked(parts))
    lists = near.groupBy("symbol_id", "o").agg(F.array_join(F.sort_array(F.collect_list("other_name")), ", ").alias("names"))
    label = F.get(F.array(*map(F.lit, titles.values())), F.col("o"))
    lines = lists.groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("o", F.concat_ws(": ", label, F.col("names")).alias("line")))).alias("lines"))
    head = F.concat(F.lit("File: "), F.col("path"), F.lit("\n"), F.col("kind"), F.lit(" "), F.col("qualified"))
    state = F.struct(head.alias("text"), F.octet_length(head).alias("size"))
    fits = lambda a, x: a["size"] + F.octet_length(x["line"]) + 1 <= budget
    grow = lambda a, x: F.struct(F.when(fits(a, x), F.concat(a["text"], F.lit("\n"), x["line"])).otherwise(a["text"]).alias("text"), F.when(fits(a, x), a["size"] + F.octet_length(x["line"]) + 1).otherwise(a["size"]).alias("size"))
    none = F.array().cast("array<struct<o:int,line:string>>")
    return s.join(lines, "symbol_id", "left").select("symbol_id", F.aggregate(F.coalesce("lines", none), state, grow, lambda a: a["text"]).alias("text"))


def embed_texts(texts: DataFrame, model_path: str, vocabulary: dict[str, int], batch: int = 50) -> DataFrame:
    """O-T21: symbol_id, vector by an ONNX sentence model that the caller supplies: masked mean of its states, unit length."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path)
        for b in batches:
            ids, out = [text.wordpieces(t or "", vocabulary) for t in b.column(1).to_pylist()], []
            for i in range(0, len(ids), batch):
                part = ids[i : i + batch]
                width = max(map(len, part))
                x = np.array([p + [0] * (width - len(p)) for p in part], np.int64)
                mask = np.array([[1] * len(p) + [0] * (width - len(p)) for p in part], np.int64)
                states = session.run(None, {"input_ids": x, "attention_mask": mask, "token_type_ids": np.zeros_like(x)})[0]
                mean = (states * mask[..., None]).sum(1) / mask.sum(1, keepdims=True)
                out += list((mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], ["symbol_id", "vector"])

    return texts.select("symbol_id", "text").mapInArrow(run, "symbol_id long, vector array<float>")


def with_bodies(symbols: DataFrame, contents: DataFrame, lines: int = 10) -> DataFrame:
    """O-T22: functions and methods with up to so many lines of their body as snippet. contents: file_id, content."""
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("line_start"), F.least(F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1)), F.lit(lines))), "\n")
    return symbols.join(contents, "file_id", "left").withColumn("snippet", F.when(F.col("kind").isin("function", "method") & F.col("content").isNotNull() & (F.col("line_start") >= 1), body)).drop("content")
