"""Full text: postings, BM25, document frequency, phrases, substrings and lines (O-T1, O-T2, O-T9, O-A11, O-P4)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import settle
from graphloom.functions.text import decompose_text

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """term, id, tf, len: counted within each row, so no occurrence is shuffled by itself."""
    words = tokens(F.concat_ws(" ", *columns))
    df = docs.select(F.col(id_column).alias("id"), words.alias("w"))
    df = df.select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return df.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def matching(docs: DataFrame, id_column: str, columns: list[str], terms: list[str]) -> DataFrame:
    """id, len, term, tf of the given terms alone: no index, one pass with map-side counts."""
    return occurring(docs.select(F.col(id_column).alias("id"), tokens(F.concat_ws(" ", *columns)).alias("w")), terms)


def occurring(df: DataFrame, terms: list[str]) -> DataFrame:
    """The same of rows whose tokens are there already: id, w."""
    none = F.array().cast("array<struct<term:string,tf:int>>")
    hits = none if not terms else F.array(*(F.struct(F.lit(t).alias("term"), F.size(F.filter("w", _equals(t))).alias("tf")) for t in terms))
    return df.select("id", F.size("w").alias("len"), F.explode(F.filter(hits, lambda h: h["tf"] > 0)).alias("h")).select("id", "len", "h.term", "h.tf")


def _equals(term: str):
    return lambda x: x == term


def counted(docs: DataFrame, id_column: str, columns: list[str], terms: list[str], keep: tuple[Column, ...] = ()) -> DataFrame:
    """id, len and tf (an array by term) of every row, and what else is kept: all that scoring asks of a text, which is read once."""
    w = docs.withColumn("w", tokens(F.concat_ws(" ", *columns)))
    tf = F.array(*(F.size(F.filter("w", _equals(t))) for t in terms)).cast("array<int>")
    return settle(w.select(F.col(id_column).alias("id"), F.size("w").alias("len"), tf.alias("tf"), *keep), "counts")


@dataclass(frozen=True)
class Statistics:
    """Rows, their average length in tokens, and for each asked term the rows that have it."""

    rows: int
    length: float
    frequency: dict[str, int]


def statistics(counts: DataFrame, terms: list[str]) -> Statistics:
    """Over all rows, in one pass that ends in one row."""
    held = [F.count_if(F.get("tf", i) > 0).alias(f"t{i}") for i in range(len(terms))]
    r = counts.agg(F.count("*").alias("n"), F.avg("len").alias("length"), *held).first()
    return Statistics(r.n, float(r.length or 1.0), {t: r[f"t{i}"] for i, t in enumerate(terms) if r[f"t{i}"]})


def document_frequency(docs: DataFrame, id_column: str, columns: list[str], terms: list[str]) -> DataFrame:
    """O-A11: rows whose text has the term, per term that occurs."""
    return matching(docs, id_column, columns, terms).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, id_column: str, columns: list[str], terms: list[str], limit: int, where: Column | None = None) -> DataFrame:
    """O-T1: id, score of the best rows, ties by id. Statistics cover all rows; where (the language, say) selects afterwards."""
    counts = counted(docs, id_column, columns, terms, (F.lit(True).alias("in") if where is None else where.alias("in"),))
    return scored(counts.where("in"), terms, terms, statistics(counts, terms), limit)


def scored(counts: DataFrame, terms: list[str], asked: list[str], known: Statistics, limit: int) -> DataFrame:
    """O-T1 from counts of terms, for those of them that are asked."""
    weights = F.lit(0.0)
    for t in asked:
        if t in known.frequency:
            df, tf = known.frequency[t], F.get("tf", terms.index(t))
            idf = max(math.log((known.rows - df + 0.5) / (df + 0.5)), 1e-6)
            weights = weights + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(known.length)))
    held = [F.get("tf", terms.index(t)) > 0 for t in asked if t in known.frequency]
    found = counts.where(reduce(lambda a, b: a | b, held, F.lit(False)))
    return found.select("id", F.round(weights, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def query_terms(query: str) -> list[list[str]]:
    """O-P4: phrases of the query: each word is one (its separators part ordered terms); its decomposition, if longer, another."""
    out = []
    for word in query.split():
        parts = re.findall(r"[^\W_]+", word.lower())
        if parts:
            out.append(parts)
    whole = decompose_text(query.replace(" ", "_")).split()
    return out + ([whole] if whole not in out and len(whole) > len(query.split()) else [])


def has_phrase(c: Column, phrase: list[str]) -> Column:
    """Ordered adjacency of the phrase's terms."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return joined.contains(f" {' '.join(phrase)} ")


def has_all(c: Column, terms: list[str]) -> Column:
    """Implicit AND, as over decomposed names."""
    return F.size(F.array_except(F.array(*map(F.lit, terms)), tokens(c))) == 0


def substring(docs: DataFrame, id_column: str, column: str, needle: str, limit: int) -> DataFrame:
    """O-T2: rows whose text contains the needle in any case, score 1."""
    return docs.where(F.instr(F.lower(column), needle.lower()) > 0).select(F.col(id_column).alias("id"), F.lit(1.0).alias("score")).orderBy("id").limit(limit)


def lines(docs: DataFrame, path_column: str, column: str) -> DataFrame:
    """path, line (from 1), text."""
    return docs.select(F.col(path_column).alias("path"), F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def grep(docs: DataFrame, path_column: str, column: str, query: str, limit: int) -> DataFrame:
    """O-T9, O-S22: one word: the first matching line of each file. More: files by the number of lines with any of the words, then path."""
    words = query.lower().split()
    hit = F.lit(False)
    for w in words:
        hit = hit | (F.instr(F.lower("text"), w) > 0)
    per = lines(docs, path_column, column).where(hit).groupBy("path").agg(F.count("*").alias("lines"), F.min(F.struct("line", "text")).alias("first"))
    order = ["path"] if len(words) == 1 else [F.desc("lines"), "path"]
    return per.select("path", "lines", "first.line", "first.text").orderBy(*order).limit(limit)
