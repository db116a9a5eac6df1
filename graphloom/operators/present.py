"""Presentation: round-robins, paging, budgets, JSON and Markdown (O-W8 to O-W11, O-S23 to O-S25, O-Q rows)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import paths


def round_robin(rows: DataFrame, cap: int = 60) -> DataFrame:
    """O-W8: areas by size; one row of each in turn until the cap; production before tests; out by area, then rank. rows: symbol_id, path, is_test."""
    a = rows.withColumn("area", paths.area(F.col("path")))
    a = a.withColumns({"size": F.count("*").over(W.partitionBy("area")), "turn": F.row_number().over(W.partitionBy("area").orderBy("is_test", "symbol_id"))})
    return a.where(F.col("turn") <= cap).orderBy("turn", F.desc("size"), "area").limit(cap).orderBy(F.desc("size"), "area", "turn")


def span_by_file(rows: DataFrame) -> DataFrame:
    """O-W9: the first row of each file before all others. rows: path, rank."""
    return rows.withColumn("again", (F.row_number().over(W.partitionBy("path").orderBy("rank")) > 1)).orderBy("again", "rank")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """O-W10: a page of a total order, with the offset of the next one (null on the last)."""
    some = rows.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.count("*").over(W.partitionBy())  # limit + 1 rows at most
    numbered = some.withColumns({"n": n, "k": F.row_number().over(W.orderBy(*order))})
    return numbered.where(F.col("k") <= limit).withColumn("next_offset", F.when(F.col("n") > limit, F.lit(offset + limit))).drop("n", "k")


def within_budget(rows: DataFrame, order: list, size: Column, budget: int) -> DataFrame:
    """O-W11: the longest prefix of the order whose running size fits. Rows are those of a capped response."""
    return rows.withColumn("used", F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= budget)


def trimmed(lists: dict[str, list], layers: list[list], size: Callable[[dict, list], int], budget: int) -> tuple[dict[str, list], list[list], bool]:
    """O-W11: drop the deepest layers, then a tenth of the longest list at a time, until the response fits."""
    lists, layers, cut = {k: list(v) for k, v in lists.items()}, list(layers), False
    while size(lists, layers) > budget:
        cut = True
        if layers:
            layers.pop()
            continue
        name = max(lists, key=lambda k: (len(lists[k]), k), default=None)
        if name is None or not lists[name]:
            break
        del lists[name][-max(1, len(lists[name]) // 10) :]
    return lists, layers, cut


def to_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """O-S23: each row as JSON, null arrays as empty ones."""
    fields = [F.coalesce(F.col(f"`{f.name}`"), F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*fields), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def markdown(sections: list[tuple[str, list[str]]], tokens: int) -> str:
    """O-S24: sections in order under four characters a token; the one that doesn't fit is cut at a line, later ones are named."""
    budget, out, left = 4 * tokens, [], []
    for title, lines in sections:
        text = "\n".join([f"## {title}", *lines, ""])
        if left or len(text) > budget:
            if not left and budget > len(title) + 4:
                kept = [f"## {title}"]
                for line in lines:
                    if sum(map(len, kept)) + len(kept) + len(line) + 4 > budget:
                        break
                    kept.append(line)
                if len(kept) > 1:
                    out.append("\n".join([*kept, "…", ""]))
            left.append(title)
            budget = 0
            continue
        out.append(text)
        budget -= len(text)
    return "\n".join([*out, *([f"Omitted: {', '.join(left)}"] if left else [])])


def snippets(sites: DataFrame, lines: DataFrame, around: int = 2, most: int = 10) -> DataFrame:
    """O-S25, O-C26: sites (path, line) with the lines about them; most sites, by path and line. lines: path, line, text."""
    some = sites.select("path", F.col("line").alias("at")).distinct().orderBy("path", "at").limit(most)
    near = lines.join(F.broadcast(some), "path").where(F.col("line").between(F.col("at") - around, F.col("at") + around))  # most rows
    return near.groupBy("path", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("snippet"))


def hydrate(rows: DataFrame, files: DataFrame) -> DataFrame:
    """O-Q11, O-T18: rows with the path of their file."""
    return rows.join(files.select("file_id", "path"), "file_id", "left")


def warnings(rows: DataFrame, most: int = 20) -> DataFrame:
    """O-Q12: kind, message -> counts by kind with the first few messages."""
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy("message")))
    return ranked.groupBy("kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.col("message")))).alias("messages"))


#: O-Q3: other names of parameters, and O-Q5: what an index can't see by extension (fixed values).
ALIASES = {"q": "query", "text": "query", "name": "symbol", "target": "symbol", "path": "file", "hops": "max_hops", "depth_limit": "max_hops", "lang": "language", "confidence": "min_confidence", "strength": "min_strength", "area": "domain", "top_k": "limit", "n": "limit"}
CAVEATS = {"rb": "Metaprogrammed calls may be missing.", "py": "Calls through getattr may be missing.", "js": "Dynamic property calls may be missing.", "php": "Magic methods may be missing.", "erb": "Helpers are bound by name."}


@dataclass(frozen=True)
class Preset:
    """O-Q4, O-Q10: defaults of the tool surface."""

    hops: int = 5
    confidence: float = 0.3
    cap: int = 200
    budget: int = 8000
    strength: float = 0.15
    instances: int = 5
    embeddings: bool = True
    watch: bool = True
    max_file_kb: int = 512
    ignore: tuple[str, ...] = ()

    @staticmethod
    def of(values: dict, environment: dict[str, str]) -> Preset:
        """Given values over environment variables (GRAPHLOOM_<NAME>) over the defaults."""
        from dataclasses import fields

        kinds = {f.name: type(f.default) for f in fields(Preset)}
        found = {k: environment[f"GRAPHLOOM_{k.upper()}"] for k in kinds if f"GRAPHLOOM_{k.upper()}" in environment} | values
        read = {bool: lambda v: str(v).lower() in ("1", "true", "yes", "on"), tuple: lambda v: tuple(v.split(",")) if isinstance(v, str) else tuple(v)}
        return Preset(**{k: read.get(kinds[k], kinds[k])(v) for k, v in found.items()})


def canonical(arguments: dict) -> dict:
    """O-Q3: aliases by their own name; a canonical name that is given wins."""
    out = {k: v for k, v in arguments.items() if k not in ALIASES}
    for k, v in arguments.items():
        if k in ALIASES:
            out.setdefault(ALIASES[k], v)
    return out


def caveat(path: Column) -> Column:
    """O-Q5."""
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    out = F.when(F.lit(False), "")
    for k, v in CAVEATS.items():
        out = out.when(ext == k, v)
    return out


def next_steps(total: int, hidden: int, ambiguous: bool, most: int = 2) -> list[str]:
    """O-Q7."""
    hints = [(ambiguous, "Name the file to choose one symbol."), (hidden > 0, f"Lower min_confidence to see {hidden} more."), (total == 0, "Search by meaning for the nearest symbols."), (total > 10, "Ask for the impact before changing this.")]
    return [text for holds, text in hints if holds][:most]
