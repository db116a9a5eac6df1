"""Pattern matches with their places, in DataFrame functions only.

A pattern's matches are marked by ``regexp_replace``, the text is split at the marks, and the pieces' lengths are summed up block by
block: places are code points, ends exclusive. Patterns here have only possessive loops, so that the regular-expression engine neither
backtracks nor recurses over long runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, INSTEAD = "\x01", "\x02"
BLOCK = 64
MATCHES = "array<struct<s:int,e:int,v:string>>"


def markable(text: Column) -> Column:
    """The text, null as empty, with the mark itself replaced by another control character: no place moves."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(INSTEAD))


def pieces(text: Column, pattern: str) -> Column:
    """Gap, match, gap, match, ..., gap; null if the pattern doesn't occur."""
    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")
    return F.when(text.rlike(pattern), F.split(marked, MARK))


def placed(parts: str) -> Column:
    """From the column of pieces the array of matches (s, e, v). Sums over blocks keep long arrays from being copied per element."""
    n = F.size(parts)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))
    none = F.array().cast(MATCHES)

    def within(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.lit(0).alias("k"), none.alias("out"))

        def step(a: Column, x: Column) -> Column:
            end = a["at"] + F.length(x)
            hit = F.array(F.struct(a["at"].alias("s"), end.alias("e"), x.alias("v")))
            return F.struct(end.alias("at"), (a["k"] + 1).alias("k"), F.when(a["k"] % 2 == 1, F.concat(a["out"], hit)).otherwise(a["out"]).alias("out"))

        return F.aggregate(block, state, step, lambda a: a["out"])

    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + F.length(x)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    found = F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), within))
    return F.when(F.col(parts).isNotNull(), found).otherwise(none)


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of spans (k, s, e) in order, comma-joined."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, names: list[str]) -> Column:
    """The text with each run of overlapping spans (k, s, e, by start) replaced by the first one's kind in brackets."""
    name = F.array(*map(F.lit, names))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        text_to = F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(F.get(name, x["k"])), F.lit("]"))
        out = F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], text_to, mark))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, state, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
