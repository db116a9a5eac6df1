"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control, in DataFrame functions only.

Candidates are runs of 20 characters or more of the base-64 alphabets. Each one's encoding is inferred, and its symbols are tested
for uniformity (chi-squared over symbols, and over classes of symbols: common letters, other ones, capitals, digits, marks), for runs
about the middle of the alphabet, and for serial correlation; the deviates of uniformity and the absolute ones of the two others add up
to its distance from randomness. The null law is that of natural compounds (words of letters as frequent as in Latin-script prose, numbers and
separators as far as the encoding has them): the distance's median and its spread below that are simulated for each encoding and length with
a fixed seed, so the law depends on no table. A candidate's p-value is the normal law's share below its deviate, which already takes its
length into account; of all candidates those are reported that pass one Benjamini-Hochberg step-up at ``RATE``, over all lengths.

Defined results: a null text is empty. Overlapping spans of different kinds all stay, so a random value of an assignment is in two
spans. Repeated rows are judged one by one. Runs of digits alone are never reported: natural numbers are as random as secret ones.
Extra columns pass through stage() and find(), whatever their names.
"""

from __future__ import annotations

import math
import random
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import spans
from graphloom.llm.common import settle

KINDS = ["assign", "access", "hex", "random"]
#: Equal to the base patterns with their least lengths: hex and access runs are maximal, so shorter ones can't hold a match.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
LEAST_ASSIGNED, RATE, BINS = 8, 0.05, 16
#: Encodings, the first that fits: pattern, symbols in order.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("^[A-Za-z]?[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("^[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("", UPPER + LOWER + DIGITS + "+/-_="),
]
NUMBERS = 2
#: The commonest letters of Latin-script prose (fixed value).
COMMON = "aeionrstlhdcu"
#: Letters of Latin-script prose, a to z, per 1,000 (fixed values).
PROSE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Lengths at which the natural law is simulated (a factor of the square root of two apart; longer tokens take the last one's), tokens each.
LENGTHS, TOKENS = tuple(round(20 * 2 ** (k / 2)) for k in range(9)), 200


def classes(alphabet: str) -> list[str]:
    """The classes of an alphabet's symbols that are not empty; capitals are split by commonness where they are the only letters."""
    letters = LOWER if "e" in alphabet else UPPER
    common = COMMON if letters == LOWER else COMMON.upper()
    marks = "".join(c for c in alphabet if not c.isalnum())
    cells = [common, "".join(c for c in letters if c not in common), UPPER if letters == LOWER else "", DIGITS, marks]
    return [x for x in ("".join(c for c in cell if c in alphabet) for cell in cells) if x]


def compound(size: int, alphabet: str, dice: random.Random) -> str:
    """A natural token: words of three to nine letters, numbers and separators, as far as the alphabet has them."""
    lower = any(c in alphabet for c in LOWER)
    letters, weights = zip(*((c if lower else c.upper(), w) for c, w in zip(LOWER, PROSE, strict=True) if (c if lower else c.upper()) in alphabet), strict=True)
    camel = lower and "A" in alphabet and dice.random() < 0.7
    between = dice.choice([c for c in "-_/" if c in alphabet] or [""]) if not camel or dice.random() < 0.5 else ""
    out = ""
    while len(out) < size:
        word = "".join(dice.choices(letters, weights, k=dice.randint(3, 9)))
        out += (word[0].upper() + word[1:] if camel else word) + between
        if "0" in alphabet and dice.random() < 0.3:
            out += str(dice.choices((dice.randint(1, 99), dice.randint(1900, 2099), dice.randint(100, 9999)), (5, 3, 2))[0]) + between
    return out[:size]


def distance(token: str, alphabet: str) -> float:
    """What battery() computes, for one token of the alphabet's symbols."""
    n, m = len(token), len(alphabet)
    values = [alphabet.index(c) for c in token]
    uniform = (m / n * sum(token.count(c) ** 2 for c in set(token)) - n - (m - 1)) / math.sqrt(2 * (m - 1))
    cells = [(sum(map(token.count, x)), n * len(x) / m) for x in classes(alphabet)]
    coarse = (sum((o - e) ** 2 / e for o, e in cells) - (len(cells) - 1)) / math.sqrt(2 * max(len(cells) - 1, 1))
    high = [v >= m / 2 for v in values]
    runs, h = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False)), sum(high)
    expected = 2 * h * (n - h) / n + 1
    mean = sum(values) / n
    variance = max(sum(v * v for v in values) / n - mean * mean, 0.25)
    serial = (sum(x * y for x, y in zip(values, values[1:], strict=False)) / (n - 1) - mean * mean) / variance * math.sqrt(n)
    return uniform + coarse + abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 0.25)) + abs(serial)


@cache
def natural_law() -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Median of the distance of natural compounds and its spread below the median, by encoding, then length; runs of digits have none."""
    dice, means, spreads = random.Random(42), [], []
    for k, (_, alphabet) in enumerate(ENCODINGS):
        for size in LENGTHS:
            found = sorted(distance(compound(size, alphabet, dice), alphabet) for _ in range(TOKENS)) if k != NUMBERS else [0.0]
            means.append(found[len(found) // 2])
            near = found[: len(found) // 2 + 1]
            spreads.append(max(math.sqrt(sum((x - means[-1]) ** 2 for x in near) / len(near)), 1.0))
    return tuple(means), tuple(spreads)


def deviate(encoding: Column, n: Column, d: Column) -> Column:
    """Deviate of a token's distance under the natural law of its encoding and length, by interpolation between lengths."""
    means, spreads = (F.array(*map(F.lit, x)) for x in natural_law())
    place = F.least(F.greatest(2 * F.log2(n / 20.0), F.lit(0.0)), F.lit(len(LENGTHS) - 1.0))
    low = F.floor(place).cast("int")
    at = encoding * len(LENGTHS) + low
    up = encoding * len(LENGTHS) + F.least(low + 1, F.lit(len(LENGTHS) - 1))
    between = lambda x: F.get(x, at) + (F.get(x, up) - F.get(x, at)) * (place - low)
    return (d - between(means)) / between(spreads)


def battery(token: Column) -> Column:
    """(encoding, bin of the deviate under the natural law) of a token."""
    encoding = reduce(lambda rest, k: F.when(token.rlike(ENCODINGS[k][0]), F.lit(k)).otherwise(rest), reversed(range(len(ENCODINGS) - 1)), F.lit(len(ENCODINGS) - 1))
    alphabets = F.array(*(F.lit(a) for _, a in ENCODINGS))

    def tests(e: Column) -> Column:
        alphabet = F.get(alphabets, e)
        x = F.when(e == 0, F.lower(token)).otherwise(token)
        n, m = F.length(x).cast("double"), F.length(alphabet).cast("double")
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, s: a + F.pow(n - F.length(F.replace(x, s, F.lit(""))), F.lit(2.0)))
        uniform = (m / n * squares - n - (m - 1)) / F.sqrt(2 * (m - 1))
        cells = F.get(F.array(*(F.array(*map(F.lit, classes(a))) for _, a in ENCODINGS)), e)

        def excess(total: Column, cell: Column) -> Column:
            expected = n * F.length(cell) / m
            return total + F.pow(n - F.length(F.call_function("translate", x, cell, F.lit(""))) - expected, F.lit(2.0)) / expected

        free = F.size(cells) - 1
        coarse = (F.aggregate(cells, F.lit(0.0), excess) - free) / F.sqrt(2.0 * F.greatest(free, F.lit(1)))
        values = F.transform(F.split(x, ""), lambda s: (F.instr(alphabet, s) - 1).cast("double"))
        zero = F.lit(0.0)
        state = F.struct(F.lit(-1.0).alias("last"), zero.alias("runs"), zero.alias("high"), zero.alias("s"), zero.alias("q"), zero.alias("c"))

        def step(a: Column, v: Column) -> Column:
            high, was = v >= m / 2, a["last"] >= m / 2
            return F.struct(v.alias("last"), (a["runs"] + F.when((a["last"] < 0) | (high != was), 1.0).otherwise(0.0)).alias("runs"), (a["high"] + F.when(high, 1.0).otherwise(0.0)).alias("high"),
                            (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), (a["c"] + F.when(a["last"] < 0, 0.0).otherwise(v * a["last"])).alias("c"))

        def total(a: Column) -> Column:
            expected = 2 * a["high"] * (n - a["high"]) / n + 1
            spread = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.25))
            mean = a["s"] / n
            variance = F.greatest(a["q"] / n - mean * mean, F.lit(0.25))
            serial = ((a["c"] / (n - 1)) - mean * mean) / variance * F.sqrt(n)
            return uniform + coarse + F.abs(a["runs"] - expected) / F.sqrt(spread) + F.abs(serial)

        d = F.aggregate(values, state, step, total)
        return F.struct(e.alias("enc"), F.floor(deviate(e, n, d) * BINS).cast("int").alias("bin"))

    return F.element_at(F.transform(F.array(encoding), tests), 1)


def _of_kind(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _s_base (k, s, e by start, then kind) and _s_tests (s, e, enc, bin of each candidate)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*own, spans.markable(F.col(text)).alias("_s_t"))
    df = df.select(*own, *(spans.pieces(F.col("_s_t"), p).alias(f"_s_p_{k}") for k, p in PATTERNS.items()))
    df = df.select(*own, *(spans.placed(f"_s_p_{k}").alias(f"_s_{k}") for k in PATTERNS))
    found = F.filter("_s_assign", lambda x: F.length(F.regexp_extract(x["v"], ASSIGNED, 1)) >= LEAST_ASSIGNED)
    base = [F.transform(a, _of_kind(k)) for k, a in enumerate([found, F.col("_s_access"), F.col("_s_hex")])]
    tests = F.transform("_s_random", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["v"]).alias("t")))
    flat = F.transform(tests, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"]["enc"].alias("enc"), x["t"]["bin"].alias("bin")))
    ordered = F.transform(F.sort_array(F.concat(*base)), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return df.select(*own, ordered.alias("_s_base"), flat.alias("_s_tests"))


def threshold(scanned: DataFrame, rate: float = RATE) -> int | None:
    """The largest bin that the step-up over all candidates reports, or None. The table has a row per bin at most, whatever the input."""
    rows = scanned.select(F.explode("_s_tests").alias("x")).where(F.col("x.enc") != NUMBERS).groupBy("x.bin").agg(F.count("*").alias("n")).collect()
    m, upto, cut = sum(r.n for r in rows), 0, None
    for r in sorted(rows):
        upto += r.n
        if math.erfc(-(r.bin + 1) / BINS / math.sqrt(2)) / 2 <= rate * upto / m:
            cut = r.bin
    return cut


def _found(docs: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """The documents' own columns as _s_c0, _s_c1, .. (so that no name clashes), _s_base and _s_spans (k, s, e by start, then kind)."""
    at = docs.columns.index(text)
    scanned = scan(docs.select(*(F.col(f"`{c}`").alias(f"_s_c{i}") for i, c in enumerate(docs.columns))), f"_s_c{at}")
    scanned = settle(scanned if keep_text else scanned.drop(f"_s_c{at}"), "secrets")
    cut = threshold(scanned)
    chosen = lambda x: (x["bin"] <= cut if cut is not None else F.lit(False)) & (x["enc"] != NUMBERS)
    more = F.transform(F.filter("_s_tests", chosen), lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS) - 1).alias("k"), x["e"].alias("e")))
    first = F.transform("_s_base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    every = F.transform(F.sort_array(F.concat(first, more)), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return scanned.withColumn("_s_spans", every).drop("_s_tests")


def find(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without the text unless keep_text) with base_spans and spans (k, s, e by start, then kind); columns of docs so named give way."""
    own = [F.col(f"_s_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("base_spans", "spans") and (keep_text or c != text)]
    return _found(docs, text, keep_text).select(*own, F.col("_s_base").alias("base_spans"), F.col("_s_spans").alias("spans"))


def stage(docs: DataFrame) -> DataFrame:
    """All documents, each run of secret spans replaced by its kind in brackets; n_chars follows the text."""
    own = {c: f"_s_c{i}" for i, c in enumerate(docs.columns)}
    any_span, t = F.size("_s_spans") > 0, F.col(own["text"])
    df = _found(docs, "text", True).withColumn(own["text"], F.when(any_span, spans.redacted(t, F.col("_s_spans"), KINDS)).otherwise(t))
    if "n_chars" in own:
        n = F.col(own["n_chars"])
        df = df.withColumn(own["n_chars"], F.when(any_span, F.length(own["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(n))
    return df.select(*(F.col(q).alias(c) for c, q in own.items()))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(spans.joined(F.col("base_spans"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), KINDS).alias("spans"),
    )
