"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Per document: word, symbol, repeated-line and repeated-window counts. Per (lang, source): a minimum-covariance-determinant
estimate of the transformed statistics, by concentration steps from two starts (coordinate medians with unit spread, and the plain mean
and covariance) until the determinants settle; the start that ends at the smaller determinant counts. A document is rejected for too few words, for too much
repetition, or for a Mahalanobis distance beyond the cutoff on the side that junk lies on.

A group of fewer than ``min_group`` rows past the base rules is judged by the estimate of its language, made in the same way from all
rows of that language, or of the whole table if the language has too few as well.

Defined results: a null text is empty (no words, base_failed). A null lang or source forms a group of its own,
apart from the empty string. Repeated rows are judged one by one. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.shared import stacked
from graphloom.llm.common import settle, text_of

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of a group that the estimate rests on, concentration steps at most, change of a log determinant that counts as settled, bins per
#: e-fold of a squared distance.
SUPPORT, STEPS, SETTLED, BINS = 0.75, 8, 1e-3, 64
#: Groups (of about 300 bytes) that are sent to every task at most; more are joined, and large partitions split.
GROUPS = 10_000
#: Smallest spread of each transformed statistic: log words, log word length, log symbols per 100, log repeated lines, repeated share.
FLOORS = (0.5, 0.08, 0.35, 0.5, 0.06)
FEATURES = len(FLOORS)
#: Median of the chi-squared law with FEATURES degrees of freedom, and the squared distance (of six consistent deviations) beyond which a document goes.
CHI2_MEDIAN, CUTOFF = 4.351, 36.0


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    t = F.col("_q_t")
    df = docs.withColumn("_q_t", text_of(text))
    df = df.withColumn("_q_w", F.filter(F.split(t, f"{SPACE}+"), lambda x: x != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_q_w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_q_w", i, WINDOW))))
    df = df.withColumns({"_q_h": hashes, "_q_l": lines})
    repeats = F.size(F.array_distinct("_q_h")) < F.size("_q_h")
    pairs = F.when(repeats, F.sort_array(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    symbols = reduce(lambda a, b: a + b, (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in SYMBOLS))
    df = df.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        pairs.alias("_q_p"),
    )
    same = lambda s, k: F.coalesce(F.get("_q_p", k)["h"] == s["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_q_p", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"]))
    df = df.withColumn("_q_at", F.when(F.col("_q_p").isNotNull(), at))
    covered = F.transform("_q_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_at", k + 1) - p, F.lit(WINDOW))))
    total = F.when(F.col("_q_at").isNull(), F.lit(0)).otherwise(F.aggregate(covered, F.lit(0), lambda a, x: a + x))
    return df.withColumn("n_repeat_words", total.cast("long")).drop("_q_p", "_q_at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _features() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log1p(F.col("n_words")), F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(F.col("n_dup_lines")), F.col("n_repeat_words") / words]


def _cholesky(cov: dict[tuple[int, int], Column], d: int) -> dict[str, Column]:
    """The factor's entries as named columns l_i_j; columns refer to earlier ones, so they are added one by one."""
    out: dict[str, Column] = {}
    for j in range(d):
        for i in range(j, d):
            v = cov[i, j]
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out[f"l_{i}_{j}"] = F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}_{j}")
    return out


def _distance(d: int) -> tuple[list[tuple[str, Column]], Column]:
    """Forward substitution of z - m through the factor: its steps, and the squared distance."""
    steps = []
    for i in range(d):
        v = F.col(f"z_{i}") - F.col(f"m_{i}")
        for k in range(i):
            v = v - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        steps.append((f"y_{i}", v / F.col(f"l_{i}_{i}")))
    return steps, reduce(lambda a, b: a + b, (F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(d)))


def _with_distance(df: DataFrame, d: int) -> DataFrame:
    steps, d2 = _distance(d)
    for name, v in steps:
        df = df.withColumn(name, v)
    return df.withColumn("d2", d2)


def _quantile_bin(df: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """Per key the first bin at which the cumulative count reaches share of the rows; bins are counted, never rows gathered."""
    counts = df.groupBy(*keys, value.alias("bin")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys)
    cum = counts.select(*keys, "bin", F.sum("c").over(w.orderBy("bin")).alias("upto"), F.sum("c").over(w).alias("n"))
    return cum.where(F.col("upto") >= F.col("n") * share).groupBy(*keys).agg(F.min("bin").alias(name), F.max("n").alias(f"{name}_n"))


def _log_bin(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-6))) * BINS).cast("int")


def _short(table: DataFrame, rows: int = GROUPS) -> bool:
    return table.limit(rows + 1).count() <= rows


def _sent(table: DataFrame, short: bool) -> DataFrame:
    """A settled table of one row per group, to be sent to every task if it is short, which spares shuffling the documents by group."""
    return F.broadcast(table) if short else table


def fit_mcd(stats: DataFrame, min_group: int = 50, keys: tuple[str, ...] = ("lang_key", "source_key"), apart: str | None = None) -> DataFrame:
    """One row per group of keys that has min_group rows: centre, factor and consistency scale of the minimum-covariance-determinant estimate.

    stats: rows with keys and z_0.. (statistics over their floors). Each step keeps the ``SUPPORT`` share nearest the centre and
    estimates anew, until the determinants of all groups settle; of all that share a value of apart, a key of few values, if it is given.
    Only counts per bin and sums per group are shuffled. The floor is added to each variance, so that a statistic that is constant in the
    core has a finite distance.
    """
    d, keys = FEATURES, list(keys)
    long = stats.select(*keys, F.posexplode(F.array(*(F.col(f"z_{i}") for i in range(d)))).alias("f", "z"))
    medians = _quantile_bin(long, [*keys, "f"], F.floor(F.col("z") * 32).cast("int"), 0.5, "med")
    middle = medians.groupBy(*keys).agg(F.max("med_n").alias("n"), *(F.max(F.when(F.col("f") == i, (F.col("med") + 0.5) / 32)).alias(f"m_{i}") for i in range(d)))
    middle = middle.where(F.col("n") >= min_group).drop("n").withColumns({f"l_{i}_{j}": F.lit(1.0 if i == j else 0.0) for i in range(d) for j in range(i + 1)})
    middle = settle(middle, "mcd")
    short = _short(middle, GROUPS // 2)  # counted once: the tables below have a row for each group and start at most
    plain = _moments(stats.join(_sent(middle, short), keys), keys)
    model = settle(middle.withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1))), "mcd")
    both, started = stats.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), [*keys, "start"]
    ended = []
    for step in range(1, STEPS + 1):
        model = model.withColumn("old", _log_determinant())
        near = _with_distance(both.join(_sent(model, short), started), d).withColumn("bin", _log_bin(F.col("d2")))
        cut = settle(_quantile_bin(near, started, F.col("bin"), SUPPORT, "cut").drop("cut_n"), "cut")
        new = settle(_moments(near.join(_sent(cut, short), started).where(F.col("bin") <= F.col("cut")), started, "old"), "mcd")
        moved = new.groupBy(*([apart] if apart else [])).agg(F.max(F.abs(_log_determinant() - F.col("old"))).alias("moved")).collect()
        model = new.drop("old")
        go_on = [r for r in moved if r.moved is not None and not r.moved < SETTLED] if step < STEPS else []
        if not go_on:
            break
        if len(go_on) < len(moved):
            rest = F.col(apart).isin([r[apart] for r in go_on])
            ended.append(model.where(~rest))
            model, both = model.where(rest), both.where(rest)
    model = stacked([*ended, model])
    best = F.min(F.struct(_log_determinant().alias("det"), "start", *(c for c in model.columns if c not in started))).alias("e")
    model = settle(model.groupBy(*keys).agg(best).select(*keys, "e.*").drop("det", "start"), "mcd")
    middle = _quantile_bin(_with_distance(stats.join(_sent(model, short), keys), d), keys, _log_bin(F.col("d2")), 0.5, "mid").drop("mid_n")
    scale = F.greatest(F.exp((F.col("mid") + 1) / BINS) / CHI2_MEDIAN, F.lit(1.0))
    return settle(model.join(middle, keys).withColumn("scale", scale).drop("mid"), "mcd")


def _log_determinant() -> Column:
    return reduce(lambda a, b: a + b, (2 * F.log(F.col(f"l_{i}_{i}")) for i in range(FEATURES)))


def _moments(rows: DataFrame, keys: list[str], *same: str) -> DataFrame:
    """Centre m_i and factor l_i_j of the rows' covariance per key, from sums about the centre m_i that the rows carry; same: columns that a key's rows share."""
    d = FEATURES
    z = [F.col(f"z_{i}") - F.col(f"m_{i}") for i in range(d)]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in same), *(F.first(f"m_{i}").alias(f"o_{i}") for i in range(d)), *(F.sum(z[i]).alias(f"s_{i}") for i in range(d)),
        *(F.sum(z[i] * z[j]).alias(f"q_{i}_{j}") for i in range(d) for j in range(i + 1)),
    )
    mean = [F.col(f"s_{i}") / F.col("n") for i in range(d)]
    cov = {(i, j): F.col(f"q_{i}_{j}") / F.col("n") - mean[i] * mean[j] + F.lit(1.0 if i == j else 0.0) for i in range(d) for j in range(i + 1)}
    for name, v in _cholesky(cov, d).items():
        sums = sums.withColumn(name, v)
    return sums.select(*keys, *same, *((F.col(f"o_{i}") + mean[i]).alias(f"m_{i}") for i in range(d)), *(f"l_{i}_{j}" for i in range(d) for j in range(i + 1)))


def fit_all(stats: DataFrame, min_group: int = 50) -> DataFrame:
    """One row for every (lang_key, source_key) of stats: its own estimate, or that of its language, or that of all rows.

    A row counts in each of these groups of which an estimate is needed, and all groups are fitted at once: every query that is planned
    takes of the driver's memory, and three fits in turn are three times as many.
    """
    keys, found = ["lang_key", "source_key"], ["level", "lang", "source"]
    at = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    own, pooled, whole = at(0, F.col("lang_key"), F.col("source_key")), at(1, F.col("lang_key"), F.lit("")), at(2, F.lit(""), F.lit(""))
    large, large_lang, by_lang = F.col("n") >= min_group, F.col("n_lang") >= min_group, W.partitionBy("lang_key")
    groups = stats.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("n_lang", F.sum("n").over(by_lang))
    groups = settle(groups.withColumn("lends", large_lang & F.max(~large).over(by_lang)), "groups")
    needed = [F.when(large, own), F.when(F.col("lends"), pooled)]
    if not groups.where(~large & ~large_lang).isEmpty():
        needed.append(whole)
    short = _short(groups)
    rows = stats.join(_sent(groups, short), keys).select(F.explode(F.filter(F.array(*needed), lambda g: g.isNotNull())).alias("g"), *(f"z_{i}" for i in range(FEATURES)))
    model = fit_mcd(settle(rows.select("g.*", *(f"z_{i}" for i in range(FEATURES))), "mcd-rows"), 1, tuple(found), "level")
    used = groups.select(*keys, F.when(large, own).when(large_lang, pooled).otherwise(whole).alias("g")).select(*keys, "g.*")
    return settle(used.join(model, found, "left").drop(*found), "mcd")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")


def _judged(docs: DataFrame, text: str, cutoff: float, min_group: int, keep_text: bool) -> DataFrame:
    """The documents' own columns as _q_c0, _q_c1, .. (so that no name clashes), and RESULTS."""
    own = {c: f"_q_c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*(F.col(f"`{c}`").alias(q) for c, q in own.items()))
    keys = {f"{c}_key": F.coalesce(F.concat(F.lit("="), F.col(own[c]).cast("string")), F.lit("")) for c in ("lang", "source")}
    stats = text_stats(docs, own[text])
    stats = settle(stats if keep_text else stats.drop(own[text]), "quality")
    named = stats.withColumns(keys | {f"z_{i}": f / w for i, (f, w) in enumerate(zip(_features(), FLOORS, strict=True))})
    model = fit_all(named.where(~base_failed()).select(*keys, *(f"z_{i}" for i in range(FEATURES))), min_group)
    sided = {"z_0": F.least("z_0", "m_0"), **{f"z_{i}": F.greatest(f"z_{i}", f"m_{i}") for i in (2, 3, 4)}}
    joined = named.join(_sent(model, _short(model)), [*keys], "left")
    d2 = _with_distance(joined.withColumns(sided), FEATURES).withColumn("distance2", F.col("d2") / F.col("scale"))
    out = d2.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))).select(*(c for c in stats.columns if c.startswith("_q_")), *RESULTS)


def judge(docs: DataFrame, text: str = "text", cutoff: float = CUTOFF, min_group: int = 50, keep_text: bool = True) -> DataFrame:
    """docs (without the text unless keep_text) with the statistics, base_failed, distance2 (null in a group of which nothing passes the base rules) and kept.

    Only deviations on the junk side count towards the distance of a rejected document: a document longer than its group, or one
    with fewer symbols or repeats, is never rejected for that. Columns of docs that have a result's name give way to it.
    """
    out = _judged(docs, text, cutoff, min_group, keep_text)
    own = [F.col(f"_q_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in RESULTS and (keep_text or c != text)]
    return out.select(*own, *RESULTS)


def stage(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    kept = _judged(docs, "text", CUTOFF, 50, True).where("kept")
    return kept.select(*(F.col(f"_q_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
    return judge(docs, keep_text=False).select(*columns)
