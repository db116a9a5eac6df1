"""Personal data: base patterns, and boosted trees over high-recall candidates, in DataFrame functions only.

Generators propose spans that may overlap: mail addresses plain and obfuscated, dotted quads plain and defanged, eight-part addresses,
card-like digit groups and phone-like numbers, and near misses of each. Each candidate has its kind, format features (digits, groups,
separator, brackets, first digit) and context features (letters or digits at its edges, words before that speak for or against it); whether
it passes its kind's check is no feature, since checks make the labels.

Labels: base spans are positive. Negative are quads and card numbers that fail their checks, handles and addresses without a dotted host,
dates, and phone-like numbers that overlap a quad or a card number. A fixed list of ``EXAMPLES`` (bounded, the same for every table) labels
forms on which the base rules say nothing. All other candidates have no label. One model is boosted for all kinds. It is calibrated by
cross-fitting: each fold of texts (copies together) is scored by trees of the others, and the threshold is the least margin above which
the precision over all folds, by its lower bound, is ``PRECISION``. Unlabelled candidates that pass their check and the threshold, and
overlap no base span, are added, of overlapping ones the first and longest. All counts cover all documents.

Defined results: a null text is empty. Overlapping base spans of different kinds all stay. Repeated rows are judged one by one. Extra
columns pass through find(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import boosting, spans
from graphloom.llm.common import settle

KINDS = ["email", "ip", "card", "phone"]
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base patterns with possessive loops. A mail address starts where its run does, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "hidden": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[(\[](?:at|AT|@)[)\]]\x20?[{LABEL}]++(?:(?:\.|\x20?[(\[](?:dot|DOT|\.)[)\]]\x20?)[{LABEL}]++)++",
    "near": rf"(?<![{LOCAL}@])[{LOCAL}]*+@[{LABEL}]++(?!\.?[{LABEL}@])",
    "hidden_ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\x20?[(\[]dot[)\]]\x20?)[0-9]{1,3}+){3}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+)(?![0-9A-Za-z:])",
    "number": r"(?<![0-9A-Za-z+.])[(]?[0-9](?:(?!\.\x20)[\x20().0-9-]){6,40}[0-9](?![0-9A-Za-z]|\.[0-9A-Za-z])",
}
OCTET = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
CONTEXT, PRECISION, FOLDS = 24, 0.9, 5
FOR = r"(?i)\b(?:mail|e-mail|contact|tel|phone|call|mobile|fax|ip|host|server|address|card|visa|amex|account|reach|write)\b"
AGAINST = r"(?i)(?:\b(?:version|release|order|invoice|isbn|issn|article|item|part|page|pages|pp|no|nr|serial|build|section|score|between|from|dated|date|follow|handle|id)\b|#|\bv$)"
DATE = r"^(?:[12][0-9]{3}([-. ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-. ])[0-9]{1,2}\2[12][0-9]{3}|[12][0-9]{3}\x20?-\x20?[12][0-9]{3})$"
FEATURES = ("k", "digits", "groups", "separator", "brackets", "lead", "edge", "favour", "against")
#: Bounded labelled examples: what a text says before a number, forms that are personal (1) or not (0); {} is filled with numbers by rule.
EXAMPLES = [
    *((1, x) for x in ("call 555-0{}-4{}", "phone (555) 0{}-4{}", "tel 020 79{} 0{}", "mobile 0170 12{}{}", "reach me on 555 0{} 4{}", "at 212-55{}-01{} any day", "contact 0{}/2{} 555 0{}".replace("/", "-"))),
    *((1, x) for x in ("write to jane{} (at) mail{} (dot) org", "mail sam.{}[at]host{}.net", "contact ann{}@ [dot]".replace("@ [dot]", " [at] site{} [dot] com"), "host 10[.]{}[.]{}[.]7", "server 172(.)16(.){}(.){}", "ip fe80:0:0:0:{}:ff:fe23:{}")),
    *((0, x) for x in ("order 40{} 12{} 77{}", "isbn 978-3-16-1{}-{}", "version 4{}.0{}.11{}", "pages 1{}-2{} 3{}-4{}", "item 00{}-11{}-22{}", "score 10{} - 20{} - 30{}", "invoice 2024-{}-00{}", "no 77{} 88{} 99{}", "serial 1{}-2{}-3{}-4{}", "between 10{} and", "part 5{} 6{} 7{}")),
    *((0, x) for x in ("follow @user{}{}", "id a{}@b{} here", "handle @team_{}{}", "from (at) home{}")),
]
REPEATS = 4


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid_ip(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda x: x.rlike(OCTET))


def valid_card(v: Column) -> Column:
    d = digits(v)
    return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)


def valid_phone(v: Column) -> Column:
    return F.length(digits(v)).between(8, 15)


VALID = {"email": lambda v: F.lit(True), "ip": valid_ip, "card": valid_card, "phone": valid_phone}


def _side(c: Column) -> Column:
    """0: none or white space, 1: letter or digit, 2: other."""
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)


def _span(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def _separator(v: Column) -> Column:
    """0: none, 1: space, 2: hyphen, 3: dot, 4: several or other."""
    marks = F.regexp_replace(v, "[0-9A-Za-z()\\[\\]@_%+]", "")
    return F.when(marks == "", 0).when(marks.rlike("^ +$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike(r"^\.+$"), 3).otherwise(4)


def _candidate(text: str, kind: int, check, label):
    """label: of the value, 1, 0 or null where the base rules say nothing."""

    def make(x: Column) -> Column:
        v, d = x["v"], digits(x["v"])
        before = F.when(x["s"] > 0, F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))).otherwise("")
        edge = (_side(F.substring(before, -1, 1)) == 1) | (_side(F.substring(text, x["e"] + 1, F.lit(1))) == 1)
        return F.struct(
            F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"),
            F.least(F.length(d), F.lit(19)).alias("digits"), F.least(F.size(F.split(v, "[^0-9A-Za-z]+")), F.lit(5)).alias("groups"), _separator(v).alias("separator"),
            v.rlike(r"[()\[\]]").cast("int").alias("brackets"), F.substring(d, 1, 1).between("3", "6").cast("int").alias("lead"), edge.cast("int").alias("edge"),
            before.rlike(FOR).cast("int").alias("favour"), before.rlike(AGAINST).cast("int").alias("against"), check(v).alias("check"), label(v).cast("int").alias("label"),
        )

    return make


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _p_fold, _p_base (k, s, e by kind, then start) and _p_candidates (k, s, e, the features, check, label: 1, 0 or null)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*own, spans.markable(F.col(text)).alias("_p_t")).withColumn("_p_fold", F.pmod(F.xxhash64("_p_t"), F.lit(FOLDS)).cast("int"))
    df = df.select(*own, "_p_fold", "_p_t", *(spans.pieces(F.col("_p_t"), p).alias(f"_p_p_{k}") for k, p in PATTERNS.items()))
    df = df.select(*own, "_p_fold", "_p_t", *(spans.placed(f"_p_p_{k}").alias(f"_p_{k}") for k in PATTERNS))
    base = [F.transform(F.filter(f"_p_{kind}", _passes(kind)), _span(k)) for k, kind in enumerate(KINDS)]
    df = df.withColumn("_p_base", F.sort_array(F.concat(*base)))
    yes, none = (lambda v: F.lit(True)), (lambda v: F.lit(None))
    cardlike = F.filter("_p_card", lambda x: F.length(digits(x["v"])).between(13, 19))
    quad = lambda v: F.when(v.contains(":"), F.lit(True)).otherwise(F.forall(F.split(v, "[^0-9]+"), lambda x: x.rlike(OCTET)))
    passed = lambda v: luhn(digits(v))
    made = [
        F.transform("_p_email", _candidate("_p_t", 0, yes, lambda v: F.lit(1))),
        F.transform("_p_hidden", _candidate("_p_t", 0, yes, none)),
        F.transform("_p_near", _candidate("_p_t", 0, yes, lambda v: F.lit(0))),
        F.transform("_p_ip", _candidate("_p_t", 1, valid_ip, lambda v: valid_ip(v))),
        F.transform("_p_hidden_ip", _candidate("_p_t", 1, quad, none)),
        F.transform(cardlike, _candidate("_p_t", 2, passed, lambda v: F.when(~passed(v), 0).when(F.length(digits(v)) >= 16, 1))),
        F.transform("_p_phone", _candidate("_p_t", 3, valid_phone, lambda v: valid_phone(v))),
        F.transform("_p_number", _candidate("_p_t", 3, valid_phone, lambda v: F.when(v.rlike(DATE), 0))),
    ]
    df = df.withColumn("_p_c", F.concat(*made))
    known = F.filter("_p_c", lambda y: (y["k"] > 0) & (y["k"] < 3))
    df = df.withColumn("_p_known", F.transform(known, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"))))
    other = lambda x: F.exists("_p_known", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    label = lambda x: F.coalesce(x["label"], F.when((x["k"] == 3) & other(x), 0))
    labelled = F.transform("_p_c", lambda x: F.struct(*(x[f].alias(f) for f in ("s", "e", *FEATURES, "check")), label(x).alias("label")))
    return df.withColumn("_p_candidates", labelled).select(*own, "_p_fold", "_p_base", "_p_candidates")


def _passes(kind: str):
    return lambda x: VALID[kind](x["v"])


def examples(spark: SparkSession) -> DataFrame:
    """label, text of the labelled examples, their blanks filled by a fixed rule."""
    rows = [(y, "so " + t.format(*(11 + (7 * i + 13 * j + 29 * n) % 88 for j in range(t.count("{}")))) + " then") for n in range(REPEATS) for i, (y, t) in enumerate(EXAMPLES)]
    return spark.createDataFrame(rows, "label int, text string")


def fitted(scanned: DataFrame, precision: float = PRECISION) -> tuple[list, float]:
    """Trees and threshold, from a table of one row per combination of features, label and fold: bounded by the features' ranges."""
    x = F.explode("_p_candidates").alias("x")
    corpus = scanned.select("_p_fold", x).select("_p_fold", "x.*").where("label is not null")
    given = scan(examples(scanned.sparkSession).withColumnRenamed("label", "given")).select("given", "_p_fold", x).select("_p_fold", "x.*", "given")
    given = given.withColumn("label", F.coalesce("label", "given")).drop("given")
    rows = corpus.unionByName(given).groupBy("_p_fold", *FEATURES).agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect()
    rows = sorted((r._p_fold, tuple(int(r[f]) for f in FEATURES), float(r.pos), float(r.n - r.pos)) for r in rows)
    held = []
    for fold in range(FOLDS):
        model = boosting.fit([r[1:] for r in rows if r[0] != fold])
        held += [(boosting.margin(model, r[1]), r[2], r[3]) for r in rows if r[0] == fold]
    return boosting.fit([r[1:] for r in rows]), boosting.threshold(held, precision)


def _found(docs: DataFrame, text: str) -> DataFrame:
    """The documents' own columns but the text as _p_c0, _p_c1, .. (so that no name clashes), _p_base and _p_spans (k, s, e by kind, then start)."""
    at = docs.columns.index(text)
    scanned = scan(docs.select(*(F.col(f"`{c}`").alias(f"_p_c{i}") for i, c in enumerate(docs.columns))), f"_p_c{at}")
    scanned = settle(scanned.drop(f"_p_c{at}"), "pii")
    model, cut = fitted(scanned)

    def chosen(x: Column) -> Column:
        clear = ~F.exists("_p_base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        passed = boosting.column(model, [x[f] for f in FEATURES]) >= cut if cut < float("inf") else F.lit(False)
        return x["label"].isNull() & x["check"] & passed & clear

    more = F.sort_array(F.transform(F.filter("_p_candidates", chosen), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    first = F.transform(more, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["e"]).alias("e")))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    kept = F.aggregate(first, none, lambda a, x: F.when((F.size(a) == 0) | (x["s"] >= F.get(a, F.size(a) - 1)["e"]), F.concat(a, F.array(x))).otherwise(a))
    return scanned.withColumn("_p_spans", F.array_distinct(F.sort_array(F.concat("_p_base", kept)))).drop("_p_candidates", "_p_fold")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with base_spans and spans (k, s, e by kind, then start); columns of docs so named give way."""
    own = [F.col(f"_p_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("base_spans", "spans") and c != text]
    return _found(docs, text).select(*own, F.col("_p_base").alias("base_spans"), F.col("_p_spans").alias("spans"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(spans.joined(F.col("base_spans"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), KINDS).alias("spans"),
    )
