"""Identifier and name functions as column expressions (O-P rows); per-row Python only where a rule needs a loop over the text."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import SYNTHETIC

#: Acronyms that a run of capitals is parted into (fixed values).
ACRONYMS = frozenset(
    "ID IO IP OS UI DB API CLI CSS CSV CDN DNS EOF FTP GUI JWT RPC SDK SQL SSH SSL TCP TLS UDP URI URL XML AWS GCP GRPC HTML HTTP JSON REST SMTP TOML UUID YAML HTTPS".split()
)
#: English function words that show a sentence (fixed values).
STOPWORDS = frozenset(
    "a an the this that these those is are was were be been being am do does did of in on at to for from by with without into onto about as and or but not no where when how why what "
    "which who whom whose their them they our your my his her its it we you i he she own can cannot could should would will shall may might must all any some if then else than so such up "
    "out over under there".split()
)
SEPARATORS = ("::", "#", ".", "\\")


def _humps(part: str) -> list[str]:
    """Case boundaries of the index tokenizer: capitals stay together, and their last one goes with what follows if others precede it."""
    cuts, start = [], 0
    for i in range(1, len(part)):
        before, now = part[i - 1].isupper(), part[i].isupper()
        if now and not before:
            cuts.append((start, i))
            start = i
        elif before and not now and i - start > 1:
            cuts.append((start, i - 1))
            start = i - 1
    return [part[a:b] for a, b in [*cuts, (start, len(part))]]


def _acronyms(run: str) -> list[str]:
    out = []
    while run:
        size = next((k for k in range(min(5, len(run)), 1, -1) if run[:k] in ACRONYMS), len(run))
        out.append(run[:size])
        run = run[size:]
    return out


def decompose_text(name: str) -> str:
    """O-P1 for one name."""
    tokens = []
    for part in filter(None, re.split(r"::|[./_\- ]", name)):
        for hump in _humps(part):
            tokens += _acronyms(hump) if len(hump) > 5 and not any(c.isalpha() and not c.isupper() for c in hump) else [hump]
    return (" ".join(tokens) or re.sub(r"::|[./]", " ", name)).lower()


@F.pandas_udf(T.StringType())
def decompose_runs(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else decompose_text(x))


def decompose(name: Column) -> Column:
    """O-P1: the index tokenizer. Names with a run of six capitals or more take the acronym rule in an Arrow batch; all others stay in the JVM."""
    plain = F.regexp_replace(name, r"::|[./_\- ]", " ")
    plain = F.regexp_replace(plain, r"(?<=[^\p{Lu} ])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}[^\p{Lu} ])", " ")
    joined = F.trim(F.regexp_replace(plain, " +", " "))
    return F.when(name.rlike(r"[\p{Lu}\d]{6}"), decompose_runs(name)).otherwise(F.lower(F.when(joined == "", F.regexp_replace(name, r"::|[./]", " ")).otherwise(joined)))


def name_parts(name: Column, qualified: Column) -> Column:
    """O-P2."""
    a, b = decompose(name), decompose(qualified)
    return F.when(a == b, a).otherwise(F.concat_ws(" ", a, b))


def split_token(token: Column) -> Column:
    """O-P3: the query tokenizer, an array of lower-case words."""
    cut = F.regexp_replace(token, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.transform(F.split(cut, r"[_\-.]"), F.lower), lambda w: w != "")


def split_token_text(token: str) -> list[str]:
    import regex

    return [w.lower() for w in regex.split(r"[_\-.]", regex.sub(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_", token)) if w]


def contains_folded(column: Column, needle: str) -> Column:
    """O-P5: substring without regard to case."""
    return F.instr(F.lower(column), needle.lower()) > 0


def leaf(qualified: Column) -> Column:
    """O-P6: what follows the last separator."""
    return F.regexp_extract(qualified, r"(?s)^(?:.*(?:::|[#.\\]))?(.*?)$", 1)


def separator(qualified: Column) -> Column:
    """O-P6: the last separator itself, or ''."""
    return F.regexp_extract(qualified, r"(?s)^.*(::|[#.\\])", 1)


def rewrite_receiver(target: Column, parent: Column) -> Column:
    """O-P7: self.x and Self::x as members of the parent, with the parent's own separator ('.' if it has none)."""
    sep = F.when(separator(parent) == "", ".").otherwise(separator(parent))
    return F.when(target.startswith("self.") & (parent != ""), F.concat(parent, sep, F.substring(target, 6, 10_000))).when(target.startswith("Self::") & (parent != ""), F.concat(parent, F.lit("::"), F.substring(target, 7, 10_000))).otherwise(target)


def distance(name: Column, qualified: Column, query: str, most: int = 2) -> Column:
    """O-P8: least case-folded edit distance of the query to the name, the qualified name and its suffixes; -1 beyond most."""
    q = F.lit(query.lower())
    parts = F.split(F.regexp_replace(qualified, "::|#", "."), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = F.concat(F.array(name, qualified), suffixes)
    found = F.array_min(F.filter(F.transform(tried, lambda t: F.levenshtein(F.lower(t), q, most)), lambda d: d >= 0))
    return F.coalesce(found, F.lit(-1))


def is_synthetic(qualified: Column, prefixes: tuple[str, ...] = SYNTHETIC) -> Column:
    """O-P10."""
    return reduce(lambda a, b: a | b, (qualified.startswith(p) for p in prefixes))


def suffix(name: Column) -> Column:
    """O-P11: the last _part, else from the last capital after the first character, else ''."""
    under, hump = F.regexp_extract(name, r"(_[^_]*)$", 1), F.regexp_extract(name, r"^.+?(\p{Lu}[^\p{Lu}]*)$", 1)
    return F.when(F.length(under) > 1, under).otherwise(hump)


def plural(word: Column) -> Column:
    """O-P16: English plural by ending."""
    return F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).when(word.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))


def singular(word: Column) -> Column:
    """O-P16: the reverse, for regular endings."""
    return F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def classify(word: Column) -> Column:
    """O-P16: a plural snake-case name as a class name."""
    return F.regexp_replace(F.initcap(F.replace(singular(word), F.lit("_"), F.lit(" "))), " ", "")


#: Suffixes that name a role played for a model, and those that rule that out (fixed values).
ROLES = ("Controller", "Serializer", "Policy", "Decorator", "Presenter", "Service", "Job", "Worker", "Mailer", "Form", "Validator")


def role_prefix(name: Column) -> Column:
    """O-P17: the name without its role suffix; '' if it has none."""
    return F.regexp_extract(name, rf"^(.+)(?:{'|'.join(ROLES)})$", 1)


@F.pandas_udf(T.StringType())
def byte_capped(texts: pd.Series, limit: pd.Series) -> pd.Series:
    """O-P18: at most so many bytes, cut between characters, with an ellipsis if cut."""

    def cap(t: str | None, n: int) -> str | None:
        raw = t.encode() if t is not None else b""
        return t if len(raw) <= n else raw[:n].decode(errors="ignore") + "…"

    return pd.Series([cap(t, n) for t, n in zip(texts, limit, strict=True)], dtype=object)


def snippet(content: Column, line: Column, limit: int = 200) -> Column:
    """O-P18: the trimmed line, so many bytes at most."""
    return byte_capped(F.trim(F.coalesce(F.get(F.split(content, "\n"), line - 1), F.lit(""))), F.lit(limit))


def arity_of(signature: str | None) -> tuple[int, int, bool]:
    """O-P19 for one signature: parameters and results of a Go function; unknown if brackets don't match."""
    if not signature or "(" not in signature:
        return 0, 0, False
    rest = re.sub(r"^func\s*(?:\([^)]*\)\s*)?[A-Za-z_]\w*", "", signature.strip())
    params, after = _bracketed(rest)
    if params is None:
        return 0, 0, False
    after = after.strip().rstrip("{").strip()
    if after.startswith("("):
        results, _ = _bracketed(after)
        return (_items(params), _items(results), True) if results is not None else (0, 0, False)
    return _items(params), 1 if after else 0, True


def _bracketed(text: str) -> tuple[str | None, str]:
    depth = 0
    for i, c in enumerate(text):
        depth += c in "([{"
        depth -= c in ")]}"
        if depth == 0 and c == ")":
            return text[text.index("(") + 1 : i], text[i + 1 :]
    return None, ""


def _items(text: str) -> int:
    depth, n = 0, 0
    for c in text:
        depth += c in "([{"
        depth -= c in ")]}"
        n += c == "," and depth == 0
    return n + 1 if text.strip() else 0


@F.pandas_udf(T.StructType([T.StructField("params", T.IntegerType()), T.StructField("results", T.IntegerType()), T.StructField("known", T.BooleanType())]))
def arity(signatures: pd.Series) -> pd.DataFrame:
    """O-P19."""
    return pd.DataFrame([arity_of(s) for s in signatures], columns=["params", "results", "known"])


def wire_confidence(c: Column) -> Column:
    """O-P21: whole numbers with one decimal, others in their shortest form."""
    return F.when(c == F.floor(c), F.format_string("%.1f", c)).otherwise(c.cast("string"))


def wire_score(c: Column) -> Column:
    """O-P21: two decimals."""
    return F.format_string("%.2f", c)


def token_estimate(struct: Column) -> Column:
    """O-P22: bytes of the JSON over four."""
    return F.floor(F.octet_length(F.to_json(struct)) / 4)


def wordpieces(text: str, vocabulary: dict[str, int], most: int = 256, unknown: str = "[UNK]") -> list[int]:
    """O-P23: lower-cased words and marks, each parted greedily into its longest known pieces."""
    ids = [vocabulary.get("[CLS]", 0)]
    for word in re.findall(r"\w+|[^\w\s]", text.lower()):
        pieces, start = [], 0
        while start < len(word):
            end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocabulary), None)
            if end is None:
                pieces = [vocabulary[unknown]]
                break
            pieces.append(vocabulary[("##" if start else "") + word[start:end]])
            start = end
        ids += pieces
    return [*ids[: most - 1], vocabulary.get("[SEP]", 0)]


def stimulus(name: Column) -> Column:
    """O-E19: kebab-case controller names, '--' parting namespaces."""
    parts = F.transform(F.split(name, "--"), lambda p: F.replace(F.initcap(F.regexp_replace(p, "[-_]", " ")), F.lit(" "), F.lit("")))
    return F.concat(F.array_join(parts, "::"), F.lit("Controller"))
