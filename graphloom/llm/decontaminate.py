"""Benchmark decontamination: prefix-filtered exact set join of benchmark windows with whole documents.

An item gives one window for each run of ``WINDOW`` of its words (an item of fewer words is one window). Words are ordered by
rarity: their document frequency over all documents, counted first. A window occurs in a document only where its rarest word does,
so that word is the prefix token by which documents probe the windows; its place in the window gives the only possible start, which
must lie in the document with the whole window's length behind it; then all words are compared.

Up to ``BLOCK_BYTES`` of item text the windows are sent to every task as an index. Beyond that, windows and documents meet in a join:
documents emit what lies about their prefix words, as far as two bit arrays of a fixed size let through, and equal window texts meet.
Either way all frequencies are counted in one pass and all windows are probed in another, however large the benchmark.

Defined results: null or wordless text has no words and no hits. Items with equal texts all count; a null item_id counts as the empty
string. Repeated rows are judged one by one. An empty benchmark hits nothing. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import byte_texts, give_back, settle, text_of

WINDOW, MIN_ITEMS, BLOCK_BYTES = 8, 2, 2 << 20
#: Bits of each filter that the join sends to the tasks (16 MiB), words that a task counts before it hands them on.
FILTER_BITS, HELD = 1 << 27, 200_000
#: Bytes of words to themselves, A-Z to lower case, all others to a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - width + 1)):
            yield tuple(words[i : i + width])


class Index:
    """Windows by their rarest word: for each (offset of that word, length) the windows and the items they stem from."""

    def __init__(self, items: Iterable[tuple[str, bytes]], frequency: dict[bytes, int], width: int = WINDOW):
        self.owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for x in windows_of(words_of(text), width):
                self.owners[x].add(item)
        self.shapes: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for x in self.owners:
            offset = min(range(len(x)), key=lambda i: (frequency.get(x[i], 0), x[i], i))
            self.shapes[x[offset]].add((offset, len(x)))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans that windows cover, and the items of those windows."""
        found, items, shapes, owners = [], set(), self.shapes, self.owners
        for i in [i for i, w in enumerate(words) if w in shapes]:
            for offset, length in shapes[words[i]]:
                start = i - offset
                if start >= 0 and start + length <= len(words) and (own := owners.get(tuple(words[start : start + length]))):
                    found.append((start, start + length))
                    items |= own
        return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def frequencies(docs: DataFrame, words: DataFrame | set[bytes], text: str) -> DataFrame:
    """word, n: the documents that hold each of the words, given as a set to be sent to every task or as a table to be joined."""
    sent = None if isinstance(words, DataFrame) else docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return got

        for b in batches:
            for t in byte_texts(b.column(0)):
                own = set(words_of(t))
                counts.update(own if sent is None else own & sent.value)
                if len(counts) > HELD:
                    yield out()
        yield out()
        give_back()

    rows = docs.select(text).mapInArrow(count, "word binary, n long")
    if sent is None:
        rows = rows.groupBy("word").agg(F.sum("n").alias("n")).join(words, "word", "left_semi")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


RESULT = pa.struct([("words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
RESULT_TYPE = "struct<words:long,spans:array<struct<start:int,end:int>>,items:array<string>>"


def _added(docs: DataFrame, name: str, kind: str, make: Callable[[list[bytes]], object], arrow: pa.DataType, text: str) -> DataFrame:
    """docs with one more column, made from the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(words_of(t)) for t in byte_texts(b.column(b.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow)], [*b.schema.names, name])
        give_back()

    more = docs.sparkSession.createDataFrame([], f"{name} {kind}").schema
    return docs.mapInArrow(run, docs.schema.__class__([*docs.schema.fields, *more.fields]))


def _by_index(docs: DataFrame, bench: DataFrame, text: str, width: int) -> DataFrame:
    """The windows of a small benchmark, sent to every task."""
    rows = [(r.item, bytes(r.t)) for r in bench.collect()]
    vocabulary = {w for _, t in rows for w in words_of(t)}
    counted = {bytes(r.word): r.n for r in frequencies(docs, vocabulary, text).collect()} if vocabulary else {}
    index = docs.sparkSession.sparkContext.broadcast(Index(rows, counted, width))

    def make(words: list[bytes]) -> dict:
        spans, items = index.value.hits(words)
        return {"words": len(words), "spans": [{"start": x, "end": y} for x, y in spans], "items": sorted(items)}

    return _added(docs, "_d", RESULT_TYPE, make, RESULT, text)


def _bit(*parts: bytes | int) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(x if isinstance(x, bytes) else b"%d" % x for x in parts)) % FILTER_BITS


def _filter(rows: DataFrame, bit: Callable[..., int]) -> np.ndarray:
    """The set bits of all rows (array of bytes FILTER_BITS / 8 long): tasks hand on distinct bits, the driver holds the array alone."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bit(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.int64())], ["bit"])

    pages = rows.mapInArrow(bits, "bit long").groupBy(F.floor(F.col("bit") / 65536).cast("int").alias("page")).agg(F.collect_set(F.pmod("bit", F.lit(65536)).cast("int")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in pages.toLocalIterator():
        whole = np.zeros(65536, bool)
        whole[r.bits] = True
        out[r.page * 8192 : (r.page + 1) * 8192] |= np.packbits(whole)
    return out


def _has(bits: np.ndarray, k: int) -> bool:
    return bool(bits[k >> 3] & (128 >> (k & 7)))


def _by_join(docs: DataFrame, bench: DataFrame, text: str, width: int) -> DataFrame:
    """The windows of a benchmark of any size, joined with what the documents hold about their prefix words."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sorted(set(windows_of(words_of(t), width)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array([b" ".join(x) for x in own], pa.binary())], ["item", "win"])

    owners = settle(bench.mapInArrow(cut, "item string, win binary").distinct(), "windows")
    words = owners.select("win").distinct().select("win", F.posexplode(F.split(F.col("win").cast("string"), " ")).alias("offset", "word"))
    words = settle(words.select("win", "offset", F.col("word").cast("binary").alias("word")), "window-words")
    counted = frequencies(docs, words.select("word").distinct(), text)
    ranked = words.join(counted, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("x"), F.count("*").alias("length"))
    shapes = settle(ranked.select(F.col("x.word").alias("word"), F.col("x.offset").alias("offset"), "length").distinct(), "prefixes")
    sent = spark.sparkContext.broadcast((_filter(shapes.select("word").distinct(), _bit), _filter(shapes, _bit)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, whole = sent.value
        for b in batches:
            key, start, win = [], [], []
            for t in byte_texts(b.column(0)):
                held, digest = words_of(t), sha256(t).digest()
                known: dict[bytes, list[tuple[int, int]]] = {}
                for i, w in enumerate(held):
                    if w not in known:
                        known[w] = [(o, n) for n in range(1, width + 1) for o in range(n) if _has(whole, _bit(w, o, n))] if _has(heads, _bit(w)) else []
                    for offset, length in known[w]:
                        if i >= offset and i - offset + length <= len(held):
                            key.append(digest)
                            start.append(i - offset)
                            win.append(b" ".join(held[i - offset : i - offset + length]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(start, pa.int32()), pa.array(win, pa.binary())], ["key", "start", "win"])
        give_back()

    probes = docs.select(text).mapInArrow(probe, "key binary, start int, win binary").distinct()
    met = settle(probes.join(owners.select("win").distinct(), "win", "left_semi"), "met")
    spans = met.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.size(F.split(F.col("win").cast("string"), " "))).alias("end")))).alias("spans"))
    items = met.select("key", "win").distinct().join(owners, "win").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = settle(spans.join(items, "key"), "hits")
    made = _added(docs, "_d_n", "long", len, pa.int64(), text).withColumn("_d_key", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))

    def runs(found: Column) -> Column:
        """Overlapping and touching spans, given by start, as one."""
        none = F.array().cast("array<struct<start:int,end:int>>")

        def step(a: Column, x: Column) -> Column:
            last = F.element_at(a, -1)
            longer = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
            return F.when((F.size(a) > 0) & (x["start"] <= F.get(a, F.size(a) - 1)["end"]), longer).otherwise(F.concat(a, F.array(x)))

        return F.aggregate(F.coalesce(found, none), none, step)

    joined = made.join(hits.withColumnRenamed("key", "_d_key"), "_d_key", "left")
    result = F.struct(F.col("_d_n").alias("words"), runs(F.col("spans")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return joined.select(*docs.columns, result.alias("_d"))


def _found(docs: DataFrame, bench: DataFrame, text: str, width: int, block_bytes: int) -> DataFrame:
    """The documents' own columns as _d_c0, _d_c1, .. (so that no name clashes), and _d (words, spans, items)."""
    bench = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of("text").cast("binary").alias("t"))
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    own = docs.select(*(F.col(f"`{c}`").alias(f"_d_c{i}") for i, c in enumerate(docs.columns)))
    return (_by_index if size <= block_bytes else _by_join)(own, bench, f"_d_c{docs.columns.index(text)}", width)


def find(docs: DataFrame, bench: DataFrame, text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words (long), hit_spans (merged word spans, ends exclusive) and hit_items (item ids as strings, sorted).

    Columns of docs that have a result's name give way to it.
    """
    names = ("n_words", "hit_spans", "hit_items")
    own = [F.col(f"_d_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in names]
    return _found(docs, bench, text, width, block_bytes).select(*own, *(F.col(f"_d.{f}").alias(n) for f, n in zip(("words", "spans", "items"), names, strict=True)))


def stage(docs: DataFrame, bench: DataFrame, min_items: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which windows of fewer than min_items items occur: by default one window is enough for a document to go."""
    kept = _found(docs, bench, "text", WINDOW, block_bytes).where(F.size("_d.items") < min_items)
    return kept.select(*(F.col(f"_d_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_items") >= MIN_ITEMS).alias("contaminated"),
    )
