"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit quarters. Two fingerprints within the radius
have counts whose differences sum to the radius at most, so all other pairs of tiles are skipped. Tiles are shipped in blocks of up to
``BLOCK`` fingerprints; within the task each pair of blocks is compared in full, ``SIDE`` by ``SIDE`` at a time, with numpy exclusive-or
and bit counts. Each such part hands on a spanning forest of its links: no link between different fingerprints is lost for the
components, and a dense group never emits all its pairs.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer than three words make one shingle.
Copies share a fingerprint and are never expanded into pairs. Repeated rows get equal results. An empty table gives an empty result.
A null doc_id takes part in its group without being its smallest. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import byte_texts, give_back, settle
from graphloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
QUARTERS, QUARTER_BITS = 4, 16
#: Fingerprints of a block at most (about), of each side compared at once, and hashes whose bits are summed at once.
BLOCK, SIDE, CHUNK = 1 << 16, 2048, 1 << 16


def fingerprint(text: bytes) -> int:
    """Signed 64-bit fingerprint of whole UTF-8 text. bytes.split() splits at \\x20 and \\x09-\\x0D, bytes.lower() lowers A-Z."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i : i + CHUNK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in byte_texts(b.column(1))], pa.int64())], ["doc_id", "fp"])
    give_back()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp of every row."""
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the two-sided graph whose links are the true cells: row and column numbers of its links."""
    rows, cols = np.nonzero(near)
    if len(rows) <= sum(near.shape):
        return rows, cols
    left, right, out = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool), ([], [])
    for start in np.unique(rows):
        if not left[start]:
            continue
        left[start] = False
        a = np.array([start])
        while len(a):
            part = near[a] & right
            b = np.flatnonzero(part.any(axis=0))
            if not len(b):
                break
            out[0].append(a[part[:, b].argmax(axis=0)])
            out[1].append(b)
            right[b] = False
            part = near[:, b] & left[:, None]
            a = np.flatnonzero(part.any(axis=1))
            out[0].append(a)
            out[1].append(b[part[a].argmax(axis=1)])
            left[a] = False
    return np.concatenate(out[0]), np.concatenate(out[1])


def _compare(radius: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (np.asarray(z.values).view(np.uint64) for z in (x, y))
                u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
                for i in range(0, len(a), side):
                    for j in range(0, len(b), side):
                        left, right = a[i : i + side], b[j : j + side]
                        rows, cols = forest(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
                        differ = left[rows] != right[cols]
                        u.append(left[rows[differ]])
                        v.append(right[cols[differ]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (u, v)], ["u", "v"])
        give_back()

    return run


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """distinct: fp, one row each. Returns u, v: for each compared pair of blocks a spanning forest of the links within radius.

    The tile directory holds at most 17**4 keys whatever the input, the offsets are fewer than (2 * radius + 1)**4; only blocks of
    about ``block`` fingerprints are ever gathered.
    """
    spark = distinct.sparkSession
    count = lambda i: F.bit_count(F.shiftrightunsigned("fp", QUARTER_BITS * i).bitwiseAND(F.lit((1 << QUARTER_BITS) - 1)))
    base = QUARTER_BITS + 1 + 2 * radius
    code = reduce(lambda x, i: x * base + count(i), range(1, QUARTERS), count(0)).cast("int")
    tiled = distinct.select("fp", code.alias("tile"))
    directory = settle(tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("subs")), "tiles")
    offsets = [reduce(lambda x, y: x * base + y, o) for o in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, o)) <= radius]
    other = directory.select(F.col("tile").alias("tile_b"), F.col("subs").alias("subs_b"))
    near = directory.select("tile", "subs", F.explode(F.lit([o for o in offsets if o >= 0])).alias("o")).withColumn("tile_b", F.col("tile") + F.col("o"))
    pairs = near.join(F.broadcast(other), "tile_b")  # at most 17**4 rows
    pairs = pairs.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("sub_b", F.explode(F.sequence(F.lit(0), F.col("subs_b") - 1)))
    pairs = pairs.where("tile <> tile_b or sub <= sub_b").select("tile", "sub", "tile_b", "sub_b")
    blocks = tiled.join(F.broadcast(directory), "tile").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    blocks = settle(blocks.groupBy("tile", "sub").agg(F.collect_list("fp").alias("fps")), "blocks")
    right = blocks.select(F.col("tile").alias("tile_b"), F.col("sub").alias("sub_b"), F.col("fps").alias("fps_b"))
    work = pairs.join(blocks, ["tile", "sub"]).join(right, ["tile_b", "sub_b"]).select("fps", "fps_b")
    return work.mapInArrow(_compare(radius, side), "u long, v long")


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: doc_id, fp (settled). Adds component_id: the smallest doc_id reachable by links within radius."""
    groups = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(groups.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def stage(docs: DataFrame) -> DataFrame:
    """The documents less all of each group but that with the smallest id; of rows that repeat an id, the least stays.

    Rows without an id stay.
    """
    fps = settle(fingerprints(docs), "fp")
    gone = classes(fps).where("doc_id <> component_id").select("doc_id")
    again = fps.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    kept = docs.join(gone.distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("r")).select("r.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = settle(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fp")
    return classes(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
