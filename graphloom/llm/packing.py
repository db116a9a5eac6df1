"""Best-fit packing by hierarchical residual rounds.

Each partition tokenizes its documents and packs their pieces best-fit by decreasing length; sequences that are nearly full are final.
The underfull ones are items of the next round: groups of ``FAN`` former groups are packed anew, best-fit, until one group is left.
No task gathers more than about ``GATHER`` pieces: a round has as many groups as that needs, and the rounds end when they no longer
mend anything. Only the descriptions of underfull sequences are shuffled, never texts or ids.

Defined results: a null or empty text is its end id alone. A document longer than the capacity is cut into full pieces and a last one;
others are never cut. Repeated rows are packed each by itself. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, settle
from graphloom.llm.tokens import in_parts, vocabulary_path, word_ids

CAPACITY, END_ID = 2048, 0
#: Rounds: former groups to a group, free places of a nearly full sequence, pieces that a task gathers.
FAN, SLACK, GATHER = 8, 16, 250_000
#: Words that a worker's tokenizer remembers, and bytes of text handled at once: small, as packing runs beside full heaps.
REMEMBERED, AT_ONCE = 150_000, 2 << 20
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill")
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill int"


def best_fit(sizes: Sequence[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, and the fill of each bin. By decreasing size (then place), each to the fullest bin that holds it.

    Bins are kept by free room; the smallest room that suffices is the lowest set bit of a mask.
    """
    where, offset, fill = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[k], offset[k] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return where, offset, fill


def pieces(doc_id: int, ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc32) of unsigned 32-bit ids."""
    for k in range(max(1, math.ceil(len(ids) / capacity))):
        part = ids[capacity * k : capacity * (k + 1)]
        yield doc_id, k, capacity * k, len(part), zlib.crc32(part)


def _table(rows: list[tuple], first_bin: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    rows.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[4]))
    where, offset, fill = best_fit([r[3] for r in rows], capacity)
    columns = [*zip(*rows, strict=True)] if rows else [()] * 5
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    made = [pa.array([first_bin + b for b in where], pa.int64()), pa.array(offset, pa.int64()), pa.array([fill[b] for b in where], pa.int32())]
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *made], list(COLUMNS)), len(fill)


def _local(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows = word_ids(path, REMEMBERED), []
        bins = TaskContext.get().partitionId() << 32
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in in_parts(texts, AT_ONCE):
                ids, at = encoder.flat(texts[i:j], END_ID)
                for doc, a, b in zip(docs[i:j], at.tolist(), at[1:].tolist(), strict=False):
                    rows += pieces(doc, ids[a:b], capacity)
            if len(rows) >= GATHER:
                table, n = _table(rows, bins, capacity)
                rows, bins = [], bins + n
                yield table
        yield _table(rows, bins, capacity)[0]
        give_back()

    return run


def _again(round_: int, capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins = rows.drop_duplicates("bin")[["bin", "fill"]].sort_values(["fill", "bin"], ascending=[False, True])
        where, shift, fill = best_fit(bins.fill.tolist(), capacity)
        first = (round_ << 56) | (int(key[0]) << 32)
        moved = pd.DataFrame({"bin": bins.bin.to_numpy(), "to": [first + b for b in where], "shift": shift, "now": [fill[b] for b in where]})
        out = rows.merge(moved, on="bin")
        out["offset"] += out["shift"]
        return out.assign(bin=out["to"], fill=out["now"])[list(COLUMNS)]

    return run


def repack(placed: DataFrame, groups: int, capacity: int = CAPACITY, fan: int = FAN, slack: int = SLACK, gather: int = GATHER) -> DataFrame:
    """placed (settled): the pieces as their partitions packed them. Returns them with underfull sequences merged in rounds."""
    final = F.col("fill") >= capacity - slack
    done, rest, round_, size = [placed.where(final)], placed.where(~final), 1, None
    while True:
        counts = rest.agg(F.count("*").alias("rows"), F.countDistinct("bin").alias("bins")).first()
        stuck = size is not None and counts.bins >= size
        if not counts.bins or (groups <= 1 and round_ > 1) or (stuck and groups <= math.ceil(counts.rows / gather)):
            break
        groups, size = max(1, math.ceil(groups / fan), math.ceil(counts.rows / gather)), counts.bins
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        mended = settle(dealt.groupBy("group").applyInPandas(_again(round_, capacity), SCHEMA), "repacked")
        done.append(mended.where(final))
        rest, round_ = mended.where(~final), round_ + 1
    out = rest
    for x in done:
        out = out.unionByName(x)
    return out


def pack(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    placed = settle(docs.select("doc_id", text).mapInArrow(_local(path or vocabulary_path(), capacity), SCHEMA), "placed")
    groups = placed.agg(F.countDistinct(F.shiftright("bin", 32))).first()[0]
    return repack(placed, groups, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def lower_bound(lengths: Iterable[int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs at least."""
    return math.ceil(sum(lengths) / capacity)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
