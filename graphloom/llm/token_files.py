"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

A file row holds doc_id, part (the file's place in id order), part_start (ids of earlier documents in the file), n_tokens and the ids.
Files are ranges of ascending doc_id and sorted inside, so readers take stripes in parallel, skip them by the statistics and Bloom
filters on doc_id, and find any document's place in the whole stream from a manifest of one row per file.

Defined results: a null or empty text is its end id alone. Rows that repeat a doc_id follow each other, ordered by text. A null doc_id
comes first. An empty table gives files without rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import give_back, new_path
from graphloom.llm.tokens import in_parts, vocabulary_path, word_ids

END_ID = 2
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = word_ids(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for i, j in in_parts(texts):
                ids, at = encoder.flat(texts[i:j], end_id)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                columns = [batch.column(0)[i:j], pa.array(np.full(j - i, part, np.int32)), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "ids"])
                start += int(at[-1])
        give_back()

    return run


def write(docs: DataFrame, target: str, text: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Tokenize every whole text, append end_id, and write the ids to target in ascending doc_id order."""
    ordered = docs.select("doc_id", text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", text)
    ordered.mapInArrow(_encode(path or vocabulary_path(), end_id), SCHEMA).write.options(**ORC_OPTIONS).orc(target)


def manifest(files: DataFrame) -> DataFrame:
    """part, ids before it: one row per file, from the short columns alone."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))


def read(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    files = spark.read.schema(SCHEMA).orc(target)
    return files.join(manifest(files), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, target: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents; statistics and Bloom filters skip what can't hold them."""
    return spark.read.schema(SCHEMA).orc(target).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), np.int32).view(np.uint8)
        at = lists.offsets.to_numpy().astype(np.int64)
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])
    give_back()


def digests(files: DataFrame) -> DataFrame:
    """doc_id, part, part_start, n_tokens, ids_crc32, of the ids as they are in the files."""
    columns = files.select("doc_id", "part", "part_start", "ids")
    return columns.mapInArrow(_digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_path(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), target)
    files = spark.read.schema(SCHEMA).orc(target)
    start = (F.col("before") + F.col("part_start")).alias("start")
    return digests(files).join(manifest(files), "part").select("doc_id", start, "n_tokens", "ids_crc32")
