"""Chat formatting: token-level assembly of conversations.

Each turn's role and text is encoded by itself; control marks are reserved ids beyond the vocabulary, spliced in between, so no text can
forge one. Control strings in a text are escaped reversibly before encoding (``\\`` within), so the rendered string holds none but the
template's own. The loss mask is a running sum of the steps at which assistant text begins (+1) and ends (-1).

Turns are encoded before the shuffle and streamed in order after it: a conversation comes out as one row for each ``CHUNK`` ids, so that
no conversation, however long, is held in memory.

Defined results: a null text or role is empty. Rows that repeat a turn follow each other, ordered by role and text. A null conv_id is a
conversation of its own, and so are all rows with it; null turns come first. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import strings

VOCABULARY, CHUNK = "byte_bpe_50k.tiktoken", 1 << 18
#: Reserved ids above the vocabulary's 50,256, with the strings they render to.
RESERVED = 50_304
BEGIN, TURN, BODY, CLOSE, END = range(RESERVED, RESERVED + 5)
MARKS = {BEGIN: "<s>", TURN: "[INST]", BODY: "[BODY]", CLOSE: "[/INST]", END: "</s>"}
#: The template's own strings, and those of other common templates: all are escaped in texts.
CONTROLS = [*MARKS.values(), "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_loaded: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level encoding whose ranks the file holds; it has no special tokens, so every string is ordinary text."""
    if path not in _loaded:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            roles, texts = strings(b.column(2)), strings(b.column(3))
            known = {r: t.encode_ordinary(escape(r)) for r in set(roles)}
            ids = [[known[r] for r in roles], [t.encode_ordinary(escape(x)) for x in texts]]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles), pa.array([hashlib.sha256(x.encode()).digest() for x in texts], pa.binary()), *lists], ["conv_id", "turn", "role", "tie", "role_ids", "text_ids"])

    return run


def assemble(turns: list[tuple[str, list[int], list[int]]], first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of consecutive turns (role, role ids, text ids) of a conversation, with its begin and end marks."""
    parts, steps, at = [], [], 0

    def put(x: list[int]) -> None:
        nonlocal at
        parts.append(np.asarray(x, np.int32))
        at += len(x)

    if first:
        put([BEGIN])
    for role, role_ids, text_ids in turns:
        put([TURN])
        put(role_ids)
        put([BODY])
        if role == "assistant":
            steps += [(at, 1), (at + len(text_ids), -1)]
        put(text_ids)
        put([CLOSE])
    if last:
        put([END])
    change = np.zeros(at + 1, np.int8)
    for k, v in steps:
        change[k] += v
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.cumsum(change[:-1], dtype=np.int8)


def _assemble(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, size, none = None, 0, [], 0, True

        def out(last: bool) -> pa.RecordBatch:
            ids, mask = assemble(held, part == 0, last)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([part], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))], ["conv_id", "part", "turns", "ids", "loss_mask"])

        for b in batches:
            for conv, role, role_ids, text_ids in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 5)), strict=True):
                if none or conv != now:
                    if not none:
                        yield out(True)
                    now, part, held, size, none = conv, 0, [], 0, False
                elif size >= chunk:
                    yield out(False)
                    part, held, size = part + 1, [], 0
                held.append((role, role_ids, text_ids))
                size += len(text_ids)
        if not none:
            yield out(True)

    return run


def format_conversations(turns: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns conv_id, part (from 0), turns, ids, loss_mask, each conversation's parts in one partition, in order."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    encoded = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(
        _encode(path), "conv_id long, turn long, role string, tie binary, role_ids array<int>, text_ids array<int>"
    )
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return ordered.mapInArrow(_assemble(chunk), "conv_id long, part int, turns int, ids array<int>, loss_mask array<tinyint>")


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        rows, state = [], None

        def close() -> None:
            rows.append((state["conv"], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types, strict=True)], names)

        for b in batches:
            for conv, part, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                ids, mask = np.asarray(ids.values), np.asarray(mask.values)
                if part == 0:
                    if state is not None:
                        close()
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                marks = np.flatnonzero(ids >= RESERVED).tolist()
                segments = [t.decode_bytes(ids[a + 1 : z].tolist()).decode() for a, z in zip(marks, marks[1:], strict=False)]
                for k, a in enumerate(marks):
                    state["chars"] += len(MARKS[ids[a]]) + (len(segments[k]) if k < len(segments) else 0)
                    if ids[a] == TURN:
                        state["turns"] += 1
                        state["all"].update(unescape(segments[k]).encode() + b"\n")
                    elif ids[a] == BODY:
                        text = unescape(segments[k])
                        state["all"].update(text.encode() + b"\n")
                        own, under = ids[a + 1 : marks[k + 1]], mask[a + 1 : marks[k + 1]] == 1
                        if under.any():
                            if not under.all():
                                text = unescape(t.decode_bytes(own[under].tolist()).decode(errors="replace"))
                            state["loss"].update(text.encode())
                            state["loss_chars"] += len(text)
            if len(rows) >= 10_000:
                yield flush()
                rows = []
        if state is not None:
            close()
        yield flush()

    return run


def read_back(formatted: DataFrame, path: str | None = None, in_order: bool = False) -> DataFrame:
    """Digests of the conversations as they are in the ids and masks. in_order: parts already follow each other within partitions."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(_read(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return read_back(format_conversations(turns.unionByName(more)), in_order=True)
