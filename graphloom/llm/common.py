"""What the training-data operators share: tables in the shared folder, texts of Arrow columns, memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.shared import new_path, settle, shared_dir

__all__ = ["byte_texts", "give_back", "new_path", "settle", "shared_dir", "strings", "text_of"]

#: Null-safe empty text.
EMPTY = ""


def give_back() -> None:
    """At a task's end: return freed memory to the system, so that an idle worker leaves room to other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(EMPTY))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings, null as empty."""
    return [x if x is not None else EMPTY for x in column.to_pylist()]


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty, without decoding."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""
