"""The property graph: schemas, vocabularies, and the edge kinds that each consumer follows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame

FILES = "file_id long, path string, language string, hash string, n_symbols int, indexed_at timestamp"
SYMBOLS = (
    "symbol_id long, file_id long, name string, qualified string, kind string, visibility string, receiver string, parent_id long, "
    "line_start int, line_end int, docstring string, complexity int, snippet string, name_parts string"
)
EDGES = "edge_id long, source_id long, target_id long, kind string, file_id long, line int, confidence double, co_changes int"
EMBEDDINGS = "symbol_id long, vector array<float>"
KEY_VALUES = "key string, value string"

SYMBOL_KINDS = ("class", "module", "method", "function", "constant", "interface", "type")
EDGE_KINDS = ("calls", "imports", "inherits", "includes", "tests", "composes", "temporal", "references")
CONTAINERS = ("class", "module", "interface", "type")
#: Kinds that each consumer follows; a test holds that together with the exemptions they are all the kinds.
FOLLOWED = {
    "blast": ("calls", "inherits", "includes", "tests", "composes", "temporal", "references"),
    "dead": ("calls", "composes", "includes", "inherits", "references"),
    "context": ("composes", "includes", "inherits", "calls"),
    "coupling": ("calls", "composes", "inherits", "includes"),
    "graph": ("calls", "imports", "inherits", "includes", "tests", "composes", "references"),
}
EXEMPT = {"blast": ("imports",), "dead": ("tests", "temporal", "imports"), "context": ("imports", "tests", "temporal", "references"), "coupling": ("imports", "tests", "temporal", "references"), "graph": ("temporal",)}
#: Confidence by how an edge was found (fixed values).
CONFIDENCE = {"static": 1.0, "convention": 0.9, "ambiguous": 0.8, "tests": 0.8, "dynamic": 0.7, "unresolved": 0.5, "collision": 0.3, "naming": 0.6, "mixin": 0.8, "dispatch": 0.8}
#: Prefixes of qualified names that stand for no source symbol (fixed values).
SYNTHETIC = (
    "turbo-channel:", "turbo-frame:", "importmap:", "partial:", "i18n:", "route:", "ruby-core:", "django-related:", "laravel-binding:", "laravel-listen:", "laravel-middleware:",
)
DIRECTIONS = ("both", "callers", "callees")


@dataclass(frozen=True)
class Graph:
    """files, symbols, edges; the optional relations are None where a source has none.

    A relation may be given as a function without arguments: it is called when somebody asks for the relation, so that a query pays for what it reads.
    Edges may be given as such a function of several tables, which together are the edges: each may keep a layout of its own (``parts``).
    """

    files: DataFrame | Callable[[], DataFrame]
    symbols: DataFrame | Callable[[], DataFrame]
    edges: DataFrame | Callable[[], DataFrame | list[DataFrame]]
    meta: DataFrame | None = None
    embeddings: DataFrame | None = None

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if name in ("files", "symbols", "edges") and not isinstance(value, DataFrame) and callable(value):
            value = value()
            return reduce(DataFrame.unionByName, value) if isinstance(value, list) else value
        return value

    @property
    def parts(self) -> list[DataFrame]:
        """The tables that together are the edges."""
        value = object.__getattribute__(self, "edges")
        value = value if isinstance(value, DataFrame) else value()
        return value if isinstance(value, list) else [value]


def replace(g: Graph, **changes) -> Graph:
    """As dataclasses.replace, without asking for the relations that stay."""
    return Graph(**({f.name: object.__getattribute__(g, f.name) for f in fields(g)} | changes))
