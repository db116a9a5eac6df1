"""The tool surface: one function per verb, with the parameters of the original tools (O-Q1 to O-Q4, O-G2, O-G3, O-Q7)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import aggregates, blast, conventions, dead, graph, present, search, status
from graphloom.sources import manifests

#: Rows of a list of choices, and of suggestions.
CHOICES, SUGGESTIONS = 10, 3


@dataclass(frozen=True)
class Answer:
    """Parts by name. choices is set if the symbol could not be told, and then there are no parts."""

    parts: dict[str, DataFrame] = field(default_factory=dict)
    choices: DataFrame | None = None
    hints: list[str] = field(default_factory=list)

    def json(self, part: str) -> DataFrame:
        return present.to_json(self.parts[part])


class Tools:
    def __init__(self, g: Graph, names: DataFrame | None = None, frameworks: DataFrame | None = None, preset: present.Preset | None = None, embed=None):
        spark = g.symbols.sparkSession
        self.g, self.embed, self.preset = g, embed, preset or present.Preset()
        self.names = names if names is not None else spark.createDataFrame([], "language string, set string, name string")
        self.frameworks = frameworks if frameworks is not None else spark.createDataFrame([], "name string")

    def call(self, verb: str, **arguments) -> Answer:
        """By name, with aliases of parameters."""
        return getattr(self, verb)(**present.canonical(arguments))

    def _one(self, symbol: str, file: str) -> tuple[DataFrame | None, Answer]:
        """O-G2, O-G3: the symbol meant, or the choices: near names if none fits, the ten most depended on of many unless one dominates."""
        found = graph.lookup(self.g, symbol, file)
        some = found.limit(2).collect()
        if len(some) == 1 and some[0].resolution != "fuzzy":
            return found, Answer()
        if not some:
            near = search.search(self.g, symbol, search.Options(limit=SUGGESTIONS), self.embed)
            return None, Answer(choices=near, hints=present.next_steps(0, 0, False))
        if some[0].resolution != "fuzzy":
            best = graph.dominant(found, self.g.edges)
            if not best.isEmpty():
                return best, Answer()
        ranked = found.join(aggregates.in_degree(self.g.edges), "symbol_id", "left").orderBy(F.desc(F.coalesce("in_degree", F.lit(0))), "symbol_id").limit(CHOICES)
        return None, Answer(choices=ranked, hints=present.next_steps(1, 0, True))

    def search(self, query: str, limit: int = 10, language: str = "", min_score: float = 0.0, mode: str = "") -> Answer:
        """mode 'keyword' leaves vectors out (O-Q9)."""
        return Answer({"results": search.search(self.g, query, search.Options(limit, language, min_score), None if mode == "keyword" else self.embed)})

    def graph(self, symbol: str = "", file: str = "", depth: int = 0, direction: str = "both", dead_code: bool = False, language: str = "", domain: str = "", min_confidence: float = graph.FLOOR) -> Answer:
        """Depth 1 by default, 2 for callers. dead_code asks for unreferenced symbols instead."""
        if dead_code:
            return self.dead(language, domain)
        root, answer = self._one(symbol, file)
        if root is None:
            return answer
        depth = depth or (2 if direction == "callers" else 1)
        near = graph.neighbourhood(self.g, root, direction)
        parts = {"edges": near, "categories": graph.categories(near, min_confidence), "layers": graph.bfs(self.g, root, depth, direction), "temporal": graph.co_changes(self.g, root), "member_callers": graph.member_callers(self.g, root, min_confidence), "inferred_callers": graph.inferred_callers(self.g, root), "also_called_by": graph.also_called_by(self.g, root)}
        return Answer(parts)

    def dead(self, language: str = "", domain: str = "", skip_test_references: bool = True) -> Answer:
        found = dead.verdicts(dead.facts(self.g, dead.unreferenced(self.g, skip_test_references, language, domain), self.names, self.frameworks))
        return Answer({"symbols": found, "reasons": dead.grouped(found)})

    def blast(self, symbol: str = "", file: str = "", diff: str = "", max_hops: int = 0, min_confidence: float = 0.0, include_tests: bool = True) -> Answer:
        """By symbol, or by a diff's changed lines."""
        options = blast.Options(max_hops or self.preset.hops, min_confidence or self.preset.confidence, self.preset.cap)
        if diff:
            ranges = manifests.diff_ranges(self.g.symbols.sparkSession.createDataFrame([(diff,)], "diff string"))
            root = aggregates.overlapping(self.g.symbols, self.g.files, ranges)
        else:
            root, answer = self._one(symbol, file)
            if root is None:
                return answer
        reached = blast.reach(self.g, root, options)
        rows = blast.without_members(blast.affected(self.g, reached), self.g)
        risk = blast.risk(rows)
        parts = {"callers": blast.capped(rows if include_tests else rows.where(~F.col("is_test")), self.g.edges, options.cap), "risk": risk, "groups": blast.groups(rows, self.g), "tests": blast.affected_tests(self.g, reached), "importers": blast.importers(self.g, reached), "parents": blast.parents(rows, self.g)}
        found = blast.carriers(self.g, root)
        parts |= {"retained_by": blast.laundered(self.g, found), "carriers": found}
        if diff:
            parts["union"], parts["worst"] = blast.merged(rows, risk)
        return Answer(parts)

    def conventions(self, domain: str = "", min_strength: float | None = None) -> Answer:
        least = self.preset.strength if min_strength is None else min_strength
        return Answer({"conventions": conventions.detect(self.g, domain, least), "key_types": aggregates.key_symbols(self.g)})

    def status(self) -> Answer:
        return Answer(status.report(self.g) | {"doctor": status.doctor(self.g), "profile": aggregates.profile(self.g)})
