"""File to symbols, edges and names (O-S6, O-S7, O-E rows), as one mapInArrow over files.

Python is read through its own syntax tree. The other languages are read by patterns over lines: declarations, nesting by indentation or
braces, bases, calls, imports. Extractors are found by extension and may be replaced or added in ``EXTRACTORS``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "file_id long, path string, language string, error string, "
    "symbols array<struct<name:string,qualified:string,kind:string,visibility:string,parent:string,line_start:int,line_end:int,docstring:string,snippet:string>>, "
    "edges array<struct<source:string,target:string,kind:string,line:int,confidence:double>>, names array<struct<set:string,name:string>>"
)
DOC_LIMIT, SNIPPET_LIMIT = 2048, 200


@dataclass
class Found:
    """What an extractor emits: rows in the order of SCHEMA's structs."""

    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    names: list[dict] = field(default_factory=list)

    def symbol(self, name, qualified, kind, visibility, parent, start, end, doc=None, line="") -> None:
        raw = (doc or "").encode()[:DOC_LIMIT].decode(errors="ignore") or None
        self.symbols.append({"name": name, "qualified": qualified, "kind": kind, "visibility": visibility, "parent": parent, "line_start": start, "line_end": end, "docstring": raw, "snippet": line.strip()[:SNIPPET_LIMIT]})

    def edge(self, source, target, kind, line, confidence=1.0) -> None:
        self.edges.append({"source": source, "target": target, "kind": kind, "line": line, "confidence": confidence})

    def name(self, set_: str, name: str) -> None:
        self.names.append({"set": set_, "name": name})


# --- Python ------------------------------------------------------------------------------------------------------------------------


def _dotted(node: ast.expr, types: dict[str, str], owner: str | None) -> str | None:
    """The written name of a call target, with receivers of known type in place of variables (O-E12)."""
    if isinstance(node, ast.Name):
        return types.get(node.id, node.id)
    if isinstance(node, ast.Attribute):
        if isinstance(node.value, ast.Name) and node.value.id in ("self", "cls") and owner:
            return f"{owner}.{node.attr}"
        base = _dotted(node.value, types, owner)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Call):
        return _dotted(node.func, types, owner)
    return None


class _Python(ast.NodeVisitor):
    def __init__(self, source: str):
        self.lines, self.found, self.scope, self.owners, self.types = source.split("\n"), Found(), [], [], [{}]

    def _line(self, node) -> str:
        return self.lines[node.lineno - 1] if node.lineno <= len(self.lines) else ""

    def _here(self) -> str | None:
        return ".".join(self.scope) or None

    def _declare(self, node, kind: str, name: str, doc=None) -> str:
        qualified = ".".join([*self.scope, name])
        private = name.startswith("_") and not re.fullmatch("__.+__", name)
        self.found.symbol(name, qualified, kind, "private" if private else "public", self._here(), node.lineno, node.end_lineno or node.lineno, doc, self._line(node))
        return qualified

    def _decorators(self, node) -> None:
        for d in node.decorator_list:
            written = _dotted(d.func if isinstance(d, ast.Call) else d, {}, None) or ""
            leaf = written.rpartition(".")[2]
            kind = "routes" if leaf in ("route", "get", "post", "put", "delete", "patch", "websocket") and "." in written else "django" if leaf in ("receiver", "register") else "decorated"
            self.found.name(kind, node.name)
            if leaf in ("task", "shared_task"):
                self.found.name("dispatch", node.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        qualified = self._declare(node, "class", node.name, ast.get_docstring(node))
        for b in node.bases:
            target = _dotted(b, {}, None)
            if target:
                self.found.edge(qualified, target, "inherits", node.lineno)
        self._decorators(node)
        self.scope.append(node.name)
        self.owners.append(qualified)
        for x in node.body:
            self.visit(x)
        self.scope.pop()
        self.owners.pop()

    def _function(self, node) -> None:
        inside = bool(self.owners) and self.scope and ".".join(self.scope) == self.owners[-1]
        qualified = self._declare(node, "method" if inside else "function", node.name, ast.get_docstring(node))
        self._decorators(node)
        known = dict(self.types[-1])
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None and (target := _dotted(a.annotation, {}, None)):
                known[a.arg] = target
                self.found.edge(qualified, target, "references", a.lineno, 0.9)
        if node.returns is not None and (target := _dotted(node.returns, {}, None)):
            self.found.edge(qualified, target, "references", node.lineno, 0.9)
        self.scope.append(node.name)
        self.types.append(known)
        for x in node.body:
            self.visit(x)
        self.scope.pop()
        self.types.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if not isinstance(t, ast.Name):
                continue
            at_top = not self.scope or (self.owners and ".".join(self.scope) == self.owners[-1])
            if t.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                for e in node.value.elts:
                    if isinstance(e, ast.Constant):
                        self.found.name("all_exports", str(e.value))
            elif at_top and t.id.isupper():
                self._declare(node, "constant", t.id)
            if isinstance(node.value, ast.Call) and (made := _dotted(node.value.func, {}, None)) and made.rpartition(".")[2][:1].isupper():
                self.types[-1][t.id] = made
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        target = _dotted(node.func, self.types[-1], self.owners[-1] if self.owners else None)
        if target in ("getattr", "setattr", "hasattr") and len(node.args) > 1 and isinstance(node.args[1], ast.Constant):
            self.found.name("dispatch", str(node.args[1].value))
        elif target:
            self.found.edge(self._here(), target, "calls", node.lineno, 1.0 if "." not in target or target.split(".")[0][:1].isupper() else 0.7)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.found.edge(None, a.name, "imports", node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.found.edge(None, f"{node.module or ''}.{a.name}".lstrip("."), "imports", node.lineno)

    def visit_Name(self, node: ast.Name) -> None:
        self.found.name("mentions", node.id)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.found.name("mentions", node.attr)
        self.generic_visit(node)


def python(source: str) -> Found:
    v = _Python(source)
    v.visit(ast.parse(source))
    v.found.name("harvest", "")
    return v.found


# --- Pattern-read languages --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Language:
    """A declaration is kind, pattern with groups name and perhaps bases or receiver; nested ones belong to the open declaration about them."""

    separator: str
    declarations: tuple[tuple[str, str], ...]
    imports: str = ""
    mixins: str = ""
    private: str = ""
    public: str = ""
    comment: str = r"^\s*(?://|/?\*+)\s?(.*)$"
    braces: bool = True


_C_TYPE = r"(?:[\w<>\[\],.?&*: ]+[ *&])"
LANGUAGES = {
    "go": Language(".", (
        ("method", r"^func\s+\(\s*\w*\s*\*?(?P<receiver>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("), ("function", r"^func\s+(?P<name>\w+)\s*[\(\[]"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("class", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("type", r"^type\s+(?P<name>\w+)\b"), ("constant", r"^(?:const|var)\s+(?P<name>\w+)\b"),
    ), imports=r'^\s*(?:import\s+)?(?:\w+\s+)?"(?P<name>[\w./-]+)"\s*$', public=r"^[A-Z]"),
    "ruby": Language("::", (
        ("class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)(?:\s*<\s*(?P<bases>[A-Z][\w:]*))?"), ("module", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>[\w]+[?!=]?)"), ("constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]+)\s*=(?!=)"),
    ), imports=r"^\s*require(?:_relative)?\s+['\"](?P<name>[^'\"]+)", mixins=r"^\s*(?:include|extend|prepend)\s+(?P<name>[A-Z][\w:]*)", comment=r"^\s*#\s?(.*)$", braces=False),
    "typescript": Language(".", (
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[\w.]+))?"), ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+))?"), ("type", r"^\s*(?:export\s+)?(?:type|enum)\s+(?P<name>\w+)\b"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("constant", r"^(?:export\s+)?const\s+(?P<name>\w+)\s*(?::[^=]+)?="),
        ("method", r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b)[\w#]+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^={]+)?\{"),
    ), imports=r"^\s*(?:import|export)\b.*?\bfrom\s+['\"](?P<name>[^'\"]+)", private=r"\bprivate\b|#", public=r"\bexport\b"),
    "rust": Language("::", (
        ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(?P<name>\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)"),
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<name>\w+)"), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z]\w*)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"),
    ), imports=r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+)", public=r"^\s*pub\s"),
}
_CURLY = (
    ("interface", r"^\s*(?:[\w@()\"]+\s+)*?(?:interface|trait|protocol)\s+(?P<name>\w+)(?:[^{]*?(?:extends|:)\s*(?P<bases>[\w.]+))?"),
    ("class", r"^\s*(?:[\w@()\"]+\s+)*?(?:class|object|struct|enum|record)\s+(?P<name>\w+)(?:[^{]*?(?:\bextends|:)\s*(?:public\s+)?(?P<bases>[\w.\\]+))?"),
    ("function", r"^\s*(?:[\w@()\"]+\s+)*?(?:fun|def|function)\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*[\(\[]"),
    ("function", r"^\s*(?!return\b|else\b|new\b|throw\b)(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|inline|const|synchronized)\s+)*" + _C_TYPE + r"(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b)\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:throws\s+[\w., ]+)?\{"),
    ("constant", r"^\s*(?:(?:public|private|protected|internal)\s+)?(?:static\s+final|const|const val|final val)\s+(?:\w+\s+)?(?P<name>[A-Z][A-Z0-9_]+)\s*="),
)
_C_IMPORT = r"^\s*(?:import\s+(?:static\s+)?|using\s+(?!\()|use\s+|#\s*include\s*[<\"])(?P<name>[\w.\\/:]+)"
for _name in ("java", "kotlin", "scala", "csharp", "php", "c", "cpp"):
    LANGUAGES[_name] = Language("\\" if _name == "php" else "::" if _name == "cpp" else ".", _CURLY, imports=_C_IMPORT, mixins=r"^\s+use\s+(?P<name>[A-Z][\w\\]*)\s*;" if _name == "php" else "", private=r"\b(?:private|protected)\b" + (r"|^static\b" if _name == "c" else ""))
LANGUAGES["javascript"] = LANGUAGES["typescript"]
_CALL = re.compile(r"(?<![\w.:>])((?:[A-Za-z_@$]\w*(?:\.|::|->|\?\.))*[A-Za-z_]\w*[?!]?)\s*\(")
_WORD = re.compile(r"[A-Za-z_]\w*")
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`")
#: Words that look like calls and aren't (fixed values).
KEYWORDS = frozenset("if for while switch catch return func function def fn fun match when sizeof typeof new await class elsif unless until and or not in else do using lock super print".split())


@cache
def _compiled(spec: Language) -> tuple:
    """The patterns of a language, ready for use by every file and line."""
    return [(k, re.compile(p)) for k, p in spec.declarations], *(re.compile(p) if p else None for p in (spec.imports, spec.mixins, spec.comment, spec.private, spec.public))


def by_lines(source: str, language: str) -> Found:
    spec, found, lines = LANGUAGES[language], Found(), source.split("\n")
    declarations, imports, mixins, comment, private, public = _compiled(spec)
    open_: list[dict] = []
    doc: list[str] = []
    depth, visibility = 0, "public"

    def close(until: Callable[[dict], bool], at: int) -> None:
        while open_ and until(open_[-1]):
            x = open_.pop()
            if x["row"] is not None:
                found.symbols[x["row"]]["line_end"] = max(at, x["line"])

    for n, line in enumerate(lines, 1):
        text = line.strip()
        if not text:
            doc = []
            continue
        if (c := comment.match(line)) and not (language in ("c", "cpp") and text.startswith("*")):
            doc.append(c[1])
            continue
        indent = len(line) - len(line.lstrip())
        if not spec.braces:
            if text == "end" or text.startswith("end "):
                close(lambda x: x["indent"] >= indent, n)
            else:
                close(lambda x: x["indent"] >= indent and not text.startswith(("else", "elsif", "rescue", "ensure", "when", ")", "]", "}")), n - 1)
        if text in ("private", "protected", "public") and language == "ruby":
            visibility = text
            continue
        hit = next(((k, m) for k, p in declarations if (m := p.match(line))), None)
        parent = next((x for x in reversed(open_) if x["kind"] in ("class", "module", "interface", "impl")), None)
        if hit:
            kind, m = hit
            groups = m.groupdict()
            name = groups["name"]
            owner = groups.get("receiver") or (parent["qualified"] if parent else None)
            joint = "#" if language == "ruby" and kind == "method" else spec.separator
            qualified = name if kind == "impl" or not owner else f"{owner}{joint}{name}"
            if kind == "function" and owner:
                kind = "method"
            shown = "private" if private and private.search(line.split("(")[0]) else "public"
            if public:
                shown = "public" if public.search(name if language == "go" else line) or (language in ("typescript", "javascript") and kind == "method" and shown == "public") else "private"
            if language == "ruby" and kind == "method":
                shown = visibility
            row = None
            if kind != "impl":
                row = len(found.symbols)
                found.symbol(name, qualified, kind, shown, owner, n, n, "\n".join(doc), line)
            if groups.get("bases"):
                found.edge(qualified, groups["bases"], "inherits", n)
            if kind in ("class", "module") and language == "ruby":
                visibility = "public"
            if "{" in line or not spec.braces or (spec.braces and n < len(lines) and lines[n].strip().startswith("{")):
                if not (language == "ruby" and (kind == "constant" or re.search(r"\bend\b\s*$|^\s*def\s+\S+.*=\s", line))):
                    open_.append({"kind": kind, "qualified": qualified, "indent": indent, "depth": depth, "row": row, "line": n})
        elif imports and (m := imports.match(line)) and not (parent and mixins):
            found.edge(None, m["name"], "imports", n)
        elif mixins and (m := mixins.match(line)) and parent:
            found.edge(parent["qualified"], m["name"], "includes", n)
        doc = []
        opened = line.find("{", hit[1].end() - 1) if hit and hit[0] in ("function", "method") else -1
        body = line if not hit else line[opened:] if opened >= 0 else ""
        here = next((x["qualified"] for x in reversed(open_) if x["kind"] in ("function", "method")), parent["qualified"] if parent else None)
        bare = _QUOTED.sub("''", body) if body else ""
        for m in _CALL.finditer(bare):
            if m[1].rpartition(".")[2] not in KEYWORDS and m[1] not in KEYWORDS:
                found.edge(here, m[1].replace("->", spec.separator).replace("?.", "."), "calls", n, 1.0 if re.fullmatch(r"\w+[?!]?", m[1]) else 0.7)
        for w in _WORD.findall(bare):
            found.name("mentions", w)
        if language == "ruby":
            for m in re.finditer(r"\b(?:send|public_send|method|respond_to\?)\(?\s*:(\w+)", line):
                found.name("dispatch", m[1])
            if m := re.match(r"^\s*(?:has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:(\w+)", line):
                if parent:
                    found.edge(parent["qualified"], "".join(p.capitalize() for p in re.sub("ies$", "y", m[1]).removesuffix("s").split("_")), "composes", n, 0.9)
        if text.startswith("@") and (m := re.match(r"^\s*@(\w+)", line)):
            after = next((x for x in lines[n : n + 4] if not x.strip().startswith("@")), "")
            if language not in ("go", "ruby") and (name := next((d.match(after)["name"] for _, d in declarations if d.match(after)), None)):
                found.name("decorated" if language in ("typescript", "javascript") else "annotated", name)
        if spec.braces:
            depth += bare.count("{") - bare.count("}") if not hit else line.count("{") - line.count("}")
            close(lambda x: depth <= x["depth"], n)
    close(lambda x: True, len(lines))
    found.name("harvest", "")
    return found


#: O-E3: what templates refer to: kind of name, pattern (fixed values).
TEMPLATE = (
    ("calls", r"data-controller=[\"'](?P<name>[\w -]+)[\"']"), ("calls", r"render\s*\(?\s*(?:partial:\s*)?[\"'](?P<partial>[\w/]+)[\"']"), ("calls", r"turbo_frame_tag\s*\(?\s*[:\"'](?P<frame>[\w-]+)"),
    ("calls", r"turbo_stream_from\s*\(?\s*[:\"'](?P<channel>[\w-]+)"), ("references", r"\bt\(\s*[\"'](?P<i18n>[\w.]+)[\"']"), ("calls", r"\b(?P<route>\w+)_(?:path|url)\b"),
)


def erb(source: str) -> Found:
    """O-E3, O-E18, O-E19: file-level edges of a template, and the calls inside its tags with their lines."""
    found = Found()
    prefix = {"partial": "partial:", "frame": "turbo-frame:", "channel": "turbo-channel:", "i18n": "i18n:", "route": "route:"}
    for n, line in enumerate(source.split("\n"), 1):
        for kind, pattern in TEMPLATE:
            for m in re.finditer(pattern, line):
                for group, value in m.groupdict().items():
                    for name in value.split() if group == "name" else [value]:
                        target = prefix[group] + name if group in prefix else "::".join("".join(p.capitalize() for p in re.split("[-_]", part)) for part in name.split("--")) + "Controller"
                        found.edge(None, target, kind, n, 0.9)
        for tag in re.findall(r"<%[=-]?(.*?)-?%>", line):
            for m in _CALL.finditer(tag):
                if m[1] not in KEYWORDS and m[1] not in ("render", "t", "turbo_frame_tag", "turbo_stream_from"):
                    found.edge(None, m[1], "calls", n, 0.7)
    return found


#: O-S6: extension to language, and language to extractor.
EXTENSIONS = {
    ".py": "python", ".go": "go", ".rb": "ruby", ".rake": "ruby", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".cs": "csharp", ".php": "php", ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".erb": "erb",
}
EXTRACTORS: dict[str, Callable[[str], Found]] = {"python": python, "erb": erb} | {k: (lambda source, k=k: by_lines(source, k)) for k in LANGUAGES}


def language_of(path: str) -> str | None:
    return EXTENSIONS.get("." + path.rpartition(".")[2]) if "." in path.rpartition("/")[2] else None


_ROWS = pa.schema([
    ("file_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("error", pa.string()),
    ("symbols", pa.list_(pa.struct([(c, pa.int32() if c in ("line_start", "line_end") else pa.string()) for c in ("name", "qualified", "kind", "visibility", "parent", "line_start", "line_end", "docstring", "snippet")]))),
    ("edges", pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("confidence", pa.float64())]))),
    ("names", pa.list_(pa.struct([("set", pa.string()), ("name", pa.string())]))),
])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for file_id, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            language, error, found = language_of(path), None, Found()
            if language is None:
                continue
            try:
                found = EXTRACTORS[language](content or "")
            except (SyntaxError, ValueError, RecursionError) as e:
                error = f"{type(e).__name__}: {e}"
            found.symbols.sort(key=lambda s: len(s["qualified"]))
            names = {(n["set"], n["name"]): n for n in found.names}
            rows.append((file_id, path, language, error, found.symbols, found.edges, list(names.values())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)


def extract(files: DataFrame) -> DataFrame:
    """O-S7: one row per file of a known language; a file that can't be read has its error and no rows. files: file_id, path, content."""
    return files.select(F.col("file_id").cast("long"), "path", "content").mapInArrow(_extract, SCHEMA)


def symbols(found: DataFrame) -> DataFrame:
    return found.select("file_id", "path", "language", F.inline("symbols"))


def edges(found: DataFrame) -> DataFrame:
    return found.select("file_id", "path", "language", F.inline("edges"))


def names(found: DataFrame) -> DataFrame:
    """language, set, name."""
    return found.select("language", F.inline("names")).distinct()


def failures(found: DataFrame) -> DataFrame:
    return found.where("error is not null").select(F.lit("parse").alias("kind"), F.concat_ws(": ", "path", "error").alias("message"))


#: One small file per language, for the registered query.
EXAMPLES = [
    (1, "shop/cart.go", "package shop\n\n// Cart holds items.\ntype Cart struct {\n\titems []Item\n}\n\nfunc (c *Cart) Add(i Item) error {\n\treturn check(i)\n}\n\nfunc check(i Item) error {\n\treturn nil\n}\n"),
    (2, "app/models/order.rb", "class Order < ApplicationRecord\n  include Payable\n  has_many :line_items\n\n  def total\n    items.sum(price)\n  end\n\n  private\n\n  def secret\n    1\n  end\nend\n"),
    (3, "src/cart.ts", "export class Cart extends Base {\n  private total(): number {\n    return sum(this.items)\n  }\n}\n\nexport const add = (x: number) => helper(x)\n"),
    (4, "src/lib.rs", "pub struct Cart {\n    n: u32,\n}\n\nimpl Shop for Cart {\n    fn add(&self) {\n        check(1);\n    }\n}\n\nfn check(n: u32) {}\n"),
    (5, "src/Cart.java", "import java.util.List;\n\npublic class Cart extends Base {\n    private int total() {\n        return sum(items);\n    }\n}\n"),
    (6, "src/Cart.kt", "class Cart : Base() {\n    fun total(): Int {\n        return sum(items)\n    }\n}\n"), (7, "src/Cart.scala", "class Cart extends Base {\n  def total(): Int = {\n    sum(items)\n  }\n}\n"),
    (8, "src/Cart.cs", "using System;\n\npublic class Cart : Base {\n    private int Total() {\n        return Sum(items);\n    }\n}\n"), (9, "src/Cart.php", "<?php\nclass Cart extends Base {\n    use Payable;\n    public function total() {\n        return sum($this->items);\n    }\n}\n"),
    (10, "src/cart.c", "#include <stdio.h>\n\nstatic int total(int n) {\n    return sum(n);\n}\n"), (11, "src/cart.cpp", "class Cart : public Base {\npublic:\n    int total() {\n        return sum(1);\n    }\n};\n"),
    (12, "app/views/cart.html.erb", "<div data-controller=\"users--list-item\">\n<%= render 'cart/row' %>\n<%= link_to t('cart.title'), cart_path %>\n</div>\n"),
]
