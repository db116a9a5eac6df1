"""Sources around the code: trees, ignore rules, generated files, manifests, history (O-S1 to O-S6, O-S18 to O-S22)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifest, pattern, framework.
FRAMEWORKS = (
    ("Gemfile", r"gem ['\"]rails['\"]", "Rails"), ("Gemfile", r"gem ['\"]sinatra['\"]", "Sinatra"), ("Gemfile", r"gem ['\"]hanami['\"]", "Hanami"),
    ("go.mod", r"github\.com/gin-gonic/gin", "Gin"), ("go.mod", r"github\.com/labstack/echo", "Echo"), ("go.mod", r"github\.com/gofiber/fiber", "Fiber"),
    ("package.json", r"\"react\"\s*:", "React"), ("package.json", r"\"next\"\s*:", "Next.js"), ("package.json", r"\"vue\"\s*:", "Vue"), ("package.json", r"\"express\"\s*:", "Express"),
    ("requirements.txt", r"(?im)^django\b", "Django"), ("requirements.txt", r"(?im)^flask\b", "Flask"), ("requirements.txt", r"(?im)^fastapi\b", "FastAPI"),
    ("pyproject.toml", r"(?i)['\"]django\b", "Django"), ("pyproject.toml", r"(?i)['\"]flask\b", "Flask"), ("pyproject.toml", r"(?i)['\"]fastapi\b", "FastAPI"),
)


def tree(spark: SparkSession, root: str, rules: list[str] | None = None, max_kb: int = 512) -> DataFrame:
    """O-S1 to O-S5: path (relative), content, length, modified of source files: no dot folders, nothing ignored, too long or generated."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    df = found.select(F.regexp_replace("path", f"^(?:file:)?/*{base.lstrip('/')}/", "").alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    df = listed(df, rules, max_kb).withColumn("content", F.decode("content", "UTF-8"))
    return df.where(~generated(F.col("content")))


def listed(files: DataFrame, rules: list[str] | None, max_kb: int) -> DataFrame:
    """O-S1 to O-S3: files (path, length) that are in no dot folder, not too long, and not ignored."""
    df = files.where((F.col("length") <= max_kb * 1024) & ~F.col("path").rlike(r"(^|/)\.[^/]"))
    return df.where(~ignored(F.col("path"), rules)) if rules else df


def kept(files: DataFrame, rules: list[str] | None, max_kb: int) -> DataFrame:
    """O-S1 to O-S4 over a listing whose content is there: path, length, content."""
    return listed(files, rules, max_kb).where(~generated(F.col("content")))


def pattern_of(rule: str) -> tuple[str, bool]:
    """O-S2: the expression of one ignore rule, and whether it takes paths back. '' for blanks and comments."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return "", False
    back = rule.startswith("!")
    body = rule[1:] if back else rule
    folder, body = body.endswith("/"), body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if body.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), back


def ignored(path: Column, rules: list[str]) -> Column:
    """O-S2: the last rule that matches decides."""
    out = F.lit(False)
    for rule in rules:
        pattern, back = pattern_of(rule)
        if pattern:
            out = F.when(path.rlike(pattern), not back).otherwise(out)
    return out


def generated(content: Column) -> Column:
    """O-S4: a 'Code generated … DO NOT EDIT.' line before the first line of code; comments, blanks and a byte-order mark may precede it."""
    head = r"(?s)^\x{FEFF}?(?:[ \t]*(?://[^\n]*)?\r?\n|[ \t]*/\*(?:[^*]|\*(?!/))*+\*/[ \t]*\r?\n?)*?// Code generated [^\n]*DO NOT EDIT\.[ \t]*\r?(?:\n|$)"
    return content.rlike(head)


def frameworks(files: DataFrame) -> DataFrame:
    """O-S18: distinct names by the manifests at the root. files: path, content."""
    rules = files.sparkSession.createDataFrame(list(FRAMEWORKS), "path string, pattern string, name string")
    return files.join(F.broadcast(rules), "path").where(F.regexp_like("content", "pattern")).select("name").distinct()  # the fixed rules


def go_modules(files: DataFrame) -> DataFrame:
    """O-S19: module path and directory of every go.mod."""
    mods = files.where(F.col("path").rlike(r"(^|/)go\.mod$"))
    folder = F.regexp_extract("path", r"^(.*)/go\.mod$", 1)
    return mods.select(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module"), F.when(folder == "", ".").otherwise(folder).alias("dir")).where("module <> ''")


def commits(log: DataFrame) -> DataFrame:
    """O-S20: commit_id, path of logs as `git log --name-only --no-merges --format=%x01%H` prints them. log: log (text)."""
    entries = log.select(F.explode(F.split("log", "\x01")).alias("e")).where("trim(e) <> ''")
    lines = entries.select(F.split("e", "\n").alias("l"))
    return lines.select(F.get("l", 0).alias("commit_id"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1)))).alias("path")).where("trim(path) <> ''")


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """O-S21: path, start, end of the new side of `git diff -U0` hunks; a hunk of no lines is its line and the next. diffs: diff (text)."""
    parts = diffs.select(F.explode(F.split("diff", r"(?m)^diff --git ")).alias("d"))
    named = parts.select(F.regexp_extract("d", r"(?m)^\+\+\+ b/(.*)$", 1).alias("path"), F.explode(F.regexp_extract_all("d", F.lit(r"(?m)^(@@ -[0-9,]+ \+[0-9,]+ @@)"), F.lit(1))).alias("h")).where("path <> ''")
    start = F.regexp_extract("h", r"\+([0-9]+)", 1).cast("int")
    given = F.regexp_extract("h", r"\+[0-9]+,([0-9]+)", 1)
    count = F.when(given == "", 1).otherwise(given.cast("int"))
    return named.select("path", start.alias("start"), F.when(count == 0, start + 1).otherwise(start + count - 1).alias("end"))
