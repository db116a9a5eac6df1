"""Path predicates and parts as column expressions. The test-path predicates differ on purpose: each belongs to its consumer (O-P9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return _any([c.contains(p) for p in parts])


def starts_any(c: Column, parts: tuple[str, ...]) -> Column:
    return _any([c.startswith(p) for p in parts])


def ends_any(c: Column, parts: tuple[str, ...]) -> Column:
    return _any([c.endswith(p) for p in parts])


#: Fixed values of the search ranking's predicate and of the dead-code analysis.
SEARCH_PARTS = ("_test.", "_spec.", ".test.", ".spec.", "/test/", "/tests/", "/spec/", "/specs/", "/mock/", "/mocks/", "/__tests__/", "/testdata/")
SEARCH_STARTS = ("test/", "spec/")
DEAD_DIR_PARTS, DEAD_DIR_STARTS = ("_test.", "/test/", "/tests/", "/spec/", "/__tests__/"), ("test/", "tests/")
FIXTURE_PARTS, FIXTURE_STARTS = ("/testdata/", "/__testfixtures__/"), ("testdata/", "__testfixtures__/")
TEST_ENDS = (".spec.ts", ".spec.js", ".test.ts", ".test.js")
LIKE_PATTERNS = ("%_test.%", "%/test/%", "%/tests/%", "%/spec/%", "%.test.%", "%.spec.%", "%test_%", "%/__tests__/%")


def search_test(path: Column) -> Column:
    """A test path to the search ranking."""
    return F.when(path == "", False).otherwise(starts_any(path, SEARCH_STARTS) | contains_any(path, SEARCH_PARTS))


def dead_test(path: Column) -> Column:
    """A test or fixture path to the dead-code entry points."""
    in_dir = contains_any(path, DEAD_DIR_PARTS) | starts_any(path, DEAD_DIR_STARTS)
    return in_dir | contains_any(path, FIXTURE_PARTS) | starts_any(path, FIXTURE_STARTS) | ends_any(path, TEST_ENDS)


def dead_sql_test(path: Column) -> Column:
    """The pattern list by which references from tests don't count: case-insensitive, its underscores are wildcards."""
    return _any([path.ilike(p) for p in LIKE_PATTERNS])


def blast_test(path: Column) -> Column:
    """A test path to the impact analysis: a test directory anywhere, or a file named like a test."""
    base = F.element_at(F.split(path, "/"), -1)
    return path.rlike(r"(^|/)(tests?|specs?|__tests__)/") | base.rlike(r"(_test|_spec|\.test|\.spec)\.[A-Za-z]+$") | base.rlike(r"^test_.*\.py$")


def resolver_test(path: Column) -> Column:
    """A test path to name resolution: production code doesn't resolve into it."""
    base = F.element_at(F.split(path, "/"), -1)
    return path.rlike(r"(^|/)(test|tests|spec|__tests__)/") | base.rlike(r"(_test\.go|_spec\.rb|_test\.rb|_test\.py|\.(test|spec)\.[jt]sx?)$") | base.startswith("test_")


def wire_test(path: Column) -> Column:
    """A test path to result shaping: the ranking's predicate, and Java and Kotlin class names."""
    return search_test(path) | ends_any(path, ("Test.java", "Tests.java", "Test.kt"))


def area(path: Column) -> Column:
    """O-P15: the directory, '.' if there is none."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def namespace(path: Column) -> Column:
    """O-P14: the first two directories, or the first, or '.'."""
    dirs = F.split(path, "/")
    return F.when(F.size(dirs) > 2, F.concat_ws("/", F.get(dirs, 0), F.get(dirs, 1))).when(F.size(dirs) == 2, F.get(dirs, 0)).otherwise(".")


def layer(path: Column) -> Column:
    """O-P13: '' below two parts, the first two of four or more, else the parent directory."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n < 2, "").when(n >= 4, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).otherwise(F.get(parts, n - 2))


def file_suffix(path: Column) -> Column:
    """O-P12: the last _part of the base name with its extension, or ''."""
    return F.regexp_extract(path, r"(_[^_/]*\.[^/.]+)$", 1)
