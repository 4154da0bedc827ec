"""Paths and names: segments, test conventions, search scopes, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that hold tests.
TEST_FOLDERS = ("tests", "test", "__tests__", "spec", "specs", "testing")


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^:.]*)$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The folder of a path; a path without one is its own."""
    return F.regexp_replace(path, "/[^/]*$", "")


def module_key(path: Column, segments: int = 3) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, segments), "/")


def under(path: Column, folder: str) -> Column:
    """Whether a path lies in a folder, as a range that a scan can skip by: '0' follows '/'."""
    return (path >= f"{folder}/") & (path < f"{folder}0")


def is_test_path(path: Column) -> Column:
    p = F.lower(F.translate(path, "\\", "/"))
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, TEST_FOLDERS))) | p.rlike(r"(^|/)test_[^/]*$|_test\.(rs|go|py)$|_tests\.rs$|\.(test|spec)\.[^/]*$")


def glob_pattern(glob: str) -> str:
    """A glob with ``**``, ``*``, ``?`` and ``{a,b}`` as a regular expression; one without a slash matches at any depth."""
    out, depth, k = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if glob[k : k + 3] == "**/":
            out.append("(?:.*/)?")
            k += 2
        elif glob[k : k + 2] == "**":
            out.append(".*")
            k += 1
        elif c in "*?":
            out.append("[^/]*" if c == "*" else "[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        else:
            out.append("|" if c == "," and depth else re.escape(c))
        k += 1
    body = "".join(out) + ")" * depth
    return f"^{body}$" if "/" in glob else f"(?:^|/){body}$"


def in_scope(path: Column, targets: list[str] = (), globs: list[str] = (), extensions: list[str] = ()) -> Column:
    """Whether a search admits a path: below one of the targets, in one of the globs (``!`` excludes), of one of the types."""
    admitted = F.lit(True)
    if targets:
        below = [(path == x.rstrip("/")) | path.startswith(x.rstrip("/") + "/") for x in targets]
        admitted = admitted & F.exists(F.array(*below), lambda x: x)
    wanted, barred = [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")]
    if wanted:
        admitted = admitted & F.exists(F.array(*[path.rlike(glob_pattern(g)) for g in wanted]), lambda x: x)
    for g in barred:
        admitted = admitted & ~path.rlike(glob_pattern(g))
    if extensions:
        admitted = admitted & F.regexp_extract(path, r"\.([^./]*)$", 1).isin(*extensions)
    return admitted


def looks_project_specific(text: Column) -> Column:
    """Whether a text holds an absolute path of a home, system or drive."""
    return text.rlike(r"(^|[\s\"'(])(/home/|/Users/|/var/|/etc/|/opt/|[A-Za-z]:\\)")


def hint_label(confidence: Column) -> Column:
    """The label of a hint, whose middle bucket starts higher than that of an edge."""
    return F.when(confidence >= 0.85, "exact").when(confidence >= 0.55, "inferred").otherwise("ambiguous")
