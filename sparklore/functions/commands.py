"""Search commands of a shell: which symbols a grep looks for, and where."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Flags of grep, rg and git grep that take a value, and what a value means here.
VALUED = {"-e": "pattern", "--regexp": "pattern", "-g": "glob", "--glob": "glob", "--include": "glob", "--exclude": "barred", "-t": "type", "--type": "type", "-A": "", "-B": "", "-C": "", "-m": "", "--max-count": "", "--context": "", "-f": "file", "--file": "file", "--color": "", "-d": ""}
#: Characters after which a command line cannot be followed by reading it.
OPAQUE = re.compile(r"[`]|\$\(|<\(|<<")
MOST_BRANCHES = 6
SCHEMA = "command string, folder string, symbols array<string>, targets array<string>, globs array<string>, types array<string>"


def segments(command: str) -> list[tuple[str, bool]]:
    """Parts of a command line and whether each begins a pipeline; quotes are kept whole."""
    out, now, quote, first = [], "", "", True
    k = 0
    while k < len(command):
        c = command[k]
        if quote:
            quote = "" if c == quote else quote
            now += c
        elif c in "'\"":
            quote = c
            now += c
        elif command[k : k + 2] in ("&&", "||"):
            out.append((now, first))
            now, first, k = "", True, k + 1
        elif c in ";\n|":
            out.append((now, first))
            now, first = "", c != "|"
        else:
            now += c
        k += 1
    return [*out, (now, first)]


def pattern_symbols(pattern: str, fixed: bool) -> list[str]:
    """The plain names that a pattern looks for: itself, without word marks and a call's bracket, or all of up to six branches."""
    branches = [pattern] if fixed else re.split(r"\\\||\|", re.sub(r"^\(\??:?(.*)\)$", r"\1", pattern))
    if len(branches) > MOST_BRANCHES:
        return []
    found = []
    for branch in branches:
        plain = branch if fixed else re.sub(r"\\b|\\<|\\>|^\^|\$$", "", branch)
        plain = re.sub(r"^(?:fn|def|func|function|class|struct|enum|trait|interface)(?:\\s\+|\s+)", "", plain)
        plain = re.sub(r"\\?\(.*$", "", plain)
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{2,}", plain):
            return []
        found.append(plain)
    return list(dict.fromkeys(found))


def search_of(command: str) -> tuple[str, list[str], list[str], list[str], list[str]] | None:
    """(folder, symbols, targets, globs, types) of the first search in a command line; null for none, or where it cannot be told."""
    folder = ""
    for text, first in segments(command):
        if not first or OPAQUE.search(text):
            continue
        try:
            words = shlex.split(text)
        except ValueError:
            continue
        while words and re.fullmatch(r"[A-Za-z_]\w*=.*|sudo|env|time|command", words[0]):
            words.pop(0)
        if len(words) == 2 and words[0] == "cd":
            folder = words[1] if words[1].startswith("/") else "/".join(x for x in (folder, words[1]) if x)
            continue
        if words[:2] == ["git", "grep"]:
            words = words[1:]
        if not words or words[0].split("/")[-1] not in ("grep", "egrep", "fgrep", "rg"):
            continue
        fixed, patterns, rest, globs, types = words[0].endswith("fgrep"), [], [], [], []
        args = iter(words[1:])
        plain = False
        for word in args:
            name, eq, value = word.partition("=")
            if plain or not word.startswith("-") or word == "-":
                rest.append(word)
            elif word == "--":
                plain = True
            elif name in VALUED or word[:2] in VALUED and not word.startswith("--"):
                key = name if name in VALUED else word[:2]
                value = value if eq and key == name else word[2:] if key != name else next(args, "")
                kind = VALUED[key]
                if kind == "file":
                    return None
                {"pattern": patterns, "glob": globs, "type": types}.get(kind, []).append(value)
                globs += [f"!{value}"] if kind == "barred" else []
            elif word in ("-F", "--fixed-strings") or re.fullmatch(r"-[A-Za-z]*F[A-Za-z]*", word):
                fixed = True
        if not patterns and rest:
            patterns.append(rest.pop(0))
        if len(patterns) != 1:
            return None
        symbols = pattern_symbols(patterns[0], fixed)
        return (folder, symbols, [x for x in rest if not x.startswith(">")], globs, types) if symbols else None
    return None


def searches(commands: DataFrame) -> DataFrame:
    """SCHEMA of every command (column command) that searches for symbols."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(c, *found) for c in frame["command"] if (found := search_of(c or ""))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return commands.select("command").mapInPandas(run, SCHEMA)
