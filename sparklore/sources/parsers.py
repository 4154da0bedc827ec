"""Functions, classes, imports, calls and routes of source files, by a scanner of declarations and braces (Python: its own grammar).

A scanner knows no types and no macros: it blanks comments and strings, then walks over declarations, braces and calls in order, with a
stack of open scopes. Calls outside a function are dropped. A file that cannot be read gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .code import parse_python

FIELDS = ("kind", "name", "qualified_name", "line_start", "line_end", "receiver", "caller", "bases", "is_method", "is_test")
SCHEMA = "kind string, name string, qualified_name string, line_start int, line_end int, receiver string, caller string, bases array<string>, is_method boolean, is_test boolean"
VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
NO_CALLS = frozenset("if for while switch match return catch function fn func class new typeof sizeof await yield in of loop elif else do try foreach isset empty array list echo print unset use case super synchronized".split())
GO_WORDS = frozenset("go defer select".split())

#: Declarations of a language: pattern of a declaration with the groups kind-specific below, and the separator of qualified names.
_NAME = r"[A-Za-z_$][\w$]*"
RULES = {
    "rust": ("::", [("function", rf"\bfn\s+(?P<name>{_NAME})"), ("class", rf"\b(?:struct|enum|trait|union)\s+(?P<name>{_NAME})(?:<[^{{;(]*?>)?(?:\s*:\s*(?P<bases>[^{{;]*))?"), ("scope", rf"\bimpl(?:<[^{{]*?>)?\s+(?:(?P<trait>[\w:]+(?:<[^{{]*?>)?)\s+for\s+)?(?P<name>{_NAME})"), ("import", r"\buse\s+(?P<tree>[^;]+);")]),
    "javascript": (".", [("function", rf"\bfunction\s*\*?\s*(?P<name>{_NAME})\s*(?=\()"), ("class", rf"\b(?:class|interface|enum)\s+(?P<name>{_NAME})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<bases>[\w.$, ]+?))?(?:\s+implements\s+(?P<more>[\w.$, ]+?))?\s*(?=\{{)"), ("function", rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]*?)?=>|{_NAME}\s*=>)"), ("method", rf"(?:^|[;{{}}\n])\s*(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<name>{_NAME})\s*\([^(){{}}]*\)\s*(?::[^{{;]*)?(?=\{{)"), ("import", r"\bimport\s+(?P<what>[^;'\"]*?)\s*(?:from\s*)?(?P<quote>['\"])(?P<module>[^'\"]*)(?P=quote)")]),
    "php": ("::", [("function", rf"\bfunction\s+&?(?P<name>{_NAME})\s*(?=\()"), ("class", rf"\b(?:class|interface|trait|enum)\s+(?P<name>{_NAME})(?:\s+extends\s+(?P<bases>[\w\\, ]+?))?(?:\s+implements\s+(?P<more>[\w\\, ]+?))?\s*(?=\{{)"), ("import", r"(?:^|\n)\s*use\s+(?P<tree>[\w\\{}, ]+);")]),
    "go": (".", [("function", rf"\bfunc\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>{_NAME})\s*(?=[\[(])"), ("class", rf"\btype\s+(?P<name>{_NAME})\s+(?:struct|interface)\s*(?=\{{)"), ("import", r"\bimport\s+(?:\w+\s+)?\"(?P<module>[^\"]+)\""), ("imports", r"\bimport\s*\((?P<block>[^)]*)\)")]),
    "java": (".", [("class", rf"\b(?:class|interface|enum|record)\s+(?P<name>{_NAME})(?:<[^{{]*?>)?(?:\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.<>, ]+?))?(?:\s+implements\s+(?P<more>[\w.<>, ]+?))?\s*(?=\{{)"), ("method", rf"(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^<>]*>\s*)?(?:[\w.<>\[\],?]+\s+)?(?P<name>{_NAME})\s*\([^(){{}};]*\)\s*(?:throws\s+[\w., ]+)?\s*(?=\{{)"), ("import", r"\bimport\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;")]),
}
RULES["typescript"] = RULES["javascript"]
CALL = rf"(?<![\w$])(?P<callee>{_NAME})\s*(?:::<[^<>()]*>)?(?=\()"
RECEIVER = r"((?:\$?[\w$\\]+(?:\([^()]*\))?(?:\??->|\?\.|\.|::))+)$"


def blanked(source: str, language: str) -> tuple[str, str]:
    """The source with comments blanked, and with strings blanked too; both keep every position and line."""
    pattern = r"//[^\n]*|/\*.*?\*/" + (r"|\#(?!\[)[^\n]*" if language == "php" else "")
    strings = r'"(?:\\.|[^"\\])*"' + (r"|`[^`]*`" if language in ("go", "javascript", "typescript") else "") + (r"|'(?:\\.|[^'\\\n])*'" if language not in ("rust", "go", "java") else r"|'(?:\\.[^']*|[^'\\])'")
    spaces = lambda text: re.sub(r"[^\n]", " ", text)
    only, both, at = [], [], 0
    for m in re.finditer(f"(?P<c>{pattern})|(?P<s>{strings})", source, re.S):
        plain = source[at : m.start()]
        only += [plain, spaces(m.group()) if m.group("c") else m.group()]
        both += [plain, spaces(m.group()) if m.group("c") else m.group()[0] + spaces(m.group()[1:-1]) + m.group()[-1]]
        at = m.end()
    return "".join([*only, source[at:]]), "".join([*both, source[at:]])


def use_tree(tree: str, separator: str) -> list[str]:
    """The paths of an import tree with braces: ``a::{b, c::{d}}`` gives a::b and a::c::d."""
    tree = tree.strip()
    start = tree.find("{")
    if start < 0:
        return [tree] if tree else []
    prefix, inner, depth, parts, now = tree[:start], tree[start + 1 : tree.rfind("}")], 0, [], ""
    for c in inner:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [prefix + x for part in [*parts, now] if part.strip() for x in use_tree(part, separator)]


def _names(text: str | None) -> list[str]:
    return [x for x in (re.sub(r"<.*", "", y).strip() for y in re.split(r"[,+]", text or "")) if x]


def _imports(kind: str, m: re.Match, language: str, separator: str) -> Iterator[tuple[str, str]]:
    """(name, module) of an import statement."""
    if kind == "imports":
        yield from ((x.split("/")[-1], x) for x in re.findall(r'"([^"]+)"', m.group("block")))
    elif "tree" in m.re.groupindex and m.group("tree"):
        for path in use_tree(m.group("tree"), separator):
            whole, _, alias = path.partition(" as ")
            yield (alias.strip() or re.split(r"::|\\", whole.strip())[-1]), whole.strip().strip("\\")
    elif language in ("javascript", "typescript"):
        what = re.findall(rf"(?:{_NAME}\s+as\s+|\*\s+as\s+)?({_NAME})", re.sub(r"^type\s+", "", m.group("what")))
        yield from ((x, m.group("module")) for x in what or [m.group("module").split("/")[-1]])
    else:
        yield re.split(r"[./]", m.group("module"))[-1], m.group("module")


def _routes(source: str, language: str, line_of) -> Iterator[tuple]:
    """Rows of routes: express-like calls, and Laravel's Route facade (a resource is one row, a match one for each verb)."""
    route = lambda verb, path, m, handler: ("route", verb, path, line_of(m.start()), line_of(m.start()), handler[0], handler[1], None, False, False)
    if language in ("javascript", "typescript"):
        for m in re.finditer(rf"\b(?:app|router)\.({'|'.join(VERBS)}|all)\(\s*['\"`]([^'\"`]*)['\"`]\s*,\s*(?:[\w.$]+\s*,\s*)*([\w.$]*)", source):
            yield route(m.group(1).upper(), m.group(2), m, (None, m.group(3).split(".")[-1] or None))
    elif language == "php":
        target = r"(?:\[\s*([\w\\]+)::class\s*,\s*'(\w+)'\s*\]|'([\w\\]+)@(\w+)'|([\w\\]+)::class)?"
        for m in re.finditer(rf"\bRoute::({'|'.join(VERBS)}|any|match|resource|apiResource)\(\s*(\[[^\]]*\]\s*,\s*)?['\"]([^'\"]*)['\"]\s*,?\s*{target}", source):
            owner, method = next(((c, f) for c, f in ((m.group(4), m.group(5)), (m.group(6), m.group(7))) if c), (m.group(8), "__invoke" if m.group(8) else None))
            verbs = {"match": [x.upper() for x in re.findall(r"\w+", m.group(2) or "")], "resource": ["RESOURCE"], "apiResource": ["RESOURCE"]}.get(m.group(1), [m.group(1).upper()])
            for verb in verbs:
                yield route(verb, m.group(3), m, (owner and owner.split("\\")[-1], None if verb == "RESOURCE" else method))


def scan_source(source: str, language: str) -> list[tuple]:
    """Rows (FIELDS) of one file of a language in RULES."""
    separator, rules = RULES[language]
    text, bare = blanked(source, language)
    starts = [0, *(m.end() for m in re.finditer("\n", bare))]
    from bisect import bisect_right

    line_of = lambda at: bisect_right(starts, at)
    events: list[tuple[int, int, str, re.Match | tuple | None]] = []
    for order, (kind, pattern) in enumerate(rules):
        events += [(m.start("name") if "name" in m.re.groupindex and m.group("name") else m.start(), order, kind, m) for m in re.finditer(pattern, text if kind in ("import", "imports") else bare)]
    taken = {at for at, _, kind, _ in events if kind in ("function", "class", "method", "scope")}
    barred = NO_CALLS | GO_WORDS if language == "go" else NO_CALLS
    for m in re.finditer(CALL, bare):
        recv = re.search(RECEIVER, bare[max(0, m.start() - 160) : m.start()])
        if m.start() not in taken and (recv or m.group("callee") not in barred) and bare[m.start() - 1 : m.start()] not in ("@", "#"):
            events.append((m.start(), 8, "call", (m.group("callee"), recv.group(1) if recv else "")))
    events += [(m.start(), 9, m.group(), None) for m in re.finditer(r"[{};]", bare)]
    rows: list[list] = []
    scopes: list[tuple[str, str, int | None]] = []  # kind, qualified name, row
    pending: tuple[str, str, int | None] | None = None
    bases: dict[str, list[str]] = {}
    for at, _, kind, m in sorted(events, key=lambda e: e[:2]):
        owner = next((q for k, q, _ in reversed(scopes) if k in ("class", "scope")), "")
        if kind == "{":
            scopes.append(pending or ("block", "", None))
            pending = None
        elif kind == "}":
            if scopes:
                row = scopes.pop()[2]
                if row is not None:
                    rows[row][4] = line_of(at)
        elif kind == ";":
            pending = None if pending and pending[0] == "function" else pending
        elif kind == "call":
            caller = next((q for k, q, _ in reversed(scopes) if k == "function"), None)
            if caller:
                name, whole = m
                recv = re.sub(r"(\?\.|\??->|\.|::)$", "", whole)
                rows.append(["call", name, name, line_of(at), line_of(at), recv or None, caller, None, whole.endswith((".", "->")), False])
        elif kind in ("import", "imports"):
            rows += [["import", name, module, line_of(at), line_of(at), None, None, None, False, False] for name, module in _imports(kind, m, language, separator)]
        elif kind == "scope":
            pending = ("scope", m.group("name"), None)
            if m.group("trait"):
                bases.setdefault(m.group("name"), []).append(re.sub(r"<.*", "", m.group("trait")).split("::")[-1])
        elif kind == "class":
            groups = m.groupdict()
            rows.append(["class", m.group("name"), m.group("name"), line_of(at), line_of(at), None, None, _names(groups.get("bases")) + _names(groups.get("more")), False, False])
            pending = ("class", m.group("name"), len(rows) - 1)
        elif kind == "function" or owner and scopes and scopes[-1][0] == "class" and m.group("name") not in barred:
            name = m.group("name")
            above = m.groupdict().get("owner") or owner
            before = bare[max(0, at - 200) : at]
            test = {"rust": bool(re.search(r"#\[(?:\w+::)*test[^\]]*\][^{};]*$", before)), "go": name.startswith(("Test", "Benchmark")), "java": bool(re.search(r"@Test\b[^{};]*$", before)), "php": name.startswith("test")}.get(language, False)
            rows.append(["function", name, f"{above}{separator}{name}" if above else name, line_of(at), line_of(at), None, None, None, False, test])
            pending = ("function", rows[-1][2], len(rows) - 1)
    for row in rows:
        if row[0] == "class":
            row[7] = [*row[7], *bases.get(row[1], [])]
    if language == "go":
        _embed(rows, bare)
    return [*map(tuple, rows), *_routes(text, language, line_of)]


def _embed(rows: list[list], bare: str) -> None:
    """Embedded types of Go's structs and interfaces as bases: lines that hold one type and nothing else."""
    lines = bare.split("\n")
    for row in rows:
        if row[0] == "class":
            row[7] = [m.group(1).split(".")[-1] for line in lines[row[3] : row[4] - 1] if (m := re.fullmatch(r"\s*\*?([A-Z][\w.]*)\s*", line))]


def python_routes(source: str) -> list[tuple]:
    """Routes of a module's decorators (a verb, Flask's route with its methods, an event) and handlers in dictionaries of functions."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    rows: list[tuple] = []
    row = lambda verb, path, node, handler: ("route", verb, path, node.lineno, node.lineno, None, handler, None, False, False)
    functions = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for mark in node.decorator_list:
                if not (isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute)):
                    continue
                path = mark.args[0].value if mark.args and isinstance(mark.args[0], ast.Constant) else ""
                if mark.func.attr in VERBS:
                    rows.append(row(mark.func.attr.upper(), str(path), node, node.name))
                elif mark.func.attr == "route":
                    methods = next((k.value for k in mark.keywords if k.arg == "methods"), None)
                    verbs = [str(x.value) for x in methods.elts if isinstance(x, ast.Constant)] if isinstance(methods, (ast.List, ast.Tuple)) else ["GET"]
                    rows += [row(v.upper(), str(path), node, node.name) for v in verbs]
                elif mark.func.attr in ("on_event", "on", "event", "listener"):
                    rows.append(row("EVENT", str(path), node, node.name))
        elif isinstance(node, ast.Dict) and node.values and all(isinstance(v, ast.Name) and v.id in functions for v in node.values):
            rows += [("call", v.id, v.id, v.lineno, v.lineno, None, "<dispatch>", None, True, False) for v in node.values]
    return rows


def parse_source(source: str, language: str) -> list[tuple]:
    """Rows (FIELDS) of one file."""
    if language in RULES:
        return scan_source(source, language)
    if language != "python":
        return []
    found = parse_python(source)
    imported = {r[1] for r in found if r[0] == "import"} | {r[5] for r in found if r[0] == "import"}
    rows = []
    for kind, name, qualified, start, end, receiver, caller, _ in found:
        root = re.split(r"[.(\[]", receiver or "")[0]
        method = kind == "call" and bool(receiver) and root not in imported and root not in ("self", "cls", "super")
        rows.append((kind, name, qualified, start, end, receiver if kind == "call" else None, caller, receiver.split(",") if kind == "class" and receiver else [] if kind == "class" else None, method, kind == "function" and name.startswith("test_")))
    return rows + python_routes(source)


def parse_files(files: DataFrame) -> DataFrame:
    """path and FIELDS of every file (path, language, source)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *row) for p, lang, s in zip(frame["path"], frame["language"], frame["source"], strict=True) for row in parse_source(s or "", lang)]
            yield pd.DataFrame(rows, columns=["path", *FIELDS])

    return files.select("path", "language", "source").mapInPandas(run, "path string, " + SCHEMA)
