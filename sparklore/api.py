"""The tools by name: ``call(store, tool, op, ...)`` gives the DataFrame that answers it.

A store holds the tables; a tool checks its arguments and composes operators. Unknown tools, operations and arguments are errors.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import memory as N
from .operators import records as M
from .operators import retrieval as R
from .operators import symbols as S


@dataclass
class Store:
    """The tables of an index (functions with body, classes, calls, files, imports, routes, chunks and their vectors) and of a memory (notes,
    runs, run_files). ``now`` is the time that ages are measured at."""

    functions: DataFrame
    classes: DataFrame
    calls: DataFrame
    files: DataFrame
    imports: DataFrame
    routes: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    notes: DataFrame
    runs: DataFrame
    run_files: DataFrame
    now: str
    dim: int = 64

    def graded(self) -> DataFrame:
        return G.grade_calls(self.calls, self.functions)

    def edges(self) -> DataFrame:
        return G.call_edges(self.graded())

    def searchable(self) -> DataFrame:
        called = self.calls.groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
        most = called.agg(F.max("_n").alias("_most"))
        rows = self.functions.join(called, "name", "left").join(F.broadcast(most))  # one row
        return rows.select("id", "name", F.concat_ws(" ", "name", "qualified_name", "body").alias("text"), (F.coalesce("_n", F.lit(0)) / F.coalesce("_most", F.lit(1))).alias("rank"))


TOOLS: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def tool(name: str, op: str = ""):
    def register(f: Callable[..., DataFrame]):
        TOOLS[name, op] = f
        return f

    return register


def call(store: Store, name: str, op: str = "", /, **arguments) -> DataFrame:
    """The answer of a tool's operation; an argument that it does not take, or lacks, is an error."""
    found = TOOLS.get((name, op))
    if found is None:
        known = sorted(o for n, o in TOOLS if n == name)
        raise ValueError(f"unknown operation {op!r} of {name}: one of {known}" if known else f"unknown tool {name!r}: one of {sorted({n for n, _ in TOOLS})}")
    try:
        inspect.signature(found).bind(store, **arguments)
    except TypeError as wrong:
        raise ValueError(f"{name} {op}: {wrong}") from wrong
    return found(store, **arguments)


def bounded(limit: int, most: int = 500) -> int:
    if not 0 < limit <= most:
        raise ValueError(f"a limit is from 1 to {most}")
    return limit


@tool("search", "lexical")
def search_lexical(store: Store, query: str, limit: int = 10) -> DataFrame:
    return R.search_code(store.searchable(), query, bounded(limit))


@tool("search", "semantic")
def search_semantic(store: Store, query: str, limit: int = 10) -> DataFrame:
    return R.semantic_search(store.chunks, store.vectors, R.bag_vector(query, store.dim), bounded(limit))


@tool("search", "hybrid")
def search_hybrid(store: Store, query: str, limit: int = 10) -> DataFrame:
    """Lexical hits and chunks, each chunk standing for the symbol of its id, fused by rank."""
    over = 4 * bounded(limit)
    lexical = R.ranked(R.search_code(store.searchable(), query, over), F.desc("score"), F.col("id")).select("id", "rank")
    dense = R.ranked(R.knn(store.vectors, R.bag_vector(query, store.dim), over, "id"), F.col("distance"), F.col("id")).select("id", "rank")
    return R.rrf([lexical, dense], "id", limit)


@tool("search", "similar")
def search_similar(store: Store, id: int, limit: int = 10) -> DataFrame:
    return R.similar_code(R.code_signatures(store.functions, "id", "body"), "id", id, bounded(limit))


@tool("symbol", "get")
def symbol_get(store: Store, name: str, hint: str | None = None) -> DataFrame:
    return S.resolve_symbol(store.functions, store.classes, name, hint)


@tool("symbol", "definitions")
def symbol_definitions(store: Store, name: str, limit: int = 50) -> DataFrame:
    return S.definitions(store.functions, store.classes, store.files, name, bounded(limit))


@tool("symbol", "references")
def symbol_references(store: Store, name: str) -> DataFrame:
    return S.references(store.functions, store.classes, store.graded(), store.imports, name)


@tool("symbol", "implementations")
def symbol_implementations(store: Store, name: str) -> DataFrame:
    return S.implementations(store.classes, name)


@tool("symbol", "brief")
def symbol_brief(store: Store, name: str) -> DataFrame:
    return S.symbol_brief(store.functions, store.classes, store.graded(), name)


@tool("graph", "callers")
def graph_callers(store: Store, name: str, certainty: str = "ambiguous", limit: int = 200) -> DataFrame:
    """Calls of a name, those of at least a certainty before the limit."""
    sure = {"ambiguous": 0.0, "inferred": 0.5, "exact": 0.85}
    if certainty not in sure:
        raise ValueError(f"certainty is one of {list(sure)}")
    return S.callers(store.graded().filter(F.col("confidence") >= sure[certainty]), store.functions, name, bounded(limit))


@tool("graph", "callees")
def graph_callees(store: Store, name: str, limit: int = 200) -> DataFrame:
    return S.callees(store.calls, store.functions, name, bounded(limit))


@tool("graph", "chain")
def graph_chain(store: Store, start: str, goal: str, depth: int = 12, least: float = 0.0) -> DataFrame:
    return S.chain_hops(store.edges(), start, goal, bounded(depth, 50), least)


@tool("graph", "tests")
def graph_tests(store: Store, name: str, depth: int = 10) -> DataFrame:
    return S.tests_reaching(store.graded(), store.functions, store.functions.sparkSession.createDataFrame([(name,)], "node string"), depth)


@tool("graph", "tests_of_file")
def graph_tests_of_file(store: Store, path: str, depth: int = 10) -> DataFrame:
    return S.tests_covering_file(store.graded(), store.functions, path, depth)


def _imported(store: Store, path: str, depth: int, reverse: bool) -> DataFrame:
    ends = ("file", "path") if reverse else ("path", "file")
    e = S.import_targets(store.imports, store.files).select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"))
    return G.walk(e, e.sparkSession.createDataFrame([(path,)], "node string"), bounded(depth, 50)).filter("depth > 0").select(F.col("node").alias("path"), "depth")


@tool("graph", "dependencies")
def graph_dependencies(store: Store, path: str, depth: int = 2) -> DataFrame:
    return _imported(store, path, depth, False)


@tool("graph", "impact")
def graph_impact(store: Store, path: str, depth: int = 2) -> DataFrame:
    return _imported(store, path, depth, True)


@tool("map", "overview")
def map_overview(store: Store) -> DataFrame:
    """Languages, modules and entry points with their counts."""
    count = lambda section, key: store.files.groupBy(F.col(key).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "item", "n")
    entries = S.entry_points(store.functions, store.routes).select(F.lit("entry").alias("section"), F.col("name").alias("item"), F.lit(1).cast("long").alias("n"))
    return G.union_all([count("language", "language"), count("module", "module"), entries])


@tool("map", "hotspots")
def map_hotspots(store: Store, limit: int = 20) -> DataFrame:
    known = store.functions.select(F.col("name").alias("callee")).distinct()
    return R.top(store.calls.join(known, "callee", "left_semi").groupBy("callee").agg(F.count(F.lit(1)).alias("n")), bounded(limit), F.desc("n"), F.col("callee"))


@tool("file", "outline")
def file_outline(store: Store, path: str) -> DataFrame:
    return S.symbols(store.functions, store.classes).filter(F.col("path") == path).orderBy("line_start")


@tool("file", "list")
def file_list(store: Store, pattern: str = "", language: str | None = None, limit: int = 50) -> DataFrame:
    found = store.files.filter(F.contains(F.lower("path"), F.lit(pattern.lower())))
    return (found if language is None else found.filter(F.col("language") == language)).orderBy("path").limit(bounded(limit))


@tool("grep")
def grep(store: Store, pattern: str, language: str | None = None, limit: int = 100) -> DataFrame:
    return S.grep(store.functions, store.classes, pattern, language, bounded(limit))


@tool("audit", "dead_code")
def audit_dead_code(store: Store) -> DataFrame:
    return S.dead_code(store.functions, store.classes, store.calls, store.routes, store.functions.select("name", "body"))


@tool("audit", "unreachable")
def audit_unreachable(store: Store) -> DataFrame:
    return S.unreachable(store.functions, store.classes, store.edges(), store.routes)


@tool("verify", "recent")
def verify_recent(store: Store, project: str, limit: int = 20) -> DataFrame:
    return R.top(store.runs.filter(F.col("project") == project), bounded(limit), F.desc("ran_at"), F.desc("id"))


@tool("verify", "last_green")
def verify_last_green(store: Store) -> DataFrame:
    return M.last_green(store.runs.join(store.run_files.select(F.col("run_id").alias("id")), "id", "left_anti"), ["project"])


@tool("check_exists")
def check_exists(store: Store, query: str) -> DataFrame:
    named = store.functions.select("name", "qualified_name", "path").unionByName(store.classes.select("name", "qualified_name", "path"))
    return R.check_exists(named, store.routes, store.functions.select("path", "body"), query)


@tool("recall")
def recall(store: Store, project: str, query: str, limit: int = 5) -> DataFrame:
    """Code and memory on a question, side by side: (section, item, score)."""
    code = search_lexical(store, query, limit).select(F.lit("code").alias("section"), F.col("name").alias("item"), "score")
    return code.unionByName(N.search(store.notes, None, R.search_terms(query), None, limit, store.now, project).select(F.lit("memory").alias("section"), F.col("id").alias("item"), "score"))


@tool("memory", "search")
def memory_search(store: Store, project: str, query: str, limit: int = 10, category: str | None = None) -> DataFrame:
    return N.search(store.notes, None, R.search_terms(query), None, bounded(limit), store.now, project, category)


@tool("memory", "list")
def memory_list(store: Store, project: str, category: str | None = None, limit: int = 50) -> DataFrame:
    return N.listed(store.notes, project, category, bounded(limit))


@tool("memory", "get")
def memory_get(store: Store, id: str) -> DataFrame:
    return store.notes.filter(F.col("id") == id)


@tool("memory", "resolve")
def memory_resolve(store: Store, project: str, ids: list[str], reason: str = "") -> DataFrame:
    """The notes after the project's own of ``ids`` are resolved; a record of another project is an error."""
    N.check_arguments(reason=reason)
    asked = store.notes.sparkSession.createDataFrame([(i, project) for i in ids], "id string, project string")
    bad = N.guarded(store.notes, asked).filter("outcome <> 'ok'").collect()  # as many as were asked for
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['outcome']}" for r in bad))
    return N.resolved(store.notes, asked)


@tool("memory", "curate")
def memory_curate(store: Store, similarity: float = 0.8, stale_days: int = 90) -> DataFrame:
    return N.curate(store.notes, store.now, min(1.0, max(0.3, similarity)), max(1, stale_days))


@tool("session", "start")
def session_start(store: Store, project: str, limit: int = 8) -> DataFrame:
    return N.session_start(store.notes, project, bounded(limit))


@tool("session", "end")
def session_end(store: Store, project: str, completed: list[str]) -> DataFrame:
    return N.session_end(store.notes, project, [R.search_terms(x) for x in completed], store.now)


@tool("developer", "rules")
def developer_rules(store: Store, project: str) -> DataFrame:
    return N.standing_rules(store.notes, [N.PROFILE, project])
