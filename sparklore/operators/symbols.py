"""Symbol lookups, call edges and their resolution, references, reachability: DataFrames in, DataFrames out.

Functions have id, name, qualified_name, path, module, language, line_start, line_end, is_test (and body where it is read); classes
the same without is_test, and bases (JSON array of names); calls caller, callee, guess, is_method, path, line; imports path,
module, target, name, line; routes method, route, handler_method, handler_class, path, line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import cut, walk

#: Methods that the standard library's traits dispatch.
DISPATCHED = (
    "fmt", "clone", "default", "from", "into", "try_from", "try_into", "drop", "eq", "ne", "hash", "cmp", "partial_cmp", "next", "deref",
    "deref_mut", "as_ref", "as_mut", "borrow", "borrow_mut", "to_string", "serialize", "deserialize", "add", "sub", "mul", "div", "rem",
    "neg", "not", "index", "index_mut", "poll", "call", "into_iter", "from_str", "source", "description", "deserialize_with", "visit_str",
    "visit_map", "visit_seq",
)
#: Receivers that are globals of a runtime, and receivers that mean the object itself.
BUILTIN_RECEIVERS = (
    "Math", "Object", "JSON", "Array", "Promise", "console", "String", "Number", "Boolean", "Date", "Reflect", "process", "window",
    "document", "globalThis", "Symbol", "Map", "Set", "WeakMap", "Buffer", "Intl", "navigator", "localStorage", "sessionStorage", "Error",
    "RegExp", "URL", "crypto", "performance", "std", "core", "alloc", "os", "sys", "re", "json", "math", "fmt", "strings", "errors", "time",
    "http", "io", "bytes", "sort", "strconv",
)
SELF_RECEIVERS = ("self", "this", "$this", "cls", "static", "parent", "Self", "super")
#: Rank of a certainty, least certain first.
CERTAINTY = {"ambiguous": 0, "inferred": 1, "exact": 2}
HIT = ("kind", "id", "name", "qualified_name", "path", "line_start", "line_end")


def symbols(functions: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """Functions and classes under one roof: HIT and columns both have."""
    pick = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*HIT, *more)
    return pick(functions, "function").unionByName(pick(classes, "class"))


def lookup(rows: DataFrame, name: str, language: str | None = None, path: str | None = None) -> DataFrame:
    """The first definition of a name by id, in a language or a file where that is asked for."""
    found = rows.filter(F.col("name") == name)
    found = found if language is None else found.filter(F.col("language") == language)
    found = found if path is None else found.filter(F.col("path") == path)
    return found.orderBy("id").limit(1)


def resolve_symbol(functions: DataFrame, classes: DataFrame, name: str, hint: str | None = None) -> DataFrame:
    """The definition of a name: a function of the hinted file, a class there, any function, any class, in this order."""
    hinted = F.coalesce(F.col("path") == F.lit(hint), F.lit(False))
    rank = F.when(hinted, 0).otherwise(2) + F.when(F.col("kind") == "class", 1).otherwise(0)
    return symbols(functions, classes).filter(F.col("name") == name).withColumn("_rank", rank).orderBy("_rank", "id").limit(1).drop("_rank")


def definitions(functions: DataFrame, classes: DataFrame, files: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """Definitions by name or qualified name in known files; each (path, line, qualified name) once, by path and line."""
    found = symbols(functions, classes).filter((F.col("name") == symbol) | (F.col("qualified_name") == symbol))
    return found.join(files.select("path"), "path", "left_semi").dropDuplicates(["path", "line_start", "qualified_name"]).orderBy("path", "line_start", "qualified_name").limit(limit)


def implementations(classes: DataFrame, name: str) -> DataFrame:
    return classes.filter(F.array_contains(F.from_json("bases", "array<string>"), name))


def grep(functions: DataFrame, classes: DataFrame, pattern: str, language: str | None = None, limit: int = 100) -> DataFrame:
    """Lines of stored bodies that match, functions before classes; a line counts from where its symbol starts."""
    re.compile(pattern)
    both = symbols(functions, classes, "language", "body")
    both = both if language is None else both.filter(F.col("language") == language)
    lines = both.filter(F.col("body").rlike(f"(?m){pattern}")).select("kind", "path", "line_start", "id", F.posexplode(F.split("body", "\n")).alias("_pos", "text"))
    hits = lines.filter(F.col("text").rlike(pattern)).select((F.col("kind") == "class").alias("_order"), "kind", "path", (F.col("line_start") + F.col("_pos")).cast("long").alias("line"), "text", "line_start", "id")
    return hits.orderBy("_order", "path", "line_start", "id", "line").limit(limit).select("kind", "path", "line", "text")


def read_window(contents: DataFrame, key: str, start: int, end: int, most_lines: int = 5000, most_bytes: int = 500_000) -> DataFrame:
    """Lines ``start`` to ``end`` (from 1, inclusive) of each text with their number, at most so many lines and bytes, and whether that
    cut some off. ``contents`` has ``key`` and text."""
    last = min(end, start + most_lines - 1)
    lines = contents.select(key, F.posexplode(F.slice(F.split("text", "\n"), start, max(0, last - start + 1))).alias("_pos", "text"), F.size(F.split("text", "\n")).alias("_n"))
    sized = lines.withColumn("_bytes", F.sum(F.octet_length("text") + 1).over(Window.partitionBy(key).orderBy("_pos")))
    kept = sized.filter(F.col("_bytes") <= most_bytes)
    reach = F.max(F.col("_pos") + start).over(Window.partitionBy(key))
    return kept.select(key, (F.col("_pos") + start).alias("line"), "text", (reach < F.least(F.col("_n"), F.lit(end))).alias("truncated"))


def contained(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(function id, class id): functions whose lines lie inside a class of the same file."""
    c = classes.select("path", F.col("id").alias("class_id"), F.col("name").alias("class_name"), F.col("body").alias("class_body"), F.col("line_start").alias("_from"), F.col("line_end").alias("_to"))
    return functions.join(c, "path").filter((F.col("line_start") >= F.col("_from")) & (F.col("line_end") <= F.col("_to"))).drop("_from", "_to")


def free_names(functions: DataFrame) -> DataFrame:
    """Names that only unqualified definitions have: a method call cannot reach them."""
    return functions.groupBy("name").agg(F.max(F.contains("qualified_name", F.lit(":")).cast("int")).alias("_q")).filter("_q = 0").select("name")


def sound_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``calls`` without method calls of names that are free functions only."""
    free = free_names(functions).select(F.col("name").alias("callee"), F.lit(True).alias("_free"))
    return calls.join(free, "callee", "left").filter("not (is_method and coalesce(_free, false))").drop("_free")


def callers(graded: DataFrame, functions: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """Calls of a name, by path and line: a qualified name by its resolved or bare callee, a free function by plain calls only."""
    found = graded.filter((F.col("callee") == name) | (F.col("resolved_callee") == name))
    if "::" not in name and "." not in name:
        found = sound_calls(found, functions)
    return found.orderBy("path", "line", "caller", "callee").limit(limit)


def callees(calls: DataFrame, functions: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """Calls made by a name or by what it is qualified as."""
    owners = functions.filter(F.col("name") == name).select(F.col("qualified_name").alias("caller")).union(functions.sparkSession.createDataFrame([(name,)], "caller string")).distinct()
    return calls.join(owners, "caller", "left_semi").orderBy("path", "line", "callee").limit(limit)


def chain_hops(edges: DataFrame, start: str, goal: str, depth: int, least: float = 0.0) -> DataFrame:
    """(step, name, confidence) of a shortest path over edges (src, dst, confidence) of at least ``least``; the confidence is that of the
    edge that leads to the step. Levels come from one walk; the path is joined back level by level."""
    kept = cut(edges.filter(F.col("confidence") >= least).select("src", "dst", "confidence"))
    spark = edges.sparkSession
    levels = cut(walk(kept, spark.createDataFrame([(start,)], "node string"), depth))
    step = levels.filter(F.col("node") == goal)
    path = step
    for _ in range(depth):
        step = cut(levels.join(step.select(F.col("pred").alias("node")).filter("node is not null"), "node", "left_semi"))
        if step.isEmpty():
            break
        path = path.unionByName(step)
    best = kept.groupBy(F.col("src").alias("pred"), F.col("dst").alias("node")).agg(F.max("confidence").alias("confidence"))
    return path.join(best, ["pred", "node"], "left").select(F.col("depth").alias("step"), F.col("node").alias("name"), "confidence")


def tests_reaching(graded: DataFrame, functions: DataFrame, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """(test, qualified_name, path, depth): tests from which a seed (column ``node``) is reached backwards over sound calls.

    A call leads to its resolved callee, or the bare one; the walk ends at a test and goes on through everything else.
    """
    edges = cut(sound_calls(graded, functions).select(F.coalesce("resolved_callee", "callee").alias("node"), F.col("caller").alias("next")).distinct())
    tests = functions.filter("is_test").groupBy("qualified_name").agg(F.max_by("name", "id").alias("test"), F.max_by("path", "id").alias("path"))
    tests = cut(tests)
    frontier = cut(seeds.select("node").distinct())
    seen, found = frontier, None
    for d in range(1, min(max(depth, 1), 10) + 1):
        reached = cut(frontier.join(edges, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"))
        if reached.isEmpty():
            break
        hits = tests.join(reached.withColumnRenamed("node", "qualified_name"), "qualified_name", "left_semi").withColumn("depth", F.lit(d))
        found = hits if found is None else found.unionByName(hits)
        frontier = reached.join(tests.select(F.col("qualified_name").alias("node")), "node", "left_anti")
        seen = seen.unionByName(reached) if d % 4 else cut(seen.unionByName(reached))
    columns = ["test", "qualified_name", "path", "depth"]
    return (tests.limit(0).withColumn("depth", F.lit(0)) if found is None else found).select(*columns)


def tests_covering_file(graded: DataFrame, functions: DataFrame, path: str, depth: int = 10) -> DataFrame:
    """Tests of a file: its own at depth 0, and those that reach one of its names that no other file defines."""
    named = functions.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("node"), "path").distinct()
    alone = named.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.first("path").alias("_path")).filter((F.col("_n") == 1) & (F.col("_path") == path)).select("node")
    own = functions.filter("is_test").filter(F.col("path") == path).select(F.col("name").alias("test"), "qualified_name", "path", F.lit(0).alias("depth"))
    far = tests_reaching(graded, functions, alone, depth)
    return own.unionByName(far).groupBy("qualified_name").agg(F.min_by("test", "depth").alias("test"), F.min_by("path", "depth").alias("path"), F.min("depth").alias("depth"))


def entry_points(functions: DataFrame, routes: DataFrame) -> DataFrame:
    """Names that start a program: main where it is defined, and what routes hand over to."""
    return functions.filter("name = 'main'").select("name").union(routes.filter("handler_method is not null").select("handler_method")).distinct()


def dispatched(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Names that are called by dispatch: standard trait methods, and functions inside a trait or an interface."""
    inside = contained(functions, classes).filter(F.contains("class_body", F.lit("trait ")) | F.contains("class_body", F.lit("interface "))).select("name")
    return inside.union(functions.sparkSession.createDataFrame([(x,) for x in DISPATCHED], "name string")).distinct()


def mentioned(bodies: DataFrame) -> DataFrame:
    """Names that another symbol's text holds as a whole identifier. ``bodies`` has name and body."""
    words = bodies.select("name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("_word"))
    known = bodies.select(F.col("name").alias("_word")).distinct()
    return words.join(known, "_word", "left_semi").filter("name <> _word").select(F.col("_word").alias("name")).distinct()


def dead_code(functions: DataFrame, classes: DataFrame, calls: DataFrame, routes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Functions that are no test, no entry point, not dispatched, and whose name no call and no other symbol's text holds."""
    out = functions.filter("not is_test")
    for known in (calls.select(F.col("callee").alias("name")), entry_points(functions, routes), dispatched(functions, classes), mentioned(bodies)):
        out = out.join(known.distinct(), "name", "left_anti")
    return out


def unreachable(functions: DataFrame, classes: DataFrame, edges: DataFrame, routes: DataFrame) -> DataFrame:
    """Functions that no walk over bare-name edges (src, dst) from an entry point reaches; tests and dispatched names are left out."""
    reached = walk(edges, entry_points(functions, routes).withColumnRenamed("name", "node"))
    out = functions.filter("not is_test")
    for known in (reached.select(F.col("node").alias("name")), dispatched(functions, classes)):
        out = out.join(known.distinct(), "name", "left_anti")
    return out


def references(functions: DataFrame, classes: DataFrame, graded: DataFrame, imports: DataFrame, symbol: str) -> DataFrame:
    """(kind, path, line, context): definitions, then calls, imports and mentions of a symbol. A mention is a line of another place's text
    with the whole identifier, on a (path, line) that no stronger kind has claimed."""
    bare = re.split(r"[:.]", symbol)[-1]
    row = lambda kind, context: (F.lit(kind).alias("kind"), "path", F.col("line").cast("long").alias("line"), context.alias("context"))
    everything = symbols(functions, classes, "body").withColumnRenamed("line_start", "line")
    defined = everything.filter((F.col("name") == symbol) | (F.col("qualified_name") == symbol)).select(*row("definition", F.lit("")))
    called = graded.filter((F.col("callee") == symbol) | (F.col("resolved_callee") == symbol))
    if not free_names(functions).filter(F.col("name") == bare).isEmpty():
        called = called.filter("not is_method")
    imported = imports.filter(F.col("name") == bare)
    claimed = cut(defined.unionByName(called.select(*row("call", F.col("caller")))).unionByName(imported.select(*row("import", F.col("target")))))
    lines = everything.filter(F.contains("body", F.lit(bare))).select("path", "line", "qualified_name", F.posexplode(F.split("body", "\n")).alias("_pos", "_text"))
    hits = lines.filter(T.contains_identifier(F.col("_text"), bare)).withColumn("line", F.col("line") + F.col("_pos")).select(*row("mention", F.col("qualified_name")))
    return claimed.unionByName(hits.join(claimed.select("path", "line").distinct(), ["path", "line"], "left_anti").select("kind", "path", "line", "context"))


def enclosing_type(qualified: Column, separator: Column) -> Column:
    """What stands before the last separator (``::`` or ``.``) of a qualified name; null for a free name."""
    before = F.when(separator == "::", F.regexp_extract(qualified, r"^(.*)::(?:(?!::).)*$", 1)).otherwise(F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1))
    return F.nullif(before, F.lit(""))


def separator(language: Column) -> Column:
    return F.when(language.isin("rust", "php"), "::").otherwise(".")


def callee_guess(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds guess to calls (caller, callee, receiver, language, path): the receiver's own type, its first base for parent, a bare class name
    as it stands, nothing for an expression."""
    first = F.get(F.from_json("bases", "array<string>"), F.lit(0))
    # several classes of one name in a file: the first by line
    base = classes.groupBy("path", F.col("name").alias("_leaf")).agg(F.min_by(first, "line_start").alias("_base"))
    sep, receiver = separator(F.col("language")), F.nullif(F.trim("receiver"), F.lit(""))
    typed = calls.withColumn("_sep", sep).withColumn("_recv", receiver).withColumn("_type", enclosing_type(F.col("caller"), F.col("_sep"))).withColumn("_leaf", F.regexp_extract("_type", r"([^:.]*)$", 1))
    joined = typed.join(base, ["path", "_leaf"], "left")
    own = F.concat("_type", "_sep", "callee")
    dynamic = F.col("_recv").rlike(r"^\$|[.:\\()\[\]{} \t\n\"'<>&*-]")
    guess = F.when(F.col("_recv").isin("self", "$this", "this", "cls", "static"), own).when(F.col("_recv") == "parent", F.concat(F.regexp_extract("_base", r"([^:.]*)$", 1), "_sep", "callee")).when(~dynamic, F.concat("_recv", "_sep", "callee"))
    return joined.withColumn("guess", guess).drop("_sep", "_recv", "_type", "_leaf", "_base")


def suffixes(path: Column, most: int = 4) -> Column:
    """The last one to ``most`` segments of a path without its extension, each as one string."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))


def import_segments(module: Column) -> Column:
    """Segments of an import in any language's spelling."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(module), r"\.(js|mjs|ts)$", ""), r"::|[\\.]", "/")
    return F.filter(F.split(plain, "/"), lambda x: (x != "") & ~x.isin("crate", "self", "super", "@", "~"))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, file): imports joined with the files whose path ends in what they name. Suffixes become keys, so this is an equi join."""
    keyed = files.select(F.col("path").alias("file"), F.explode(suffixes(F.col("path"))).alias("_key")).distinct()
    wanted = imports.select("path", "target", F.array_join(import_segments(F.col("target")), "/").alias("_key")).distinct()
    return wanted.join(keyed, "_key").filter("path <> file").select("path", "target", "file")


def mark_receivers(calls: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """is_method set where a receiver's root names no project module: runtime globals, or nothing that the file imports from the project.
    ``calls`` have receiver, language and path; rust is foreign for its standard library only, and php never."""
    root = F.regexp_extract("receiver", r"([\p{L}\p{N}_$]+)", 1)
    own = import_targets(imports, files).select("path", "target").distinct().join(imports.select("path", "target", "name"), ["path", "target"])
    parts = import_segments(F.col("target"))
    names = own.select("path", F.explode(F.array_compact(F.array("name", F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)))).alias("_root")).distinct().withColumn("_known", F.lit(True))
    joined = calls.withColumn("_root", root).join(names, ["path", "_root"], "left")
    foreign = F.when(F.col("language") == "rust", F.col("_root").isin("std", "core", "alloc")).when(F.col("language") == "php", F.lit(False)).otherwise(F.col("_root").isin(*BUILTIN_RECEIVERS) | F.col("_known").isNull())
    asked = F.coalesce(F.col("receiver"), F.lit("")) != ""
    return joined.withColumn("is_method", F.col("is_method") | (asked & ~F.col("_root").isin(*SELF_RECEIVERS) & foreign)).drop("_root", "_known")


def module_edges(graded: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst) over nodes ``module|name``: a call leads to the definition of its target in the caller's module, else to the only other
    module that defines it, else nowhere. Method calls of free names are left out."""
    last = lambda c: F.regexp_extract(c, r"([^:.]*)$", 1)
    defined = functions.select("module", "name").distinct()
    single = defined.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.first("module").alias("_only")).filter("_n = 1").select("name", "_only")
    calls = sound_calls(graded, functions).select("module", last(F.col("caller")).alias("from"), last(F.coalesce("resolved_callee", "callee")).alias("name"))
    here = defined.withColumn("_here", F.lit(True))
    found = calls.join(here, ["module", "name"], "left").join(single, "name", "left")
    to = F.when(F.col("_here"), F.col("module")).otherwise(F.col("_only"))
    return found.filter(to.isNotNull()).select(F.concat("module", F.lit("|"), "from").alias("src"), F.concat(to, F.lit("|"), "name").alias("dst"))


def symbol_brief(functions: DataFrame, classes: DataFrame, graded: DataFrame, name: str, most: int = 4, callers_shown: int = 3) -> DataFrame:
    """A hint on a name: its definitions and up to three callers, the surest and untested first; nothing where there are none or over four."""
    found = cut(symbols(functions, classes).filter(F.col("name") == name))
    if not 0 < found.count() <= most:
        return found.limit(0).select(F.lit("definition").alias("kind"), "path", F.col("line_start").cast("long").alias("line"), F.col("qualified_name").alias("text"))
    tests = functions.filter("is_test").select(F.col("qualified_name").alias("caller"), F.lit(1).alias("_test")).distinct()
    calls = callers(graded, functions, name, 1 << 30).join(tests, "caller", "left")
    once = Window.partitionBy("path", "line").orderBy(F.desc("confidence"), F.coalesce("_test", F.lit(0)), "caller")
    shown = calls.withColumn("_n", F.row_number().over(once)).filter("_n = 1").orderBy(F.desc("confidence"), F.coalesce("_test", F.lit(0)), "path", "line").limit(callers_shown)
    return found.select(F.lit("definition").alias("kind"), "path", F.col("line_start").cast("long").alias("line"), F.col("qualified_name").alias("text")).unionByName(shown.select(F.lit("caller").alias("kind"), "path", F.col("line").cast("long").alias("line"), F.col("caller").alias("text")))
