"""Registered queries on symbols, call edges, references and reachability, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import paths as P
from .operators import graph as G
from .operators import retrieval as R
from .operators import symbols as S
from .registry import query

#: Calls with their confidence and resolved callee, from counts of definitions by qualified and by bare name.
GRADED = """SELECT c.*, CASE WHEN q.n = 1 THEN 0.9 WHEN q.n > 1 THEN 0.7 WHEN c.is_method THEN CASE WHEN b.n > 0 THEN 0.4 ELSE 0.3 END WHEN b.n = 1 THEN 0.6 WHEN b.n > 1 THEN 0.4 ELSE 0.3 END AS confidence,
CASE WHEN q.n > 0 THEN c.guess END AS resolved_callee FROM v_calls c LEFT JOIN (SELECT qualified_name AS k, count(*) AS n FROM v_functions GROUP BY 1) q ON q.k = c.guess LEFT JOIN (SELECT name AS k, count(*) AS n FROM v_functions GROUP BY 1) b ON b.k = c.callee"""
SYMBOLS = "SELECT 'function' AS kind, id, name, qualified_name, path, line_start, line_end FROM v_functions UNION ALL SELECT 'class', id, name, qualified_name, path, line_start, line_end FROM v_classes"
#: The name that is called most: the subject of point queries.
HOT = "(SELECT callee FROM v_calls GROUP BY callee ORDER BY count(*) DESC, callee LIMIT 1)"
HOT_CLASS = "(SELECT name FROM v_classes GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"
FREE = "(SELECT name FROM v_functions GROUP BY name HAVING NOT bool_or(qualified_name LIKE '%:%'))"
SOUND = f"(SELECT * FROM ({GRADED}) g WHERE NOT (is_method AND callee IN {FREE}))"
PATH5 = "(SELECT path FROM v_files WHERE id = 5)"


def hot(t) -> str:
    return t["v_calls"].groupBy("callee").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "callee").first()["callee"]


def hot_class(t) -> str:
    return t["v_classes"].groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").first()["name"]


def path_of(t, file: int = 5) -> str:
    return t["v_files"].filter(F.col("id") == file).first()["path"]


def graded(t) -> DataFrame:
    return G.grade_calls(t["v_calls"], t["v_functions"])


def class_rows(t) -> DataFrame:
    return t["v_classes"]


def function_rows(t) -> DataFrame:
    return t["v_functions"]


@query(f"SELECT id, qualified_name, path FROM v_functions WHERE name = {HOT} ORDER BY id LIMIT 1")
def get_function(t):
    return S.lookup(t["v_functions"], hot(t)).select("id", "qualified_name", "path")


@query(f"SELECT id, qualified_name, path FROM v_classes WHERE name = {HOT_CLASS} AND language = 'rust' ORDER BY id LIMIT 1")
def get_class(t):
    return S.lookup(t["v_classes"], hot_class(t), language="rust").select("id", "qualified_name", "path")


@query(f"SELECT 'function' AS kind, id FROM (SELECT id FROM v_functions WHERE path = {PATH5} AND name = (SELECT min(name) FROM v_functions WHERE path = {PATH5}) ORDER BY id LIMIT 1) a UNION ALL SELECT 'class', id FROM (SELECT id FROM v_classes WHERE path = {PATH5} AND name = (SELECT min(name) FROM v_classes WHERE path = {PATH5}) ORDER BY id LIMIT 1) b")
def symbol_in_file(t):
    path = path_of(t)
    parts = []
    for kind, rows in (("function", t["v_functions"]), ("class", t["v_classes"])):
        name = rows.filter(F.col("path") == path).agg(F.min("name")).first()[0]
        parts.append(S.lookup(rows, name, path=path).select(F.lit(kind).alias("kind"), "id"))
    return G.union_all(parts)


@query(f"""WITH x AS (SELECT s.*, CASE WHEN path = {PATH5} THEN 0 ELSE 2 END + CASE WHEN kind = 'class' THEN 1 ELSE 0 END AS r FROM ({SYMBOLS}) s),
a AS (SELECT 'function name' AS asked, kind, id, path FROM x WHERE name = {HOT} ORDER BY r, id LIMIT 1), b AS (SELECT 'class name' AS asked, kind, id, path FROM x WHERE name = {HOT_CLASS} ORDER BY r, id LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b""")
def resolve_symbol(t):
    asked = (("function name", hot(t)), ("class name", hot_class(t)))
    return G.union_all([S.resolve_symbol(t["v_functions"], t["v_classes"], name, path_of(t)).select(F.lit(label).alias("asked"), "kind", "id", "path") for label, name in asked])


@query(f"WITH x AS (SELECT name, min(CASE WHEN kind = 'function' THEN 0 ELSE 1 END) AS k FROM ({SYMBOLS}) s GROUP BY name) SELECT x.name, arg_min(qualified_name, id) AS qualified_name FROM x JOIN ({SYMBOLS}) s ON s.name = x.name AND (CASE WHEN s.kind = 'function' THEN 0 ELSE 1 END) = x.k GROUP BY x.name")
def lookup_qualified_names(t):
    """The qualified name of every bare name: a function's before a class's, the first by id."""
    rank = F.struct((F.col("kind") == "class").alias("k"), "id")
    return S.symbols(t["v_functions"], t["v_classes"]).groupBy("name").agg(F.min_by("qualified_name", rank).alias("qualified_name"))


@query(f"SELECT kind, name, qualified_name, line_start, line_end FROM ({SYMBOLS}) s WHERE path = {PATH5}")
def file_outline_symbols(t):
    return S.symbols(t["v_functions"], t["v_classes"]).filter(F.col("path") == path_of(t)).select("kind", "name", "qualified_name", "line_start", "line_end")


@query(f"SELECT id, path, module, language FROM v_files WHERE path = {PATH5}")
def stat_file(t):
    return t["v_files"].filter(F.col("path") == path_of(t)).select("id", "path", "module", "language")


@query("SELECT method, route, handler_class, handler_method, path, line FROM v_routes WHERE upper(method) = 'POST' AND route ILIKE '%/en/%' AND (handler_class ILIKE '%brand%' OR handler_method ILIKE '%gear%') ORDER BY path, line, route, id LIMIT 100")
def find_routes(t):
    keep = (F.upper("method") == "POST") & F.col("route").ilike("%/en/%") & (F.col("handler_class").ilike("%brand%") | F.col("handler_method").ilike("%gear%"))
    return t["v_routes"].filter(keep).orderBy("path", "line", "route", "id").limit(100).select("method", "route", "handler_class", "handler_method", "path", "line")


PATTERN = r"use [a-z]+_ring_\d$|trait [A-Z]"


@query(rf"""WITH b AS (SELECT 'function' AS kind, id, path, line_start, body FROM v_bodies UNION ALL SELECT 'class', id, path, line_start, body FROM v_classes),
l AS (SELECT kind, id, path, line_start, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM b)
SELECT kind, path, CAST(line_start + pos AS BIGINT) AS line, text FROM l WHERE regexp_matches(text, '{PATTERN}') ORDER BY kind = 'class', path, line_start, id, line LIMIT 1000""")
def grep_code(t):
    return S.grep(t["v_bodies"], t["v_classes"], PATTERN, limit=1000)


@query(f"SELECT DISTINCT path, line_start, qualified_name FROM ({SYMBOLS}) s WHERE (name = {HOT} OR qualified_name = {HOT}) AND path IN (SELECT path FROM v_files) ORDER BY path, line_start, qualified_name LIMIT 50")
def definitions_of_symbol(t):
    return S.definitions(t["v_functions"], t["v_classes"], t["v_files"], hot(t)).select("path", "line_start", "qualified_name")


HOT_BASE = "(SELECT bases[3:-3] FROM v_classes GROUP BY bases ORDER BY count(*) DESC, bases LIMIT 1)"


@query(f"SELECT name, path, bases FROM v_classes WHERE bases LIKE concat('%\"', {HOT_BASE}, '\"%')")
def find_implementations(t):
    base = t["v_classes"].groupBy("bases").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bases").first()["bases"]
    return S.implementations(t["v_classes"], base[2:-2]).select("name", "path", "bases")


@query("SELECT path, name, language FROM v_classes ORDER BY path, name LIMIT 200")
def list_classes(t):
    return t["v_classes"].orderBy("path", "name").limit(200).select("path", "name", "language")


@query("SELECT id, path, regexp_extract(qualified_name, '([^:.]*)$', 1) AS name FROM v_chunks WHERE id IN (1, 5, 17, 40, 1000000000)")
def chunk_hits(t):
    wanted = t.spark.createDataFrame([(k,) for k in (1, 5, 17, 40, 1000000000)], "id long")
    return t["v_chunks"].join(F.broadcast(wanted), "id", "left_semi").select("id", "path", P.last_segment(F.col("qualified_name")).alias("name"))  # five ids


@query("SELECT qualified_name, arg_min(chunk_text, id) AS chunk_text FROM v_chunks GROUP BY qualified_name")
def chunk_text_for_symbol(t):
    return t["v_chunks"].groupBy("qualified_name").agg(F.min_by("chunk_text", "id").alias("chunk_text"))


@query("SELECT path, list_sort(list(DISTINCT name)) AS names FROM v_functions GROUP BY path")
def function_names_in_file(t):
    return t["v_functions"].groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))


@query("SELECT i.path, i.target, i.line, coalesce(f.module, '') AS module FROM v_imports i LEFT JOIN v_files f ON f.path = i.path WHERE i.module = 'n3'")
def imports_of_module(t):
    return t["v_imports"].filter("module = 'n3'").drop("module").join(t["v_files"].select("path", "module"), "path", "left").select("path", "target", "line", F.coalesce("module", F.lit("")).alias("module"))


@query(f"SELECT DISTINCT target FROM v_imports WHERE path = {PATH5}")
def import_modules(t):
    return t["v_imports"].filter(F.col("path") == path_of(t)).select("target").distinct()


@query("SELECT r.handler_method, r.method, r.route, f.module FROM v_routes r JOIN v_files f ON f.path = r.path WHERE f.module = 'n3'")
def routes_of_module(t):
    return t["v_routes"].join(t["v_files"].filter("module = 'n3'").select("path", "module"), "path").select("handler_method", "method", "route", "module")


@query("SELECT c.id AS class_id, count(*) AS n FROM v_functions f JOIN v_classes c ON c.path = f.path AND f.line_start >= c.line_start AND f.line_end <= c.line_end GROUP BY c.id")
def class_members(t):
    return S.contained(t["v_functions"], t["v_classes"]).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, count(DISTINCT path) AS files FROM v_functions GROUP BY name HAVING count(DISTINCT path) > 1")
def ambiguous_names(t):
    return t["v_functions"].groupBy("name").agg(F.countDistinct("path").alias("files")).filter("files > 1")


@query(f"SELECT path, line, caller, callee FROM {SOUND} g WHERE callee = {HOT} OR resolved_callee = {HOT} ORDER BY path, line, caller, callee LIMIT 200")
def get_callers(t):
    return S.callers(graded(t), t["v_functions"], hot(t)).select("path", "line", "caller", "callee")


HOT_CALLER = "(SELECT f.name FROM v_calls c JOIN v_functions f ON f.qualified_name = c.caller GROUP BY f.name ORDER BY count(*) DESC, f.name LIMIT 1)"


@query(f"SELECT path, line, callee FROM v_calls WHERE caller = {HOT_CALLER} OR caller IN (SELECT qualified_name FROM v_functions WHERE name = {HOT_CALLER}) ORDER BY path, line, callee LIMIT 200")
def get_callees(t):
    owners = t["v_functions"].select("name", F.col("qualified_name").alias("caller"))
    name = t["v_calls"].join(owners, "caller").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").first()["name"]
    return S.callees(t["v_calls"], t["v_functions"], name).select("path", "line", "callee")


BARE = f"SELECT regexp_extract(caller, '([^:.]*)$', 1) AS s, regexp_extract(callee, '([^:.]*)$', 1) AS d, max(confidence) AS c FROM ({GRADED}) g WHERE regexp_extract(caller, '([^:.]*)$', 1) <> regexp_extract(callee, '([^:.]*)$', 1) GROUP BY 1, 2"


def chain_sql(least: float) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM ({BARE}) b WHERE c >= {least}), a AS (SELECT min(s) AS s FROM e),
r(node, depth, pred) USING KEY (node) AS (SELECT s, 0, CAST(NULL AS VARCHAR) FROM a UNION SELECT e.d, min(r.depth) + 1, min(e.s) FROM r JOIN e ON e.s = r.node WHERE r.depth < 12 AND NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.node = e.d) GROUP BY e.d),
goal AS (SELECT max(node) AS node FROM r WHERE depth = (SELECT max(depth) FROM r WHERE depth <= 5)),
p(node, depth, pred) AS (SELECT r.* FROM r JOIN goal ON goal.node = r.node UNION ALL SELECT r.* FROM p JOIN r ON r.node = p.pred)
SELECT p.depth AS step, p.node AS name, CAST(e.c AS DOUBLE) AS confidence FROM p LEFT JOIN e ON e.s = p.pred AND e.d = p.node"""


def _chain(t, least: float) -> DataFrame:
    edges = G.cut(G.call_edges(graded(t)))
    kept = edges.filter(F.col("confidence") >= least)
    start = kept.agg(F.min("src")).first()[0]
    near = G.cut(G.walk(kept, t.spark.createDataFrame([(start,)], "node string"), 5))
    goal = near.join(near.agg(F.max("depth").alias("depth")), "depth").agg(F.max("node")).first()[0]
    return S.chain_hops(edges, start, goal, 12, least)


@query(chain_sql(0.0))
def call_chain_names(t):
    return _chain(t, 0.0)


@query(chain_sql(0.5))
def call_chain_exact(t):
    """The chain over edges of at least inferred certainty, with the confidence of each hop."""
    return _chain(t, 0.5)


def tests_sql(seed: str, own: str = "") -> str:
    return f"""WITH RECURSIVE t AS (SELECT qualified_name, arg_max(name, id) AS test, arg_max(path, id) AS path FROM v_functions WHERE is_test GROUP BY 1),
e AS MATERIALIZED (SELECT DISTINCT coalesce(resolved_callee, callee) AS d, caller AS s FROM {SOUND} g),
r(node, depth) USING KEY (node) AS ({seed} UNION SELECT e.s, min(r.depth) + 1 FROM r JOIN e ON e.d = r.node WHERE r.depth < 10 AND (r.depth = 0 OR r.node NOT IN (SELECT qualified_name FROM t)) AND NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.node = e.s) GROUP BY e.s)
SELECT test, qualified_name, path, depth FROM (SELECT t.test, t.qualified_name, t.path, CAST(r.depth AS INTEGER) AS depth FROM r JOIN t ON t.qualified_name = r.node WHERE r.depth > 0{own}) x"""


@query(tests_sql(f"SELECT {HOT}, 0"))
def tests_covering(t):
    return S.tests_reaching(graded(t), t["v_functions"], t.spark.createDataFrame([(hot(t),)], "node string"))


NAMED = "SELECT node FROM (SELECT name AS node, path FROM v_functions UNION SELECT qualified_name, path FROM v_functions) n GROUP BY node HAVING count(*) = 1 AND min(path) = (SELECT path FROM v_files WHERE id = 5)"


@query("SELECT qualified_name, arg_min(test, depth) AS test, arg_min(path, depth) AS path, min(depth) AS depth FROM (" + tests_sql(f"SELECT node, 0 FROM ({NAMED}) z", " UNION ALL SELECT name, qualified_name, path, 0 FROM v_functions WHERE is_test AND path = (SELECT path FROM v_files WHERE id = 5)") + ") y GROUP BY qualified_name")
def tests_covering_file(t):
    return S.tests_covering_file(graded(t), t["v_functions"], path_of(t))


DISPATCHED = "(SELECT f.name FROM v_functions f JOIN v_classes c ON c.path = f.path AND f.line_start >= c.line_start AND f.line_end <= c.line_end WHERE c.body LIKE '%trait %' OR c.body LIKE '%interface %' UNION SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in S.DISPATCHED) + ") s(name))"
ENTRIES = "(SELECT name FROM v_functions WHERE name = 'main' UNION SELECT handler_method FROM v_routes WHERE handler_method IS NOT NULL)"


@query(f"""WITH w AS (SELECT DISTINCT name, unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM v_bodies), m AS (SELECT DISTINCT word FROM w WHERE word <> name)
SELECT id, qualified_name, path FROM v_functions WHERE NOT is_test AND name NOT IN (SELECT callee FROM v_calls) AND name NOT IN {ENTRIES} AND name NOT IN {DISPATCHED} AND name NOT IN (SELECT word FROM m)""")
def dead_code(t):
    return S.dead_code(t["v_functions"], t["v_classes"], t["v_calls"], t["v_routes"], t["v_bodies"]).select("id", "qualified_name", "path")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT s, d FROM ({BARE}) b), r(node) AS (SELECT name FROM {ENTRIES} y UNION SELECT e.d FROM r JOIN e ON e.s = r.node)
SELECT id, qualified_name, path FROM v_functions WHERE NOT is_test AND name NOT IN (SELECT node FROM r) AND name NOT IN {DISPATCHED}""")
def unreachable(t):
    return S.unreachable(t["v_functions"], t["v_classes"], G.call_edges(graded(t)), t["v_routes"]).select("id", "qualified_name", "path")


@query(f"""WITH b AS (SELECT name, qualified_name, path, line_start, body FROM v_bodies UNION ALL SELECT name, qualified_name, path, line_start, body FROM v_classes),
d AS (SELECT 'definition' AS kind, path, CAST(line_start AS BIGINT) AS line, '' AS context FROM b WHERE name = {HOT} OR qualified_name = {HOT}),
c AS (SELECT 'call' AS kind, path, CAST(line AS BIGINT) AS line, caller AS context FROM ({GRADED}) g WHERE (callee = {HOT} OR resolved_callee = {HOT}) AND NOT (is_method AND {HOT} IN {FREE})),
i AS (SELECT 'import' AS kind, path, CAST(line AS BIGINT) AS line, target AS context FROM v_imports WHERE name = {HOT}),
k AS (SELECT * FROM d UNION ALL SELECT * FROM c UNION ALL SELECT * FROM i),
l AS (SELECT path, qualified_name, line_start + generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line, unnest(string_split(body, chr(10))) AS text FROM b)
SELECT * FROM k UNION ALL SELECT 'mention', path, CAST(line AS BIGINT), qualified_name FROM l WHERE list_contains(regexp_extract_all(text, '[A-Za-z0-9_]+'), {HOT}) AND NOT EXISTS (SELECT 1 FROM k WHERE k.path = l.path AND k.line = l.line)""")
def find_references(t):
    return S.references(t["v_bodies"], t["v_classes"], graded(t), t["v_imports"], hot(t))


def receiver_calls(t) -> DataFrame:
    """Calls with a receiver, dealt from the line and the callee of each."""
    kind = F.pmod(F.col("src_id") + F.col("dst_id"), F.lit(8))
    receiver = F.when(kind == 0, "self").when(kind == 1, "parent").when(kind == 2, F.concat(F.lit("Brand"), F.col("line") + 10)).when(kind == 3, "a.b").when(kind == 4, "std::mem").when(kind == 5, F.concat(F.lit("s"), F.pmod("dst_id", F.lit(100)))).when(kind == 6, "Math")
    files = t["v_files"].select("path", "language")
    return t["v_calls"].withColumn("receiver", receiver).join(files, "path").select("src_id", "dst_id", "path", "line", "caller", "callee", "receiver", "language", "is_method")


RECEIVERS = """SELECT c.*, f.language, CASE (src_id + dst_id) % 8 WHEN 0 THEN 'self' WHEN 1 THEN 'parent' WHEN 2 THEN concat('Brand', line + 10) WHEN 3 THEN 'a.b' WHEN 4 THEN 'std::mem' WHEN 5 THEN concat('s', dst_id % 100) WHEN 6 THEN 'Math' END AS receiver,
CASE WHEN f.language IN ('rust', 'php') THEN '::' ELSE '.' END AS sep FROM v_calls c JOIN v_files f ON f.path = c.path"""


@query(f"""WITH x AS (SELECT *, nullif(CASE WHEN sep = '::' THEN regexp_extract(caller, '^(.*)::[^:]*$', 1) ELSE regexp_extract(caller, '^(.*)[.][^.]*$', 1) END, '') AS ty FROM ({RECEIVERS}) r),
b AS (SELECT path, name, arg_min(regexp_extract(bases, '"([^"]*)"', 1), line_start) AS base FROM v_classes GROUP BY 1, 2)
SELECT src_id, dst_id, line, CASE WHEN receiver IS NULL THEN NULL WHEN receiver = 'self' THEN ty || sep || callee WHEN receiver = 'parent' THEN b.base || sep || callee WHEN receiver LIKE 'Brand%' OR receiver = 'Math' OR regexp_matches(receiver, '^s[0-9]+$') THEN receiver || sep || callee END AS guess
FROM x LEFT JOIN b ON b.path = x.path AND b.name = x.ty""")
def callee_guesses(t):
    return S.callee_guess(receiver_calls(t), t["v_classes"]).select("src_id", "dst_id", "line", "guess")


@query(f"""WITH s AS (SELECT DISTINCT path, concat('n', regexp_extract(path, '/n([0-9]+)/', 1), '/', regexp_extract(path, '/(s[0-9]+)[.]', 1)) AS tail FROM v_files),
n0 AS (SELECT i.path, i.target, i.name FROM v_imports i JOIN s ON s.tail = i.target AND s.path <> i.path),
n AS (SELECT path, name AS root FROM n0 UNION SELECT path, split_part(target, '/', 1) FROM n0 UNION SELECT path, split_part(target, '/', 2) FROM n0),
r AS (SELECT *, regexp_extract(receiver, '([a-zA-Z0-9_$]+)', 1) AS root FROM ({RECEIVERS}) r)
SELECT r.src_id, r.dst_id, r.line, r.is_method OR (r.receiver IS NOT NULL AND r.root NOT IN ('self', 'parent') AND CASE WHEN language = 'rust' THEN r.root = 'std' WHEN language = 'php' THEN false ELSE r.root IN ('std', 'Math') OR n.root IS NULL END) AS is_method
FROM r LEFT JOIN n ON n.path = r.path AND n.root = r.root""")
def mark_receiver_calls(t):
    return S.mark_receivers(receiver_calls(t), t["v_imports"], t["v_files"]).select("src_id", "dst_id", "line", "is_method")


@query(f"SELECT g.src_id, g.dst_id, g.line, CAST(confidence AS DOUBLE) AS confidence, resolved_callee FROM ({GRADED}) g WHERE callee IN (SELECT name FROM v_functions WHERE path = {PATH5})")
def regrade_subset(t):
    names = t["v_functions"].filter(F.col("path") == path_of(t)).select(F.col("name").alias("callee")).distinct()
    return G.grade_calls(t["v_calls"].join(names, "callee", "left_semi"), t["v_functions"]).select("src_id", "dst_id", "line", "confidence", "resolved_callee")


@query(f"""WITH d AS (SELECT DISTINCT module, name FROM v_functions), o AS (SELECT name, min(module) AS solo FROM d GROUP BY name HAVING count(*) = 1),
c AS (SELECT module, regexp_extract(caller, '([^:.]*)$', 1) AS f, regexp_extract(coalesce(resolved_callee, callee), '([^:.]*)$', 1) AS name FROM {SOUND} g)
SELECT concat(c.module, '|', f) AS src, concat(CASE WHEN d.name IS NOT NULL THEN c.module ELSE solo END, '|', c.name) AS dst, count(*) AS n FROM c LEFT JOIN d ON d.module = c.module AND d.name = c.name LEFT JOIN o ON o.name = c.name WHERE d.name IS NOT NULL OR solo IS NOT NULL GROUP BY 1, 2""")
def module_edges(t):
    return S.module_edges(graded(t), t["v_functions"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query()
def module_symbol_rank(t):
    """Ranks over names in their modules; iterated, so without SQL (a small graph is tested against brute force)."""
    nodes = t["v_functions"].select(F.concat("module", F.lit("|"), "name").alias("node")).distinct()
    return G.symbol_rank(S.module_edges(graded(t), t["v_functions"]), nodes)


@query("""WITH s AS (SELECT path AS file, regexp_replace(regexp_replace(path, '[.][a-z]+$', ''), '^src/r[0-9]+/', '') AS tail FROM v_files) SELECT DISTINCT i.path, i.target, s.file FROM v_imports i JOIN s ON s.tail = i.target WHERE i.path <> s.file""")
def resolved_imports(t):
    return S.import_targets(t["v_imports"], t["v_files"])


IMPORT_EDGES = "SELECT DISTINCT i.path AS s, f.path AS d FROM v_imports i JOIN v_files f ON regexp_replace(regexp_replace(f.path, '[.][a-z]+$', ''), '^src/r[0-9]+/', '') = i.target WHERE i.path <> f.path"


def _import_walk(t, reverse: bool) -> DataFrame:
    e = S.import_targets(t["v_imports"], t["v_files"]).select(F.col("path").alias("src"), F.col("file").alias("dst"))
    e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else e
    return G.walk(e, t.spark.createDataFrame([(path_of(t),)], "node string"), 2).filter("depth > 0").select(F.col("node").alias("path"), "depth")


def _import_walk_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED ({IMPORT_EDGES}), r(node, depth) USING KEY (node) AS (SELECT {PATH5}, 0 UNION SELECT e.{b}, min(r.depth) + 1 FROM r JOIN e ON e.{a} = r.node WHERE r.depth < 2 AND NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.node = e.{b}) GROUP BY e.{b})
SELECT node AS path, CAST(depth AS INTEGER) AS depth FROM r WHERE depth > 0"""


@query(_import_walk_sql("s", "d"))
def find_dependencies(t):
    return _import_walk(t, False)


@query(_import_walk_sql("d", "s"))
def impact_analysis(t):
    return _import_walk(t, True)


@query(f"""WITH d AS (SELECT 'definition' AS part, path, CAST(line_start AS BIGINT) AS line, qualified_name AS text FROM ({SYMBOLS}) s WHERE name = {HOT} ORDER BY kind DESC, id LIMIT 1),
cr AS (SELECT 'caller' AS part, path, CAST(line AS BIGINT) AS line, caller AS text FROM {SOUND} g WHERE callee = {HOT} OR resolved_callee = {HOT} ORDER BY path, line, caller, callee LIMIT 200),
ce AS (SELECT 'callee' AS part, path, CAST(line AS BIGINT) AS line, callee AS text FROM v_calls WHERE caller = {HOT} OR caller IN (SELECT qualified_name FROM v_functions WHERE name = {HOT}) ORDER BY path, line, callee LIMIT 200),
im AS (SELECT 'import' AS part, path, CAST(line AS BIGINT) AS line, target AS text FROM v_imports WHERE path = (SELECT path FROM d)),
ro AS (SELECT 'route' AS part, path, CAST(line AS BIGINT) AS line, route AS text FROM v_routes WHERE handler_method = {HOT}),
ip AS (SELECT 'implementation' AS part, path, CAST(line_start AS BIGINT) AS line, name AS text FROM v_classes WHERE bases LIKE concat('%"', {HOT}, '"%'))
SELECT * FROM d UNION ALL SELECT * FROM cr UNION ALL SELECT * FROM ce UNION ALL SELECT * FROM im UNION ALL SELECT * FROM ro UNION ALL SELECT * FROM ip""")
def symbol_context(t):
    """All that is known of a symbol: definition, callers, callees, imports of its file, routes, implementations."""
    name, f, c = hot(t), t["v_functions"], t["v_classes"]
    row = lambda df, part, text, line="line": df.select(F.lit(part).alias("part"), "path", F.col(line).cast("long").alias("line"), F.col(text).alias("text"))
    own = S.resolve_symbol(f, c, name)
    parts = [row(own, "definition", "qualified_name", "line_start"), row(S.callers(graded(t), f, name), "caller", "caller"), row(S.callees(t["v_calls"], f, name), "callee", "callee")]
    parts.append(row(t["v_imports"].join(own.select("path"), "path", "left_semi"), "import", "target"))
    parts.append(row(t["v_routes"].filter(F.col("handler_method") == name), "route", "route"))
    return G.union_all([*parts, row(S.implementations(c, name), "implementation", "name", "line_start")])


@query(f"""WITH l AS (SELECT 'language' AS section, language AS item, count(*) AS n FROM v_files GROUP BY language), m AS (SELECT 'module' AS section, module AS item, count(*) AS n FROM v_files GROUP BY module ORDER BY n DESC, item LIMIT 10),
h AS (SELECT 'hotspot' AS section, callee AS item, count(*) AS n FROM v_calls WHERE callee IN (SELECT name FROM v_functions) GROUP BY callee ORDER BY n DESC, item LIMIT 10), e AS (SELECT DISTINCT 'entry' AS section, name AS item, CAST(0 AS BIGINT) AS n FROM {ENTRIES} y)
SELECT * FROM l UNION ALL SELECT * FROM m UNION ALL SELECT * FROM h UNION ALL SELECT * FROM e""")
def repo_map(t):
    """Languages, largest modules, call hotspots and entry points under one roof."""
    count = lambda df, section, key: df.groupBy(F.col(key).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "item", "n")
    known = t["v_functions"].select(F.col("name").alias("callee")).distinct()
    hotspots = count(t["v_calls"].join(known, "callee", "left_semi"), "hotspot", "callee")
    entries = S.entry_points(t["v_functions"], t["v_routes"]).select(F.lit("entry").alias("section"), F.col("name").alias("item"), F.lit(0).cast("long").alias("n"))
    return G.union_all([count(t["v_files"], "language", "language"), R.top(count(t["v_files"], "module", "module"), 10, F.desc("n"), F.col("item")), R.top(hotspots, 10, F.desc("n"), F.col("item")), entries])


@query(f"""WITH n AS (SELECT name FROM v_functions GROUP BY name HAVING count(*) BETWEEN 1 AND 4 AND name IN (SELECT callee FROM v_calls) AND name NOT IN (SELECT name FROM v_classes) ORDER BY name LIMIT 1),
g AS (SELECT c.path, c.line, c.caller, c.confidence, CASE WHEN c.caller IN (SELECT qualified_name FROM v_functions WHERE is_test) THEN 1 ELSE 0 END AS tst FROM {SOUND} c, n WHERE c.callee = n.name OR c.resolved_callee = n.name),
o AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY confidence DESC, tst, caller) AS k FROM g)
SELECT 'definition' AS kind, path, CAST(line_start AS BIGINT) AS line, qualified_name AS text FROM v_functions WHERE name = (SELECT name FROM n) UNION ALL SELECT * FROM (SELECT 'caller', path, CAST(line AS BIGINT), caller FROM o WHERE k = 1 ORDER BY confidence DESC, tst, path, line LIMIT 3) z""")
def symbol_brief(t):
    called, classes = t["v_calls"].select(F.col("callee").alias("name")).distinct(), t["v_classes"].select("name").distinct()
    few = t["v_functions"].groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n <= 4").join(called, "name", "left_semi").join(classes, "name", "left_anti")
    return S.symbol_brief(t["v_functions"], t["v_classes"], graded(t), few.agg(F.min("name")).first()[0])


@query(f"""WITH f AS (SELECT DISTINCT name FROM v_functions WHERE path = {PATH5}) SELECT callee AS name, CAST(count_if(confidence >= 0.85) AS BIGINT) AS exact, CAST(count_if(confidence >= 0.5 AND confidence < 0.85) AS BIGINT) AS inferred, CAST(count_if(confidence < 0.5) AS BIGINT) AS ambiguous FROM ({GRADED}) g WHERE callee IN (SELECT name FROM f) GROUP BY callee""")
def file_impact_by_certainty(t):
    """Callers of each symbol of a file, by how sure they are."""
    names = t["v_functions"].filter(F.col("path") == path_of(t)).select(F.col("name").alias("callee")).distinct()
    sure = G.certainty(F.col("confidence"))
    counts = [F.count_if(sure == kind).alias(kind) for kind in ("exact", "inferred", "ambiguous")]
    return graded(t).join(names, "callee", "left_semi").groupBy(F.col("callee").alias("name")).agg(*counts)


@query(f"SELECT src_id, dst_id, line, CASE WHEN confidence >= 0.85 THEN 'exact' WHEN confidence >= 0.5 THEN 'inferred' ELSE 'ambiguous' END AS certainty, CASE WHEN confidence >= 0.85 THEN 'exact' WHEN confidence >= 0.55 THEN 'inferred' ELSE 'ambiguous' END AS label FROM ({GRADED}) g WHERE confidence >= 0.5")
def calls_at_least_inferred(t):
    """The certainty filter before any limit, with both ways of naming a confidence."""
    c = F.col("confidence")
    return graded(t).filter(c >= 0.5).select("src_id", "dst_id", "line", G.certainty(c).alias("certainty"), P.hint_label(c).alias("label"))


@query("SELECT path, regexp_extract(path, '([^/]*)$', 1) AS file, regexp_replace(path, '/[^/]*$', '') AS parent, array_to_string(list_slice(string_split(path, '/'), 1, 3), '/') AS module_key, path >= 'src/r1/n1/' AND path < 'src/r1/n10' AS under FROM v_files")
def path_parts(t):
    p = F.col("path")
    return t["v_files"].select("path", P.file_name(p).alias("file"), P.parent(p).alias("parent"), P.module_key(p).alias("module_key"), P.under(p, "src/r1/n1").alias("under"))


TEST_PATHS = "(VALUES ('src/tests/a.rs'), ('src/Test/b.py'), ('lib/test_x.py'), ('lib/x_test.go'), ('web/a.spec.ts'), ('web/a.test.js'), ('src/contest/a.rs'), ('src/latest.py'), ('specs/x.rb'), ('a_tests.rs')) v(path)"


@query(f"SELECT path, len(list_intersect(string_split(lower(path), '/'), ['tests', 'test', '__tests__', 'spec', 'specs', 'testing'])) > 0 OR regexp_matches(lower(path), '(^|/)test_[^/]*$|_test[.](rs|go|py)$|_tests[.]rs$|[.](test|spec)[.][^/]*$') AS is_test FROM (SELECT path FROM v_files UNION ALL SELECT path FROM {TEST_PATHS}) x")
def test_paths(t):
    more = t.spark.createDataFrame([(x,) for x in ("src/tests/a.rs", "src/Test/b.py", "lib/test_x.py", "lib/x_test.go", "web/a.spec.ts", "web/a.test.js", "src/contest/a.rs", "src/latest.py", "specs/x.rb", "a_tests.rs")], "path string")
    return t["v_files"].select("path").unionByName(more).select("path", P.is_test_path(F.col("path")).alias("is_test"))


@query("SELECT path FROM v_files WHERE (path LIKE 'src/r1/%' OR path LIKE 'src/r2/%') AND regexp_matches(path, '^src/.*[.](py|rs)$') AND NOT regexp_matches(path, '^src/r1/n1/.*$')")
def search_scope(t):
    return t["v_files"].filter(P.in_scope(F.col("path"), ["src/r1", "src/r2"], ["src/**/*.{py,rs}", "!src/r1/n1/**"])).select("path")


@query("""SELECT doc_id, regexp_matches(text, '(^|[\\s"''(])(/home/|/Users/|/var/|/etc/|/opt/|[A-Za-z]:\\\\)') AS specific FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'see /home/u/x'), (-2, 'C:\\x'), (-3, 'a/home/b')) v(doc_id, text)) d""")
def project_specific(t):
    more = t.spark.createDataFrame([(-1, "see /home/u/x"), (-2, "C:\\x"), (-3, "a/home/b")], "doc_id long, text string")
    return t["documents"].select("doc_id", "text").unionByName(more).select("doc_id", P.looks_project_specific(F.col("text")).alias("specific"))
