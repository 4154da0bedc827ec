"""Registered queries on the reference operators, with the DuckDB text that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog_code import GRADED
from .functions import text as T
from .operators import graph as G
from .operators import records as M
from .operators import retrieval as R
from .registry import ORACLE, QUERIES, query
from .streaming import maintenance as S

NOW = "2024-06-01 00:00:00"
TERMS = ["herean", "thention", "the", "wholly"]
SYMBOL_ID = 100


def bm25_sql(table: str, key: str, text: str, condition: str, n: int) -> str:
    """BM25 by an inverted list of all tokens (another way round than the operator's single pass)."""
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return f"""WITH tok AS (SELECT {key} AS k, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {table} WHERE {condition}),
w AS (SELECT * FROM tok WHERE t <> ''), dl AS (SELECT k, count(*) AS dl FROM w GROUP BY k),
st AS (SELECT (SELECT count(*) FROM {table} WHERE {condition}) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM {table} WHERE {condition}) AS av),
p AS (SELECT k, t, count(*) AS tf FROM w WHERE t IN ({terms}) GROUP BY k, t), df AS (SELECT t, count(*) AS df FROM p GROUP BY t)
SELECT p.k AS {key}, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score
FROM p JOIN dl ON dl.k = p.k JOIN df ON df.t = p.t CROSS JOIN st GROUP BY p.k ORDER BY score DESC, {key} LIMIT {n}"""


@query(bm25_sql("documents", "doc_id", "text", "true", 20))
def lexical_search_bm25(t):
    return R.top(R.bm25(t["documents"], "doc_id", "text", TERMS), 20, F.desc("score"), F.col("doc_id"))


@query(bm25_sql("documents", "doc_id", "text", "source = 'src3'", 20))
def lexical_search_scoped(t):
    return R.top(R.bm25(t["documents"].filter("source = 'src3'"), "doc_id", "text", TERMS), 20, F.desc("score"), F.col("doc_id"))


@query(bm25_sql("v_memories", "id", "content", "status = 'active'", 20))
def memory_lexical_scored(t):
    return R.top(R.bm25(t["v_memories"].filter("status = 'active'"), "id", "content", TERMS), 20, F.desc("score"), F.col("id"))


KNN = "SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings WHERE {} ORDER BY distance, vec_id LIMIT {}"


def _query_vector(t) -> list[float]:
    return t["embeddings"].filter("vec_id = 0").first()["embedding"]


@query(KNN.format("true", 10))
def vector_knn(t):
    return R.knn(t["embeddings"], _query_vector(t), 10)


@query(KNN.format("label = 3", 10))
def vector_knn_scoped(t):
    return R.knn(t["embeddings"].filter("label = 3"), _query_vector(t), 10)


HYBRID = f"""WITH lex AS ({bm25_sql("documents", "doc_id", "text", "true", 50)}), vec AS ({KNN.format("true", 50)}),
l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM lex), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS r FROM vec),
b AS (SELECT * FROM l UNION ALL SELECT * FROM v) SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM b GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""


@query(HYBRID)
def rrf_hybrid(t):
    lexical = R.top(R.bm25(t["documents"], "doc_id", "text", TERMS), 50, F.desc("score"), F.col("doc_id"))
    dense = R.knn(t["embeddings"], _query_vector(t), 50)
    lists = [R.ranked(lexical, F.desc("score"), F.col("doc_id")).select("doc_id", "rank"), R.ranked(dense, F.col("distance"), F.col("vec_id")).select(F.col("vec_id").alias("doc_id"), "rank")]
    return R.rrf(lists, "doc_id", 10)


@query(f"""WITH h AS ({HYBRID}), m AS ({bm25_sql("v_memories", "id", "content", "status = 'active'", 10)})
SELECT 'code' AS section, CAST(doc_id AS VARCHAR) AS item, score FROM h UNION ALL SELECT 'memory', id, score FROM m""")
def recall_sections(t):
    memory = R.top(R.bm25(t["v_memories"].filter("status = 'active'"), "id", "content", TERMS), 10, F.desc("score"), F.col("id"))
    code = rrf_hybrid(t).select(F.lit("code").alias("section"), F.col("doc_id").cast("string").alias("item"), "score")
    return code.unionByName(memory.select(F.lit("memory").alias("section"), F.col("id").alias("item"), "score"))


@query("SELECT 'files' AS name, count(*) AS n FROM v_files UNION ALL SELECT 'functions', count(*) FROM v_functions UNION ALL SELECT 'calls', count(*) FROM v_calls")
def repo_stats(t):
    return G.union_all([t[v].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, v in (("files", "v_files"), ("functions", "v_functions"), ("calls", "v_calls"))])


@query("SELECT language, count(*) AS n FROM v_files GROUP BY language")
def language_counts(t):
    return t["v_files"].groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT module, count(*) AS n FROM v_files GROUP BY module")
def module_list(t):
    return t["v_files"].groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT array_to_string(list_slice(string_split(path, '/'), 1, 3), '/') AS module_key, count(*) AS functions, CAST(sum(CASE WHEN is_test THEN 1 ELSE 0 END) AS BIGINT) AS tests FROM v_functions GROUP BY 1")
def module_aggregate(t):
    key = F.array_join(F.slice(F.split("path", "/"), 1, 3), "/")
    return t["v_functions"].groupBy(key.alias("module_key")).agg(F.count(F.lit(1)).alias("functions"), F.sum(F.col("is_test").cast("long")).alias("tests"))


@query("SELECT callee, count(*) AS n FROM v_calls WHERE callee IN (SELECT name FROM v_functions) GROUP BY callee ORDER BY n DESC, callee LIMIT 20")
def call_hotspots(t):
    known = t["v_functions"].select(F.col("name").alias("callee")).distinct()
    return R.top(t["v_calls"].join(known, "callee", "left_semi").groupBy("callee").agg(F.count(F.lit(1)).alias("n")), 20, F.desc("n"), F.col("callee"))


FREE = "(SELECT name FROM v_functions GROUP BY name HAVING NOT bool_or(qualified_name LIKE '%:%'))"


def free_names(functions: DataFrame) -> DataFrame:
    """Names that only unqualified definitions have."""
    return functions.groupBy("name").agg(F.max(F.contains("qualified_name", F.lit(":")).cast("int")).alias("q")).filter("q = 0").select("name")


@query(f"SELECT callee, count(*) AS n FROM v_calls WHERE module = 'n3' AND callee IN (SELECT name FROM v_functions WHERE module = 'n3' AND NOT is_test) AND NOT (is_method AND callee IN {FREE}) GROUP BY callee")
def call_hotspots_scoped(t):
    own = t["v_functions"].filter("module = 'n3' and not is_test").select(F.col("name").alias("callee")).distinct()
    free = free_names(t["v_functions"]).select(F.col("name").alias("callee"), F.lit(True).alias("free"))
    calls = t["v_calls"].filter("module = 'n3'").join(own, "callee", "left_semi").join(free, "callee", "left")
    return calls.filter("not (is_method and coalesce(free, false))").groupBy("callee").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH fo AS (SELECT f.id, count(DISTINCT c.callee) AS fan_out FROM v_functions f JOIN v_calls c ON c.caller = f.qualified_name OR c.caller = f.name GROUP BY f.id),
ca AS (SELECT callee, count(*) AS callers FROM v_calls GROUP BY callee)
SELECT f.id, f.qualified_name, f.line_end - f.line_start + 1 + 5 * coalesce(fan_out, 0) + 2 * coalesce(callers, 0) AS score FROM v_functions f LEFT JOIN fo ON fo.id = f.id LEFT JOIN ca ON ca.callee = f.name ORDER BY score DESC, f.id LIMIT 25""")
def complex_functions(t):
    f = t["v_functions"]
    fan = G.fan_out(f, t["v_calls"]).select(F.col("qualified_name").alias("_q"), F.col("name").alias("_n"), "fan_out")
    same = F.col("qualified_name").eqNullSafe(F.col("_q")) & F.col("name").eqNullSafe(F.col("_n"))
    callers = t["v_calls"].groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("callers"))
    score = F.col("line_end") - F.col("line_start") + 1 + 5 * F.coalesce("fan_out", F.lit(0)) + 2 * F.coalesce("callers", F.lit(0))
    return R.top(f.join(fan, same, "left").join(callers, "name", "left").select("id", "qualified_name", score.alias("score")), 25, F.desc("score"), F.col("id"))


@query("""WITH fo AS (SELECT caller, count(*) AS fan_out FROM v_calls GROUP BY caller) SELECT f.id, f.line_end - f.line_start + 1 + 5 * coalesce(fan_out, 0) AS score FROM v_functions f LEFT JOIN fo ON fo.caller = f.qualified_name WHERE module = 'n3'""")
def complex_functions_scoped(t):
    fan = t["v_calls"].groupBy(F.col("caller").alias("qualified_name")).agg(F.count(F.lit(1)).alias("fan_out"))
    own = t["v_functions"].filter("module = 'n3'").join(fan, "qualified_name", "left")
    return own.select("id", (F.col("line_end") - F.col("line_start") + 1 + 5 * F.coalesce("fan_out", F.lit(0))).alias("score"))


@query("SELECT name, qualified_name, line_start, line_end FROM v_functions WHERE path = (SELECT path FROM v_files WHERE id = 5) ORDER BY line_start")
def file_outline(t):
    path = t["v_files"].filter("id = 5").select("path")
    return t["v_functions"].join(path, "path", "left_semi").select("name", "qualified_name", "line_start", "line_end").orderBy("line_start")


@query("SELECT path, module, language FROM v_files WHERE path ILIKE '%N1%' AND language = 'rust' ORDER BY path LIMIT 50")
def list_files(t):
    return t["v_files"].filter(F.col("path").ilike("%n1%") & (F.col("language") == "rust")).select("path", "module", "language").orderBy("path").limit(50)


@query(f"SELECT DISTINCT f.path, f.line_start, f.qualified_name FROM v_functions f JOIN v_files x ON x.id = f.file_id WHERE f.name = (SELECT name FROM v_functions WHERE id = {SYMBOL_ID}) OR f.qualified_name = (SELECT name FROM v_functions WHERE id = {SYMBOL_ID})")
def find_definitions(t):
    name = t["v_functions"].filter(f"id = {SYMBOL_ID}").first()["name"]
    f = t["v_functions"].filter((F.col("name") == name) | (F.col("qualified_name") == name))
    return f.join(t["v_files"].select(F.col("id").alias("file_id")), "file_id").select("path", "line_start", "qualified_name").distinct()


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '\b[0-9]{1,3}([.][0-9]{1,3}){3}\b')")
def grep_lines(t):
    lines = t["documents"].filter(F.col("text").rlike(r"\b[0-9]{1,3}([.][0-9]{1,3}){3}\b")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(r"\b[0-9]{1,3}([.][0-9]{1,3}){3}\b")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


CALL_COLUMNS = "path, caller, callee, line"
NAME = f"(SELECT name FROM v_functions WHERE id = {SYMBOL_ID})"


@query(f"SELECT {CALL_COLUMNS} FROM v_calls WHERE callee = {NAME}")
def callers_bare(t):
    return t["v_calls"].join(t["v_functions"].filter(f"id = {SYMBOL_ID}").select(F.col("name").alias("callee")), "callee", "left_semi").select("path", "caller", "callee", "line")


@query(f"SELECT {CALL_COLUMNS} FROM v_calls WHERE callee IN {FREE} AND NOT is_method")
def callers_free_functions(t):
    return t["v_calls"].filter("not is_method").join(free_names(t["v_functions"]).select(F.col("name").alias("callee")), "callee", "left_semi").select("path", "caller", "callee", "line")


@query(f"SELECT {CALL_COLUMNS} FROM v_calls WHERE guess = (SELECT min(qualified_name) FROM v_functions WHERE qualified_name LIKE '%::%')")
def callers_qualified(t):
    q = t["v_functions"].filter("qualified_name like '%::%'").agg(F.min("qualified_name").alias("guess"))
    return t["v_calls"].join(F.broadcast(q), "guess", "left_semi").select("path", "caller", "callee", "line")  # one row


@query(f"SELECT {CALL_COLUMNS} FROM v_calls WHERE caller = (SELECT qualified_name FROM v_functions WHERE id = {SYMBOL_ID})")
def callees(t):
    q = t["v_functions"].filter(f"id = {SYMBOL_ID}").select(F.col("qualified_name").alias("caller"))
    return t["v_calls"].join(q, "caller", "left_semi").select("path", "caller", "callee", "line")


@query(f"WITH g AS ({GRADED}) SELECT src_id, dst_id, line, is_method, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN EXISTS (SELECT 1 FROM v_functions f WHERE f.qualified_name = guess) THEN guess END AS resolved_callee FROM g")
def grade_calls(t):
    return G.grade_calls(t["v_calls"], t["v_functions"]).select("src_id", "dst_id", "line", "is_method", "confidence", "resolved_callee")


@query(f"WITH g AS ({GRADED}) SELECT regexp_extract(caller, '([^:.]*)$', 1) AS src, regexp_extract(callee, '([^:.]*)$', 1) AS dst, CAST(max(confidence) AS DOUBLE) AS confidence FROM g WHERE regexp_extract(caller, '([^:.]*)$', 1) <> regexp_extract(callee, '([^:.]*)$', 1) GROUP BY 1, 2")
def resolved_edges(t):
    return G.call_edges(G.grade_calls(t["v_calls"], t["v_functions"]))


@query(f"WITH g AS ({GRADED}) SELECT caller, CASE WHEN confidence >= 0.85 THEN 'exact' WHEN confidence >= 0.5 THEN 'inferred' ELSE 'ambiguous' END AS certainty, count(*) AS n FROM g GROUP BY 1, 2")
def callers_by_certainty(t):
    return G.grade_calls(t["v_calls"], t["v_functions"]).groupBy("caller", G.certainty(F.col("confidence")).alias("certainty")).agg(F.count(F.lit(1)).alias("n"))


CHAIN_DEPTH = 12
#: Breadth-first levels to the end, or to a depth: a node is kept once, at the level that reaches it first.
BFS = """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src_id AS s, dst_id AS d FROM v_calls WHERE src_id <> dst_id),
r(node, depth) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.d, min(r.depth) + 1 FROM r JOIN e ON e.s = r.node WHERE {within} AND NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.node = e.d) GROUP BY e.d)
SELECT {out} FROM r {tail}"""


def _edges(t, reverse: bool = False) -> DataFrame:
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    return t["v_calls"].filter("src_id <> dst_id").select(F.col(a).alias("src"), F.col(b).alias("dst"))


def _seed(t, node: int) -> DataFrame:
    return t.spark.range(1).select(F.lit(node).cast("long").alias("node"))


@query(BFS.format(within="true", out="node, CAST(depth AS INTEGER) AS depth", tail=""))
def bfs_distances(t):
    return G.walk(_edges(t), _seed(t, 0)).select("node", "depth")


@query(BFS.format(within=f"r.depth < {CHAIN_DEPTH}", out="CAST(max(depth) AS INTEGER) AS hops", tail="WHERE node = (SELECT max(dst_id) FROM v_calls WHERE dst_id < 150)"))
def call_chain(t):
    goal = t["v_calls"].filter("dst_id < 150").agg(F.max("dst_id")).first()[0]
    return G.shortest_path(_edges(t), 0, goal, CHAIN_DEPTH).agg(F.max("step").alias("hops"))


#: Steps that the SQL texts unroll; they return the first one that changes ranks by less than 1e-6 in all, as the queries do.
STEPS = 40


def pagerank_sql(a: str, b: str, p: str = "") -> str:
    """CTEs up to ``{p}out`` (node, rank)."""
    ctes = [
        f"{p}e AS MATERIALIZED (SELECT {a} AS s, {b} AS d, count(*) AS w FROM v_calls WHERE src_id <> dst_id GROUP BY 1, 2)",
        f"{p}l AS MATERIALIZED (SELECT s, d, w / sum(w) OVER (PARTITION BY s) AS share FROM {p}e)",
        f"{p}n AS MATERIALIZED (SELECT count(*) AS n FROM v_functions)",
        f"{p}x AS MATERIALIZED (SELECT id AS node, id NOT IN (SELECT s FROM {p}l) AS dangling FROM v_functions)",
        f"{p}r0 AS MATERIALIZED (SELECT id AS node, CAST(1 AS DOUBLE) / n AS rank FROM v_functions, {p}n)",
    ]
    for k in range(STEPS):
        got = f"(SELECT d AS node, sum(rank * share) AS got FROM {p}r{k} JOIN {p}l ON {p}l.s = {p}r{k}.node GROUP BY d)"
        loose = f"(SELECT coalesce(sum(rank), 0) AS dang FROM {p}r{k} JOIN {p}x USING (node) WHERE dangling)"
        ctes.append(f"{p}r{k + 1} AS MATERIALIZED (SELECT f.node, 0.15 / n + 0.85 * (coalesce(got, 0) + dang / n) AS rank FROM {p}x f LEFT JOIN {got} g ON g.node = f.node CROSS JOIN {loose} h CROSS JOIN {p}n)")
    ctes.append(f"{p}c AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.rank - b.rank)) AS change FROM {p}r{k} a JOIN {p}r{k - 1} b USING (node)" for k in range(1, STEPS + 1)) + ")")
    ctes.append(f"{p}stop AS MATERIALIZED (SELECT min(k) AS k FROM {p}c WHERE change < 1e-6)")
    ctes.append(f"{p}out AS (" + " UNION ALL ".join(f"SELECT node, rank FROM {p}r{k} WHERE {k} = (SELECT k FROM {p}stop)" for k in range(1, STEPS + 1)) + ")")
    return ", ".join(ctes)


def _nodes(t) -> DataFrame:
    return t["v_functions"].select(F.col("id").alias("node"))


@query(f"WITH {pagerank_sql('src_id', 'dst_id')} SELECT node, round(rank, 9) AS rank FROM out")
def pagerank_authority(t):
    return G.pagerank(_edges(t), _nodes(t)).select("node", F.round("rank", 9).alias("rank"))


@query(f"WITH {pagerank_sql('dst_id', 'src_id')} SELECT node, round(rank, 9) AS rank FROM out")
def pagerank_hub(t):
    return G.pagerank(_edges(t, reverse=True), _nodes(t)).select("node", F.round("rank", 9).alias("rank"))


@query(f"WITH {pagerank_sql('src_id', 'dst_id', 'a')}, {pagerank_sql('dst_id', 'src_id', 'h')}, b AS (SELECT a.node, sqrt(a.rank * h.rank) AS r FROM aout a JOIN hout h ON h.node = a.node) SELECT node, round(r / max(r) OVER (), 6) AS rank FROM b")
def symbol_rank(t):
    return G.symbol_rank(_edges(t), _nodes(t))


FILE_EDGES = f"SELECT a.path AS a, b.path AS b, a.is_test AS from_test, round(sum(greatest(confidence, 0.3)), 6) AS w FROM ({GRADED}) c JOIN v_functions a ON a.id = c.src_id JOIN v_functions b ON b.id = c.dst_id WHERE a.path <> b.path GROUP BY 1, 2, 3"


@query(f"SELECT a, b, from_test, CAST(w AS DOUBLE) AS w FROM ({FILE_EDGES}) x")
def file_graph_edges(t):
    f = t["v_functions"]
    graded = G.grade_calls(t["v_calls"], f).select("src_id", "dst_id", "confidence")
    a = f.select(F.col("id").alias("src_id"), F.col("path").alias("a"), F.col("is_test").alias("from_test"))
    b = f.select(F.col("id").alias("dst_id"), F.col("path").alias("b"))
    both = graded.join(a, "src_id").join(b, "dst_id").filter("a <> b")
    return both.groupBy("a", "b", "from_test").agg(F.round(F.sum(F.greatest("confidence", F.lit(0.3))), 6).alias("w"))


@query()
def subsystems_louvain(t):
    edges = file_graph_edges(t).filter("not from_test").withColumn("scope", F.lit("all"))
    return G.subsystems(edges.select("scope", "a", "b", "w"))


@query("SELECT f.id, count(c.src_id) AS callers FROM v_functions f JOIN v_calls c ON c.dst_id = f.id JOIN v_functions a ON a.id = c.src_id WHERE NOT a.is_test GROUP BY f.id ORDER BY callers DESC, f.id LIMIT 50")
def hubs(t):
    production = t["v_functions"].filter("not is_test").select(F.col("id").alias("src_id"))
    return R.top(t["v_calls"].join(production, "src_id", "left_semi").groupBy(F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("callers")), 50, F.desc("callers"), F.col("id"))


SCORE = f"round(greatest(0.0, least(importance, 5.0)) / 5 + least(0.03 * access_count, 1.0) - CASE WHEN importance >= 5 OR last_accessed_at IS NULL THEN 0.0 ELSE least(0.005 * greatest(0.0, epoch(TIMESTAMP '{NOW}' - date_trunc('second', last_accessed_at)) / 3600.0), 0.5) END, 6)"


@query(f"SELECT id, CAST({SCORE} AS DOUBLE) AS score FROM v_memories")
def effective_score(t):
    return t["v_memories"].select("id", M.effective_score(F.col("importance"), F.col("access_count"), F.col("last_accessed_at"), NOW).alias("score"))


@query("SELECT id, project FROM v_memories WHERE importance >= 5 AND status = 'active'")
def l0_records(t):
    return t["v_memories"].filter(M.is_always_on(F.col("importance")) & (F.col("status") == "active")).select("id", "project")


@query("SELECT project, count(*) AS n FROM v_memories WHERE NOT starts_with(project, '__') GROUP BY project")
def project_list(t):
    return t["v_memories"].filter("not startswith(project, '__')").groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, project, CAST(floor(epoch(TIMESTAMP '{NOW}' - date_trunc('second', last_accessed_at)) / 86400) AS BIGINT) AS idle_days FROM v_memories WHERE status = 'active' AND importance <= 2 AND floor(epoch(TIMESTAMP '{NOW}' - date_trunc('second', last_accessed_at)) / 86400) >= 90")
def curate_stale(t):
    return M.curate_stale(t["v_memories"], NOW)


PAIRS = r"""WITH b AS (SELECT project, doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3))) AS t FROM v_memories),
c AS (SELECT project, t, min(doc_id) AS k FROM b WHERE len(t) > 0 GROUP BY project, t)
SELECT x.project, x.k AS a, y.k AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard
FROM c x JOIN c y ON x.project = y.project AND x.k < y.k AND len(x.t) >= 0.8 * len(y.t) AND len(y.t) >= 0.8 * len(x.t) WHERE round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) >= 0.8"""


@query(PAIRS)
def curate_pairs(t):
    return M.similar_pairs(t["v_memories"])


@query(r"""WITH b AS (SELECT project, doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3))) AS t FROM v_memories)
SELECT project, doc_id, min(doc_id) OVER (PARTITION BY project, t) AS representative FROM b WHERE len(t) > 0""")
def curate_members(t):
    return M.class_members(t["v_memories"]).select("project", "doc_id", "representative")


@query()
def curate_greedy(t):
    return M.curate_copies(t["v_memories"])


@query("""WITH p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, 1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d FROM embeddings x JOIN embeddings y ON y.label = x.label AND y.vec_id < x.vec_id),
n AS (SELECT label, a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) SELECT label, a, b, round(d, 6) AS distance FROM n WHERE r = 1 AND d < 0.75""")
def dedup_gate(t):
    return M.nearest_same_project(t["embeddings"], 0.75)


@query(r"""SELECT doc_id, regexp_replace(text, '(token = ")[0-9a-f]{40}(")?', '\1[REDACTED:assigned-secret]\2', 'g') AS text FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}')""")
def redact_secrets(t):
    return t["documents"].filter(F.size(T.redacted_kinds(F.col("text"))) > 0).select("doc_id", T.redact_secrets(F.col("text")).alias("text"))


@query(r"""SELECT conv_id, turn, list_filter(list_distinct_ordered, lambda x: true) AS tokens FROM (SELECT conv_id, turn, list_reduce(list_prepend([''], list_transform(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
lambda x: strlen(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'into', 'over', 'per', 'via', 'does', 'has', 'have', 'are', 'was', 'were', 'will', 'can', 'should', 'would', 'could', 'its', 'any', 'all', 'not', 'but', 'how', 'such', 'when', 'where', 'there', 'already', 'you', 'your', 'our', 'their', 'them', 'they', 'his', 'her', 'who', 'why', 'what')),
lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END)[2:] AS list_distinct_ordered FROM conversations)""")
def salient_tokens(t):
    return t["conversations"].select("conv_id", "turn", T.salient_tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT id, list_filter(string_split_regex(regexp_replace(regexp_replace(concat(name, 'HTTPServerFoo'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[_\-. ]+'), lambda x: x <> '') AS pieces FROM v_functions""")
def split_identifiers(t):
    return t["v_functions"].select("id", T.split_identifier(F.concat(F.col("name"), F.lit("HTTPServerFoo"))).alias("pieces"))


@query(r"""WITH q AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS q FROM conversations), s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(q, '([.!?？])', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM q)
SELECT conv_id, turn, CASE WHEN length(q) <= 200 THEN q ELSE left(coalesce(list_filter(s, lambda x: (contains(x, '?') OR contains(x, '？')) AND length(x) >= 5)[1], list_filter(s, lambda x: length(x) >= 10)[-1], q), 300) END AS query FROM s""")
def sanitize_queries(t):
    return t["conversations"].select("conv_id", "turn", T.sanitize_query(F.col("text")).alias("query"))


@query("""WITH u AS (SELECT conv_id, max({'t': turn, 'x': text}) AS m FROM conversations WHERE role = 'user' AND length(trim(text)) >= 8 GROUP BY 1), a AS (SELECT conv_id, max({'t': turn, 'x': text}) AS m FROM conversations WHERE role = 'assistant' AND length(trim(text)) >= 80 GROUP BY 1)
SELECT c.conv_id, u.m.x AS last_user, a.m.x AS last_assistant FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON u.conv_id = c.conv_id LEFT JOIN a ON a.conv_id = c.conv_id""")
def transcript_digest(t):
    return M.transcript_digest(t["conversations"])


@query("SELECT id, project, kind FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY id DESC) AS n FROM v_runs) WHERE n <= 500")
def prune_runs(t):
    return M.newest_runs(t["v_runs"]).select("id", "project", "kind")


@query("SELECT id, project, kind, ok FROM v_runs WHERE project = 'p1' ORDER BY ran_at DESC, id DESC LIMIT 20")
def recent_runs(t):
    return R.top(t["v_runs"].filter("project = 'p1'"), 20, F.desc("ran_at"), F.desc("id")).select("id", "project", "kind", "ok")


@query("SELECT project, max(ran_at) AS ran_at, arg_max(kind, {'r': ran_at, 'i': id}) AS kind FROM v_runs WHERE ok AND wide GROUP BY project")
def last_green(t):
    return M.last_green(t["v_runs"].filter("wide"), ["project"])


FILE_RUN = "SELECT f.path, concat('p', f.id % 5) AS project, e.ts + INTERVAL 27 DAY AS changed_at FROM v_files f JOIN events e ON e.event_id = f.id"


@query(f"""WITH f AS ({FILE_RUN}), g AS (SELECT x.path, max(r.ran_at) AS t FROM v_runs r JOIN v_files x ON x.id = r.id % (SELECT count(*) FROM v_files) WHERE r.ok AND NOT r.wide GROUP BY 1), w AS (SELECT project, max(ran_at) AS w FROM v_runs WHERE ok AND wide GROUP BY 1),
c AS (SELECT f.*, CASE WHEN t IS NOT NULL AND (w IS NULL OR t >= w) THEN t ELSE w END AS covered_at FROM f LEFT JOIN g ON g.path = f.path LEFT JOIN w ON w.project = f.project) SELECT path, project, changed_at, covered_at FROM c WHERE covered_at IS NULL OR changed_at >= covered_at""")
def stale_files(t):
    files = t["v_files"]
    changed = files.join(t["events"].select(F.col("event_id").alias("id"), F.expr("ts + interval 27 days").alias("changed_at")), "id").select("path", F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("project"), "changed_at")
    n = files.count()
    runs = t["v_runs"].filter("ok and not wide").select((F.col("id") % n).alias("id"), "ran_at")
    targeted = runs.join(files.select("id", "path"), "id").groupBy("path").agg(F.max("ran_at").alias("ran_at"))
    return M.stale_files(changed, targeted, M.last_green(t["v_runs"].filter("wide"), ["project"]))


@query("SELECT CASE WHEN e.vec_id IS NULL THEN 'pending' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'embedded' END AS state, count(*) AS n FROM documents d FULL OUTER JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def drift_report(t):
    both = t["documents"].select("doc_id").join(t["embeddings"].select("vec_id"), F.col("doc_id") == F.col("vec_id"), "full_outer")
    return both.groupBy(F.when(F.col("vec_id").isNull(), "pending").when(F.col("doc_id").isNull(), "orphan").otherwise("embedded").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) GROUP BY 1")
def embed_cache_misses(t):
    pending = t["documents"].join(t["embeddings"].select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return pending.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT user_id, max({'t': ts, 'e': event_id}).e AS event_id FROM events GROUP BY user_id")
def stream_upsert(t):
    """Events as a stream of file changes, merged batch by batch: the newest event of every user."""
    base = G.shared_folder(t.spark)
    schema = t["events"].schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    import uuid

    read = S.maintain(stream.select("user_id", "ts", "event_id"), t.spark, f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}", "user_id", ["ts", "event_id"])
    return read().select("user_id", "event_id")


@query("""SELECT c.* FROM (VALUES ('cargo test --workspace', 'test', true), ('cd x && RUST_LOG=debug cargo test -p core', 'test', false), ('npm run build > out.log', 'build', true), ('pytest tests/a.py', 'test', false), ('ls -la', NULL, NULL)) c(command, kind, wide)""")
def classify_commands(t):
    rows = [("cargo test --workspace",), ("cd x && RUST_LOG=debug cargo test -p core",), ("npm run build > out.log",), ("pytest tests/a.py",), ("ls -la",)]
    return t.spark.createDataFrame(rows, "command string").withColumn("r", T.classify_command(F.col("command"))).select("command", "r.kind", "r.wide")


@query("""SELECT * FROM (VALUES ('7 passed; 0 failed', 'pass'), ('2 failed, 10 passed, 1 skipped', 'fail'), ('nothing to say', 'unknown'), ('', 'unknown'), ('test failed', 'fail'), ('12 passed in 1.2s', 'pass')) c(output, outcome)""")
def run_outcomes(t):
    rows = [("7 passed; 0 failed",), ("2 failed, 10 passed, 1 skipped",), ("nothing to say",), ("",), ("test failed",), ("12 passed in 1.2s",)]
    return t.spark.createDataFrame(rows, "output string").withColumn("outcome", T.run_outcome(F.col("output")))




from . import catalog_code, catalog_memory, catalog_search  # noqa: E402, F401
