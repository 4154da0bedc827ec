"""Registered queries on the life of memory records, the run ledger and the store's health, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as T
from .operators import graph as G
from .operators import memory as N
from .operators import records as M
from .operators import retrieval as R
from .registry import query

NOW = "2024-06-01 00:00:00"
PROJECT = "src3"
WORDS = ["herean", "thention", "the", "wholly"]
AGE = f"greatest(CAST(floor(epoch(TIMESTAMP '{NOW}' - date_trunc('second', created_at)) / 86400) AS BIGINT), 0)"
STANDING = "(importance >= 5 OR (importance >= 4 AND len(list_intersect(list_transform(from_json(tags, '[\"VARCHAR\"]'), lambda x: lower(trim(x))), ['l0', 'always-on', 'critical'])) > 0))"
SCORE = f"round(greatest(0.0, least(importance, 5.0)) / 5 + least(0.03 * access_count, 1.0) - CASE WHEN {STANDING} OR last_accessed_at IS NULL THEN 0.0 ELSE least(0.005 * greatest(0.0, epoch(TIMESTAMP '{NOW}' - date_trunc('second', last_accessed_at)) / 3600.0), 0.5) END, 6)"
LIST = "from_json(tags, '[\"VARCHAR\"]')"


def bm25(source: str, n: int) -> str:
    """(id, rank) of the best records of a source of (id, content), scores rounded as the operator rounds them."""
    terms = ", ".join(f"'{t}'" for t in WORDS)
    return f"""(WITH s AS ({source}), w AS (SELECT id AS k, unnest(list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM s), dl AS (SELECT k, count(*) AS dl FROM w GROUP BY k),
st AS (SELECT (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM s) AS av), p AS (SELECT k, t, count(*) AS tf FROM w WHERE t IN ({terms}) GROUP BY k, t), df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
z AS (SELECT p.k AS id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM p JOIN dl ON dl.k = p.k JOIN df ON df.t = p.t CROSS JOIN st GROUP BY p.k ORDER BY score DESC, id LIMIT {n})
SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM z)"""


def dense(condition: str, n: int) -> str:
    return f"""(WITH z AS (SELECT n.id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS d FROM embeddings e JOIN v_notes n ON n.doc_id = e.vec_id WHERE {condition} ORDER BY d, n.id LIMIT {n})
SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM z)"""


def fused(condition: str, n: int) -> str:
    return f"""WITH l AS (SELECT * FROM {bm25(f"SELECT id, content FROM v_notes WHERE {condition}", 30)} UNION ALL SELECT * FROM {dense("n." + condition.replace(" AND ", " AND n."), 30)}), f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM l GROUP BY id)
SELECT f.id, CAST(round(s + 0.1 * {SCORE}, 6) AS DOUBLE) AS score FROM f JOIN v_notes n ON n.id = f.id WHERE NOT starts_with(project, '__') ORDER BY score DESC, f.id LIMIT {n}"""


def vectors(t) -> DataFrame:
    return t["embeddings"].join(t["v_notes"].select("id", F.col("doc_id").alias("vec_id")), "vec_id").select("id", "embedding")


def query_vector(t) -> list[float]:
    return t["embeddings"].filter("vec_id = 0").first()["embedding"]


@query(fused(f"project = '{PROJECT}' AND status = 'active'", 10))
def memory_search(t):
    return N.search(t["v_notes"], vectors(t), WORDS, query_vector(t), 10, NOW, PROJECT)


@query(fused("status = 'active'", 20))
def memory_search_all(t):
    return N.search(t["v_notes"], vectors(t), WORDS, query_vector(t), 20, NOW)


@query(fused(f"project = '{PROJECT}' AND category = 'decision' AND status = 'active'", 10))
def why_this_exists(t):
    return N.search(t["v_notes"], vectors(t), WORDS, query_vector(t), 10, NOW, PROJECT, "decision")


@query(f"SELECT id, category FROM v_notes WHERE project = '{PROJECT}' AND status = 'active' ORDER BY created_at DESC, id LIMIT 25")
def memory_list(t):
    return N.listed(t["v_notes"], PROJECT, limit=25).select("id", "category")


@query("SELECT id, project, content FROM v_notes WHERE id = (SELECT max(id) FROM v_notes)")
def memory_get(t):
    newest = t["v_notes"].agg(F.max("id").alias("id"))
    return t["v_notes"].join(F.broadcast(newest), "id", "left_semi").select("id", "project", "content")  # one id


@query(f"SELECT 'tag' AS how, id FROM v_notes WHERE list_contains({LIST}, 'core') UNION ALL SELECT 'prefix', id FROM v_notes WHERE len(list_filter({LIST}, lambda x: starts_with(x, 'sid:'))) > 0")
def find_by_tag(t):
    return G.union_all([N.with_tag(t["v_notes"], tag, prefix).select(F.lit(how).alias("how"), "id") for how, tag, prefix in (("tag", "core", False), ("prefix", "sid:", True))])


@query(f"SELECT id, CAST({SCORE} AS DOUBLE) AS score, row_number() OVER (PARTITION BY project ORDER BY {SCORE} DESC, id) AS place FROM v_notes")
def memory_rank(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id"))
    return N.scored(t["v_notes"], NOW).select("id", "score", place.alias("place"))


@query(f"SELECT id, importance FROM v_notes WHERE project IN ('{PROJECT}', 'src1') AND status = 'active' AND {STANDING} ORDER BY importance DESC, id")
def standing_rules(t):
    return N.standing_rules(t["v_notes"], [PROJECT, "src1"])


@query(f"SELECT project, CASE WHEN d <= 7 THEN 'fresh' WHEN d <= 30 THEN 'recent' WHEN d <= 90 THEN 'aging' ELSE 'stale' END AS age, count(*) AS n FROM (SELECT project, greatest(CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00' - date_trunc('second', created_at)) / 86400) AS BIGINT), 0) AS d FROM v_notes) x GROUP BY 1, 2")
def age_buckets(t):
    """Ages are measured from creation."""
    _, bucket = N.age(F.col("created_at"), F.col("last_accessed_at"), "2024-02-01 00:00:00")
    return t["v_notes"].groupBy("project", bucket.alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query()
def memory_add(t):
    """Every fifth record as a batch against the others, project by project and in order; a fold, tested against brute force."""
    rows = t["embeddings"].select(F.col("label").cast("string").alias("project"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"), "embedding", (F.col("vec_id") % 5 == 0).alias("new"))
    return N.add(rows.filter("not new"), rows.filter("new"), 0.7)


CHANGES = "SELECT id, CASE doc_id % 3 WHEN 0 THEN content WHEN 1 THEN concat(content, '!') END AS content, CASE WHEN doc_id % 2 = 0 THEN '[\"new\"]' END AS tags FROM v_notes WHERE doc_id % 10 = 0 UNION ALL SELECT 'mem_none__x', 'text', NULL"


@query(f"SELECT c.id, coalesce(c.content, n.content) AS content, coalesce(c.tags, n.tags) AS tags, CASE WHEN n.id IS NULL THEN 'unknown' WHEN c.content <> n.content THEN 'embedded' ELSE 'kept' END AS outcome FROM ({CHANGES}) c LEFT JOIN v_notes n ON n.id = c.id")
def memory_update(t):
    some = t["v_notes"].filter("doc_id % 10 = 0")
    content = F.when(F.col("doc_id") % 3 == 0, F.col("content")).when(F.col("doc_id") % 3 == 1, F.concat("content", F.lit("!")))
    changes = some.select("id", content.alias("content"), F.when(F.col("doc_id") % 2 == 0, '["new"]').alias("tags"))
    return N.updated(t["v_notes"], changes.unionByName(t.spark.createDataFrame([("mem_none__x", "text", None)], changes.schema)))


@query(f"SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'resolved' ELSE status END AS status, access_count + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS access_count, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '{NOW}' ELSE last_accessed_at END AS last_accessed_at FROM v_notes WHERE doc_id % 11 <> 0")
def memory_resolve_access_delete(t):
    notes = t["v_notes"]
    pick = lambda n: notes.filter(F.col("doc_id") % n == 0).select("id")
    after = N.accessed(N.resolved(notes, pick(7)), pick(4), NOW)
    return after.join(pick(11), "id", "left_anti").select("id", "status", "access_count", "last_accessed_at")


@query(f"SELECT CASE WHEN project = '{PROJECT}' THEN regexp_replace(id, '__{PROJECT}$', '__renamed') ELSE id END AS id, CASE WHEN project = '{PROJECT}' THEN 'renamed' ELSE project END AS project FROM v_notes")
def rename_project(t):
    return N.renamed(t["v_notes"], PROJECT, "renamed").select("id", "project")


@query("SELECT coalesce(r.name, x.name) AS name, coalesce(r.created_at, x.f) AS created_at, coalesce(x.l, r.last_session_at) AS last_session_at FROM (SELECT project AS name, min(created_at) AS created_at, min(last_accessed_at) AS last_session_at FROM v_notes WHERE doc_id % 3 > 0 GROUP BY 1) r FULL JOIN (SELECT concat('src', user_id % 40) AS name, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1) x ON x.name = r.name")
def touch_projects(t):
    registry = t["v_notes"].filter("doc_id % 3 > 0").groupBy(F.col("project").alias("name")).agg(F.min("created_at").alias("created_at"), F.min("last_accessed_at").alias("last_session_at"))
    return N.touched_projects(registry, t["events"].select(F.concat(F.lit("src"), F.col("user_id") % 40).alias("name"), F.col("ts").alias("at")))


@query("SELECT id, CASE doc_id % 3 WHEN 0 THEN project ELSE 'src1' END AS project, CASE WHEN doc_id % 3 = 0 OR project = 'src1' THEN 'ok' ELSE 'foreign_record' END AS outcome FROM v_notes WHERE doc_id % 9 < 4 UNION ALL SELECT 'mem_none__x', 'src1', 'not_found'")
def ownership_guard(t):
    asked = t["v_notes"].filter("doc_id % 9 < 4").select("id", F.when(F.col("doc_id") % 3 == 0, F.col("project")).otherwise("src1").alias("project"))
    return N.guarded(t["v_notes"], asked.unionByName(t.spark.createDataFrame([("mem_none__x", "src1")], "id string, project string")))


@query(f"SELECT id, project, {AGE} AS age_days FROM v_notes WHERE status = 'active' AND importance <= 1 AND len(list_filter({LIST}, lambda x: starts_with(x, 'sid:'))) > 0 AND category NOT IN ('todo', 'bug', 'decision') AND {AGE} > 14")
def stale_drafts(t):
    return N.stale_drafts(t["v_notes"], NOW)


@query(f"SELECT * FROM (SELECT 'profile' AS section, id FROM v_notes WHERE project = 'src1' AND status = 'active' ORDER BY created_at DESC, id LIMIT 10) a UNION ALL SELECT * FROM (SELECT 'project', id FROM v_notes WHERE project = '{PROJECT}' AND status = 'active' ORDER BY created_at DESC, id LIMIT 8) b")
def session_start(t):
    return N.session_start(t["v_notes"], PROJECT, 8, profile="src1")


@query(f"""WITH p AS (SELECT *, {STANDING} AS l0 FROM v_notes WHERE project = 'src1' AND status = 'active' ORDER BY created_at DESC, id LIMIT 10), c AS (SELECT * FROM v_notes WHERE project = '{PROJECT}' AND status = 'active' ORDER BY created_at DESC, id LIMIT 40),
k AS (SELECT * FROM c WHERE NOT (importance < 2 AND len(list_filter({LIST}, lambda x: starts_with(x, 'sid:'))) > 0 AND category NOT IN ('todo', 'bug', 'decision')) ORDER BY created_at DESC, id LIMIT 8)
SELECT 'profile' AS section, id, row_number() OVER (ORDER BY l0 DESC, importance DESC, created_at DESC, id) - 1 AS place FROM p UNION ALL SELECT 'project', id, row_number() OVER (ORDER BY created_at DESC, id) - 1 FROM k""")
def session_prime(t):
    return N.prime(t["v_notes"], PROJECT, profile="src1")


@query()
def session_end(t):
    """What two completed items close; one item after the other, so without SQL."""
    return N.session_end(t["v_notes"], PROJECT, [WORDS[:2], WORDS[2:]], NOW)


@query(f"""WITH e AS (SELECT project, unnest({LIST}) AS tag, id, tags, created_at FROM v_notes), x AS (SELECT project, tag, arg_max({{'id': id, 'tags': tags}}, {{'c': created_at, 'i': id}}) AS r FROM e GROUP BY 1, 2),
i AS (SELECT DISTINCT project, 'chat:k1' AS tag, concat('done in ', project) AS content FROM v_notes UNION ALL SELECT 'fresh', 'chat:k1', 'done in fresh')
SELECT i.project, i.tag, coalesce(x.r.id, concat('mem_', substr(sha256(concat_ws('|', i.project, i.tag, i.content)), 1, 16), '__', i.project)) AS id, CASE WHEN x.r IS NULL THEN 'created' ELSE 'updated' END AS action,
CASE WHEN x.r IS NULL THEN ['host-session', i.tag] ELSE list_concat(from_json(x.r.tags, '["VARCHAR"]'), list_filter(['host-session', i.tag], lambda y: NOT list_contains(from_json(x.r.tags, '["VARCHAR"]'), y))) END AS tags FROM i LEFT JOIN x ON x.project = i.project AND x.tag = i.tag""")
def chat_upsert(t):
    """One record for each chat: updated by its tag, or created."""
    projects = t["v_notes"].select("project").distinct().union(t.spark.createDataFrame([("fresh",)], "project string"))
    tag = F.lit("chat:k1")
    incoming = projects.select("project", tag.alias("tag"), F.concat(F.lit("done in "), "project").alias("content"), F.array(F.lit("host-session"), tag).alias("tags"))
    return N.by_tag_upsert(t["v_notes"], incoming)


@query()
def curate_report(t):
    """Duplicates and stale records of all projects; a fold, tested against brute force."""
    return N.curate(t["v_notes"], NOW)


@query("""WITH r AS (SELECT * FROM v_runs WHERE project = 'p1' ORDER BY ran_at DESC, id DESC LIMIT 30) SELECT r.id, r.kind, r.ok, list_sort(list(f.path) FILTER (f.path IS NOT NULL)) AS files FROM r LEFT JOIN v_run_files f ON f.run_id = r.id GROUP BY 1, 2, 3""")
def recent_runs_with_files(t):
    newest = R.top(t["v_runs"].filter("project = 'p1'"), 30, F.desc("ran_at"), F.desc("id")).select("id", "kind", "ok")
    files = t["v_run_files"].select(F.col("run_id").alias("id"), "path")
    joined = newest.join(files, "id", "left").groupBy("id", "kind", "ok").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return joined.withColumn("files", F.when(F.size("files") > 0, F.col("files")))


@query("SELECT project, max(ran_at) AS ran_at, arg_max(kind, {'r': ran_at, 'i': id}) AS kind FROM v_runs r WHERE ok AND NOT EXISTS (SELECT 1 FROM v_run_files f WHERE f.run_id = r.id) GROUP BY project")
def last_green_project_run(t):
    wide = t["v_runs"].join(t["v_run_files"].select(F.col("run_id").alias("id")), "id", "left_anti")
    return M.last_green(wide, ["project"])


@query("SELECT project, path, max(ran_at) AS ran_at, arg_max(kind, {'r': ran_at, 'i': run_id}) AS kind FROM v_run_files WHERE ok GROUP BY 1, 2")
def green_file_coverage(t):
    return M.last_green(t["v_run_files"].withColumnRenamed("run_id", "id"), ["project", "path"])


CHANGED = "SELECT f.path, concat('p', f.id % 5) AS project, e.ts AS changed_at FROM v_files f JOIN events e ON e.event_id = f.id * 71 % (SELECT count(*) FROM events)"


@query(f"""WITH f AS ({CHANGED}), g AS (SELECT path, project, max(ran_at) AS t FROM v_run_files WHERE ok GROUP BY 1, 2), w AS (SELECT project, max(ran_at) - INTERVAL 20 DAY AS w FROM v_runs WHERE ok AND wide GROUP BY 1),
c AS (SELECT f.*, CASE WHEN t IS NOT NULL AND (w IS NULL OR t >= w) THEN t ELSE w END AS covered_at FROM f LEFT JOIN g ON g.path = f.path AND g.project = f.project LEFT JOIN w ON w.project = f.project),
n AS (SELECT path, CAST(count_if(is_test) AS BIGINT) AS own_tests FROM v_functions GROUP BY 1)
SELECT c.path, c.project, changed_at, covered_at, coalesce(own_tests, 0) AS own_tests FROM c LEFT JOIN n ON n.path = c.path WHERE covered_at IS NULL OR changed_at >= covered_at ORDER BY changed_at DESC, c.path LIMIT 500""")
def stale_report(t):
    """Files changed after the runs that cover them (wide runs as of twenty days before), newest change first, with the tests they hold."""
    n, files = t["events"].count(), t["v_files"]
    events = t["events"].select(F.col("event_id").alias("_e"), F.col("ts").alias("changed_at"))
    changed = files.withColumn("_e", F.col("id") * 71 % n).join(events, "_e").select("path", F.concat(F.lit("p"), F.col("id") % 5).alias("project"), "changed_at")
    targeted = t["v_run_files"].filter("ok").groupBy("path", "project").agg(F.max("ran_at").alias("ran_at"))
    own = targeted.join(changed.select("path", "project"), ["path", "project"], "left_semi")
    wide = M.last_green(t["v_runs"].filter("wide"), ["project"]).withColumn("ran_at", F.expr("ran_at - interval 20 days"))
    tests = t["v_functions"].groupBy("path").agg(F.count_if("is_test").alias("own_tests"))
    stale = M.stale_files(changed, own, wide).join(tests, "path", "left")
    return R.top(stale.withColumn("own_tests", F.coalesce("own_tests", F.lit(0))), 500, F.desc("changed_at"), F.col("path"))


@query("SELECT session, symbol, first_at FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_at, symbol) AS n FROM (SELECT user_id AS session, f.name AS symbol, min(ts) AS first_at FROM events e JOIN v_functions f ON f.id = e.event_id % 2000 GROUP BY 1, 2) x) y WHERE n <= 8")
def hint_ledger(t):
    """At most eight hints in a session, and a symbol never twice."""
    asked = t["events"].withColumn("id", F.col("event_id") % 2000).join(t["v_functions"].select("id", "name"), "id").select(F.col("user_id").alias("session"), F.col("name").alias("symbol"), F.col("ts").alias("at"))
    return M.hint_ledger(asked)


@query("SELECT 'chunk without file' AS what, count(*) AS n FROM v_chunks c WHERE NOT EXISTS (SELECT 1 FROM v_files f WHERE f.path = c.path) UNION ALL SELECT 'chunk without vector', count(*) FROM v_chunks c WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.id) UNION ALL SELECT 'vector without chunk', count(*) FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM v_chunks c WHERE c.id = e.vec_id AND c.id % 3 > 0)")
def index_drift(t):
    chunks, vecs = t["v_chunks"], t["embeddings"].select(F.col("vec_id").alias("id"))
    parts = (("chunk without file", chunks.join(t["v_files"].select("path"), "path", "left_anti")), ("chunk without vector", chunks.join(vecs, "id", "left_anti")), ("vector without chunk", vecs.join(chunks.filter("id % 3 > 0").select("id"), "id", "left_anti")))
    return G.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, df in parts])


@query("SELECT id, path FROM v_chunks WHERE path IN (SELECT path FROM v_files)")
def prune_ghost_chunks(t):
    return t["v_chunks"].join(t["v_files"].select("path"), "path", "left_semi").select("id", "path")


@query("SELECT c.id, sha256(c.chunk_text) AS content_hash FROM v_chunks c LEFT JOIN embeddings e ON e.vec_id = c.id WHERE e.vec_id IS NULL AND c.id > 100 ORDER BY c.id LIMIT 64")
def pending_embeddings(t):
    """The next chunks to embed after a cursor, with the hash that a cache is asked for."""
    waiting = t["v_chunks"].filter("id > 100").join(t["embeddings"].select(F.col("vec_id").alias("id")), "id", "left_anti")
    return waiting.orderBy("id").limit(64).select("id", F.sha2(F.col("chunk_text").cast("binary"), 256).alias("content_hash"))


@query(r"""SELECT doc_id, CASE WHEN length(l) > 100 THEN concat(left(l, 100), '…') ELSE l END AS preview, CASE WHEN length(text) > 40 THEN concat(left(text, 40), '…') ELSE text END AS cut, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+', ' ', 'g') AS line
FROM (SELECT doc_id, text, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1], '') AS l FROM documents) d""")
def previews(t):
    text = F.col("text")
    return t["documents"].select("doc_id", T.preview(text).alias("preview"), T.truncate(text, 40).alias("cut"), T.one_line(text).alias("line"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS e FROM embeddings) SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6)) AS fitted FROM v""")
def fit_dimensions(t):
    fitted = F.transform(R.fit_dim(F.col("embedding"), 16), lambda x: R.round_as_double(x, 6))
    return t["embeddings"].select("vec_id", fitted.alias("fitted"))


@query("SELECT id, regexp_extract(id, '__(.*)$', 1) AS project, regexp_extract(id, '^mem_([0-9]+)__', 1) AS serial FROM v_notes")
def memory_ids(t):
    return t["v_notes"].select("id", T.project_of(F.col("id")).alias("project"), F.regexp_extract("id", "^mem_([^_]+)__", 1).alias("serial"))


@query(r"""WITH q AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3)) AS w FROM conversations WHERE length(text) <= 200)
SELECT conv_id, turn, list_sort(list_transform(w, lambda x: CASE WHEN length(x) <= 4 THEN x WHEN length(x) = 5 THEN left(x, 4) ELSE left(x, length(x) - 2) END)) AS stems FROM q WHERE len(w) <= 16""")
def query_stems(t):
    """Stems of short messages (long ones are cut to what they ask first, which SQL does not show here)."""
    tokens = T.query_tokens(F.col("text"))
    return t["conversations"].filter((F.length("text") <= 200) & (F.size(T.query_tokens(F.col("text"), 10_000)) <= 16)).select("conv_id", "turn", F.array_sort(F.transform(tokens, T.stem)).alias("stems"))


@query(r"""SELECT id, list_sort(list_distinct(list_filter(string_split(lower(regexp_replace(concat(name, '::', 'parseHTTPBody'), '([a-z])([A-Z])', '\1 \2', 'g')), ' ').list_transform(lambda x: string_split_regex(x, '[:._\s-]+')).flatten(), lambda x: length(x) >= 2))) AS pieces FROM v_functions""")
def verdict_pieces(t):
    return t["v_functions"].select("id", F.array_sort(T.verdict_pieces(F.concat("name", F.lit("::parseHTTPBody")))).alias("pieces"))


@query(f"SELECT project, count(*) AS n, CAST(count_if({STANDING}) AS BIGINT) AS standing FROM v_notes WHERE NOT starts_with(project, '__') AND status = 'active' AND category = 'decision' GROUP BY project")
def passes_filters(t):
    kept = t["v_notes"].filter("not startswith(project, '__') and status = 'active' and category = 'decision'")
    return kept.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_if(M.is_always_on(F.col("importance"), N.tag_list(F.col("tags")))).alias("standing"))


@query("SELECT path, language, CASE WHEN path LIKE '%/s1%' THEN 'unchanged' WHEN path LIKE '%/s2%' THEN 'touch' WHEN path LIKE '%/s3%' THEN 'oversize' WHEN path LIKE '%/s4%' THEN 'deleted' WHEN path LIKE '%/s5%' THEN 'new' ELSE 'reindex' END AS state FROM v_files")
def classify_files(t):
    """Files of a tree against an index of them, dealt into every state."""
    from .sources import ingest as I

    p = F.col("path")
    digit = F.regexp_extract(p, "/s([0-9])[0-9]*[.]", 1).cast("int")
    disk = t["v_files"].filter(digit != 4).select("path", F.when(digit == 3, 2_000_000).otherwise(10).cast("long").alias("size"), F.when(digit == 2, 9).otherwise(1).cast("long").alias("mtime"), F.when(digit.isin(1, 2, 3), "same").otherwise("other").alias("hash"))
    index = t["v_files"].filter(digit != 5).select("path", F.lit(10).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.lit("same").alias("hash"))
    return I.classify(disk, index).join(t["v_files"].select("path", "language"), "path").select("path", "language", "state")


@query("SELECT path, CASE WHEN path LIKE 'src/r1/%' THEN 'src/r1' WHEN path LIKE 'src/r2/n%' THEN regexp_extract(path, '^(src/r2/n[0-9]+)/', 1) ELSE '' END AS module FROM v_files")
def module_of(t):
    """The shallowest folder with a manifest above each file."""
    from .sources import ingest as I

    files = t["v_files"].select("path")
    two = files.filter("path like 'src/r2/%'").select(F.concat(F.regexp_extract("path", "^(src/r2/n[0-9]+)/", 1), F.lit("/Cargo.toml")).alias("path")).distinct()
    one = files.filter("path like 'src/r1/%'").select(F.explode(F.array(F.lit("src/r1/package.json"), F.concat(F.regexp_extract("path", "^(src/r1/n[0-9]+)/", 1), F.lit("/.git")))).alias("path")).distinct()
    return I.module_of(files, one.union(two))


@query("SELECT doc_id, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) l WHERE line BETWEEN 2 AND 3")
def read_file_window(t):
    from .operators import symbols as S

    return S.read_window(t["documents"].select("doc_id", "text"), "doc_id", 2, 3).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query("SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM v_files WHERE path >= 'src/r2/' AND path < 'src/r20'")
def files_under(t):
    return t["v_files"].filter(P.under(F.col("path"), "src/r2")).select("path", P.file_name(F.col("path")).alias("name"))
