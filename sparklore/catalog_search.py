"""Registered queries on code search, existence and similarity, with their DuckDB texts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph as G
from .operators import retrieval as R
from .registry import query

TERMS = ["herean", "thention", "the", "wholly"]
#: Symbols with the text that a search reads, and how much their name is called, from 0 to 1.
INDEXED = """SELECT b.id, b.name, concat_ws(' ', b.name, b.qualified_name, b.body) AS text, coalesce(n.n, 0) / (SELECT max(n) FROM (SELECT count(*) AS n FROM v_calls GROUP BY callee) m) AS rank FROM v_bodies b LEFT JOIN (SELECT callee, count(*) AS n FROM v_calls GROUP BY callee) n ON n.callee = b.name"""


def indexed(t) -> DataFrame:
    called = t["v_calls"].groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    most = called.agg(F.max("_n").alias("_most"))
    joined = t["v_bodies"].join(called, "name", "left").join(F.broadcast(most))  # one row
    return joined.select("id", "name", F.concat_ws(" ", "name", "qualified_name", "body").alias("text"), (F.coalesce("_n", F.lit(0)) / F.col("_most")).alias("rank"))


def search_sql(needle: str, terms: list[str], n: int) -> str:
    each = " UNION ALL ".join(f"SELECT k, {i} AS q, count(*) AS tf FROM w WHERE starts_with(t, '{x}') GROUP BY k" for i, x in enumerate(terms))
    return f"""WITH s AS MATERIALIZED ({INDEXED}), w AS MATERIALIZED (SELECT id AS k, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM s), dl AS (SELECT k, count(*) AS dl FROM w GROUP BY k),
st AS (SELECT (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM s) AS av), p AS ({each}), df AS (SELECT q, count(*) AS df FROM p GROUP BY q),
z AS (SELECT p.k, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM p JOIN dl ON dl.k = p.k JOIN df ON df.q = p.q CROSS JOIN st GROUP BY p.k)
SELECT s.id, s.name, CAST(round(z.score + CASE WHEN lower(s.name) = '{needle}' THEN 1000.0 WHEN starts_with(lower(s.name), '{needle}') OR starts_with('{needle}', lower(s.name)) THEN 500.0 ELSE 0.0 END + 5.0 * s.rank, 5) AS DOUBLE) AS score FROM z JOIN s ON s.id = z.k ORDER BY score DESC, s.id LIMIT {n}"""


@query(search_sql("small_ring_0", ["small", "ring", "0"], 20))
def lexical_name_boost(t):
    """A symbol's name first, then what starts so, then what only mentions it."""
    return R.search_code(indexed(t), "small_ring_0", 20)


@query(search_sql("rin bol", ["rin", "bol"], 30))
def search_code(t):
    """Two prefix terms."""
    return R.search_code(indexed(t), "rin bol", 30)


@query(search_sql("sma", ["sma"], 100000))
def search_code_all(t):
    """Every hit of a prefix, without a cut."""
    return R.search_code(indexed(t), "sma", 100_000)


@query(f"""WITH tok AS (SELECT doc_id AS k, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM documents), w AS (SELECT * FROM tok WHERE t <> ''), dl AS (SELECT k, count(*) AS dl FROM w GROUP BY k),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents) AS av), p AS (SELECT k, t, count(*) AS tf FROM w WHERE t IN ({", ".join(f"'{x}'" for x in TERMS)}) GROUP BY k, t), df AS (SELECT t, count(*) AS df FROM p GROUP BY t)
SELECT p.k AS doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM p JOIN dl ON dl.k = p.k JOIN df ON df.t = p.t CROSS JOIN st GROUP BY p.k""")
def lexical_index(t):
    """An index is written to the shared folder and asked; every hit."""
    from .operators.graph import shared_folder

    folder = f"{shared_folder(t.spark).rstrip('/')}/lexical-{uuid.uuid4().hex}"
    return R.LexicalIndex.write(t["documents"], "doc_id", "text", folder).search(TERMS, "doc_id")


@query()
def semantic_search(t):
    """Chunks nearest to a sentence under the deterministic embedding; tested against brute force."""
    chunks = t["v_chunks"]
    return R.semantic_search(chunks, R.embedded(chunks, "id", "chunk_text"), R.bag_vector("src r1 n1 small ring Brand12", 64), 20)


@query()
def find_similar(t):
    """Functions alike by two MinHash views of their bodies; tested against sets of shingles."""
    bodies = t["v_bodies"]
    return R.similar_code(R.code_signatures(bodies, "id", "body"), "id", 100, 20, own=R.code_signatures(bodies.filter("id = 100"), "id", "body"))


QUESTIONS = ("small_ring_0", "small ring 0 wholly", "metal gear route", "wholly", "the src zzz", "of it", "zzyzx qqq", "/fr/8")


def exists_sql(asked: str) -> str:
    tokens = [x for x in dict.fromkeys(w for w in re.split(r"[\W_]+", asked.lower()) if len(w) >= 3) if x not in T.STOP_WORDS]
    if not tokens:
        return f"SELECT '{asked}' AS query, 'absent' AS verdict, CAST(0.0 AS DOUBLE) AS confidence, NULL AS kind"
    listed, generic = "[" + ", ".join(f"'{x}'" for x in tokens) + "]", "[" + ", ".join(f"'{x}'" for x in R.GENERIC) + "]"
    focused = "true" if len(asked.split()) == 1 else "false"
    held = " + ".join(f"CAST(contains(hay, '{x}') AS INTEGER)" for x in tokens)
    words = " OR ".join(f"contains(lower(body), '{x}')" for x in tokens)
    return f"""SELECT '{asked}' AS query, * FROM (WITH s0 AS (SELECT name, list_distinct(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[:._\\s-]+'), lambda x: length(x) >= 2)) AS p FROM (SELECT name FROM v_functions UNION ALL SELECT name FROM v_classes) b),
s1 AS (SELECT name, p, list_filter({listed}, lambda y: y = lower(name) OR list_contains(p, y)) AS m, ({focused} AND lower(name) = '{asked.lower()}') OR list_contains({listed}, lower(name)) AS exact FROM s0),
s2 AS (SELECT exact, len(m) AS n, {focused} OR (len(m) >= 2 AND (len(list_filter(m, lambda y: NOT list_contains({generic}, y))) > 0 OR (len(p) > 0 AND len(list_filter(p, lambda y: NOT list_contains(m, y))) = 0))) AS worthy FROM s1 WHERE exact OR len(m) > 0),
s3 AS (SELECT exact, max(n) AS n, bool_or(worthy) AS worthy FROM s2 x WHERE n = (SELECT max(n) FROM s2 y WHERE y.exact = x.exact) GROUP BY exact),
r AS (SELECT max({held}) AS n FROM (SELECT lower(concat_ws(' ', route, coalesce(handler_method, ''), coalesce(handler_class, ''))) AS hay FROM v_routes) h),
f AS (SELECT CASE WHEN worthy THEN 1 ELSE 4 END AS o, CASE WHEN worthy THEN 'exists' ELSE 'weak' END AS verdict, CASE WHEN worthy THEN CASE WHEN n >= 2 THEN 0.92 ELSE 0.85 END ELSE 0.5 END AS confidence, 'exact' AS kind FROM s3 WHERE exact
UNION ALL SELECT CASE WHEN {focused} OR n >= 2 THEN 2 ELSE 5 END, CASE WHEN {focused} OR n >= 2 THEN 'exists' ELSE 'weak' END, CASE WHEN {focused} OR n >= 2 THEN 0.8 ELSE 0.45 END, 'route' FROM r WHERE n > 0
UNION ALL SELECT CASE WHEN worthy THEN 3 ELSE 6 END, CASE WHEN worthy THEN 'exists' ELSE 'weak' END, CASE WHEN worthy THEN CASE WHEN n >= 2 THEN 0.82 ELSE 0.65 END ELSE 0.45 END, 'name' FROM s3 WHERE NOT exact
UNION ALL SELECT 7, 'weak', 0.3, 'body' WHERE EXISTS (SELECT 1 FROM v_bodies WHERE {words}) UNION ALL SELECT 8, 'absent', 0.65, NULL)
SELECT verdict, CAST(confidence AS DOUBLE) AS confidence, kind FROM f ORDER BY o LIMIT 1) z"""


@query(" UNION ALL ".join(f"SELECT * FROM ({exists_sql(q)}) q{i}" for i, q in enumerate(QUESTIONS)))
def check_exists(t):
    """Eight questions, so that every kind of answer is given."""
    symbols = G.cut(t["v_functions"].select("name", "qualified_name", "path").unionByName(t["v_classes"].select("name", "qualified_name", "path")))
    routes, bodies = G.cut(t["v_routes"]), G.cut(t["v_bodies"].select("path", "body"))
    ask = lambda q: R.check_exists(symbols, routes, bodies, q).select(F.lit(q).alias("query"), "verdict", "confidence", "kind")
    return G.union_all([ask(q) for q in QUESTIONS])


@query(r"""SELECT doc_id, list_contains(regexp_extract_all(text, '[A-Za-z0-9_]+'), 'the') AS holds, array_to_string(string_split(text, chr(10))[-2:], chr(10)) AS tail FROM documents""")
def identifiers_and_tails(t):
    """Whether a text holds a whole identifier, and its last two lines."""
    text = F.col("text")
    return t["documents"].select("doc_id", F.coalesce(T.contains_identifier(text, "the"), F.lit(False)).alias("holds"), T.output_tail(text, 2).alias("tail"))


@query(r"""WITH w AS (SELECT id, unnest(range(1, len(x) + 1)) AS i, x FROM (SELECT id, regexp_extract_all(concat(name, ' ', qualified_name), '[A-Za-z_][A-Za-z0-9_]*') AS x FROM v_functions) a),
p AS (SELECT id, i, 0 AS j, x[i] AS piece FROM w UNION ALL SELECT id, i, k, list_filter(string_split(x[i], '_'), lambda y: y <> '')[k] FROM (SELECT id, i, x, unnest(range(1, len(list_filter(string_split(x[i], '_'), lambda y: y <> '')) + 1)) AS k FROM w) b),
f AS (SELECT id, lower(piece) AS l, arg_min(piece, i * 1000 + j) AS piece, min(i * 1000 + j) AS o FROM p GROUP BY 1, 2) SELECT id, string_agg(piece, ' ' ORDER BY o) AS search_text FROM f GROUP BY id""")
def search_text(t):
    """What an index keeps of a function's names: identifiers and their pieces, the first spelling of each."""
    return t["v_functions"].select("id", T.search_text(F.concat_ws(" ", "name", "qualified_name")).alias("search_text"))
