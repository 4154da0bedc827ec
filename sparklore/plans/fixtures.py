"""The code-graph, memory and ledger tables, derived from the driver tables. The texts run in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_files": "SELECT s.s_suppkey AS id, concat('src/r', n.n_regionkey, '/n', n.n_nationkey, '/s', s.s_suppkey, CASE s.s_suppkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.ts' ELSE '.php' END) AS path, concat('n', n.n_nationkey) AS module, CASE s.s_suppkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'typescript' ELSE 'php' END AS language FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey",
    "v_functions": "SELECT p.p_partkey AS id, f.id AS file_id, f.path, f.module, f.language, concat(replace(p.p_name, ' ', '_'), '_', p.p_partkey % 40) AS name, CASE WHEN p.p_size % 2 = 0 THEN concat(replace(p.p_brand, '#', ''), '::', replace(p.p_name, ' ', '_'), '_', p.p_partkey % 40) ELSE concat(replace(p.p_name, ' ', '_'), '_', p.p_partkey % 40) END AS qualified_name, 100 + p.p_partkey AS line_start, 100 + p.p_partkey + p.p_size AS line_end, p.p_partkey % 10 = 0 AS is_test FROM part p CROSS JOIN (SELECT count(*) AS ns FROM supplier) c JOIN v_files f ON f.id = p.p_partkey % c.ns",
    "v_calls": "SELECT a.path, a.module, a.id AS src_id, b.id AS dst_id, a.qualified_name AS caller, b.name AS callee, CASE WHEN l.l_linestatus = 'F' THEN b.qualified_name END AS guess, l.l_returnflag = 'R' AS is_method, l.l_linenumber AS line FROM (SELECT l_partkey, l_discount, l_returnflag, l_linestatus, l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nxt FROM lineitem) l JOIN v_functions a ON a.id = l.l_partkey JOIN v_functions b ON b.id = l.nxt WHERE l.l_discount < 0.015",
    "v_memories": "SELECT concat('mem_', lpad(CAST(d.doc_id AS STRING), 8, '0'), '__', d.source) AS id, d.doc_id, d.source AS project, d.text AS content, CASE d.doc_id % 7 WHEN 0 THEN 'decision' WHEN 1 THEN 'progress' WHEN 2 THEN 'context' WHEN 3 THEN 'bug' WHEN 4 THEN 'todo' WHEN 5 THEN 'code' ELSE 'general' END AS category, CASE WHEN l.toxic = 1 THEN 'resolved' ELSE 'active' END AS status, CAST(d.doc_id % 6 AS DOUBLE) AS importance, d.doc_id % 50 AS access_count, e.ts AS last_accessed_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN events e ON e.event_id = d.doc_id",
    "v_runs": "SELECT event_id AS id, concat('p', user_id % 5) AS project, CASE event_type WHEN 'view' THEN 'test' WHEN 'click' THEN 'build' WHEN 'signup' THEN 'lint' WHEN 'purchase' THEN 'typecheck' ELSE 'other' END AS kind, event_type <> 'error' AS ok, event_id % 3 = 0 AS wide, ts AS ran_at FROM events",
    "v_bodies": "SELECT f.id, f.file_id, f.path, f.module, f.language, f.name, f.qualified_name, f.line_start, f.line_end, f.is_test, concat('fn ', f.name, chr(10), coalesce(d.text, ''), chr(10), CASE WHEN f.id % 3 = 0 THEN concat('use ', g.name) ELSE 'end' END) AS body FROM v_functions f CROSS JOIN (SELECT count(*) AS nf FROM part) c JOIN v_functions g ON g.id = (f.id * 7 + 3) % c.nf LEFT JOIN documents d ON d.doc_id = f.id",
    "v_classes": "SELECT min(f.id) AS id, f.file_id, f.path, f.module, f.language, split_part(f.qualified_name, '::', 1) AS name, concat(f.module, '::', split_part(f.qualified_name, '::', 1)) AS qualified_name, min(f.line_start) - 1 AS line_start, max(f.line_end) + 1 AS line_end, concat('[\"Brand', min(f.id) % 5 + 1, min(f.id) % 3 + 1, '\"]') AS bases, concat(CASE WHEN min(f.id) % 4 = 0 THEN 'trait ' ELSE 'class ' END, split_part(f.qualified_name, '::', 1)) AS body FROM v_functions f WHERE f.qualified_name LIKE '%::%' GROUP BY f.file_id, f.path, f.module, f.language, split_part(f.qualified_name, '::', 1)",
    "v_imports": "SELECT a.path, a.file_id, a.module, concat(b.module, '/s', b.file_id) AS target, min(b.name) AS name, min(c.line) AS line FROM v_calls c JOIN v_functions a ON a.id = c.src_id JOIN v_functions b ON b.id = c.dst_id WHERE a.file_id <> b.file_id GROUP BY a.path, a.file_id, a.module, b.module, b.file_id",
    "v_routes": "SELECT p.page_id AS id, CASE p.page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method, regexp_extract(p.url, '://[^/]+(/[^?#]*)', 1) AS route, f.name AS handler_method, CASE WHEN f.qualified_name LIKE '%::%' THEN split_part(f.qualified_name, '::', 1) END AS handler_class, f.path, f.line_start AS line FROM pages p CROSS JOIN (SELECT count(*) AS nf FROM part) c JOIN v_functions f ON f.id = (p.page_id * 13 + 5) % c.nf",
    "v_notes": "SELECT m.id, m.doc_id, m.project, m.content, m.category, m.status, m.importance, m.access_count, m.last_accessed_at, CASE m.doc_id % 3 WHEN 0 THEN m.last_accessed_at - INTERVAL 10 DAY WHEN 1 THEN m.last_accessed_at - INTERVAL 60 DAY ELSE m.last_accessed_at - INTERVAL 120 DAY END AS created_at, CASE m.doc_id % 5 WHEN 0 THEN '[\"L0 \",\"core\"]' WHEN 1 THEN '[\"sid:abc\"]' WHEN 2 THEN '[\"chat:k1\",\"note\"]' ELSE '[]' END AS tags FROM v_memories m",
    "v_run_files": "SELECT r.id AS run_id, r.project, r.kind, r.ok, r.ran_at, f.path FROM v_runs r CROSS JOIN (SELECT count(*) AS nf FROM supplier) c JOIN v_files f ON f.id = (r.id * 5 + 1) % c.nf WHERE NOT r.wide",
    "v_chunks": "SELECT f.id, CASE WHEN f.id % 17 = 0 THEN concat('gone/', f.path) ELSE f.path END AS path, f.qualified_name, f.name, concat(f.path, ' ', f.qualified_name, ' ', f.line_start) AS chunk_text FROM v_functions f",
}


class Tables:
    """Driver tables and derived views of one folder, each built on first use (no global temporary names)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._counts = spark, folder, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = self._with_counts(VIEWS[name])
        words = set(text.replace("(", " ").replace(")", " ").split())
        used = [t for t in [*TABLES, *VIEWS] if t in words and t != name]
        return self.spark.sql(_braced(text, used), **{t: self[t] for t in used})

    def _with_counts(self, text: str) -> str:
        """Cross joins with the count of a table as that number. As a relation it stands between two tables whose only equality needs it,
        and a filter that reads both then makes Spark join these first, by nested loops."""
        for found, column, table, alias in re.findall(r"(CROSS JOIN \(SELECT count\(\*\) AS (\w+) FROM (\w+)\) (\w+) )", text):
            if table not in self._counts:
                self._counts[table] = self[table].count()
            text = re.sub(rf"\b{alias}\.{column}\b", f"{self._counts[table]}L" if self._counts[table] else "CAST(NULL AS BIGINT)", text.replace(found, ""))
        return text


def _braced(text: str, names: list[str]) -> str:
    """``FROM name`` and ``JOIN name`` as parameters of spark.sql, so that views need no catalog entry."""
    for name in names:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name} ", f"{word} {{{name}}} {name if f' {name}.' in text else ''} ").replace(f"{word} {name})", f"{word} {{{name}}})")
        if text.endswith(f"FROM {name}"):
            text = text[: -len(name)] + f"{{{name}}}"
    return text


def with_views(sql: str) -> str:
    """DuckDB text with the views it uses as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in need:
                add(VIEWS[name])
                need.append(name)

    add(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}{', ' if ctes else ''}{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}{', ' if ctes else ''}{body[5:]}"
    return f"WITH {ctes} {body}" if ctes else body
