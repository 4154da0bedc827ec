"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, mixture, packing, pii, quality, shards, simhash, suffixes, urls, warc
from .common import scratch_path, table

#: The surrogates' key in the query; a deployment passes its own secret.
PII_KEY = "sparklore-demonstration-key"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(table(spark, sf_dir, "documents")).drop("row_key")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages.select("page_id", "url"), urls.junk_listed(pages))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_warc, op3_shards, op4_quality, op5_suffixes, op6_mixture, op7_pii, op8_urls, op9_exact, op10_packing)}

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = rf"string_split_regex(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_SPACE}+')"

ORACLE = {
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN g.least IS NOT NULL AND g.least IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.least IS NOT NULL AND g.least IS DISTINCT FROM page_id THEN g.least END AS refers_to
FROM p LEFT JOIN g ON g.h = p.h AND p.n >= 100""",
    "op4_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
  list_filter({_WORDS}, lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
e AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 9),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM e),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, CAST(sum(least(8, coalesce(i - lag_i, 8))) AS BIGINT) AS n
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS lag_i FROM rep) GROUP BY rid),
f AS (SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
  coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov ON cov.rid = d.rid),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  10 * n_symbols > n_words OR word_chars > 15 * n_words OR 3 * n_dup_lines > n_lines AS strict_failed FROM f),
h AS (SELECT source, count(*) AS n, CAST(count_if(base_failed OR strict_failed) AS BIGINT) AS k FROM r GROUP BY source),
a AS (SELECT CAST(count(*) AS DOUBLE) AS h, CAST(sum(n) AS DOUBLE) AS nt, CAST(sum(k) AS DOUBLE) AS kt, CAST(sum(n * n) AS DOUBLE) AS nn, sum(CAST(k AS DOUBLE) * k / n) AS kk FROM h),
b0 AS (SELECT kt / nt AS m, nt, h, (nt - nn / nt) - (h - 1) AS free, kk FROM a),
b1 AS (SELECT m, nt, CASE WHEN m > 0 AND m < 1 AND free > 0 THEN ((kk - nt * m * m) / (m * (1 - m)) - (h - 1)) / free END AS alike FROM b0),
b AS (SELECT m, CASE WHEN alike IS NULL THEN 10.0 WHEN alike > 0 THEN least(1 / alike - 1, nt) ELSE nt END AS s FROM b1),
x AS (SELECT source, (k + m * s) / (n + s) > {quality.MAX_RATE} AS host_rejected FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_rejected AND strict_failed) AS kept
FROM r JOIN x ON x.source IS NOT DISTINCT FROM r.source""",
    "op6_mixture": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter({_WORDS}, lambda x: x <> '')) AS BIGINT) AS size,
  md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
n AS (SELECT greatest(8, CAST(ceil(count(*) / {mixture.ROWS_PER_SHARD}.0) AS BIGINT)) AS shards FROM d),
r AS (SELECT d.*, CAST('0x' || substr(k, 1, 8) AS BIGINT) % shards AS shard FROM d, n),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM r GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s0),
s2 AS (SELECT *, (rk - 1) % 3 + 1 AS w, 3 * ss AS cap, sum(ss) OVER () AS total, count(*) OVER () AS ns FROM s1),
s3 AS (SELECT *, row_number() OVER o AS place, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2 WINDOW o AS (ORDER BY cap / w, rk)),
s4 AS (SELECT *, (SELECT lvl FROM s3 WHERE cap >= lvl * w ORDER BY place LIMIT 1) AS fin FROM s3),
s5 AS (SELECT source, ss, rk, CAST(total AS BIGINT) AS total, least(CAST(cap AS DOUBLE), fin * w) AS target,
  greatest(1, least({mixture.BLOCK_WORDS}, CAST(total AS BIGINT) // (ns * {mixture.BLOCKS_PER_SOURCE}))) AS b FROM s4),
q0 AS (SELECT source, target / (2 * j + 1) AS q, rk, j, round_even(total / b, 0) AS seats
  FROM s5, LATERAL (SELECT unnest(range(0, CAST(ceil(target / b) AS BIGINT) + 40)) AS j)),
q1 AS (SELECT source, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY q DESC, rk, j) AS o FROM q0) WHERE o <= seats GROUP BY source),
c0 AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell FROM r GROUP BY source, shard),
c1 AS (SELECT c0.*, ss, target, b, coalesce(blocks, 0) AS blocks FROM c0 JOIN s5 ON s5.source IS NOT DISTINCT FROM c0.source LEFT JOIN q1 ON q1.source IS NOT DISTINCT FROM c0.source),
c2 AS (SELECT source, shard, cell / (2 * j + 1) AS q, j, blocks
  FROM c1, LATERAL (SELECT unnest(range(0, CAST(ceil(blocks * cell / greatest(ss, 1)) AS BIGINT) + 20)) AS j)),
c3 AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, j) AS o FROM c2) WHERE o <= blocks GROUP BY source, shard),
c4 AS (SELECT c1.*, least(coalesce(quota, 0) * b, 3 * cell) AS take,
  CASE WHEN cell > 0 THEN CAST('0x' || substr(md5('7:' || coalesce(c1.source, '') || ':' || c1.shard), 1, 8) AS BIGINT) % CAST(ceil(cell / b) AS BIGINT) * b ELSE 0 END AS f
  FROM c1 LEFT JOIN c3 ON c3.source IS NOT DISTINCT FROM c1.source AND c3.shard = c1.shard),
t AS (SELECT doc_id, source, shard, size, sum(size) OVER (PARTITION BY source, shard ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop FROM r)
SELECT doc_id, size, ss AS source_size, target, CAST(CASE WHEN cell > 0 THEN take // cell * size
  + greatest(0, least(stop, f + take % cell) - greatest(stop - size, f)) + greatest(0, least(stop, f + take % cell - cell) - (stop - size)) ELSE 0 END AS BIGINT) AS taken
FROM t JOIN c4 ON c4.source IS NOT DISTINCT FROM t.source AND c4.shard = t.shard""",
    "op8_urls": r"""
WITH u AS (SELECT page_id, html, url,
  coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS q FROM pages),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.', '')
  || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical FROM u),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(html, '<title>[^<]*(%%%|###|[*][*][*]|[$][$][$]|&&&)[^<]*</title>') AND canonical <> ''),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
j AS (SELECT c.page_id, c.host, c.path, c.canonical,
  (SELECT arg_max({'rule': h || p, 'verdict': verdict}, length(h || p)) FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS x FROM c)
SELECT page_id, host, path, x.rule AS rule, coalesce(x.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM j LEFT JOIN l ON l.canonical = j.canonical""",
    "op9_exact": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
}
