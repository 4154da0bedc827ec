"""URL filters: prefix rules first, then a list of canonical URLs behind a blocked Bloom filter; DataFrame functions only.

A null url or one without ``://`` has an empty host and path, no rule, and is allowed unless its (empty) canonical form is
listed, which never happens: empty forms are not listed. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, with_possible

#: Verdict, host, path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Query parameters that only track.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
#: Symbols that mark a junk title.
JUNK_TITLE = "<title>[^<]*(%%%|###|[*][*][*]|[$][$][$]|&&&)[^<]*</title>"

def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` or a closing slash, parameters sorted without trackers."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    bare_host = F.regexp_replace(host(url), r"^(www|m)\.", "")
    bare_path = F.regexp_replace(F.regexp_replace(path(url), r"\.html$", ""), "/+$", "")
    whole = F.concat(bare_host, bare_path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(host(url) == "", "").otherwise(F.coalesce(whole, F.lit("")))


def matched_rule(host_column: Column, path_column: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for what, domain, prefix in ordered:
        fits = ((host_column == domain) | host_column.endswith("." + domain)) & path_column.startswith(prefix)
        rule = F.when(fits, domain + prefix) if rule is None else rule.when(fits, domain + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def junk_listed(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages whose title is symbol junk."""
    return pages.filter(F.col("html").rlike(JUNK_TITLE)).select(canonical(F.col("url")).alias("canonical")).filter("canonical <> ''").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict; ``listed`` has a column ``canonical``.

    The list is computed once; the filter's size follows its length, up to the bound of ``bloom_size``. URLs that a rule
    decides or the filter rules out are done; only the rest meets the list in a join, which has the last word.
    """
    listed = checkpointed(listed.select("canonical").distinct())
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_canonical"))
    rule, ruled = matched_rule(F.col("host"), F.col("path"))
    marked = with_possible(rows.withColumn("rule", rule).withColumn("_ruled", ruled), F.col("_canonical"), listed, "canonical")
    probe = F.col("_ruled").isNull() & F.col("_possible")
    out = ["page_id", "host", "path", "rule"]
    passed = marked.filter(~probe).select(*out, F.coalesce("_ruled", F.lit("allow")).alias("verdict"))
    hits = marked.filter(probe).join(listed.withColumnRenamed("canonical", "_listed"), F.col("_canonical") == F.col("_listed"), "left")
    return passed.unionByName(hits.select(*out, F.when(F.col("_listed").isNull(), "allow").otherwise("block").alias("verdict")))
