"""Host-level quality rules with an empirical beta prior; DataFrame functions only.

A document's ``source`` is its host. Base rules are absolute: fewer than 20 words, or over 30 % of the words in 8-word
windows that the text repeats. Every host's rate of documents that fail a base rule or a strict one is shrunk toward all
hosts by a beta prior fitted to the hosts' counts by moments. In a host whose shrunk rate is above ``max_rate``, documents
that fail a strict rule go too; clean documents stay in any host. A null text has no words; a null source is a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, checkpointed, meeting, small

WINDOW = 8
#: A host is held to the strict rules where its shrunk rate is above one in ten.
MAX_RATE = 0.1
#: Hosts up to this many are broadcast (some 50 bytes each); more are joined by shuffling.
BROADCAST_HOSTS = 100_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur at two places or more. Arrays are bound once by a one-element transform."""
    spans = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = F.transform(F.array(pairs), lambda p: F.array_sort(F.transform(F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])), lambda x: x["i"])))
        total = F.aggregate(
            F.get(starts, F.lit(0)),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(0)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(F.get(F.transform(F.array(spans), covered), F.lit(0)))


def _once(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a one-row generator: later filters and projections refer to it and never compute it again."""
    return docs.select("*", F.explode(F.array(value)).alias(name))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of FEATURES, ``base_failed`` and ``strict_failed`` added (as columns with a leading _)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    parts = _once(docs, "_parts", F.struct(words.alias("words"), lines.alias("lines")))
    counts = F.struct(
        F.size("_parts.words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_parts.lines").cast("long").alias("n_lines"),
        (F.size("_parts.lines") - F.size(F.array_distinct("_parts.lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_parts.words")).cast("long").alias("n_repeat_words"),
    )
    counted = _once(parts, "_counts", counts).select(*docs.columns, *[F.col(f"_counts.{x}").alias(f"_{x}") for x in (*FEATURES, "n_lines")])
    base = (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))
    strict = (10 * F.col("_n_symbols") > F.col("_n_words")) | (F.col("_word_chars") > 15 * F.col("_n_words")) | (3 * F.col("_n_dup_lines") > F.col("_n_lines"))
    return counted.withColumn("_base_failed", base).withColumn("_strict_failed", strict).drop("_n_lines")


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per source: ``_host``, n_docs, n_failed, shrunk_rate and ``host_rejected``.

    The prior is a beta fitted by moments of the beta-binomial: hosts weigh by their documents, and the part of the spread
    that chance alone gives hosts of their sizes is taken off, so small hosts do not widen it. Where no spread is left the
    prior weighs as much as all documents; where sizes tell nothing (one document a host) as much as ten.
    """
    failed = (F.col("_base_failed") | F.col("_strict_failed")).cast("long")
    hosts = measured.groupBy(F.col("source").alias("_host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"))
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")).first()
    mean, strength = prior(sums["hosts"], sums["n"] or 0.0, sums["k"] or 0.0, sums["nn"] or 0.0, sums["kk"] or 0.0)
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_rejected", F.col("shrunk_rate") > max_rate)


def prior(hosts: int, n: float, k: float, nn: float, kk: float) -> tuple[float, float]:
    """Mean and weight (alpha + beta) of the prior from the sums over hosts of 1, n, k, n * n and k * k / n."""
    mean = k / n if n else 0.0
    free = (n - nn / n) - (hosts - 1) if n else 0.0
    if not 0 < mean < 1 or free <= 0:
        return mean, 10.0
    alike = ((kk - n * mean * mean) / (mean * (1 - mean)) - (hosts - 1)) / free
    return mean, min(1 / alike - 1, n) if alike > 0 else n


def judged(docs: DataFrame, measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with features (computed here) joined with the verdicts of the hosts in ``measured``; adds ``_kept``."""
    hosts = checkpointed(host_verdicts(measured, max_rate).select("_host", "host_rejected"))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = docs.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("_kept", ~F.col("_base_failed") & ~(F.col("host_rejected") & F.col("_strict_failed"))).drop("_host", "host_rejected")


def quality_report(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document; rows that repeat are judged alike, each for itself."""
    measured = checkpointed(features(docs.select("doc_id", "text", "source")).drop("text"))
    out = judged(measured, measured, max_rate)
    return out.select("doc_id", *[F.col(f"_{x}").alias(x) for x in FEATURES], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns kept. Features are computed once and kept without texts; the
    rejected rows (id, hash of the text, host) are then taken out of ``docs``. Equal rows of a host are judged alike."""
    row = ("doc_id", F.xxhash64("text").alias("_text"), "source")
    measured = checkpointed(features(docs.select("doc_id", "text", "source")).select(*row, "_base_failed", "_strict_failed"))
    bad = checkpointed(judged(measured, measured, max_rate).filter("not _kept").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), F.col("source").alias("_host")).distinct())
    rows, rest = meeting(docs.withColumn("_text", F.xxhash64("text")), F.col("_text"), bad, "_hash")
    same = (F.col("_text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_host"))
    out = rows.join(small(bad), same, "left_anti").select(*docs.columns)
    return out if rest is None else out.unionByName(rest.select(*docs.columns))
