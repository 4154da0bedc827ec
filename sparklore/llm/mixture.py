"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
three times its source's size and the excess is shared again by weight. The corpus is worth N blocks of B words; sources
get blocks by highest quotients target / (2k + 1), and each source's blocks are dealt to its shards by the same rule on
shard sizes. A shard's rows stand in a seeded order on a ring; whole turns and then one seeded run of blocks are taken,
so no row exceeds three times its size and reruns agree. Null texts have size 0; equal rows are interchangeable.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, word_count

BLOCK_WORDS = 4096
BLOCKS_PER_SOURCE = 2000
ROWS_PER_SHARD = 100_000
MIN_SHARDS = 8
MOST_REPEATS = 3


def sainte_lague(values: np.ndarray, seats: int) -> np.ndarray:
    """Seats for each value by the highest quotients value / (2k + 1); ties go to the earlier value.

    The divisor that gives no more than ``seats`` is found by halving an interval, and only the last seats, at most about
    one for each value, are contested one by one; nothing grows with the number of seats.
    """
    values = np.asarray(values, float)
    total = values.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(values), np.int64)
    rounded = lambda step: np.floor(values / step + 0.5).astype(np.int64)
    low, high = total / (seats + len(values) + 1), 4 * total  # too many or just enough, and none
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if rounded(middle).sum() > seats:
            low = middle
        else:
            high = middle
    # one less for every value, so that a rounding of the divisor gives nobody a seat that another has won
    given = np.maximum(rounded(high) - 1, 0)
    contest = [(-v / (2 * int(k) + 1), i) for i, (v, k) in enumerate(zip(values.tolist(), given.tolist(), strict=True)) if v > 0]
    heapq.heapify(contest)
    for _ in range(seats - int(given.sum())):
        _, i = contest[0]
        given[i] += 1
        heapq.heapreplace(contest, (-values[i] / (2 * int(given[i]) + 1), i))
    return given


def _seed_number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def row_key(seed: int) -> Column:
    """Seeded order of a row, from its doc_id and text alone."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.md5(mark.cast("binary"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank, weight, target from (source, source_size); water-filling in one pass over the sources."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long")).withColumn("cap", MOST_REPEATS * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("place", F.row_number().over(fill))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    )
    free = F.col("cap") >= F.col("level") * F.col("weight")
    marked = levels.withColumn("final", F.min(F.when(free, F.struct("place", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight"))
    return marked.select("source", "source_size", "rank", "weight", "total", target.alias("target"))


def block_quotas(sources: DataFrame) -> DataFrame:
    """Adds ``block`` (words in a block) and ``blocks`` (the source's quota); one row per source, so one task."""
    columns = "source string, source_size long, target double, block long, blocks long"

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", ignore_index=True)
        total = int(frame["total"].iloc[0])
        block = max(1, min(BLOCK_WORDS, total // (len(frame) * BLOCKS_PER_SOURCE)))
        frame["block"] = block
        frame["blocks"] = sainte_lague(frame["target"].to_numpy(), round(total / block))
        return frame[["source", "source_size", "target", "block", "blocks"]]

    return sources.groupBy(F.lit("all").alias("whole")).applyInPandas(share, columns)


def shard_quotas(cells: DataFrame) -> DataFrame:
    """Deals each source's blocks to its shards; a group holds one row per shard."""

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard", ignore_index=True)
        frame["quota"] = sainte_lague(frame["cell"].to_numpy(), int(frame["blocks"].iloc[0]))
        return frame[["source", "shard", "cell", "source_size", "target", "block", "quota"]]

    return cells.groupBy("source").applyInPandas(share, "source string, shard int, cell long, source_size long, target double, block long, quota long")


def mixed(docs: DataFrame, seed: int = 7, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the row's ``row_key``."""
    rows = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key(seed).alias("row_key")))
    shards = max(MIN_SHARDS, math.ceil(rows.count() / rows_per_shard))
    dealt = rows.withColumn("shard", (F.conv(F.substring("row_key", 1, 8), 16, 10).cast("long") % shards).cast("int"))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell"))
    sources = block_quotas(source_targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size"))))
    same = cells["source"].eqNullSafe(sources["source"])
    quotas = shard_quotas(cells.join(sources, same).drop(sources["source"]))
    start = _seed_number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")), F.lit(":"), F.col("shard").cast("string")))
    words = F.least(F.col("quota") * F.col("block"), MOST_REPEATS * F.col("cell"))
    ring = quotas.select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell", "source_size", "target",
        F.when(F.col("cell") > 0, F.expr("least(quota * block, 3 * cell) div cell")).otherwise(0).alias("turns"),
        F.when(F.col("cell") > 0, words % F.col("cell")).otherwise(0).alias("part"),
        F.when(F.col("cell") > 0, start % F.ceil(F.col("cell") / F.col("block")) * F.col("block")).otherwise(0).alias("first"),
    )
    line = Window.partitionBy("source", "shard").orderBy("row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("stop", F.sum("size").over(line)).join(ring, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    begin, last = F.col("stop") - F.col("size"), F.col("first") + F.col("part")
    inside = F.greatest(F.lit(0), F.least(F.col("stop"), last) - F.greatest(begin, F.col("first"))) + F.greatest(F.lit(0), F.least(F.col("stop"), last - F.col("cell")) - begin)
    taken = F.col("turns") * F.col("size") + inside
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "row_key")


def apply_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (to the nearest whole time), all columns kept.

    Rows equal in doc_id and text share what they are given evenly. A row is cut by at most the two ends of its shard's
    run, so rounding moves a shard by one row at most.
    """
    shares = mixed(docs, seed).groupBy("row_key").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    copies = shares.select(F.col("row_key").alias("_key"), F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(0).cast("int").alias("_copies")).filter("_copies > 0")
    joined = docs.withColumn("_key", row_key(seed)).join(copies, "_key")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
