"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

At every level a row draws ``-ln(u) / weight`` for each child, with ``u`` a hash of the doc_id and the child's name, and
descends into the least draw. A child's draw depends on its own weight alone, so a changed weight moves rows only into
or out of that child's subtree. The first ``base`` shards form the regular tree; each shard added later comes as a
region of its own with one rack, hence it takes rows only into itself (the ``key`` law). A null doc_id is hashed as 0
beside its own mark; rows that repeat a doc_id share its shard. Sizes: UTF-8 bytes of the text (null: none) plus 8.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gapless_rank


@dataclass(frozen=True)
class HashTree:
    """``weights[region][rack]`` lists the weights of the shards there; shards are numbered in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def regular(cls, shards: int, base: int = 24, regions: int = 2, racks: int = 3, weight: float = 1.0) -> HashTree:
        per_rack, left = divmod(base, regions * racks)
        assert not left and shards >= 1
        tree = tuple(tuple((weight,) * per_rack for _ in range(racks)) for _ in range(regions)) if shards >= base else ()
        return cls(tree + (((weight,),),) * (shards - base if shards >= base else shards))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


def _least_draw(doc_id: Column, level: str, parents: list[Column], weights: list[tuple[int, Column]]) -> Column:
    """The child with the least weighted draw; a child without weight is never drawn."""

    def draw(child: int, weight: Column) -> Column:
        # 52 bits of the hash as a number strictly between 0 and 1
        bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.lit(level), *parents, F.lit(child)), 12)
        return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / weight

    return F.array_min(F.filter(F.array(*[F.struct(draw(k, w).alias("draw"), F.lit(k).alias("child")) for k, w in weights]), lambda x: x["draw"].isNotNull()))["child"]


def place(doc_id: Column, tree: HashTree) -> Column:
    """The shard of a doc_id: three weighted draws, none of which looks at other rows."""
    sums = [[sum(rack) for rack in region] for region in tree.weights]
    region = _least_draw(doc_id, "region", [], [(k, F.lit(float(sum(x)))) for k, x in enumerate(sums)])

    def of(rows: list[list[float]], at: Column, k: int) -> Column:
        """Weight of child k below the parent numbered ``at``; null where it has no such child."""
        return F.get(F.array(*[F.lit(float(x[k])) if k < len(x) else F.lit(None).cast("double") for x in rows]), at)

    rack = _least_draw(doc_id, "rack", [region], [(k, of(sums, region, k)) for k in range(max(map(len, sums)))])
    width = max(map(len, sums))
    leaves = [list(x[k]) if k < len(x) else [] for x in tree.weights for k in range(width)]
    at = region * width + rack
    shard = _least_draw(doc_id, "shard", [region, rack], [(k, of(leaves, at, k)) for k in range(max(map(len, leaves)))])
    starts, total = [], 0
    for x in leaves:
        starts.append(total)
        total += len(x)
    return (F.get(F.array(*[F.lit(x) for x in starts]), at) + shard).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, tree: HashTree | None = None, grown: HashTree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in its shard), grown_shard (with one shard more)."""
    tree, grown = tree or HashTree.regular(shards), grown or HashTree.regular(shards + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), tree).alias("shard"),
        place(F.col("doc_id"), grown).alias("grown_shard"),
    )
    ranked = gapless_rank(checkpointed(rows), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
