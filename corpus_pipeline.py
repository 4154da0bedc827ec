"""From raw documents to packed training sequences.

Every stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``. Extra
columns pass through under neutral names, so they may clash with nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparklore.llm import exact, mixture, packing, quality, simhash
from sparklore.llm.common import remove_path, scratch_path, shielded, table, unshielded

#: Near-duplicate stage: words in a shingle, and the Jaccard similarity of the sets of shingles at which texts link.
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8
#: Earlier stages leave an executor with several Python workers; each may keep this many words a generation.
CACHED_WORDS = 50_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _whole(step: Callable[[DataFrame], DataFrame]) -> Stage:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner, names = shielded(docs)
        return unshielded(step(inner), names)

    return stage


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cached_words=CACHED_WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _whole(quality.keep_good)),
    ("exact_dedup", _whole(exact.drop_exact_duplicates)),
    ("simhash_near_dedup", _whole(lambda docs: simhash.drop_near_duplicates(docs, NEAR_WORDS, NEAR_SIMILARITY))),
    ("mix_sources", _whole(mixture.apply_mix)),
    ("best_fit_packing", pack_stage),
]

#: The last stage tokenises, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next, then removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
