"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that parts words: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only in local mode without it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sparklore-"))
    return configured or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Words of 64 bits in a Bloom filter at most: its broadcast is bounded whatever the list's length. A list too long for it
#: lets more rows through to the exact join and changes no result.
MOST_WORDS = 1 << 18
#: Rows of a checkpointed table that are broadcast at most, where a row has a few hundred bytes.
BROADCAST_ROWS = 50_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table, to be broadcast if it has at most ``rows`` rows and to be joined by shuffling beyond."""
    return F.broadcast(table) if table.count() <= rows else table


def bloom_bits(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a blocked Bloom filter that a key falls in, and the key's four bits in it."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    mask = None
    for shift in (0, 6, 12, 18):
        bit = F.call_function("shiftleft", one, F.shiftrightunsigned(g, shift).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(h, F.lit(words)).cast("int"), mask


def bloom_size(keys: int) -> int:
    """Words for so many keys, four keys a word, from 64 to MOST_WORDS."""
    return min(MOST_WORDS, 1 << max(6, math.ceil(math.log2(max(1, keys) / 4))))


def bloom_words(listed: DataFrame, key: str, words: int) -> DataFrame:
    """(_word, _bits): the filter of the keys in ``listed``, at most ``words`` rows."""
    word, mask = bloom_bits(F.col(key), words)
    return listed.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def with_possible(rows: DataFrame, key: Column, listed: DataFrame, column: str, name: str = "_possible") -> DataFrame:
    """Adds whether ``key`` may be among the ``column`` of the checkpointed ``listed``: false only where it is not."""
    words = bloom_size(listed.count())
    word, mask = bloom_bits(key, words)
    probed = rows.withColumn("_at", word).withColumn("_need", mask).join(F.broadcast(bloom_words(listed, column, words)), F.col("_at") == F.col("_word"), "left")
    found = F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(F.col("_need")) == F.col("_need")
    return probed.withColumn(name, found & key.isNotNull()).drop("_at", "_need", "_word", "_bits")


def meeting(rows: DataFrame, key: Column, listed: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` that may meet the checkpointed ``listed`` in a join on ``key``, and the rest. All of them, without a rest, where
    ``listed`` is small enough to be broadcast; else a Bloom filter parts them, so that only possible partners are shuffled."""
    if listed.count() <= BROADCAST_ROWS:
        return rows, None
    parted = with_possible(rows, key, listed, column)
    return parted.filter("_possible").drop("_possible"), parted.filter("not _possible").drop("_possible")


def gapless_rank(df: DataFrame, key: str, order: list[str], out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps.

    A key's rows are dealt into hash buckets, ranked inside their bucket and shifted by the bucket's offset, so no task
    holds a whole key. ``df`` should be checkpointed: it is read twice. Rows equal in ``order`` may be numbered either way.
    """
    buckets = max(8, math.ceil(df.count() / rows_per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return dealt.join(offsets, [key, "_bucket"]).withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1).drop("_bucket", "_offset")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small slices, so that a worker never holds a whole batch as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shielded(docs: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``docs`` with columns beyond DOCUMENT_COLUMNS under neutral names, so that they clash with nothing, and (new, old) names."""
    names = [(c if c in DOCUMENT_COLUMNS else f"_extra{i}", c) for i, c in enumerate(docs.columns)]
    return docs.toDF(*[new for new, _ in names]), names


def unshielded(docs: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    return docs.select(*[new for new, _ in names]).toDF(*[old for _, old in names])


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")
