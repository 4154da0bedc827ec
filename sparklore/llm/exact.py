"""Exact duplicates: counting quotient filters find repeated fingerprints, bytes confirm them.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
largest doc_id stays (null ids come last; of rows that repeat that id one stays). Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, meeting, slices, small, with_possible

FP, SHA = "_fp", "_sha"
#: Rows whose fingerprints a segment of the filters holds on average, and segments at least.
ROWS_PER_SEGMENT = 250_000
MIN_SEGMENTS = 64


class CountingQuotientFilter:
    """A lossless multiset of ``bits``-wide fingerprints.

    A fingerprint is split into a quotient (its ``qbits`` high bits) and a remainder. ``occupied`` has a bit for each
    quotient in use, ``run_end`` one for each stored remainder that closes its quotient's run; remainders are sorted
    inside a run. Counts above one are kept beside the slots.
    """

    def __init__(self, bits: int, qbits: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.qbits = bits, qbits
        self.occupied, self.run_end, self.remainders, self.counts = occupied, run_end, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int, qbits: int) -> CountingQuotientFilter:
        distinct, counts = np.unique(fingerprints, return_counts=True)
        return cls.of_sorted(distinct, counts, bits, qbits)

    @classmethod
    def of_sorted(cls, distinct: np.ndarray, counts: np.ndarray, bits: int, qbits: int) -> CountingQuotientFilter:
        """From distinct fingerprints in order, and their counts."""
        quotients = (distinct >> np.uint64(bits - qbits)).astype(np.int64)
        occupied = np.zeros(1 << qbits, bool)
        occupied[quotients] = True
        run_end = np.r_[quotients[1:] != quotients[:-1], True] if len(distinct) else np.empty(0, bool)
        return cls(bits, qbits, occupied, run_end, distinct & np.uint64((1 << (bits - qbits)) - 1), counts)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order, and their counts."""
        runs = np.cumsum(np.r_[0, self.run_end[:-1]]).astype(np.int64) if len(self.run_end) else np.empty(0, np.int64)
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[runs]
        return (quotients << np.uint64(self.bits - self.qbits)) | self.remainders, self.counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter for all, of the widest quotient among them: runs are merged pair by pair in order of their remainders
        and counts add up, so nothing is lost and nothing is sorted again."""
        parts = [f.entries() for f in filters]
        while len(parts) > 1:
            parts = [merged_entries(*parts[k], *parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return cls.of_sorted(*parts[0], filters[0].bits, max(f.qbits for f in filters))

    def to_bytes(self) -> bytes:
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.bits, self.qbits, len(self.remainders), len(many)], "<u4").tobytes()
        return b"".join((head, np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), self.remainders.astype("<u8").tobytes(), many.astype("<u4").tobytes(), self.counts[many].astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, qbits, n, m = (int(x) for x in np.frombuffer(data, "<u4", 4))
        at = 16

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        occupied = np.unpackbits(take("u1", ((1 << qbits) + 7) // 8), count=1 << qbits).astype(bool)
        run_end = np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(bool)
        remainders, counts = take("<u8", n).astype(np.uint64), np.ones(n, np.int64)
        many = take("<u4", m)
        counts[many] = take("<i8", m)
        return cls(bits, qbits, occupied, run_end, remainders, counts)


def merged_entries(values: np.ndarray, counts: np.ndarray, others: np.ndarray, other_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of distinct fingerprints in order and their counts as one: each entry's place follows from a search in the other."""
    at = np.searchsorted(values, others)
    there = np.zeros(len(others), bool)
    inside = at < len(values)
    there[inside] = values[at[inside]] == others[inside]
    counts = counts.copy()
    counts[at[there]] += other_counts[there]
    new = ~there
    places = at[new] + np.arange(int(new.sum()))
    out, out_counts = np.empty(len(values) + len(places), np.uint64), np.empty(len(values) + len(places), np.int64)
    own = np.ones(len(out), bool)
    own[places] = False
    out[places], out_counts[places] = others[new], other_counts[new]
    out[own], out_counts[own] = values, counts
    return out, out_counts


def with_digests(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, the 64-bit fingerprint ``_fp`` and the hex SHA-256 ``_sha`` of the normalised text."""
    wide = T.StructType([*docs.schema.fields, T.StructField(FP, T.LongType()), T.StructField(SHA, T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(x or b"").lower() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            prints = pa.array(np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64))
            shas = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints, shas], [*batch.schema.names, FP, SHA])

    return docs.mapInArrow(digest, wide)


def repeated_fingerprints(prints: DataFrame, segments: int | None = None, qbits: int = 12) -> DataFrame:
    """Fingerprints that occur more than once, as (``_fp``, ``n``).

    Every partition builds one filter for each segment (range) of the fingerprint space, of eight bytes a row; a segment's
    filters meet in one task. The number of segments follows from the number of rows, so a task's share does not grow.
    """
    segments = segments or max(MIN_SEGMENTS, prints.count() // ROWS_PER_SEGMENT)
    levels = max(1, (segments - 1).bit_length())
    bits = 64 - levels

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.sort(np.concatenate([np.empty(0, np.uint64), *(frame[FP].to_numpy(np.int64).view(np.uint64) for frame in frames)]))
        if not len(values):
            return
        owners = (values >> np.uint64(bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        width = min(qbits, max(1, int(len(values) / len(cuts)).bit_length()))
        filters = [CountingQuotientFilter.build(part & np.uint64((1 << bits) - 1), bits, width).to_bytes() for part in np.split(values, cuts[1:])]
        yield pd.DataFrame({"segment": owners[cuts], "filter": filters})

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in frame["filter"]]).entries()
        many = counts > 1
        return pd.DataFrame({FP: (values[many] | (np.uint64(int(key[0])) << np.uint64(bits))).view(np.int64), "n": counts[many]})

    return prints.select(FP).mapInPandas(build, "segment long, filter binary").groupBy("segment").applyInPandas(merge, f"{FP} long, n long")


def duplicate_groups(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """One row per group of two or more equal texts: ``_fp``, ``_sha``, keep_id, keep_row and group_size; checkpointed.

    ``digests`` is the checkpointed (doc_id, _row, _fp, _sha) of ``docs``. Texts whose fingerprint repeats are compared
    byte by byte: the rows that share a text must be as many as those that share its digest.
    """
    repeated = checkpointed(repeated_fingerprints(digests).select(FP))
    rows = digests.join(small(repeated), FP)
    top = F.max(F.struct("doc_id", "_row"))
    groups = rows.groupBy(FP, SHA).agg(top.alias("_top"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    same = F.col("group_size") == F.col("_bytes_n")
    safe = F.when(same, F.col("group_size")).otherwise(F.raise_error(F.lit("texts with one SHA-256 differ in bytes")).cast("long"))
    checked = groups.join(texts_by_bytes(docs, repeated), [FP, SHA])
    return checkpointed(checked.select(FP, SHA, F.col("_top.doc_id").alias("keep_id"), F.col("_top._row").alias("keep_row"), safe.alias("group_size")))


def texts_by_bytes(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Count the rows of each normalised text among those whose fingerprint is in the checkpointed ``repeated``.

    A Bloom filter of bounded size keeps other texts where they are; copies meet as one row per task first.
    """

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(x or b"").lower() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            prints = pa.array(np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([prints, pa.array(texts, pa.binary())], [FP, "_norm"])

    texts = docs.select("text").mapInArrow(normalise, f"{FP} long, _norm binary").withColumn("_norm", F.col("_norm").cast("string"))
    routed = with_possible(texts, F.col(FP), repeated, FP).filter("_possible").drop("_possible")
    counts = routed.join(small(repeated), FP, "left_semi").groupBy(FP, "_norm").agg(F.count(F.lit(1)).alias("_bytes_n"))
    return counts.select(FP, F.sha2(F.col("_norm").cast("binary"), 256).alias(SHA), "_bytes_n")


def digest_rows(docs: DataFrame) -> DataFrame:
    """The checkpointed (doc_id, _row, _fp, _sha) of every row."""
    return checkpointed(with_digests(docs.select("doc_id", "text")).select("doc_id", FP, SHA).withColumn("_row", F.monotonically_increasing_id()))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = digest_rows(docs)
    joined = digests.join(small(duplicate_groups(docs, digests)), [FP, SHA], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("keep_row"))).alias("kept"),
        F.col(SHA).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Texts stay where they are while the table of groups is small enough to be broadcast. Beyond that, a Bloom filter
    parts the texts that may have a copy, which meet their group by shuffling, from all others.
    """
    digests = digest_rows(docs)
    groups = duplicate_groups(docs, digests)
    again = digests.join(small(groups), [FP, SHA]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(FP, SHA).agg(F.count(F.lit(1)).alias("_ties"))
    marked = checkpointed(groups.join(again, [FP, SHA]).select(FP, SHA, F.col("keep_id").alias("_keep"), "_ties"))
    rows, alone = meeting(with_digests(docs), F.col(FP), marked, FP)
    joined = rows.join(small(marked), [FP, SHA], "left")
    stays = joined.filter(F.col("_ties").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep")))
    once = stays.filter("_ties is null or _ties = 1").select(*docs.columns)
    if marked.filter("_ties > 1").isEmpty():
        out = once
    else:
        out = once.unionByName(stays.filter("_ties > 1").dropDuplicates([FP, SHA]).select(*docs.columns))
    return out if alone is None else out.unionByName(alone.select(*docs.columns))
