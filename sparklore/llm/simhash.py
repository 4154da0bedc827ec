"""SimHash near-duplicates by the generalised pigeonhole principle.

A text (null: empty) is lower-cased in A-Z and cut into words and shingles; a fingerprint bit is set where over half of the
shingles' XXH64 (seed 42) have it; without words the fingerprint is 0. Two fingerprints link at ``radius`` or fewer
differing bits. Correlated bits share a partition; a dynamic program gives partition i a threshold t_i (-1: not probed) with
sum(t_i) = radius - partitions + 1, so that every linked pair is within t_i somewhere, at the least estimated cost. Rows
meet on partition values (t = 0) or on values with t bits masked, and are verified on all 64 bits. Only distinct
fingerprints take part; copies follow their fingerprint. A bucket that outgrows a task is split again by a plain
pigeonhole over other blocks of bits, which loses no link. Classes are found by alternating stars in checkpointed rounds.

Near duplicates at a similarity of shingle sets (``drop_near_duplicates``) need more than one fingerprint of the whole text:
at a Jaccard similarity of 0.8 it differs in about ten of 64 bits, and no probe of that radius finds nearly all such pairs
at a cost that stays linear. So a text's set of shingles is dealt by hash into parts of three to six shingles, the first PARTS
parts get a SimHash each, and texts meet in a bucket where two part fingerprints link at RADIUS or fewer bits, by the same
pigeonhole. Most parts of similar texts are equal, so a pair of 0.8 misses all buckets with a chance below one in a hundred.
Members of a bucket are then held against each other on their whole sets of shingles; only that check links them. Texts
with equal sets are one class; a group of any size is compared without emitting its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, meeting, slices, small

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 2
#: Fingerprints that one task compares at most; larger buckets are split.
BUCKET = 4096
SAMPLED = 16
PARTITION_CHOICES = (2, 3, 4, 5, 6)
#: Cost of moving a key against that of verifying a candidate pair.
KEY_COST = 40.0
#: Shingles in a part of a text at most, on average, and parts of a text that get a fingerprint.
PART_SHINGLES = 6
PARTS = 16
#: Rows that are held against each other in a task; rows of a larger bucket that every one of its blocks meets.
TRIED = 1024
PIVOTS = 8
#: Links that one task connects at most.
ONE_TASK = 200_000
SECOND_SALT = 0xD1B54A32D192ED03


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(itertools.accumulate(map(len, tokens)))
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + k for k, e in enumerate(ends, 1))]
    stops = [e + k for k, e in enumerate(ends)]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops[words - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, name: str = "_simhash") -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a (signed) long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(x or b"", words) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def bit_statistics(prints: DataFrame, by: str = "fp") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, bit means and bit correlations of all fingerprints; 64 x 64 sums reach the driver, whatever the corpus."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for frame in frames:
            bits = np.unpackbits(frame[by].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        rows, columns = np.indices(both.shape)
        yield pd.DataFrame({"i": rows.ravel(), "j": columns.ravel(), "both": both.ravel(), "n": float(n)})

    sums = prints.select(by).mapInPandas(count, "i int, j int, both double, n double").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).toPandas()
    n = int(sums["n"].max()) if len(sums) else 0
    both = np.zeros((BITS, BITS))
    both[sums["i"], sums["j"]] = sums["both"]
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return n, mean, (both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of near equal width; each grows from the bit most correlated with the rest by its closest bits."""
    strength = np.abs(correlation) - np.eye(BITS)
    free, out = set(range(BITS)), []
    for k in range(partitions):
        width = len(free) // (partitions - k)
        pool = sorted(free)
        seed = pool[int(np.argmax(strength[np.ix_(pool, pool)].sum(axis=1)))]
        group = [seed]
        free.discard(seed)
        while len(group) < width:
            pool = sorted(free)
            best = pool[int(np.argmax(strength[np.ix_(pool, group)].mean(axis=1)))]
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(n: int, mean: np.ndarray, groups: list[list[int]], radius: int, key_cost: float = KEY_COST) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost. The chance that two rows differ in t bits of a partition follows from the bits'
    means; a partition probed with threshold t sends C(width, t) keys for each row."""
    costs = []
    for group in groups:
        chance = np.array([1.0])
        for bit in group:
            differ = 2 * mean[bit] * (1 - mean[bit])
            chance = np.convolve(chance, [1 - differ, differ])
        within = np.cumsum(chance)
        costs.append([0.0] + [key_cost * n * math.comb(len(group), t) + math.comb(len(group), t) * n * (n - 1) / 2 * within[t] for t in range(radius + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k, cost in enumerate(costs, 1):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (so_far, chosen) in best.items():
            for t in range(-1, min(radius, len(groups[k - 1]) - 1) + 1):
                found = (so_far + cost[t + 1], [*chosen, t])
                if total + t not in step or found[0] < step[total + t][0]:
                    step[total + t] = found
        best = step
    return best[radius - len(groups) + 1]


def choose_plan(n: int, mean: np.ndarray, correlation: np.ndarray, radius: int, key_cost: float = KEY_COST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed, for the number of partitions that costs least."""
    best = None
    for m in PARTITION_CHOICES:
        groups = group_bits(correlation, m)
        cost, thresholds = allocate(n, mean, groups, radius, key_cost)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def _mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (multiply and shift rounds), so that keys spread evenly."""
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9), (32, 0)):
        values = values ^ (values >> np.uint64(shift))
        values = values * np.uint64(factor) if factor else values
    return values


def _keyed_schema(frame: DataFrame) -> str:
    return "key long, " + ", ".join(f"{c} long" for c in frame.columns if c != "key")


def probe_keys(prints: DataFrame, plan: list[tuple[list[int], int]], by: str = "fp") -> DataFrame:
    """``prints`` under keys: two rows within t bits of each other in a partition share a key with t of its bits masked."""
    masks = []
    for group, threshold in plan:
        whole = sum(1 << b for b in group)
        masks += [whole & ~sum(1 << b for b in off) for off in itertools.combinations(group, threshold)]

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[by].to_numpy(np.int64).view(np.uint64)
            for k, mask in enumerate(masks):
                keys = _mix((values & np.uint64(mask)) + _mix(np.full(1, k + 1, np.uint64)))
                yield pd.DataFrame({"key": keys.view(np.int64)} | {c: frame[c] for c in frame})

    return prints.mapInPandas(spread, _keyed_schema(prints))


def split_keys(rows: DataFrame, level: int, radius: int, by: str = "fp") -> DataFrame:
    """A finer key for each of radius + 1 blocks of bits: rows within the radius agree in a block wholly."""
    order = np.roll(np.arange(BITS), 11 * level + 5)
    masks = [sum(1 << int(b) for b in part) for part in np.array_split(order, radius + 1)]

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values, keys = frame[by].to_numpy(np.int64).view(np.uint64), frame["key"].to_numpy(np.int64).view(np.uint64)
            for k, mask in enumerate(masks):
                finer = _mix(_mix((values & np.uint64(mask)) + np.uint64(k + 1)) ^ keys)
                yield pd.DataFrame({"key": finer.view(np.int64)} | {c: frame[c] for c in frame if c != "key"})

    return rows.mapInPandas(spread, _keyed_schema(rows))


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect what is connected among the rows of a bucket: at most one fewer than rows."""
    links, left = [], np.arange(len(values))
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            found = np.zeros(len(left), bool)
            for row in frontier:
                near = ~found & (np.bitwise_count(values[row] ^ values[left]) <= radius)
                links += [(int(row), int(x)) for x in left[near]]
                found |= near
            frontier, left = left[found], left[~found]
    return links


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) verified links among the rows that share a key; rows come sorted by key and buckets are compared at once."""

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64)]

        def found(keys: np.ndarray, nodes: np.ndarray) -> pd.DataFrame:
            values = nodes.view(np.uint64)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[first, len(keys)])
            few = np.repeat(sizes, sizes) <= 16
            pairs = []
            for gap in range(1, int(sizes[sizes <= 16].max(initial=1))):
                at = np.flatnonzero(few[:-gap] & (keys[gap:] == keys[:-gap]))
                at = at[np.bitwise_count(values[at] ^ values[at + gap]) <= radius]
                pairs.append(np.stack([at, at + gap], axis=1))
            for k in np.flatnonzero(sizes > 16):
                part = slice(first[k], first[k] + sizes[k])
                order = np.argsort(nodes[part])  # the same tree for the same rows under every key
                pairs.append(first[k] + order[np.array(spanning_links(values[part][order], radius), np.int64).reshape(-1, 2)])
            ends = nodes[np.concatenate(pairs)] if pairs else np.empty((0, 2), np.int64)
            ends = ends[ends[:, 0] != ends[:, 1]]
            return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})

        for frame in frames:
            held = [np.r_[old, frame[c].to_numpy(np.int64)] for old, c in zip(held, ("key", "fp"), strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield found(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield found(*held)

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(link, "a long, b long").distinct()


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = 8) -> DataFrame:
    """Verified links (a, b) that connect all distinct fingerprints (column ``fp``)."""
    prints = prints.select("fp")
    n, mean, correlation = bit_statistics(prints)
    plan, parts = choose_plan(n, mean, correlation, radius), []
    rows = probe_keys(prints, plan)
    # large buckets are looked for among one in so many fingerprints of a large table; missing one costs time and loses no link
    share = SAMPLED if n > SAMPLED * bucket else 1
    some = rows if share == 1 else probe_keys(prints.filter(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0), plan)
    for level in range(levels + 1):
        # few buckets are beyond the bound, so this table is tiny
        large = checkpointed(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * share > bucket).select("key"))
        if level == levels or large.isEmpty():
            parts.append(bucket_links(rows, radius))
            break
        parts.append(bucket_links(rows.join(large, "key", "left_anti"), radius))
        rows = some = checkpointed(split_keys(rows.join(large, "key"), level, radius))
        share = 1
    return reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): alternating large and small stars until nothing changes.

    Up to ONE_TASK links, a few megabytes, take their rounds in one task, without a shuffle; more are shuffled.
    """
    both = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    few = both.count() <= ONE_TASK
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both_ways = lambda df, *pairs: df.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v")
    before = None
    while True:
        both = both.coalesce(1) if few else both
        # large star: neighbours above u hang on the least of u and its neighbours
        around = both_ways(both, pair("u", "v"), pair("v", "u"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below u, and u, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = both_ways(large.join(low, "u"), pair("v", "m"), pair("u", "m")).filter("u <> v").distinct()
        both = checkpointed(small_star)
        state = both.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return both_ways(both, pair("u", "v"), pair("v", "v")).distinct().toDF("node", "root")


def part_prints(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """SimHashes of the first PARTS parts of a sorted set of shingle hashes, as (signed) longs.

    The number of parts is a power of two that follows from the set's size; a set of up to PARTS parts has smaller ones. Where a similar set may be so much smaller that it
    has half as many, the parts of that number come too. A part of a single shingle says little and is left out, unless
    the whole set has no more parts than these.
    """
    mixed = _mix(shingles ^ np.uint64(SECOND_SALT))
    halvings = lambda x: max(0, math.ceil(math.log2(x)))
    depth = lambda n: max(halvings(n / PART_SHINGLES), min(halvings(2 * n / PART_SHINGLES), halvings(PARTS)))
    found = []
    for level in {depth(len(shingles)), depth(math.ceil(similarity * len(shingles)))} if len(shingles) else ():
        part = mixed >> np.uint64(64 - level) if level else np.zeros(len(mixed), np.uint64)
        order = np.argsort(part, kind="stable")
        order = order[: np.searchsorted(part[order], PARTS)]
        if not len(order):
            continue
        first = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        sizes = np.diff(np.r_[first, len(order)])
        bits = np.unpackbits(shingles[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        prints = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel()
        found.append(prints[(sizes > 1) | (1 << level <= PARTS)])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def sketches(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, _text (the text's xxhash64), _set (128-bit hash of the set of shingles) and _parts (part fingerprints)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(x or b"", words)) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            names = pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], pa.string())
            parts = pa.array([part_prints(x, similarity) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), names, parts], ["doc_id", "_text", "_set", "_parts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_text"), "text")
    return rows.mapInArrow(sketch, "doc_id long, _text long, _set string, _parts array<long>")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, class), checkpointed: classes with a part fingerprint that links with one of another class."""
    members = classes.select("class", F.explode("_parts").alias("fp"))
    close = checkpointed(links(members.select("fp").distinct()))
    if close.isEmpty():
        members = members.withColumnRenamed("fp", "bucket")
    else:
        roots = checkpointed(components(close))
        members = members.join(small(roots), F.col("fp") == F.col("node"), "left").select("class", F.coalesce("root", "fp").alias("bucket"))
    met = checkpointed(members.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("bucket"))
    return checkpointed(members.join(small(met), "bucket").select("bucket", "class").distinct())


def with_sets(docs: DataFrame, chosen: DataFrame, units: DataFrame, words: int) -> DataFrame:
    """(unit, class, label, shingles) of ``units`` (unit, class, label), where ``chosen`` (class, _id, _hash) names the row of ``docs``
    that stands for a class. Sets are computed where the texts lie and move once.

    Texts stay where they are while the table is small enough to be broadcast; beyond that a Bloom filter keeps others back.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], 64):
                sets = [np.unique(shingle_hashes(x or b"", words)).view(np.int64) for x in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("class"), part.column("units"), pa.array(sets, pa.list_(pa.int64()))], ["class", "units", "shingles"])

    wanted = units.groupBy("class").agg(F.collect_list(F.struct("unit", "label")).alias("units"))
    wanted = checkpointed(wanted.join(chosen, "class"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text", F.xxhash64("text").alias("_text"))
    rows, _ = meeting(texts, F.col("_text"), wanted, "_hash")
    found = rows.join(small(wanted), (F.col("_text") == F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id"))).select("class", "units", "text")
    sets = found.mapInArrow(cut, "class long, units array<struct<unit: long, label: long>>, shingles array<long>")
    return sets.select("class", F.explode("units").alias("_u"), "shingles").select("_u.unit", "class", "_u.label", "shingles")


def similar_links(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect what a Jaccard similarity of ``similarity`` or more connects; rows of one label are connected
    already. A row meets all later ones at once through lists of the rows that hold each shingle."""
    sizes = np.array([len(x) for x in sets])
    stops, n = np.cumsum(sizes), len(sets)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    starts = np.r_[0, np.cumsum(np.bincount(ids))]
    labels, out = np.unique(labels, return_inverse=True)[1], []
    for i in range(n - 1):
        if (labels == labels[0]).all():
            break
        own = ids[stops[i] - sizes[i] : stops[i]]
        lengths = starts[own + 1] - starts[own]
        total = int(lengths.sum())
        at = np.arange(total) + np.repeat(starts[own] - (np.cumsum(lengths) - lengths), lengths)
        shared = np.bincount(owners[at], minlength=n)[i + 1 :]
        near = (labels[i + 1 :] != labels[i]) & (shared >= similarity * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if labels[j] != labels[i]:
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def confirmed(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), checkpointed: links of ``similarity`` or more that connect the rows (unit, class, label, shingles) of each unit.

    A unit holds a bounded number of rows, and a task takes its units one after another.
    """

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(frame: pd.DataFrame) -> pd.DataFrame:
            # rows of the input that repeat id and text give a class the same set again
            frame = frame.drop_duplicates(["unit", "class"])
            keys, nodes, labels = (frame[c].to_numpy(np.int64) for c in ("unit", "class", "label"))
            sets, ends = list(frame["shingles"]), []
            bounds = [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist(), len(keys)]
            for a, b in itertools.pairwise(bounds):
                ends += [(nodes[a + i], nodes[a + j]) for i, j in similar_links(sets[a:b], labels[a:b], similarity)] if b - a > 1 else []
            pairs = np.array(ends, np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(held):
                continue
            last = int(np.flatnonzero(held["unit"].to_numpy() != held["unit"].iloc[-1]).max(initial=-1)) + 1
            if last:
                yield found(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held)

    dealt = sets.select("unit", "class", "label", "shingles").repartition("unit").sortWithinPartitions("unit", "class")
    return checkpointed(dealt.mapInPandas(link, "a long, b long").filter("a <> b").distinct())


def similar_classes(shared: DataFrame, load: Callable[[DataFrame], DataFrame], similarity: float, block: int = TRIED) -> DataFrame:
    """(node, root) of the classes that links of ``similarity`` or more among members of a bucket connect. ``load`` adds the shingles
    to rows (unit, class, label).

    Buckets that share classes form a group, whose members are compared in one task where they are ``block`` or fewer. Larger
    groups are compared bucket by bucket, and a bucket beyond ``block`` in blocks: first each block by itself, along with some
    pivots of the bucket, then pairs of blocks, but only those that the first round has left in different classes.
    """
    least = shared.groupBy("bucket").agg(F.min("class").alias("low"))
    groups = checkpointed(components(shared.join(least, "bucket").select(F.col("class").alias("a"), F.col("low").alias("b"))))
    wide = checkpointed(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("root"))
    key = lambda *parts: F.xxhash64(*parts).alias("unit")
    units = groups.join(small(wide), "root", "left_anti").select(key(F.lit("group"), F.col("root")), F.col("node").alias("class"), F.col("node").alias("label"))
    if wide.isEmpty():
        return components(confirmed(load(units), similarity))
    rest = checkpointed(shared.join(groups.join(small(wide), "root").select(F.col("node").alias("class")), "class"))
    counted = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
    dealt = rest.join(counted, "bucket").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    pivot = F.pmod(F.xxhash64("class", F.lit("pivot")), F.ceil(F.col("n") / PIVOTS)) == 0
    spread = F.when(pivot & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = dealt.select("bucket", "class", F.explode(spread).alias("block"))
    more = first.select(key(F.lit("bucket"), F.col("bucket"), F.col("block")), "class", F.col("class").alias("label"))
    edges = confirmed(load(units.unionByName(more)), similarity)
    hot = dealt.filter("blocks > 1").select("bucket", "class")
    roots = checkpointed(components(edges))
    labelled = checkpointed(hot.join(roots, hot["class"] == roots["node"], "left").select("bucket", "class", F.coalesce("root", "class").alias("label")))
    per_label = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("of_label"))
    open_buckets = per_label.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum(F.when(F.col("of_label") <= block, F.col("of_label")).otherwise(0)).alias("light")).filter("labels > 1")
    placed = labelled.join(per_label, ["bucket", "label"]).join(open_buckets, "bucket")
    heavy = F.col("of_label") > block
    # a block holds rows of one large label, or small labels dealt by hash
    own = F.struct(
        F.when(heavy, F.col("label")).alias("of"),
        F.when(heavy, F.pmod(F.xxhash64("class"), F.ceil(F.col("of_label") / block))).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.ceil(F.col("light") / block)))).alias("part"),
    )
    placed = checkpointed(placed.select("bucket", "class", "label", own.alias("own")))
    others = placed.groupBy("bucket").agg(F.collect_set("own").alias("all"))
    met = placed.join(others, "bucket").select("bucket", "class", "label", "own", F.explode("all").alias("other"))
    met = met.filter(F.col("own.of").isNull() | ~F.col("own.of").eqNullSafe(F.col("other.of")))
    tried = met.select(key(F.lit("blocks"), F.col("bucket"), F.least("own", "other"), F.greatest("own", "other")), "class", "label")
    return components(edges.unionByName(confirmed(load(tried), similarity)))


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds component_id, the least doc_id reachable, to checkpointed rows (doc_id, _simhash). Null ids count only where a
    group has no other."""
    prints = checkpointed(rows.groupBy(F.col("_simhash").alias("fp")).agg(F.min("doc_id").alias("least")))
    classes = components(links(prints, radius))
    rooted = prints.join(classes, prints["fp"] == classes["node"], "left").withColumn("_class", F.coalesce("root", "fp"))
    smallest = rooted.filter("root is not null").groupBy("_class").agg(F.min("least").alias("_smallest"))
    moved = rooted.filter("root is not null").join(smallest, "_class").select(F.col("fp").alias("_moved"), "_smallest")
    alone = prints.join(moved, prints["fp"] == moved["_moved"], "left").select(F.col("fp"), F.when(F.col("_moved").isNull(), F.col("least")).otherwise(F.col("_smallest")).alias("component_id"))
    return rows.join(alone, rows["_simhash"] == alone["fp"]).drop("fp")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = checkpointed(with_fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "_simhash"))
    grouped = near_groups(rows, radius)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("_simhash"), 16, "0")).alias("fingerprint"), "component_id")


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, _text, keep), checkpointed: every row, and the row (absent, doc_id, _text) of its group that stays: that of the
    least doc_id, or of the least text hash where ids repeat. Null ids stay only where a group has no other."""
    row = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_text")
    rows = checkpointed(sketches(docs, words, similarity))
    classes = rows.groupBy("_set").agg(F.min(row).alias("_row"), F.first("_parts").alias("_parts"))
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))
    shared = shared_buckets(classes)
    chosen = checkpointed(shared.select("class").distinct().join(classes, "class").select("class", F.col("_row.doc_id").alias("_id"), F.col("_row._text").alias("_hash")))
    roots = similar_classes(shared, lambda units: with_sets(docs, chosen, units, words), similarity)
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").select("_set", "_row", F.coalesce("root", "class").alias("_root"))
    keepers = rooted.join(rooted.groupBy("_root").agg(F.min("_row").alias("keep")), "_root").select("_set", "keep")
    return checkpointed(rows.select("doc_id", "_text", "_set").join(keepers, "_set").select("doc_id", "_text", "keep"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept: that of ``similar_rows``; of rows that repeat
    its id and text, one. Extra columns may have any names but ``_text``, ``_gone``, ``_id`` and ``_hash``."""
    rows = similar_rows(docs, words, similarity)
    stays = F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep._text") == F.col("_text"))
    counted = rows.groupBy("doc_id", "_text").agg(F.count(F.lit(1)).alias("n"), F.first(~stays).alias("_gone"))
    # what goes, and what stays once of several equal rows
    marks = checkpointed(counted.filter("_gone or n > 1").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "_gone"))
    hashed, alone = meeting(docs.withColumn("_text", F.xxhash64("text")), F.col("_text"), marks, "_hash")
    joined = hashed.join(small(marks), (F.col("_text") == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    out = joined.filter("_gone is null").select(*docs.columns)
    if not marks.filter("not _gone").isEmpty():
        out = out.unionByName(joined.filter("not _gone").dropDuplicates(["_id", "_hash"]).select(*docs.columns))
    return out if alone is None else out.unionByName(alone.select(*docs.columns))
