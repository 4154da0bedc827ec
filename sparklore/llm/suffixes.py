"""Repeated byte strings: a distributed, common-prefix-aware merge sort of sampled suffixes.

Every ``length``-byte string contains a gram of GRAM bytes with the least hash; equal strings have it at the same place, so
comparing suffixes at these anchors finds every repeat. Anchors whose gram occurs once in the corpus are left out. An
anchor's suffix, followed by its left context read backwards, is a sort key. Each partition sorts its keys, front-codes
them (shared prefix length and the rest) and sends each range of the sort order its part (ranges are cut at quantiles of a
bounded sample, their number follows the input's bytes); a range's sorted runs are combined by a loser
tree on common prefix lengths, which compares bytes only beyond what is known to agree. Keys with the same gram are then
neighbours and their common prefixes (to the right) and left contexts tell which bytes repeat.

A gram or key that a partition holds twice is settled there: its members pass through and a single mark goes on, so a hot
passage costs a range one entry for each partition. Texts are whole UTF-8 byte strings (null: empty). Rows that repeat
doc_id and text are documents of their own, hence repeats of each other. Texts shorter than ``length`` are left as they are.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, with_possible

LENGTH = 200
GRAM = 64
#: Bytes of input for a range of the sort order, and ranges at least and at most (beyond, ranges hold more).
RANGE_BYTES = 4 << 20
MIN_RANGES, MOST_RANGES = 32, 1 << 18
#: The sample that ranges are cut by: texts, grams of a text at most, and grams for each range.
SAMPLED_TEXTS, GRAMS, SAMPLES = 2000, 32, 4
#: Texts are searched for anchors in stretches of this many bytes, so positions fit the low bits of a hash.
STRETCH = 1 << 22
#: Groups up to this size compare their keys pair by pair in numpy; larger ones compare window hashes, in linear time.
PAIRWISE = 48
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        have = _powers[base] = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, np.uint64(b))]) for b in (base, inverse))
    return have


def rolling(text: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every ``width`` bytes in a row: a function of those bytes alone."""
    n = len(text)
    powers, inverses = _power_tables(base, n + 1)
    sums = np.r_[np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:n])]
    found = (sums[width:] - sums[:-width]) * inverses[: n - width + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, position, first and last window start of every anchor of a text."""
    parts = []
    for base in range(0, max(1, len(text) - length + 1), STRETCH):
        piece = np.frombuffer(text, np.uint8)[base : base + STRETCH + length - 1]
        if len(piece) < length:
            continue
        grams = rolling(piece, gram)
        span = length - gram + 1
        windows = len(grams) - span + 1
        low = np.uint64((1 << 23) - 1)
        marked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        block = np.r_[marked, np.full(-len(marked) % span, np.uint64(2**64 - 1))].reshape(-1, span)
        ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(block, axis=1).ravel()
        at = (np.minimum(ahead[:windows], behind[span - 1 : span - 1 + windows]) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], windows] - 1
        parts.append((grams[at[first]], at[first] + base, first + base, last + base))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key of both. Rows that repeat both share a key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).tolist()
    return zip(keys, batch.column("text").cast(pa.binary()).to_pylist(), strict=True)


def cut_points(texts: DataFrame, length: int, gram: int) -> list[bytes]:
    """The grams that part the sort order into ranges of about RANGE_BYTES of input each, at most MOST_RANGES.

    They are quantiles of the grams of a bounded sample of texts, drawn by hash: about SAMPLED_TEXTS of them, or SAMPLES for
    each range, with at most GRAMS grams of a text.
    """
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = min(MOST_RANGES, max(MIN_RANGES, (size["bytes"] or 0) // RANGE_BYTES))
    wanted = max(SAMPLED_TEXTS, ranges * SAMPLES // GRAMS)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for _, text in _texts(batch):
                at = anchors(text, length, gram)[1]
                found += [text[k : k + gram] for k in at[:: max(1, -(-len(at) // GRAMS))].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["gram"])

    some = texts.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(max(1, size["n"] // wanted))) == 0)
    grams = sorted(bytes(r["gram"]) for r in some.mapInArrow(take, "gram binary").collect())
    return sorted({grams[k * len(grams) // ranges] for k in range(1, ranges)}) if grams else []


def _ranges(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of every stretch of equal values in sorted ``values``."""
    if len(values):
        begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        yield from zip(values[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)], strict=True)


PICK = np.dtype([("key", "<u8"), ("at", "<u4"), ("left", "<u2"), ("right", "<u2")])
HASHED = np.dtype([("gram", "<u8"), ("key", "<u8"), ("at", "<u4"), ("left", "<u2"), ("right", "<u2")])


def _picks_by_key(picks: np.ndarray) -> pd.DataFrame:
    """One row per document: its key and its packed picks."""
    picks = picks[np.argsort(picks["key"], kind="stable")]
    rows = [(key, picks[a:b].tobytes()) for key, a, b in _ranges(picks["key"])]
    return pd.DataFrame({"key": np.array([k for k, _ in rows], np.uint64).view(np.int64), "packed": [p for _, p in rows]})


def repeated_anchors(texts: DataFrame, segments: int, length: int, gram: int) -> DataFrame:
    """(key, packed picks): the anchors whose gram occurs twice or more in the corpus."""
    levels = max(1, (segments - 1).bit_length())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in slices(batches):
            for key, text in _texts(batch):
                if len(text) >= length:
                    grams, at, first, last = anchors(text, length, gram)
                    rows = np.empty(len(grams), HASHED)
                    rows["gram"], rows["key"], rows["at"], rows["left"], rows["right"] = grams, key, at, at - first, last + length - at
                    found.append(rows)
        if not found:
            return
        rows = np.concatenate(found)
        rows = rows[np.argsort(rows["gram"], kind="stable")]
        same = rows["gram"][1:] == rows["gram"][:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        # what repeats here is settled; one mark (right = 0) tells the others
        marks = rows[twice & np.r_[True, ~same]].copy()
        marks["right"] = 0
        sent = np.concatenate([rows[~twice], marks])
        sent = sent[np.argsort(sent["gram"], kind="stable")]
        segment = (sent["gram"] >> np.uint64(64 - levels)).astype(np.int64)
        out = [(k, False, zlib.compress(sent[a:b].tobytes(), 1)) for k, a, b in _ranges(segment)]
        settled = rows[twice]
        step = max(1, -(-len(settled) // (1 << levels)))
        out += [(int(rows["gram"][0] >> np.uint64(64 - levels)) ^ (a // step), True, zlib.compress(settled[a : a + step].tobytes(), 1)) for a in range(0, len(settled), step)]
        for a in range(0, len(out), 64):
            columns = list(zip(*out[a : a + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary())], ["segment", "settled", "packed"])

    def join(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        load = lambda some: np.concatenate([np.empty(0, HASHED), *(np.frombuffer(zlib.decompress(x), HASHED) for x in some)])
        passed, rows = load(frame["packed"][frame["settled"]]), load(frame["packed"][~frame["settled"]])
        rows = rows[np.argsort(rows["gram"], kind="stable")]
        same = rows["gram"][1:] == rows["gram"][:-1]
        open_ = rows["right"] > 0
        # a lone row that meets another row, or the mark of a partition
        found = rows[open_ & (np.r_[False, same] | np.r_[same, False])] if len(rows) else rows
        both = np.concatenate([passed, found])
        picks = np.empty(len(both), PICK)
        for name in PICK.names:
            picks[name] = both[name]
        return _picks_by_key(picks)

    dealt = texts.select("key", "text").mapInArrow(find, "segment long, settled boolean, packed binary")
    return dealt.groupBy("segment").applyInPandas(join, "key long, packed binary")


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string shares with the one before it (0 for the first)."""
    out = np.zeros(len(strings), np.int64)
    for a in range(0, len(strings), 4096):
        some = strings[max(0, a - 1) : a + 4096]
        sizes = np.array([len(x) for x in some])
        width = int(sizes.max(initial=0))
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in some), np.uint8).reshape(len(some), width) if width else np.zeros((len(some), 0), np.uint8)
        differ = grid[1:] != grid[:-1]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(some) - 1, np.int64)
        prefix = np.minimum(prefix, np.minimum(sizes[1:], sizes[:-1]))
        out[max(1, a) : a + len(some)] = prefix[: len(out[max(1, a) : a + len(some)])]
    return out


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths of sorted strings, and the rest of each in a row."""
    shared = common_prefixes(strings)
    return shared, b"".join(x[n:] for x, n in zip(strings, shared.tolist(), strict=True))


def front_decode(shared: list[int], sizes: list[int], rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for n, size in zip(shared, sizes, strict=True):
        end = at + size - n
        before = before[:n] + rest[at:end]
        at = end
        out.append(before)
    return out


def _differ_at(a: bytes, b: bytes, start: int) -> int:
    """First place from ``start`` on where two strings differ; the shorter length where they do not."""
    stop = min(len(a), len(b))
    while start < stop:
        x, y = a[start : start + 32], b[start : start + 32]
        if x != y:
            for k, (p, q) in enumerate(zip(x, y)):  # noqa: B905
                if p != q:
                    return start + k
            return stop
        start += 32
    return stop


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of (strings, prefix shared with the one before in the run) by a loser tree.

    Returns (run, index) of every string in order and the prefix it shares with the string before it in that order. Every
    contender knows the prefix it shares with the last output: the longer one is the smaller string, and only contenders
    with equal prefixes look at bytes, from that prefix on.
    """
    leaves = 1
    while leaves < max(1, len(runs)):
        leaves *= 2
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - len(runs))
    shared, place = [0] * leaves, [0] * leaves
    losers = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) between the heads of two runs."""
        x, y = now[a], now[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        at = _differ_at(x, y, p)
        first = len(x) <= len(y) if at == len(x) or at == len(y) else x[at] < y[at]
        if first:
            shared[b] = at
            return a, b
        shared[a] = at
        return b, a

    winners = list(range(leaves))
    level = [0] * leaves + winners
    for node in range(leaves - 1, 0, -1):
        level[node], losers[node] = play(level[2 * node], level[2 * node + 1])
    best = level[1] if leaves > 1 else 0
    order: list[tuple[int, int]] = []
    prefixes: list[int] = []
    while now[best] is not None:
        order.append((best, place[best]))
        prefixes.append(shared[best])
        strings, inside = runs[best]
        place[best] = k = place[best] + 1
        if k < len(strings):
            now[best], shared[best] = strings[k], inside[k]
        else:
            now[best] = None
        node = (leaves + best) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1
    return order, prefixes


RUN_ROW = np.dtype([("key", "<u8"), ("at", "<u4"), ("left", "<u2"), ("right", "<u2"), ("shared", "<u2"), ("marks", "u1")])


def sorted_runs(texts: DataFrame, cuts: list[bytes], gram: int) -> DataFrame:
    """(range, settled, packed) of every partition: front-coded sorted keys for each range of the sort order, and settled picks.

    Ranges follow one another in the order of all keys; keys with one gram fall in one range.
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: dict[tuple[int, bytes, int], list[tuple[int, int]]] = {}
        for frame in frames:
            for key, packed, picks in zip(frame["key"].to_numpy(np.int64).view(np.uint64).tolist(), frame["text"], frame["picks"], strict=True):
                text = zstandard.ZstdDecompressor().decompress(packed)
                chosen = np.frombuffer(b"".join(picks), PICK)
                for _, at, left, right in chosen.tolist():
                    sort_key = text[at : at + right] + text[at - left : at][::-1]
                    home = bisect.bisect_right(cuts, sort_key[:gram])
                    entries.setdefault((home, sort_key, left), []).append((key, at))
        rows, settled = [], []
        for home, sort_key, left in sorted(entries):
            members = entries[home, sort_key, left]
            right = len(sort_key) - left
            if len(members) > 1:
                settled += [(key, at, left, right) for key, at in members]
            rows.append((home, sort_key, left, right, members[0], len(members) > 1))
        for home, a, b in _ranges(np.array([r[0] for r in rows], np.int64)):
            some = rows[a:b]
            shared, rest = front_code([r[1] for r in some])
            head = np.empty(len(some), RUN_ROW)
            head["key"], head["at"] = [r[4][0] for r in some], [r[4][1] for r in some]
            head["left"], head["right"], head["marks"], head["shared"] = [r[2] for r in some], [r[3] for r in some], [r[5] for r in some], shared
            yield pd.DataFrame({"range": [home], "settled": [False], "packed": [zstandard.ZstdCompressor(level=3).compress(len(some).to_bytes(4, "little") + head.tobytes() + rest)]})
        ready = np.array(settled, PICK)
        step = max(1, -(-len(ready) // (len(cuts) + 1)))
        for k, a in enumerate(range(0, len(ready), step)):
            yield pd.DataFrame({"range": [k], "settled": [True], "packed": [zstandard.ZstdCompressor(level=3).compress(ready[a : a + step].tobytes())]})

    return texts.mapInPandas(build, "range long, settled boolean, packed binary")


def _load_run(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(data[:4], "little")
    head = np.frombuffer(data, RUN_ROW, n, 4)
    sizes = (head["left"].astype(np.int64) + head["right"]).tolist()
    return head, front_decode(head["shared"].tolist(), sizes, data[4 + n * RUN_ROW.itemsize :])


def _grid(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)


def best_reach(keys: list[bytes], shared: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct keys in sorted order: how far left and right of its anchor each key's repeats reach, 0 without any."""
    n = len(keys)
    reach_left, reach_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    group = np.cumsum(np.r_[False, shared[1:] < gram]) if n else np.empty(0, np.int64)
    sizes = np.bincount(group) if n else np.empty(0, np.int64)
    size = sizes[group] if n else sizes
    backward = [k[r:] for k, r in zip(keys, right.tolist(), strict=True)]

    def note(i: np.ndarray, j: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> None:
        fits = ahead + back >= length
        for x in (i, j):
            np.maximum.at(reach_left, x[fits], back[fits])
            np.maximum.at(reach_right, x[fits], ahead[fits])

    some = np.flatnonzero((size > 1) & (size <= PAIRWISE))
    if len(some):
        where = np.full(n, -1)
        where[some] = np.arange(len(some))
        width = max(1, int(left[some].max()))
        grid = _grid([backward[k] for k in some], width)
        least = np.full(n, np.iinfo(np.int64).max)
        for gap in range(1, int(size[some].max())):
            least[: n - gap] = np.minimum(least[: n - gap], shared[gap:])
            i = some[some < n - gap]
            i = i[group[i + gap] == group[i]]
            for a in range(0, len(i), 1 << 15):
                x = i[a : a + (1 << 15)]
                y = x + gap
                ahead = np.minimum(least[x], np.minimum(right[x], right[y]))
                differ = grid[where[x]] != grid[where[y]]
                back = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
                note(x, y, ahead, np.minimum(back, np.minimum(left[x], left[y])))
    for g in np.flatnonzero(sizes > PAIRWISE):
        members = np.flatnonzero(group == g)
        owner, offset, hashes = [], [], []
        for k in members.tolist():
            whole = np.frombuffer(backward[k][::-1] + keys[k][: right[k]], np.uint8)
            both = np.stack([rolling(whole, length, base) for base in BASES], axis=1)
            owner.append(np.full(len(both), k))
            offset.append(left[k] - np.arange(len(both)))
            hashes.append(both)
        owner, offset, hashes = np.concatenate(owner), np.concatenate(offset), np.concatenate(hashes)
        order = np.lexsort((hashes[:, 1], hashes[:, 0], offset))
        same = (offset[order][1:] == offset[order][:-1]) & (hashes[order][1:] == hashes[order][:-1]).all(axis=1)
        twice = order[np.r_[False, same] | np.r_[same, False]]
        np.maximum.at(reach_left, owner[twice], offset[twice])
        np.maximum.at(reach_right, owner[twice], length - offset[twice])
    return reach_left, reach_right


def repeated_spans(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, packed spans): begin and end of every stretch that repeats, one row for each document and range."""

    def merge(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ready = np.concatenate([np.empty(0, PICK), *(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), PICK) for x in frame["packed"][frame["settled"]])])
        found = [(ready["key"], ready["at"].astype(np.int64) - ready["left"], ready["at"].astype(np.int64) + ready["right"])]
        loaded = [_load_run(x) for x in frame["packed"][~frame["settled"]]]
        if loaded:
            order, prefixes = merge_runs([(strings, head["shared"].tolist()) for head, strings in loaded])
            offsets = np.cumsum([0, *(len(h) for h, _ in loaded)])
            at = np.array([offsets[r] + k for r, k in order])
            heads = np.concatenate([h for h, _ in loaded])[at]
            shared = np.array(prefixes, np.int64)
            left, right = heads["left"].astype(np.int64), heads["right"].astype(np.int64)
            # equal keys are neighbours: such an entry repeats wholly
            equal = np.r_[False, (shared[1:] == (left + right)[1:]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])]
            entry = np.cumsum(~equal) - 1
            first = np.flatnonzero(~equal)
            copies = np.bincount(entry) + np.bincount(entry, weights=heads["marks"]).astype(np.int64)
            keys = [loaded[order[k][0]][1][order[k][1]] for k in first.tolist()]
            reach_left, reach_right = best_reach(keys, shared[first], left[first], right[first], length, gram)
            whole = copies > 1
            reach_left[whole], reach_right[whole] = left[first][whole], right[first][whole]
            use = (reach_right[entry] > 0) & (heads["marks"] == 0)
            base = heads["at"].astype(np.int64)
            found.append((heads["key"][use], (base - reach_left[entry])[use], (base + reach_right[entry])[use]))
            # members of a key that one partition settled are covered already, as far as the key goes
        key, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, key))
        spans = np.stack([begin, end], axis=1)[order].astype("<u4")
        rows = [(k, spans[a:b].tobytes()) for k, a, b in _ranges(key[order])]
        return pd.DataFrame({"key": np.array([k for k, _ in rows], np.uint64).view(np.int64), "packed": [p for _, p in rows]})

    return runs.groupBy("range").applyInPandas(merge, "key long, packed binary")


def met(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` (doc_id, key, and text under Zstandard) whose key is in the checkpointed ``found``, with its other columns. A
    Bloom filter of bounded size keeps other texts where they are."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            packed = pa.array([packer.compress(text) for _, text in _texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), packed], ["doc_id", "key", "text"])

    possible = with_possible(texts, F.col("key"), found, "key").filter("_possible").select("doc_id", "key", "text")
    return possible.mapInArrow(squeeze, "doc_id long, key long, text binary").join(found.hint("shuffle_hash"), "key", "left")


def repeated_parts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, spans), checkpointed: for every key of ``keyed`` texts with a repeat, packed begin and end positions."""
    cuts = cut_points(texts, length, gram)
    picks = checkpointed(repeated_anchors(texts, len(cuts) + 1, length, gram).groupBy("key").agg(F.collect_list("packed").alias("picks")))
    # rows that repeat doc_id and text are read once for each row, so that their keys repeat
    chosen = met(texts, picks).filter("picks is not null").select("key", "text", "picks")
    spans = repeated_spans(sorted_runs(chosen, cuts, gram), length, gram)
    return checkpointed(spans.groupBy("key").agg(F.collect_list("packed").alias("spans")))


def cut_spans(text: bytes, spans: list[bytes] | None) -> tuple[bytes, int, int]:
    """What is left of a text without its spans, the bytes removed and the number of maximal removed runs."""
    if spans is None or not len(spans):
        return text, 0, 0
    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    begins, ends = pairs[new, 0].tolist(), reach[np.r_[new[1:] - 1, len(pairs) - 1]].tolist()
    kept = [text[a:b] for a, b in zip([0, *ends], [*begins, len(text)], strict=True)]
    return b"".join(kept), sum(ends) - sum(begins), len(begins)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document. Only texts with a repeat move."""
    texts = keyed(docs)
    spans = repeated_parts(texts, length, gram)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for packed, some in zip(frame["text"], frame["spans"], strict=True):
                text = zstandard.ZstdDecompressor().decompress(packed)
                kept, removed, n = cut_spans(text, some)
                rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_bytes": columns[0], "n_removed": columns[1], "n_spans": columns[2], "kept_sha256": columns[3]})

    done = met(texts, spans).mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    none = F.lit(0).cast("long")
    whole = with_possible(texts, F.col("key"), spans, "key").filter("not _possible")
    return done.unionByName(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))
