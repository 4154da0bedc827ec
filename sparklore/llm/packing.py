"""Packing token pieces into sequences by non-negative least squares over few-document patterns.

Every text (null: empty) is tokenised and closed with id 0; only documents longer than a sequence are cut. The histogram
of piece lengths (at most ``capacity`` entries, whatever the corpus) is all that the driver sees. Lengths are rounded up
to a grid; patterns of two or three grid lengths that fill a sequence get repeat counts by non-negative least squares on
the histogram; counts are rounded down and the longest pieces of each grid length are dealt to them; what is left goes
by best fit, longest first, into the sequence with the least room that still holds it. Pieces are then numbered inside
their length and look up their place. Rows that repeat a doc_id are packed each by itself.
"""

from __future__ import annotations

import itertools
import re
import sys
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gapless_rank, slices

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
GRID = 8
#: Shares of the fitted counts that are tried; the rest of the pieces fills gaps by best fit.
SHARES = (1.0, 0.5, 0.25)
#: Distinct words in each of the two generations of a worker's cache, which lives as long as a task.
CACHED_WORDS = 400_000
#: Bytes of text that are split into words at once.
TEXT_BYTES = 1 << 21
#: A byte that is always a token of its own; words that hold it are encoded singly.
MARK = b"\x7f"
PUNCTUATION = b".,;:!?|"
#: ASCII letters and lower-case Latin-1 letters, then punctuation.
PLAIN_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])+[.,;:!?|]*")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a text as little-endian bytes. White space always parts tokens in this vocabulary, so the ids of a text are
    those of its ASCII-space-separated words in a row, and each distinct word is encoded once while it stays cached."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        # lower-case Latin letters and lone punctuation pass the normaliser and the splitting pattern unchanged
        self.letters = Tokenizer(self.tokenizer.model)  # one model in memory for both
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.mark,) = self._ids(self.tokenizer, MARK.decode())
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """One for each worker process, kept between tasks."""
        kept = sys.__dict__.setdefault("_sparklore_encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Encode many words as one text, which costs far less than one call for each.

        Words of Latin letters and closing punctuation are one or two tokens' runs, each closed by a token that ends a
        word; other words are told apart by marks.
        """
        plain, parts, counts, others = [], [], [], []
        for word in words:
            if PLAIN_WORD.fullmatch(word):
                core = word.rstrip(PUNCTUATION)
                plain.append(word)
                parts.append(core if len(core) == len(word) else core + b" " + word[len(core) :])
                counts.append(1 + (len(core) < len(word)))
            elif MARK not in word:
                others.append(word)
        if plain:
            ids = self._ids(self.letters, b" ".join(parts).lower().decode())
            closed = np.flatnonzero(self.closing[ids]) + 1
            last = np.cumsum(counts)
            if len(closed) == last[-1]:
                self._keep(plain, ids, np.r_[0, closed[last[:-1] - 1]], closed[last - 1])
        if others:
            ids = self._ids(self.tokenizer, (b" " + MARK + b" ").join(others).decode())
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(others) - 1:
                self._keep(others, ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])
        self.known.update((w, self._ids(self.tokenizer, w.decode()).tobytes()) for w in words if w not in self.known)

    def _keep(self, words: list[bytes], ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        data = ids.tobytes()
        self.known.update((w, data[a:b]) for w, a, b in zip(words, (4 * begin).tolist(), (4 * end).tolist(), strict=True))

    def forget(self) -> None:
        """Between tasks an idle worker keeps the tokenizer and no words."""
        self.known, self.older = {}, {}

    def encode(self, texts: list[bytes], cached_words: int = CACHED_WORDS) -> list[bytes]:
        split = [text.split() for text in texts]
        if len(self.known) > cached_words:  # words that still occur move back from the older generation
            self.known, self.older = {}, self.known
        fresh = set(itertools.filterfalse(self.known.__contains__, itertools.chain.from_iterable(split)))
        self.known.update((w, self.older[w]) for w in fresh if w in self.older)
        new = [w for w in fresh if w not in self.known]
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document. ``cached_words`` trades a worker's memory for speed."""
    where = path or tokenizer_path()
    closing = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder.shared(where)
        try:
            for batch in slices(batches):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
                begun = np.cumsum([0] + [len(x or b"") for x in texts]) // TEXT_BYTES
                firsts = [a for a in range(len(texts)) if not a or begun[a] != begun[a - 1]]
                for a, z in itertools.pairwise([*firsts, len(texts)]):
                    rows = []
                    for doc_id, coded in zip(ids[a:z], encoder.encode([x or b"" for x in texts[a:z]], cached_words), strict=True):
                        coded += closing
                        for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                            part = coded[at : at + 4 * capacity]
                            rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def patterns(present: np.ndarray, total: int) -> np.ndarray:
    """Two or three grid lengths of ``present`` that add up to ``total``; rows of indices into ``present``, -1 for none."""
    index = np.full(total + 1, -1)
    index[present] = np.arange(len(present))
    found = []
    for i, a in enumerate(present):
        rest = total - a
        second = present[(present >= a) & (present <= rest - (rest - present))]
        second = second[second <= rest]
        third = rest - second
        pairs = second[third == 0]
        found += [(i, int(index[b]), -1) for b in pairs]
        fits = (third >= second) & (third > 0)
        known = index[np.where(fits, third, 0)]
        found += [(i, int(index[b]), int(k)) for b, k, ok in zip(second, known, fits, strict=True) if ok and k >= 0]
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min ||A x - target||, x >= 0; ``columns`` lists each pattern's rows."""
    n, m = len(columns), len(target)
    dense = np.zeros((m, n))
    for k in range(columns.shape[1]):
        held = columns[:, k] >= 0
        np.add.at(dense, (columns[held, k], np.flatnonzero(held)), 1.0)
    x, passive = np.zeros(n), np.zeros(n, bool)
    limit = 1e-7 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds or 3 * m):
        gradient = dense.T @ (target - dense @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient)) if n else 0
        if not n or gradient[best] <= limit:
            break
        passive[best] = True
        while True:
            chosen = np.flatnonzero(passive)
            trial = np.linalg.lstsq(dense[:, chosen], target, rcond=None)[0]
            if trial.min() > 0:
                x[:] = 0
                x[chosen] = trial
                break
            falling = trial <= 0
            old = x[chosen]
            alpha = np.min(old[falling] / np.maximum(old[falling] - trial[falling], 1e-300))
            x[chosen] = old + alpha * (trial - old)
            passive[chosen[falling & (x[chosen] <= 1e-9)]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def fit(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid lengths present, patterns of them, and the patterns' fitted repeat counts."""
    counts: dict[int, int] = defaultdict(int)
    for length, count in histogram.items():
        counts[-(-length // grid)] += count
    total = capacity // grid
    present = np.array(sorted(p for p, k in counts.items() if p < total and k), np.int64)
    ways = patterns(present, total) if len(present) else np.empty((0, 3), np.int64)
    target = np.array([counts[p] for p in present.tolist()], float)
    return present, ways, nnls(ways, target) if len(ways) else np.empty(0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """The places (see ``fill``) for the share of the fitted counts that needs the fewest sequences, the largest if equal."""
    fitted = fit(histogram, capacity, grid)
    tried = [fill(histogram, fitted, share, capacity, grid) for share in SHARES]
    return min(tried, key=lambda places: max((first + many for _, _, many, first, _ in places), default=0))


def fill(histogram: dict[int, int], fitted: tuple[np.ndarray, np.ndarray, np.ndarray], share: float, capacity: int, grid: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (length, first rank, how many, first sequence, offset).

    The list is bounded by the lengths and patterns, not by the pieces: a step ends a length or a class of sequences.
    """
    left = {n: k for n, k in histogram.items() if k}
    used: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free tokens: (first sequence, how many) of classes
    free: list[int] = []
    sequences = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        places.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    def keep(space: int, first: int, count: int) -> None:
        if space:
            if space not in room:
                insort(free, space)
            room[space].append((first, count))

    present, ways, counts = fitted
    if len(ways):
        repeats = np.floor(share * counts + 1e-6).astype(np.int64)
        members = {int(p): sorted((n for n in left if -(-n // grid) == p)) for p in present}
        stock = np.array([sum(left[n] for n in members[p]) for p in present.tolist()])
        for way, count in sorted(zip(ways.tolist(), repeats.tolist(), strict=True), key=lambda x: -x[1]):
            parts = [p for p in way if p >= 0]
            count = min([count, *(int(stock[p]) // parts.count(p) for p in parts)])
            if count <= 0:
                continue
            for p in parts:
                stock[p] -= count
            classes = [(sequences, count, 0)]
            sequences += count
            for p in parts:
                split, lengths = [], members[int(present[p])]
                for first, many, offset in classes:
                    while many:
                        while not left[lengths[-1]]:
                            lengths.pop()
                        some = min(many, left[lengths[-1]])
                        put(lengths[-1], some, first, offset)
                        split.append((first, some, offset + lengths[-1]))
                        first, many = first + some, many - some
                classes = split
            for first, many, offset in classes:
                keep(capacity - offset, first, many)
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect_left(free, length)
            if at == len(free):  # no room anywhere: as many new sequences as this length fills alone
                each = capacity // length
                whole, rest = divmod(left[length], each)
                for first, many, inside in ((sequences, whole, each), (sequences + whole, 1 if rest else 0, rest)):
                    for k in range(inside if many else 0):
                        put(length, many, first, k * length)
                    if many:
                        keep(capacity - inside * length, first, many)
                sequences += whole + bool(rest)
                break
            space = free[at]
            first, many = room[space].pop()
            if not room[space]:
                del room[space]
                free.pop(at)
            some = min(many, left[length])
            put(length, some, first, capacity - space)
            keep(space - length, first, some)
            if many > some:
                keep(space, first + some, many - some)
    return places


def place_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to checkpointed pieces."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    #: The last rank of any length is far below 2**40, so one sorted number holds length and rank.
    starts = (places[:, 0] << 40) | places[:, 1]
    ranked = gapless_rank(cut, "length", ["doc_id", "piece", "ids_crc32"], "_rank")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def seat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = frame["_rank"].to_numpy(np.int64)
            at = np.searchsorted(starts, (frame["length"].to_numpy(np.int64) << 40) | rank, side="right") - 1
            frame["sequence_id"] = places[at, 3] + rank - places[at, 1]
            frame["offset"] = places[at, 4]
            yield frame[names]

    return ranked.mapInPandas(seat, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place_pieces(checkpointed(pieces(docs, path, capacity, cached_words)), capacity)
