"""Operators on memory records and the run ledger. ``now`` is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import cut

#: Buckets in which frequencies of hashed tokens are counted, places of a filter of keys, records of a block whose tokens are compared.
BUCKETS, SPOTS, TILE = 1 << 20, 1 << 22, 2048


def is_always_on(importance: Column, tags: Column | None = None) -> Column:
    """Importance of 5, or of 4 with one of the standing tags."""
    tagged = F.lit(False) if tags is None else F.exists(tags, lambda t: F.lower(F.trim(t)).isin("l0", "always-on", "critical"))
    return (importance >= 5) | ((importance >= 4) & tagged)


def effective_score(importance: Column, access: Column, last: Column, now: str, tags: Column | None = None) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last)) / 3600.0)
    decay = F.when(is_always_on(importance, tags) | last.isNull(), 0.0).otherwise(F.least(0.005 * hours, F.lit(0.5)))
    return F.round(F.greatest(F.lit(0.0), F.least(importance, F.lit(5.0))) / 5 + F.least(0.03 * access, F.lit(1.0)) - decay, 6)


def curate_stale(memories: DataFrame, now: str, days: int = 90, importance: float = 2) -> DataFrame:
    """Active records to archive for age: idle and unimportant."""
    idle = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_accessed_at")) / 86400)
    return memories.filter((F.col("status") == "active") & (idle >= days) & (F.col("importance") <= importance)).select("id", "project", idle.alias("idle_days"))


def token_text(text: Column) -> Column:
    """The sorted tokens of a text, joined by blanks; equal sets give equal texts."""
    return F.array_join(F.array_sort(T.curation_tokens(text)), " ")


def tokenised(memories: DataFrame, key: str, scope: str, text: str) -> DataFrame:
    """(scope, key, _t) of every record with tokens, each tokenised once."""
    return cut(memories.select(scope, key, token_text(F.col(text)).alias("_t"))).filter("_t <> ''")


def members_of(base: DataFrame, key: str, scope: str) -> DataFrame:
    """``class_members`` of tokenised records. Only digests of their tokens move."""
    hashed = cut(base.select(scope, key, F.unhex(F.sha2("_t", 256)).alias("_class")))
    ends = hashed.groupBy(scope, "_class").agg(F.min(key).alias("representative"), F.max(key).alias("newest"))
    return hashed.join(ends, [scope, "_class"]).select(scope, key, "representative", "newest")


def class_members(memories: DataFrame, key: str = "doc_id", scope: str = "project", text: str = "content") -> DataFrame:
    """(scope, key, representative, newest) of every record with tokens: the least and greatest key of its set of tokens."""
    return members_of(memories.select(scope, key, token_text(F.col(text)).alias("_t")).filter("_t <> ''"), key, scope)


def _among(rows: DataFrame, keys: DataFrame, inside: bool) -> DataFrame:
    """Rows whose first two columns are in ``keys``, or those that are not. Only rows that a filter of hashed keys can't tell move."""
    spot = lambda df: F.pmod(F.xxhash64(*df.columns[:2]), F.lit(SPOTS))
    table = np.zeros(SPOTS, bool)
    table[keys.select(spot(keys).alias("spot")).distinct().toArrow()["spot"].to_numpy()] = True  # SPOTS rows at most
    held = rows.sparkSession.sparkContext.broadcast(table)

    def look(spots: pd.Series) -> pd.Series:
        return pd.Series(held.value[spots.to_numpy()])

    maybe = F.pandas_udf(look, "boolean")(spot(rows))
    some = rows.filter(maybe).join(keys, keys.columns[:2], "left_semi" if inside else "left_anti")
    return some if inside else rows.filter(~maybe).unionByName(some)


def similar_pairs(memories: DataFrame, threshold: float = 0.8, key: str = "doc_id", scope: str = "project", text: str = "content") -> DataFrame:
    """(scope, a, b, jaccard) of all pairs in a scope at or above ``threshold``, exactly, by prefix filtering.

    Tokens go by rising frequency; a pair that similar shares a token in the shorter one's first |x| - ceil(2t/(1+t) |x|) + 1 and the longer
    one's first |y| - ceil(t |y|) + 1 tokens, so only those are joined, and only where their places leave room for enough more. Frequencies
    are counts of hashed tokens (any order is exact, and this one needs no join), and tokens meet by their hash. Sets of hashed bits then
    bound what a pair can share, and only records of pairs that they leave move their tokens. Equal token sets stand in as one row, that of
    the least key; ``class_members`` tells whom it stands for.
    """
    base = tokenised(memories, key, scope, text)
    return pairs_of(base, cut(members_of(base, key, scope)), threshold, key, scope)


def pairs_of(base: DataFrame, members: DataFrame, threshold: float, key: str, scope: str) -> DataFrame:
    """``similar_pairs`` of tokenised records and their classes."""
    kinds = dict(base.dtypes)
    names = f"{scope} {kinds[scope]}, a {kinds[key]}"
    low = threshold - 5e-7  # what rounds to the threshold
    share = low / (1 + low)
    classes = _among(base.select(scope, key, "_t"), members.filter(F.col(key) != F.col("representative")).select(scope, key), False).withColumnRenamed(key, "a")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                words = " ".join(part["_t"]).encode().split(b" ")
                yield part, np.array([x.count(" ") + 1 for x in part["_t"]]), np.fromiter(map(crc32, words), np.int64, len(words))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, np.int64)
        for _, _, h in hashed(frames):
            seen += np.bincount(h % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": used, "n": seen[used]})

    counted = base.select("_t").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    table = np.zeros(BUCKETS, np.int64)
    table[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    frequency = base.sparkSession.sparkContext.broadcast(table)

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = frequency.value
        for part, n, h in hashed(frames):
            row = np.repeat(np.arange(len(n)), n)
            ordered = h[np.lexsort((h, often[h % BUCKETS], row))].astype(np.uint32).view(np.int32)
            first = (n - np.ceil(low * n - 1e-9) + 1).astype(int)
            held = np.zeros((len(n), 1024), bool)
            held[row, h // BUCKETS % 1024] = True
            prefix = [ordered[at : at + k] for at, k in zip(np.cumsum(n) - n, first, strict=True)]
            yield pd.DataFrame({scope: part[scope].to_numpy(), "a": part["a"].to_numpy(), "n": n, "prefix": prefix, "bits": list(np.packbits(held, axis=1).view(np.int64))})

    sketches = cut(classes.mapInPandas(sketch, f"{names}, n int, prefix array<int>, bits array<long>"))
    prefix = sketches.select(scope, "a", "n", F.posexplode("prefix").alias("place", "token"))
    short = prefix.filter(F.col("place") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9))
    long = prefix.select(scope, F.col("a").alias("b"), F.col("n").alias("m"), F.col("place").alias("other_place"), "token")
    sizes = ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))) & (F.col("n") >= low * F.col("m") - 1e-9)
    # at the first token that a pair shares, only what follows it in both can be shared too
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other_place"))
    enough = share * (F.col("n") + F.col("m")) - 1e-9
    candidates = short.join(long, [scope, "token"]).filter(sizes & (room >= enough)).select(scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    marks = sketches.select(scope, "a", "n", "bits")
    others = marks.select(scope, F.col("a").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other_bits"))
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    most = F.least(F.col("n") - alone("bits", "other_bits"), F.col("m") - alone("other_bits", "bits"))
    pairs = cut(candidates.join(marks, [scope, "a"]).join(others, [scope, "b"]).filter(most >= enough).select(scope, "a", "b"))
    both = _compared(pairs, base.select(scope, key, "_t"), names)
    return both.select(scope, "a", "b", F.round(F.col("shared") / F.col("total"), 6).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def _compared(pairs: DataFrame, base: DataFrame, names: str) -> DataFrame:
    """(scope, a, b, shared, total): numbers of tokens that each of ``pairs`` (scope, a, b) shares and has.

    Records go by the least record near them into blocks of about ``TILE``, larger groups into several, and a task compares the pairs of two blocks, so the texts that
    move grow with the records and the blocks they meet, not with the pairs.
    """
    scope, key, _ = base.columns
    ends = pairs.select(scope, F.col("a").alias(key), F.col("a").alias("_near")).union(pairs.select(scope, "b", "a"))
    near = cut(ends.groupBy(scope, key).agg(F.min("_near").alias("_near")))
    nearer = near.select(scope, F.col(key).alias("_near"), F.col("_near").alias("_least"))
    near = cut(near.join(nearer, [scope, "_near"]).select(scope, key, "_least"))
    blocks = near.count() // TILE + 1
    crowds = near.groupBy(scope, "_least").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_parts"))
    block = F.pmod(F.xxhash64(scope, "_least"), F.lit(blocks)) + blocks * F.pmod(F.xxhash64(key), F.col("_parts"))
    dealt = cut(near.join(crowds, [scope, "_least"]).select(scope, key, block.alias("_block")))
    a, b = (dealt.select(scope, F.col(key).alias(c), F.col("_block").alias(f"_{c}")) for c in "ab")
    tiled = cut(pairs.join(a, [scope, "a"]).join(b, [scope, "b"]).select(scope, "a", "b", F.least("_a", "_b").alias("_i"), F.greatest("_a", "_b").alias("_j")))
    met = tiled.select(scope, F.col("a").alias(key), "_i", "_j").union(tiled.select(scope, "b", "_i", "_j")).distinct()
    texts = _among(base, near.select(scope, key), True).join(met, [scope, key]).withColumnsRenamed({"_i": "_p", "_j": "_q"})

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[str, int] = {}
        held = {}
        for s, x, t in zip(right[scope], right[key], right["_t"], strict=True):
            held[s, x] = np.array([numbers.setdefault(w, len(numbers)) for w in t.split(" ")], np.int32)
        shared, total = [], []
        for s, x, y in zip(left[scope], left["a"], left["b"], strict=True):
            p, q = held[s, x], held[s, y]
            shared.append(len(np.intersect1d(p, q, assume_unique=True)))
            total.append(len(p) + len(q) - shared[-1])
        return pd.DataFrame({scope: left[scope], "a": left["a"], "b": left["b"], "shared": shared, "total": total})

    return tiled.groupBy("_i", "_j").cogroup(texts.groupBy("_p", "_q")).applyInPandas(compare, f"{names}, b {dict(pairs.dtypes)['b']}, shared long, total long")


def curate_greedy(pairs: DataFrame, scope: str = "project") -> DataFrame:
    """(scope, loser, keeper): pairs in order, a loser drops out at once; a scope's similar pairs fit one task, as two arrays of keys."""

    def fold(table: pa.Table) -> pa.Table:
        a, b = (table[c].to_numpy() for c in "ab")
        order = np.lexsort((a, b))[::-1]
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        gone, keepers = {}, b[starts].tolist()
        for keeper, at, end in zip(keepers, starts, [*starts[1:], len(b)], strict=True):
            if keeper not in gone:
                for loser in a[at:end].tolist():
                    gone.setdefault(loser, keeper)
        return pa.table({scope: pa.repeat(table[scope][0], len(gone)), "loser": pa.array(gone.keys(), pa.int64()), "keeper": pa.array(gone.values(), pa.int64())})

    return pairs.select(scope, "a", "b").groupBy(scope).applyInArrow(fold, f"{scope} string, loser long, keeper long")


def curate_copies(memories: DataFrame, threshold: float = 0.8, key: str = "doc_id", scope: str = "project", text: str = "content") -> DataFrame:
    """(scope, loser, keeper) of ``curate_greedy`` over the pairs of all records, copies too.

    The newest record of a set of tokens meets all pairs of its class first, so a class falls as a whole, to the newest of
    another, or keeps its newest and loses the rest: the pairs of the newest decide, and no group is expanded into all pairs.
    """
    base = tokenised(memories, key, scope, text)
    members = cut(members_of(base, key, scope))
    newest = members.select(scope, "representative", "newest").distinct()
    a, b = (newest.select(scope, F.col("representative").alias(c), F.col("newest").alias(f"_{c}")) for c in "ab")
    pairs = cut(pairs_of(base, members, threshold, key, scope).select(scope, "a", "b")).join(a, [scope, "a"]).join(b, [scope, "b"])
    fallen = curate_greedy(pairs.select(scope, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")), scope)
    kept = members.join(fallen.withColumnRenamed("loser", "newest"), [scope, "newest"], "left").withColumn("keeper", F.coalesce("keeper", "newest"))
    return kept.filter(F.col(key) != F.col("keeper")).select(scope, F.col(key).alias("loser"), "keeper")


def newest_runs(runs: DataFrame, keep: int = 500) -> DataFrame:
    """The ledger after pruning: the newest runs of each project."""
    order = Window.partitionBy("project").orderBy(F.col("id").desc())
    return runs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def last_green(runs: DataFrame, scope: list[str]) -> DataFrame:
    """Newest passing run per scope, with that run's kind."""
    return runs.filter("ok").groupBy(*scope).agg(F.max("ran_at").alias("ran_at"), F.max_by("kind", F.struct("ran_at", "id")).alias("kind"))


def stale_files(files: DataFrame, targeted: DataFrame, wide: DataFrame) -> DataFrame:
    """Files (path, project, changed_at) changed at or after the newest run that covers them; a tie is stale.

    ``targeted`` has (path, ran_at), ``wide`` (project, ran_at); a targeted run counts where it is as new as the wide one.
    """
    joined = files.join(targeted.select("path", F.col("ran_at").alias("t")), "path", "left").join(wide.select("project", F.col("ran_at").alias("w")), "project", "left")
    covered = F.when(F.col("t").isNotNull() & (F.col("w").isNull() | (F.col("t") >= F.col("w"))), F.col("t")).otherwise(F.col("w"))
    return joined.withColumn("covered_at", covered).filter(F.col("covered_at").isNull() | (F.col("changed_at") >= F.col("covered_at"))).select("path", "project", "changed_at", "covered_at")


def transcript_digest(turns: DataFrame) -> DataFrame:
    """Per conversation the last real user text (8 characters or more) and the last assistant text (80 or more)."""
    user = F.when((F.col("role") == "user") & (F.length(F.trim("text")) >= 8), F.col("turn"))
    assistant = F.when((F.col("role") == "assistant") & (F.length(F.trim("text")) >= 80), F.col("turn"))
    return turns.groupBy("conv_id").agg(F.max_by("text", F.struct(user, "text")).alias("_u"), F.max(user).alias("user_turn"), F.max_by("text", F.struct(assistant, "text")).alias("_a"), F.max(assistant).alias("assistant_turn")).select(
        "conv_id", F.when(F.col("user_turn").isNotNull(), F.col("_u")).alias("last_user"), F.when(F.col("assistant_turn").isNotNull(), F.col("_a")).alias("last_assistant"))


def nearest_same_project(vectors: DataFrame, threshold: float = 0.12, block: int = 8192) -> DataFrame:
    """(label, a, b, distance): per record its nearest earlier record of the project, where it is below ``threshold``.

    Records of a project are dealt into blocks of about ``block`` by their key, and a task compares two blocks in numpy, so no pair table
    is built and a task's memory does not grow with its project. Of equal distances (to 12 digits) the least key counts.
    """
    rows = vectors.select("label", "vec_id", "embedding").filter("label is not null")
    blocks = -(-(rows.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 1) // block)

    def nearest(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        def side(part: pd.DataFrame) -> tuple:
            part = part.sort_values("vec_id", ignore_index=True)
            v = np.stack(part["embedding"].to_numpy()).astype(float) if len(part) else np.zeros((0, 1))
            return part["vec_id"].to_numpy(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)

        i, j = int(frame["_i"].iloc[0]), int(frame["_j"].iloc[0])
        first = side(frame[frame["_own"] == i])
        second = side(frame[frame["_own"] == j]) if i != j else first
        found = []
        for (ids, v), (others, w) in [(first, second), (second, first)][: 1 + (i != j)]:
            for at in range(0, len(v) if len(w) else 0, 512):
                own = ids[at : at + 512]
                d = np.round(1 - v[at : at + 512] @ w.T, 12)
                d[others[None, :] >= own[:, None]] = np.inf
                best = d.argmin(axis=1)
                near = d[np.arange(len(d)), best]
                hit = np.flatnonzero(near < threshold)
                found.append(pd.DataFrame({"label": frame["label"].iloc[0], "a": own[hit], "b": others[best[hit]], "d": near[hit]}))
        return pd.concat(found) if found else pd.DataFrame({"label": [], "a": [], "b": [], "d": []})

    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = dealt.select("label", "vec_id", "embedding", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    near = pairs.groupBy("label", "_i", "_j").applyInPandas(nearest, "label int, a long, b long, d double")
    best = near.groupBy("label", "a").agg(F.min(F.struct("d", "b")).alias("_m"))
    return best.select("label", "a", "_m.b", F.round("_m.d", 6).alias("distance"))


def hint_ledger(asked: DataFrame, most: int = 8) -> DataFrame:
    """(session, symbol, first_at) of the hints to give: the first ``most`` distinct symbols of each session in (session, symbol, at)."""
    first = asked.groupBy("session", "symbol").agg(F.min("at").alias("first_at"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("first_at", "symbol"))
    return first.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")
