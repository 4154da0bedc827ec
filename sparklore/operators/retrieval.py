"""Full text (BM25), vectors (exact cosine), fusion (RRF), MinHash and existence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from .graph import cut

K1, B = 1.2, 0.75
RRF_K = 60
#: Boosts of a search hit for its name, and the weight of its rank.
EXACT_NAME, NAME_PREFIX, RANK_WEIGHT = 1000.0, 500.0, 5.0
#: Words too common in names to tell anything alone.
GENERIC = (
    "get", "set", "add", "new", "list", "find", "fetch", "file", "files", "path", "paths", "data", "value", "values", "item", "items", "run",
    "make", "create", "update", "delete", "remove", "open", "close", "read", "write", "save", "load", "name", "names", "type", "types", "key",
    "keys", "index", "store", "count", "init", "handle", "process", "build", "parse", "check", "call", "exec", "use", "main", "util", "utils",
    "helper", "func", "method", "class", "object", "string", "number", "temp",
)
#: Tokens that carry a program's skeleton; other names are alike in the structural view.
KEYWORDS = (
    "if", "else", "elif", "while", "for", "foreach", "loop", "do", "switch", "case", "default", "match", "break", "continue", "return", "yield",
    "goto", "try", "catch", "except", "finally", "throw", "throws", "raise", "panic", "defer", "go", "async", "await", "fn", "func", "function",
    "def", "lambda", "class", "struct", "enum", "trait", "interface", "impl", "extends", "implements", "let", "const", "var", "mut", "static",
    "final", "public", "private", "protected", "new", "delete", "import", "from", "use", "package", "module", "export", "self", "this", "super",
    "true", "false", "null", "nil", "none", "some", "ok", "err", "and", "or", "not", "in", "is", "as", "with", "pass", "void",
)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl) of every document, counted in its row without a shuffle: sorted words, and where each run of equal ones starts.
    A key that occurs in several rows has postings of each."""
    tokens = docs.select(key, F.explode(F.array(F.array_sort(T.words(F.col(text))))).alias("_w")).filter(F.size("_w") > 0)
    new = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1)))
    starts = tokens.select(key, "_w", F.size("_w").alias("dl"), F.explode(F.array(new)).alias("_s"))
    runs = F.transform("_s", lambda s, i: F.struct(F.get("_w", s).alias("term"), (F.coalesce(F.get("_s", i + 1), F.col("dl")) - s).cast("long").alias("tf")))
    return starts.select(key, "dl", F.explode(runs).alias("_r")).select(key, "_r.term", "_r.tf", "dl")


def bm25(docs: DataFrame, key: str, text: str, query: list[str], prefix: bool = False) -> DataFrame:
    """(key, score) of every document with a query term, or with ``prefix`` with a word that starts so. Texts are read and cut into words
    once; lengths and counts of the terms are kept, and statistics and scores come from these."""
    terms = list(dict.fromkeys(query))
    if not terms:
        return docs.limit(0).select(key, F.lit(0.0).alias("score"))

    def occurrences(term: str) -> Column:
        return F.size(F.filter("_w", lambda x: x.startswith(term) if prefix else x == term))

    lists = docs.select(key, F.explode(F.array(T.words(F.col(text)))).alias("_w"))
    scanned = cut(lists.select(key, F.size("_w").alias("dl"), *[occurrences(t).alias(f"_tf{i}") for i, t in enumerate(terms)]))
    stats = scanned.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))])
    joined = scanned.filter(reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))  # one row of statistics
    parts = [bm25_part(F.col(f"_tf{i}"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col(f"_df{i}")) for i in range(len(terms))]
    return joined.select(key, F.round(reduce(lambda a, b: a + b, parts), 6).alias("score"))


def bm25_part(tf: Column, dl: Column, n: Column, avgdl: Column, df: Column) -> Column:
    """What a term adds to a document's score."""
    idf = F.greatest(F.lit(1e-6), F.ln((n - df + 0.5) / (df + 0.5)))
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class LexicalIndex:
    """An inverted index in a shared folder: postings parted by a hash of their term, and the statistics of the corpus.

    A search reads the parts of its terms only; the corpus is cut into words once, when the index is written.
    """

    PARTS = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def write(cls, docs: DataFrame, key: str, text: str, folder: str) -> LexicalIndex:
        part = F.pmod(F.xxhash64("term"), F.lit(cls.PARTS)).cast("int")
        found = postings(docs, key, text).withColumn("part", part)
        found.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/postings")
        sizes = docs.select(F.size(T.words(F.col(text))).alias("dl"))
        sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{folder}/statistics")
        return cls(docs.sparkSession, folder)

    def search(self, query: list[str], key: str) -> DataFrame:
        """(key, score) of every document with a query term."""
        terms = list(dict.fromkeys(query))
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.PARTS)).cast("int").alias("p"))
        parts = [r["p"] for r in wanted.distinct().collect()]  # as many as the query has terms
        found = self.spark.read.parquet(f"{self.folder}/postings").filter(F.col("part").isin(parts) & F.col("term").isin(terms))
        hits = found.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        stats = self.spark.read.parquet(f"{self.folder}/statistics")
        joined = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))  # a row for each term, and one row
        return joined.groupBy(key).agg(F.round(F.sum(bm25_part(F.col("tf"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("df"))), 6).alias("score"))


def search_terms(query: str) -> list[str]:
    """Lower-cased prefix terms of a code query; an underscore parts terms too."""
    return [x for x in re.split(r"[\W_]+", query.lower()) if x]


def search_code(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, name, score) of symbols (id, name, text, rank): BM25 of prefix terms over all their text, a boost that no text reaches for the
    name itself or a prefix of it, and a nudge by rank."""
    needle, name = query.strip().lower(), F.lower("name")
    found = bm25(symbols, "id", "text", search_terms(query), prefix=True)
    boost = F.when(name == needle, EXACT_NAME).when(name.startswith(needle) | F.startswith(F.lit(needle), name), NAME_PREFIX).otherwise(0.0)
    scored = symbols.select("id", "name", "rank").join(found, "id").select("id", "name", F.round(F.col("score") + boost + RANK_WEIGHT * F.col("rank"), 5).alias("score"))
    return top(scored, limit, F.desc("score"), F.col("id"))


def fnv1a(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for byte in data:
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def bag_vector(text: str, dim: int) -> list[float]:
    """A deterministic embedding: lower-cased words counted in hashed dimensions, at unit length; the first axis for no words."""
    vector = np.zeros(dim)
    for word in re.split(r"[\W_]+", text):
        if word:
            vector[fnv1a(word.lower().encode()) % dim] += 1
    norm = np.sqrt((vector * vector).sum())
    return (vector / norm if norm else np.eye(1, dim)[0]).tolist()


def embedded(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, embedding): the deterministic embedding of each text, words hashed once in a task."""

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "embedding": [bag_vector(x or "", dim) for x in frame[text]]})

    return docs.select(key, text).mapInPandas(embed, f"{key} {dict(docs.dtypes)[key]}, embedding array<double>")


def semantic_search(chunks: DataFrame, vectors: DataFrame, query: list[float], k: int, over: int = 50) -> DataFrame:
    """(qualified_name, id, score) of chunks (id, qualified_name) by vectors (id, embedding): the nearest ``over``, the best of each name,
    and of these the first ``k``; scores are 1 - distance between 0 and 1."""
    near = knn(vectors, query, over, "id").join(chunks.select("id", "qualified_name"), "id")
    best = near.groupBy("qualified_name").agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance"))), 6)
    return top(best.select("qualified_name", "id", score.alias("score")), k, F.desc("score"), F.col("qualified_name"))


def _mix64(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def fnv1a_many(texts: list[bytes]) -> np.ndarray:
    """``fnv1a`` of each text, byte by byte over all that are as long."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    starts, falling = (np.cumsum(sizes) - sizes)[order], -sizes[order]
    data, state = np.frombuffer(b"".join(texts), np.uint8), np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    for place in range(-int(falling[0]) if len(texts) else 0):
        n = int(np.searchsorted(falling, -place))  # texts longer than ``place``
        state[:n] ^= data[starts[:n] + place]
        state[:n] *= np.uint64(0x100000001B3)
    out = np.empty_like(state)
    out[order] = state
    return out


def _least(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least mixed value for each seed, over blocks that stay in the processor's cache."""
    least = np.full(len(seeds), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(values), 1024):
        x = values[at : at + 1024, None] ^ seeds
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def code_signature(code: str, hashes: int = 64) -> list[int]:
    """Two MinHash views of a text's token 3-grams: as written, and with chosen names alike. No tokens: all values are the greatest."""
    return code_signatures_of([code], hashes)[0]


def code_signatures_of(codes: list[str], hashes: int = 64) -> list[list[int]]:
    """``code_signature`` of each text; the grams of all are hashed together."""
    seeds = _mix64(np.arange(hashes, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    grams: list[bytes] = []
    ends = [0]
    alike: dict[str, str] = {}
    for code in codes:
        tokens = re.findall(r"\w+|[^\w\s]", code)
        for t in [t for t in set(tokens) if t not in alike]:
            alike[t] = "\x02" if (t[0].isalpha() or t[0] == "_") and t.lower() not in KEYWORDS else t
        for view in (tokens, [alike[t] for t in tokens]):
            grams += [g.encode() for g in set(map("\x01".join, zip(view, view[1:], view[2:], strict=False))) or set(view)]
            ends.append(len(grams))
    values = fnv1a_many(grams)
    views = [(_least(values[a:b], seeds) >> np.uint64(32)).tolist() if b > a else [0xFFFFFFFF] * hashes for a, b in zip(ends, ends[1:], strict=False)]
    return [views[i] + views[i + 1] for i in range(0, len(views), 2)]


def code_signatures(symbols: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signature) of every symbol's text."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):  # so many texts share their hashing
                part = frame.iloc[at : at + 256]
                yield pd.DataFrame({key: part[key], "signature": code_signatures_of([x or "" for x in part[text]])})

    return symbols.select(key, text).mapInPandas(sign, f"{key} {dict(symbols.dtypes)[key]}, signature array<long>")


def similar_code(signatures: DataFrame, key: str, seed: int, n: int, hashes: int = 64, own: DataFrame | None = None) -> DataFrame:
    """(key, score): the mean of both views' estimates against one symbol, itself and what is not alike left out. ``own`` is the seed's row
    of ``signatures`` where it can be had without signing the others (a filter does not go down through Python)."""
    one = (signatures if own is None else own).filter(F.col(key) == seed).select(F.col("signature").alias("_q"))

    def view(at: int) -> Column:
        a, b = F.slice("signature", at, hashes), F.slice("_q", at, hashes)
        same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / hashes
        return F.when((F.array_min(a) == 0xFFFFFFFF) | (F.array_min(b) == 0xFFFFFFFF), 0.0).otherwise(same)

    found = signatures.filter(F.col(key) != seed).join(F.broadcast(one)).select(key, F.round((view(1) + view(1 + hashes)) / 2, 6).alias("score")).filter("score > 0")  # one row
    return top(found, n, F.desc("score"), F.col(key))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1 where a norm is zero; the shorter length wins."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), zero)), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), 1.0).otherwise(1 - dot / (norm(a) * norm(b)))


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact nearest neighbours: (key, distance); filter ``vectors`` first to scope the search."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select(key, F.round(cosine_distance(F.col(column), q), 6).alias("distance")), k, F.col("distance"), F.col(key))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """0-based rank of a list that a limit has bounded already."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def rrf(lists: list[DataFrame], key: str, n: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank): each list counts a key once, at its best rank."""
    once = [x.groupBy(key).agg(F.min("rank").alias("rank")) for x in lists]
    both = reduce(lambda a, b: a.unionByName(b), once)
    fused = both.groupBy(key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top(fused, n, F.col("score").desc(), F.col(key))


def check_exists(symbols: DataFrame, routes: DataFrame, bodies: DataFrame, query: str) -> DataFrame:
    """One row (verdict, confidence, kind, evidence): whether a thing exists, from symbols (name, qualified_name, path), routes (route,
    handler_method, handler_class) and bodies (path, body), all outside test paths.

    In this order: a name that the query is or holds and that is more than a chance word, a route, a name that shares enough words,
    then weak signs (one word of many on a name or route, words in bodies only), else absent. Among equals the name decides.
    """
    spark = symbols.sparkSession
    tokens = [x for x in dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if len(w.encode()) >= 3) if x not in T.STOP_WORDS]
    if not tokens:
        return spark.createDataFrame([("absent", 0.0, None, None)], "verdict string, confidence double, kind string, evidence string")
    focused = len(query.split()) == 1
    wanted, pieces = F.array(*map(F.lit, tokens)), T.verdict_pieces(F.col("name"))
    matched = F.filter(wanted, lambda t: (t == F.lower("name")) | F.array_contains("_pieces", t))
    names = symbols.filter(~P.is_test_path(F.col("path"))).withColumn("_pieces", pieces).withColumn("_matched", matched).withColumn("_n", F.size("_matched"))
    exact = (F.lower("name") == query.strip().lower() if focused else F.lit(False)) | F.lower("name").isin(tokens)
    telling = F.exists("_matched", lambda t: ~t.isin(*GENERIC)) | ((F.size("_pieces") > 0) & (F.size(F.array_except("_pieces", "_matched")) == 0))
    worthy = F.lit(True) if focused else (F.col("_n") >= 2) & telling
    judged = names.select("name", "qualified_name", "path", "_n", exact.alias("_exact"), worthy.alias("_worthy")).filter("_exact or _n > 0")
    best = judged.groupBy("_exact").agg(F.max_by(F.struct("qualified_name", "_n", "_worthy"), F.struct("_n", F.hash("qualified_name", "path"))).alias("b")).select("_exact", "b.*")
    text = F.lower(F.concat_ws(" ", "route", F.coalesce("handler_method", F.lit("")), F.coalesce("handler_class", F.lit(""))))
    known = symbols.filter(~P.is_test_path(F.col("path"))).select(F.col("name").alias("handler_method")).distinct()
    held = F.size(F.filter(wanted, lambda t: F.contains(text, t)))
    handled = routes.join(known, "handler_method", "left_semi").select("route", held.alias("_n")).filter("_n > 0").agg(F.max_by("route", F.struct("_n", "route")).alias("route"), F.max("_n").alias("_n")).filter("route is not null")
    grep = "(?i)(" + "|".join(map(re.escape, tokens)) + ")"
    body = bodies.filter(~P.is_test_path(F.col("path")) & F.col("body").rlike(grep)).agg(F.min("path").alias("path")).filter("path is not null")

    def rows(df: DataFrame, order: Column, verdict: Column, confidence: Column, kind: str, evidence: str) -> DataFrame:
        return df.select(order.cast("int").alias("_order"), verdict.alias("verdict"), confidence.cast("double").alias("confidence"), F.lit(kind).alias("kind"), F.col(evidence).alias("evidence"))

    sure, weak, two = F.lit("exists"), F.lit("weak"), F.col("_n") >= 2
    a, b = best.filter("_exact"), best.filter("not _exact")
    strong_route = F.lit(True) if focused else two
    found = [
        rows(a, F.when(F.col("_worthy"), 1).otherwise(4), F.when(F.col("_worthy"), sure).otherwise(weak), F.when(F.col("_worthy"), F.when(two, 0.92).otherwise(0.85)).otherwise(0.5), "exact", "qualified_name"),
        rows(handled, F.when(strong_route, 2).otherwise(5), F.when(strong_route, sure).otherwise(weak), F.when(strong_route, 0.8).otherwise(0.45), "route", "route"),
        rows(b, F.when(F.col("_worthy"), 3).otherwise(6), F.when(F.col("_worthy"), sure).otherwise(weak), F.when(F.col("_worthy"), F.when(two, 0.82).otherwise(0.65)).otherwise(0.45), "name", "qualified_name"),
        rows(body, F.lit(7), weak, F.lit(0.3), "body", "path"),
        spark.createDataFrame([(8, "absent", 0.65, None, None)], "_order int, verdict string, confidence double, kind string, evidence string"),
    ]
    return reduce(lambda x, y: x.unionByName(y), found).orderBy("_order").limit(1).drop("_order")


def fit_dim(vector: Column, n: int) -> Column:
    """The first ``n`` dimensions, at unit length; a zero vector stays."""
    cut_off = F.transform(F.slice(vector, 1, n), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut_off, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, cut_off).otherwise(F.transform(cut_off, lambda x: x / norm))


def round_as_double(x: Column, digits: int) -> Column:
    """``x`` rounded on its binary value, half away from zero; what rounds to zero keeps its sign (Spark's own round goes by the decimal text
    and loses the sign)."""
    scaled = F.abs(x) * 10.0**digits
    whole = F.floor(scaled).cast("double")
    rounded = (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(F.isnan(x) | (scaled >= 2.0**52), x).when((x < 0) | (x.cast("string") == "-0.0"), -rounded).otherwise(rounded)
