"""Graph operators: call edges, frontier walks, PageRank, grading, Louvain communities."""

from __future__ import annotations

import itertools
import re
import tempfile
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Confidence by the way an edge resolved.
QUALIFIED_ONE, QUALIFIED_MANY, BARE_ONE, BARE_MANY, UNRESOLVED = 0.9, 0.7, 0.6, 0.4, 0.3


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only in local mode without it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sparklore-"))
    return configured or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def grade_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds confidence (by the guess as parsed) and resolved_callee (the guess where a definition has it)."""
    by_q = functions.groupBy(F.col("qualified_name").alias("_q")).agg(F.count(F.lit(1)).alias("nq"))
    by_n = functions.groupBy(F.col("name").alias("_n")).agg(F.count(F.lit(1)).alias("nn"))
    joined = calls.join(by_q, F.col("guess") == F.col("_q"), "left").join(by_n, F.col("callee") == F.col("_n"), "left")
    confidence = (
        F.when(F.col("nq") == 1, QUALIFIED_ONE).when(F.col("nq") > 1, QUALIFIED_MANY)
        .when(F.col("is_method"), F.when(F.col("nn") >= 1, BARE_MANY).otherwise(UNRESOLVED))
        .when(F.col("nn") == 1, BARE_ONE).when(F.col("nn") > 1, BARE_MANY).otherwise(UNRESOLVED)
    )
    return joined.withColumn("confidence", confidence).withColumn("resolved_callee", F.when(F.col("nq") >= 1, F.col("guess"))).drop("_q", "_n", "nq", "nn")


def certainty(confidence) -> F.Column:
    return F.when(confidence >= 0.85, "exact").when(confidence >= 0.5, "inferred").otherwise("ambiguous")


def call_edges(graded: DataFrame) -> DataFrame:
    """(src, dst, confidence): bare names, no self edges, the best confidence of each pair."""
    src, dst = F.regexp_extract("caller", r"([^:.]*)$", 1), F.regexp_extract("callee", r"([^:.]*)$", 1)
    return graded.select(src.alias("src"), dst.alias("dst"), "confidence").filter("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def fan_out(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(qualified_name, name, fan_out): distinct callees of callers by either name, of each pair of names that functions have.

    Counts of both names less the callees that they share, so definitions of one name are not multiplied by its callees.
    """
    edges = calls.select("caller", "callee").filter("callee is not null").distinct()
    count = lambda name, n: edges.groupBy(F.col("caller").alias(name)).agg(F.count(F.lit(1)).alias(n))
    names = functions.select("qualified_name", "name").distinct()
    two = names.filter("qualified_name <> name")
    by_name = edges.select(F.col("caller").alias("name"), "callee")
    shared = two.join(edges.withColumnRenamed("caller", "qualified_name"), "qualified_name").join(by_name, ["name", "callee"], "left_semi")
    both = shared.groupBy("qualified_name", "name").agg(F.count(F.lit(1)).alias("_both"))
    joined = names.join(count("qualified_name", "_q"), "qualified_name", "left").join(count("name", "_n"), "name", "left").join(both, ["qualified_name", "name"], "left")
    zero = F.lit(0)
    bare = F.when(F.col("qualified_name") == F.col("name"), zero).otherwise(F.coalesce("_n", zero))
    return joined.select("qualified_name", "name", (F.coalesce("_q", zero) + bare - F.coalesce("_both", zero)).alias("fan_out"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth, pred): breadth-first levels from ``seeds`` (node) over (src, dst); least predecessor wins ties.
    Without ``depth`` it goes on until nothing new is reached."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("pred")))
    levels = seen = frontier
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "pred"))
        if frontier.isEmpty():
            break
        levels = levels.unionByName(frontier)
        if d % 10 == 0:
            levels = cut(levels)
        seen = levels
    return levels


def shortest_path(edges: DataFrame, start: int | str, goal: int | str, depth: int) -> DataFrame:
    """(step, node) of one shortest path; no rows where none is within ``depth``. Predecessors are joined level by level."""
    kind = dict(edges.dtypes)["src"]
    levels = cut(walk(edges, edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node")), depth))
    step = path = levels.filter(F.col("node") == goal)
    for _ in range(depth):
        step = cut(levels.join(step.filter("pred is not null").select(F.col("pred").alias("node")), "node", "left_semi"))
        if step.isEmpty():
            break
        path = path.unionByName(step)
    return path.select(F.col("depth").alias("step"), "node").orderBy("step")


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank), iterated to an L1 change below ``tolerance``: parallel edges count, self loops go, dangling mass spreads evenly."""
    out = edges.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    links = cut(out.join(out.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    sources = links.select(F.col("src").alias("node"), F.lit(False).alias("dangling")).distinct()
    n = nodes.select("node").distinct().count()
    start = nodes.select("node").distinct().join(sources, "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling"))
    ranks = cut(start.withColumn("rank", F.lit(1.0 / max(n, 1))).withColumn("change", F.lit(0.0)))
    for _ in range(iterations):
        dangling = ranks.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d")).first()["d"]
        given = ranks.join(links, ranks["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) / max(n, 1) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling / max(n, 1)))
        ranks = cut(ranks.join(given, "node", "left").select("node", "dangling", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change")))
        if (ranks.agg(F.sum("change").alias("c")).first()["c"] or 0.0) < tolerance:
            break
    return ranks.select("node", "rank")


def symbol_rank(edges: DataFrame, nodes: DataFrame, iterations: int = 100) -> DataFrame:
    """Square root of authority times hub, over the greatest: (node, rank)."""
    authority = pagerank(edges, nodes, iterations)
    hub = pagerank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes, iterations).withColumnRenamed("rank", "hub")
    both = authority.join(hub, "node").select("node", F.sqrt(F.col("rank") * F.col("hub")).alias("r"))
    most = both.agg(F.max("r").alias("m"))
    return both.join(F.broadcast(most)).select("node", F.round(F.col("r") / F.col("m"), 6).alias("rank"))  # one row


def _adjacency(rows: np.ndarray, columns: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, neighbours, weights) of entries in order: equal ones are summed where the first stands."""
    key = rows.astype(np.int64) * n + columns
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    summed = np.bincount(np.cumsum(new) - 1, weights=w[order], minlength=int(new.sum()))
    key, first = key[new], order[new]
    del order, new
    place = np.lexsort((first, key // n))
    key, summed = key[place], summed[place]
    return np.searchsorted(key // n, np.arange(n + 1)), (key % n).astype(np.int32), summed


def communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, levels: int = 16, sweeps: int = 64) -> np.ndarray:
    """Communities of an undirected weighted graph of nodes 0 to n - 1; deterministic: nodes go in order. Edges stay in arrays."""
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    starts, near, weight = _adjacency(np.column_stack((a, b)).ravel(), np.column_stack((b, a)).ravel(), np.repeat(w, 2), n)
    owner, loops = np.arange(n), np.zeros(n)
    for _ in range(levels):
        size, at = len(loops), starts.tolist()
        sums = [sum(weight[at[k] : at[k + 1]].tolist()) for k in range(size)]
        total = sum(sums) + sum(loops.tolist())
        degree = [x + y for x, y in zip(sums, loops.tolist(), strict=True)]
        group, mass = list(range(size)), degree[:]
        moved_any = False
        for _ in range(sweeps):
            moved = False
            for k in range(size):
                home = group[k]
                mass[home] -= degree[k]
                ties: dict[int, float] = {home: 0.0}
                for j, x in zip(near[at[k] : at[k + 1]].tolist(), weight[at[k] : at[k + 1]].tolist(), strict=True):
                    ties[group[j]] = ties.get(group[j], 0.0) + x
                gain = lambda c: ties[c] - mass[c] * degree[k] / total if total else 0.0  # noqa: E731, B023
                best = max(sorted(ties), key=lambda c: (gain(c), c == home))
                if best != home and gain(best) <= gain(home) + 1e-12:
                    best = home
                group[k] = best
                mass[best] += degree[k]
                moved |= best != home
            moved_any |= moved
            if not moved:
                break
        names = {c: k for k, c in enumerate(dict.fromkeys(group))}
        named = np.array([names[c] for c in group], np.int64)
        owner = named[owner]
        if not moved_any:
            break
        rows, columns = np.repeat(named, np.diff(starts)), named[near]
        inside = rows == columns
        loops = np.bincount(np.insert(rows, starts[:-1], named), weights=np.insert(np.where(inside, weight, 0.0), starts[:-1], loops), minlength=len(names))
        starts, near, weight = _adjacency(rows[~inside], columns[~inside], weight[~inside], len(names))
    return owner


def louvain(weights: pd.DataFrame, levels: int = 16, sweeps: int = 64) -> dict[str, int]:
    """``communities`` of a file graph (a, b, w), by name; nodes go in name order."""
    nodes = sorted(set(weights["a"]) | set(weights["b"]))
    index = {x: k for k, x in enumerate(nodes)}
    found = communities(*(weights[c].map(index).to_numpy(np.int32) for c in "ab"), weights["w"].to_numpy(float), len(nodes), levels, sweeps) if nodes else []
    return {name: int(k) for name, k in zip(nodes, found, strict=True)}


def subsystems(file_edges: DataFrame) -> DataFrame:
    """(path, subsystem) from (scope, a, b, w): Louvain per scope, whose file graph fits one task as arrays of numbers, some 100 bytes an edge."""
    edges = cut(file_edges.select("scope", "a", "b", "w"))
    paths = edges.select("scope", F.col("a").alias("path")).union(edges.select("scope", "b")).distinct()
    nodes = cut(paths.withColumn("_k", (F.row_number().over(Window.partitionBy("scope").orderBy("path")) - 1).cast("int")))
    side = lambda c: nodes.select("scope", F.col("path").alias(c), F.col("_k").alias(f"_{c}"))
    numbered = edges.join(side("a"), ["scope", "a"]).join(side("b"), ["scope", "b"]).select("scope", "_a", "_b", F.col("w").cast("double").alias("w"))

    def cluster(key: tuple, table: pa.Table) -> pa.Table:
        a, b, w = (table[c].to_numpy() for c in ("_a", "_b", "w"))
        del table
        found = communities(a, b, w, int(max(a.max(), b.max())) + 1)
        return pa.table({"scope": pa.array([key[0].as_py()] * len(found)), "_k": pa.array(np.arange(len(found), dtype=np.int32)), "subsystem": pa.array(found.astype(np.int32))})

    found = numbered.groupBy("scope").applyInArrow(cluster, "scope string, _k int, subsystem int")
    return nodes.join(found, ["scope", "_k"]).select("path", "subsystem")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node reachable, by spreading labels and jumping to their labels."""
    links = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    roots = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = links.join(roots, links["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_heard"))
        told = roots.join(heard, "node").select("node", F.col("root").alias("_old"), F.least("root", "_heard").alias("_root"))
        jump = roots.select(F.col("node").alias("_root"), F.col("root").alias("_next"))
        new = cut(told.join(jump, "_root", "left").select("node", "_old", F.least("_root", F.coalesce("_next", "_root")).alias("root")))
        if new.filter("_old <> root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
