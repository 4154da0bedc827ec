"""Keeping an index in step with a source tree: states of files, modules, merges of derived rows, parse errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files that mark the root of a module.
MANIFESTS = (".git", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "composer.json", "pom.xml", "build.gradle")
#: Bytes beyond which a file is not read.
MOST_BYTES = 1_500_000


def classify(disk: DataFrame, index: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, state) from files on disk and in the index (path, size, mtime, hash): new, deleted, unchanged (same size and time), oversize,
    failed (no hash), touch (same content) or reindex."""
    old = index.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"))
    both = disk.withColumn("_on_disk", F.lit(True)).join(old, "path", "full_outer")
    state = (
        F.when(F.col("_on_disk").isNull(), "deleted").when(F.col("size") > most, "oversize").when((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & (F.col("hash") == F.col("_hash")), "unchanged")
        .when(F.col("hash").isNull(), "failed").when(F.col("_hash").isNull(), "new").when(F.col("hash") == F.col("_hash"), "touch").otherwise("reindex")
    )
    return both.select("path", state.alias("state"))


def module_of(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, module): the shallowest folder above each file that holds a marker (a path that ends in a manifest or .git); '' without."""
    roots = markers.filter(F.regexp_extract("path", "([^/]*)$", 1).isin(*MANIFESTS)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("_folder")).distinct()
    parts = F.split("path", "/")
    above = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_depth", "_folder"))
    found = above.join(roots, "_folder", "left_semi").groupBy("path").agg(F.min_by("_folder", "_depth").alias("_module"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("_module", F.lit("")).alias("module"))


def replaced(table: DataFrame, rows: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    """``table`` with all rows of the given ``paths`` replaced by ``rows``; paths without rows are thereby deleted."""
    return table.join(paths.select(key).distinct(), key, "left_anti").unionByName(rows)


def deleted(tables: dict[str, DataFrame], paths: DataFrame, key: str = "path") -> dict[str, DataFrame]:
    """Every table of an index without the rows of deleted files."""
    gone = paths.select(key).distinct()
    return {name: table.join(gone, key, "left_anti") for name, table in tables.items()}


def touched(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """``files`` with mtime and size of ``metadata`` (path, mtime, size) and nothing else changed."""
    new = metadata.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    return files.join(new, "path", "left").withColumn("mtime", F.coalesce("_mtime", "mtime")).withColumn("size", F.coalesce("_size", "size")).drop("_mtime", "_size")


def with_errors(errors: DataFrame, found: DataFrame) -> DataFrame:
    """The table of parse errors (path, fingerprint, error) after ``found``: a new fingerprint replaces a path's rows, a known one is kept once."""
    fresh = found.dropDuplicates(["path", "fingerprint"]).join(errors.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")
    return errors.join(fresh.select("path").distinct(), "path", "left_anti").unionByName(fresh.select(*errors.columns))


def pruned_errors(errors: DataFrame, on_disk: DataFrame) -> DataFrame:
    return errors.join(on_disk.select("path").distinct(), "path", "left_semi")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Chunks (path, qualified_name, part, ...) with an id that follows from these, and no embedding."""
    return chunks.withColumn("id", F.xxhash64("path", "qualified_name", "part")).withColumn("embedded", F.lit(False))


def merged_cache(shared: DataFrame, local: DataFrame) -> DataFrame:
    """The shared embedding cache (content_hash, model, embedding) with what only the local one has; entries there are stay."""
    return shared.unionByName(local.join(shared.select("content_hash", "model"), ["content_hash", "model"], "left_anti").dropDuplicates(["content_hash", "model"]).select(*shared.columns))


def should_compact(rows: int, removed: int) -> bool:
    """Whether a table is worth rewriting: 500 rows are gone, or a fifth."""
    return removed >= 500 or removed * 5 >= rows > 0


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that a changed file had or has: those whose callers are graded again."""
    return reduce(lambda a, b: a.union(b), [before.select("name"), after.select("name")]).distinct()
