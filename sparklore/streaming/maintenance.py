"""Incremental maintenance: file events are debounced per micro-batch and merged, idempotently, into a table folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of every key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return events.withColumn("_n", rank).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of the batch replace those of the same key unless they are older; replays change nothing."""
    return latest(existing.unionByName(batch), key, order)


def maintain(events: DataFrame, spark: SparkSession, folder: str, key: str, order: list[str]) -> Callable[[], DataFrame]:
    """Run a stream of events to its end into versions ``folder/v<batch>``; returns a reader of the newest version."""
    state = {"version": None}

    def merge(batch: DataFrame, number: int) -> None:
        once = latest(batch, key, order)
        before = state["version"]
        merged = once if before is None else upsert(spark.read.parquet(before), once, key, order)
        path = f"{folder}/v{number}"
        merged.write.mode("overwrite").parquet(path)
        state["version"] = path

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return lambda: spark.read.parquet(state["version"])
