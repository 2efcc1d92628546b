"""Streams: routing, upserts, quotas, deduplication and counters over files that arrive. Outputs and states are in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.streaming.merged import MergedTable
from siftline.tables import new_path

#: Setting and value of the state store that state of any form needs.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files at a path, be it a file or a folder, with the schema that they have; at most `files` a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path}*")


@contextmanager
def _store(spark: SparkSession, rocks: bool) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB, which state of any form needs."""
    before = spark.conf.get(STORE, None)
    if rocks:
        spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if rocks:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run_append(stream: DataFrame, name: str, rocks: bool = False) -> DataFrame:
    """Run a stream over all that is there into an append sink of Parquet, and read it."""
    path = new_path(stream.sparkSession, name)
    with _store(stream.sparkSession, rocks):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_latest(stream: DataFrame, name: str, keys: list[str], mode: str = "update", version: str | None = None, most: int = 8) -> DataFrame:
    """Run a stream and keep the latest row a key in a MergedTable: that of the largest version, else of the last batch."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    table = MergedTable(spark, path, stream.schema, keys, version, most)
    stream.writeStream.outputMode(mode).foreachBatch(table.write).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return table.read().select(*stream.columns)


def route(stream: DataFrame, router: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row-local router applied to a stream; it needs no state."""
    return router(stream)


def quota_windows(events: DataFrame, time: str, key: str, per_minute: int, late: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    """Requests by key and tumbling window, and whether they are over the budget. A batch of rows gives the same table."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    n = x.groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"))
    return n.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > per_minute).alias("over"))


def dedup_responses(prompts: DataFrame, time: str, hash_col: str, late: str = "1 hour") -> DataFrame:
    """The first of each prompt hash within the watermark."""
    return prompts.withWatermark(time, late).dropDuplicatesWithinWatermark([hash_col])


def stage_counts(routed: DataFrame, key: str) -> DataFrame:
    """Running counts by key."""
    return routed.groupBy(key).agg(F.count("*").alias("n"))
