"""Mailbox change streams: the batch operators applied to micro-batches.

State lives in written tables, so a restarted query goes on where it stopped and a
replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators import changes, delivery_dedup


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def accepted_notifications(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each notification once, by seen ranges; runs until the source is drained."""
    sink = delivery_dedup.foreach_batch(target)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def net_changes(stream: DataFrame, keys: list[str], order: list[str], deleted: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last event of every key as a table of versions under ``target``.

    Each batch joins the version before it and writes the next one; the version number
    is the batch number, so a replay rewrites the same folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(*keys).agg(F.max(F.struct(*order, F.col(deleted).cast("int").alias("gone"))).alias("last"))
        if number > 0:
            before = spark.read.parquet(f"{target}/version={number - 1}")
            last = before.select(*keys, "last").unionByName(last).groupBy(*keys).agg(F.max("last").alias("last"))
        last.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_of(spark: SparkSession, target: str, version: int, keys: list[str]) -> DataFrame:
    """(keys, op) of one version."""
    op = F.when(F.col("last.gone") == 1, "deleted").otherwise("added")
    return spark.read.parquet(f"{target}/version={version}").select(*keys, op.alias("op"))


def cursors(stream: DataFrame, key: str, sequence: str) -> DataFrame:
    """Running greatest sequence number per key (update mode)."""
    return changes.cursors(stream, key, sequence)


def hourly(stream: DataFrame, at: str, by: str, late: str = "1 hour") -> DataFrame:
    """Counts of tumbling hours with a watermark (extension)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), by).agg(F.count("*").alias("events"))
