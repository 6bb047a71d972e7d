"""Keyed change application on Parquet tables, and history folding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key over both tables; later ``order`` wins, nulls lose."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete_stale(stored: DataFrame, current: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Stored rows without those whose parent was reprocessed and no longer has them."""
    touched = current.select(*parent).distinct()
    stale = stored.join(touched, parent, "left_semi").join(current.select(*parent, key), [*parent, key], "left_anti")
    return stored.join(stale.select(*parent, key).distinct(), [*parent, key], "left_anti")


def net_changes(events: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    """(keys, op): the last event of each key decides; of one record deletes count after adds."""
    last = F.max_by(deleted, F.struct(*order, F.col(deleted).cast("int")))
    return events.groupBy(*keys).agg(last.alias("_d"), F.count("*").alias("events")).select(
        *keys, F.when(F.col("_d"), "deleted").otherwise("added").alias("op"), "events"
    )


def cursors(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, cursor): greatest sequence number, compared as numbers; never rewinds."""
    return events.groupBy(key).agg(F.max(F.coalesce(F.expr(f"try_cast({sequence} as decimal(20,0))"), F.lit(0).cast("decimal(20,0)"))).alias("cursor"))


def running_max(events: DataFrame, key: str, at: str, tie: str, value: str, block: int = 3600) -> DataFrame:
    """Events with ``cursor``: the greatest value of the key up to the event, in order of (at, tie), null times last.

    Windows hold one block of ``block`` seconds of a key; what came before is a running
    maximum over one row a block, so a key with a third of all events is no single task.
    """
    rows = events.withColumn("_block", F.coalesce(F.floor(F.unix_seconds(at) / block), F.lit(1 << 60)))
    inside = Window.partitionBy(key, "_block").orderBy(F.col(at).asc_nulls_last(), tie).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_block").agg(F.max(value).alias("_top")).select(key, "_block", F.max("_top").over(before).alias("_before"))
    return rows.withColumn("_here", F.max(value).over(inside)).join(blocks, [key, "_block"]).withColumn("cursor", F.greatest("_here", "_before")).drop("_block", "_here", "_before")


def pending(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no fingerprint in ``done`` covers."""
    return candidates.join(done.select(*keys).distinct(), keys, "left_anti")
