"""Exactly-once acceptance of messages that were delivered at least once.

An identifier made of digits is read as *producer* (the leading digits) and a
*sequence number*. For each producer the numbers already accepted are kept as
disjoint closed ranges, cut into blocks of ``BLOCK`` numbers so that no state
row and no group can grow beyond ``BLOCK`` entries however busy one producer is.
A delivery whose number lies in a range is a repeat; an uncovered number is
accepted once, with the smallest (received_at, delivery_id). Identifiers of any
other form are looked up by exact key.

Defined results
  * null received_at sorts after every time; ties fall to the smaller delivery id
  * no identifier (null column and no readable push body): never a repeat, never
    accepted, reported with a null ``message_key``
  * an identifier with leading zeros or over 18 digits is an exact key
  * empty input gives empty outputs; extra columns are ignored
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.runtime import materialize

#: numbers in a block of a producer's sequence; bounds every state row
BLOCK = 4096
#: digits that count within a producer
SEQUENCE_DIGITS = 12

STATE_SCHEMA = "producer bigint, block bigint, ranges array<struct<lo: bigint, hi: bigint>>"
KEYS_SCHEMA = "message_key string"


@dataclass
class SeenState:
    """What earlier batches accepted: number ranges, and keys of other form."""

    ranges: DataFrame
    keys: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> SeenState:
        return SeenState(spark.createDataFrame([], STATE_SCHEMA), spark.createDataFrame([], KEYS_SCHEMA))


def push_identifier(body: Column) -> Column:
    """Message id inside a raw push body; either spelling of the field, else null."""
    return F.coalesce(
        F.get_json_object(body, "$.message.messageId"), F.get_json_object(body, "$.message.message_id")
    )


def keyed(deliveries: DataFrame) -> DataFrame:
    """(delivery_id, received_at, message_key, producer, block, seq) of each delivery."""
    # an empty string is no identifier in either place
    key = F.coalesce(
        F.nullif(F.col("pubsub_message_id"), F.lit("")), F.nullif(push_identifier(F.col("push_body")), F.lit(""))
    )
    number = F.when(F.col("message_key").rlike("^[1-9][0-9]{0,17}$"), F.col("message_key").cast("bigint"))
    span = 10**SEQUENCE_DIGITS
    return (
        deliveries.select("delivery_id", "received_at", key.alias("message_key"))
        .withColumn("n", number)
        .select(
            "delivery_id",
            "received_at",
            "message_key",
            F.expr(f"n div {span}").alias("producer"),
            F.expr(f"(n % {span}) div {BLOCK}").alias("block"),
            F.expr(f"n % {span}").alias("seq"),
        )
    )


def _arrival() -> Column:
    return F.struct(F.col("received_at").isNull().alias("late"), "received_at", "delivery_id")


def merge_ranges(numbers: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Disjoint maximal ranges per (producer, block) of accepted numbers and a prior state.

    Gaps and islands: a piece that starts beyond everything before it opens a range. Each
    window holds at most ``BLOCK`` pieces.
    """
    pieces = numbers.select("producer", "block", F.col("seq").alias("lo"), F.col("seq").alias("hi"))
    if prior is not None:
        pieces = pieces.unionByName(prior.select("producer", "block", F.explode("ranges").alias("r")).select("producer", "block", "r.lo", "r.hi"))
    in_order = Window.partitionBy("producer", "block").orderBy("lo", "hi")
    reached = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        pieces.withColumn("opens", (F.col("lo") > F.coalesce(reached + 1, F.lit(-1))).cast("int"))
        .withColumn("island", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("producer", "block", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("producer", "block")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    )


def accept(batch: DataFrame, state: SeenState) -> tuple[DataFrame, DataFrame]:
    """Accepted and repeated deliveries of one ``keyed`` batch, given what was seen.

    The choice within the batch is a minimum per identifier, combined before the
    shuffle, so one identifier with a third of the rows moves one row a task.
    Repeats are found by the unique delivery id, which can't be skewed.
    """
    covered = F.exists("ranges", lambda r: (r["lo"] <= F.col("seq")) & (F.col("seq") <= r["hi"]))
    first = F.min(_arrival()).alias("first")
    numbered = (
        batch.where("seq is not null")
        .groupBy("producer", "block", "seq", "message_key")
        .agg(first)
        .join(state.ranges, ["producer", "block"], "left")
        .where(~F.coalesce(covered, F.lit(False)))
        .select(F.col("first.delivery_id").alias("delivery_id"), "producer", "block", "seq", "message_key")
    )
    other = (
        batch.where("seq is null and message_key is not null")
        .groupBy("message_key")
        .agg(first)
        .join(state.keys, "message_key", "left_anti")
        .select(
            F.col("first.delivery_id").alias("delivery_id"),
            F.lit(None).cast("bigint").alias("producer"),
            F.lit(None).cast("bigint").alias("block"),
            F.lit(None).cast("bigint").alias("seq"),
            "message_key",
        )
    )
    accepted = materialize(numbered.unionByName(other), "accepted")
    repeats = (
        batch.where("message_key is not null")
        .select("delivery_id", "message_key")
        .join(accepted.select("delivery_id"), "delivery_id", "left_anti")
    )
    return accepted, repeats


def advance(state: SeenState, accepted: DataFrame) -> SeenState:
    """State after a batch: ranges merged, new keys added; both written durably."""
    return SeenState(
        materialize(merge_ranges(accepted.where("seq is not null"), state.ranges), "seen-ranges"),
        materialize(
            state.keys.unionByName(accepted.where("seq is null").select("message_key")), "seen-keys"
        ),
    )


def deduplicate(deliveries: DataFrame, slices: int = 2) -> tuple[DataFrame, DataFrame, SeenState]:
    """Accepted, repeats and final state of a whole table, folded in arrival order.

    The table is taken in ``slices`` spans of received_at, as batches would have
    come; the split never changes the result, as a copy with a smaller arrival
    is always in the same or an earlier span.
    """
    spark = deliveries.sparkSession
    rows = materialize(keyed(deliveries).withColumn("at", F.unix_micros("received_at")), "deliveries")
    edges = rows.approxQuantile("at", [i / slices for i in range(1, slices)], 0.02) if slices > 1 else []
    edges = sorted({int(e) for e in edges})
    state, kept, dropped = SeenState.empty(spark), [], []
    for i in range(len(edges) + 1):
        part = rows
        if i < len(edges):
            part = part.where(F.col("at") <= edges[i])
        elif edges:
            part = part.where((F.col("at") > edges[-1]) | F.col("at").isNull())
        if 0 < i < len(edges):
            part = part.where(F.col("at") > edges[i - 1])
        accepted, repeats = accept(part, state)
        kept.append(accepted)
        dropped.append(repeats)
        state = advance(state, accepted)
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, dropped), state


def saved_state(spark: SparkSession, target_path: str, batch_id: int) -> SeenState:
    """The state after a batch, as ``foreach_batch`` wrote it; empty before the first."""
    path = f"{target_path}/state/batch={batch_id}"
    if batch_id < 0:
        return SeenState.empty(spark)
    return SeenState(spark.read.schema(STATE_SCHEMA).parquet(f"{path}/ranges"), spark.read.schema(KEYS_SCHEMA).parquet(f"{path}/keys"))


def foreach_batch(target_path: str):
    """Sink for ``writeStream.foreachBatch``: writes the accepted rows of each batch.

    The state after a batch is a table of the batch's number beside them. A batch starts
    from the state of the number before its own, so a restarted stream goes on where it
    stopped, and a batch that is replayed writes the same rows and state once more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = saved_state(spark, target_path, batch_id - 1)
        accepted, _ = accept(materialize(keyed(batch), "deliveries"), before)
        batch.join(accepted.select("delivery_id"), "delivery_id", "left_semi").write.mode("overwrite").parquet(f"{target_path}/accepted/batch={batch_id}")
        path = f"{target_path}/state/batch={batch_id}"
        merge_ranges(accepted.where("seq is not null"), before.ranges).write.mode("overwrite").parquet(f"{path}/ranges")
        before.keys.unionByName(accepted.where("seq is null").select("message_key")).write.mode("overwrite").parquet(f"{path}/keys")

    return write


def accepted_rows(spark: SparkSession, target_path: str) -> DataFrame:
    """All rows a stream has accepted so far."""
    return spark.read.parquet(f"{target_path}/accepted")
