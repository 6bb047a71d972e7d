"""Mentions, relations and facts around chunks; every access is one hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import has_update_cue
from threadloom.operators.corpus import first_per_message
from threadloom.operators.enrichment import ENTITY_TYPES


def metadata_relations(messages: DataFrame) -> DataFrame:
    """(msg_key, predicate, subject, object): SENT, CC and REPLY_TO from headers alone."""
    unique = first_per_message(messages.where("message_id is not null")).select(
        "tenant_id", "mailbox_id", F.col("message_id").alias("in_reply_to"), F.col("sender").alias("object")
    )
    base = messages.where("sender is not null")
    sent = base.select("msg_key", F.lit("SENT").alias("predicate"), F.col("sender").alias("subject"), F.explode("recipients").alias("object"))
    copied = base.select("msg_key", F.lit("CC").alias("predicate"), F.col("sender").alias("subject"), F.explode("cc").alias("object"))
    reply = base.join(unique, ["tenant_id", "mailbox_id", "in_reply_to"]).select(
        "msg_key", F.lit("REPLY_TO").alias("predicate"), F.col("sender").alias("subject"), "object"
    )
    return sent.unionByName(copied).unionByName(reply).where("object is not null").distinct()


def entities(mentions: DataFrame) -> DataFrame:
    """(scope, type, normalized_name, canonical_name, mentions): the first canonical spelling wins."""
    return mentions.groupBy("tenant_id", "mailbox_id", "entity_type", "normalized_name").agg(
        F.min_by("canonical_name", F.struct(F.col("created_at").isNull(), "created_at", "mention_id")).alias("canonical_name"),
        F.count("*").alias("mentions"),
        F.count_distinct("chunk_id").alias("chunks"),
    )


def grounded_mentions(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mentions whose span really holds their text in the chunk."""
    texts = chunks.groupBy("chunk_id").agg(F.min_by("text", "chunk_key").alias("text"))
    span = F.substring(F.col("text"), F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start"))
    return mentions.join(texts, "chunk_id").where(span == F.col("mention_text"))


def supersession(facts: DataFrame, scope: list[str], order: list[str], cue: str) -> DataFrame:
    """Adds supersedes and superseded_by: a fact with a cue closes the one before it in its scope."""
    w = Window.partitionBy(*scope).orderBy(*order)
    key = order[-1]
    return facts.withColumn("supersedes", F.when(F.col(cue), F.lag(key).over(w))).withColumn(
        "superseded_by", F.when(F.lead(cue).over(w), F.lead(key).over(w))
    )


def money_facts(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Amounts mentioned in a chunk as facts of its thread, with supersession by wording."""
    texts = chunks.groupBy("chunk_id").agg(F.min_by(F.struct("text", "thread_id"), "chunk_key").alias("c"))
    rows = (
        mentions.where("entity_type = 'MONEY'")
        .join(texts, "chunk_id")
        .select("mention_id", "mailbox_id", F.col("c.thread_id").alias("thread_id"), F.col("canonical_name").alias("value"), "created_at", has_update_cue(F.col("c.text")).alias("cue"))
    )
    return supersession(rows, ["mailbox_id", "thread_id"], ["created_at", "mention_id"], "cue")


def violations(mentions: DataFrame) -> DataFrame:
    """Mentions that break the table's checks, with the first that is ``broken``: offsets given in
    part, a span that ends before it starts, a type that doesn't exist."""
    return mentions.withColumn(
        "broken",
        F.when(F.col("source_start").isNull() != F.col("source_end").isNull(), "offsets").when(F.col("chunk_end") < F.col("chunk_start"), "span").when(~F.col("entity_type").isin(*ENTITY_TYPES), "type"),
    ).where("broken is not null")
