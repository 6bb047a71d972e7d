"""Registered queries of the core: name -> callable, and name -> reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators import delivery_dedup
from threadloom.plans import library, mailroom  # noqa: F401  each registers its queries
from threadloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a notification but the first to arrive."""
    rows = table(
        spark, sf_dir, "gmail_notifications", "delivery_id", "received_at", "pubsub_message_id", "push_body"
    )
    _, repeats, _ = delivery_dedup.deduplicate(rows)
    return repeats.select("delivery_id")


QUERIES: dict[str, Query] = {"p3_found": p3_found} | library.QUERIES

ORACLES: dict[str, str] = {
    "p3_found": """
        WITH k AS (
          SELECT delivery_id, received_at,
                 coalesce(nullif(pubsub_message_id, ''),
                          CASE WHEN json_valid(push_body) THEN
                            coalesce(nullif(json_extract_string(push_body, '$.message.messageId'), ''),
                                     nullif(json_extract_string(push_body, '$.message.message_id'), '')) END) AS message_key
          FROM gmail_notifications),
        r AS (
          SELECT delivery_id, row_number() OVER (
                   PARTITION BY message_key ORDER BY received_at NULLS LAST, delivery_id) AS n
          FROM k WHERE message_key IS NOT NULL)
        SELECT delivery_id FROM r WHERE n > 1
    """,
} | library.ORACLES
