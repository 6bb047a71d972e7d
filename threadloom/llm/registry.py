"""Registered queries of the training-data operators and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import encode, language, leakage, names, neighbours, quoted, scans, split
from threadloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids whose text had to be cut."""
    rows = table(spark, sf_dir, "email_chunks", "chunk_id", "text")
    pieces = split.split_oversized(rows, source_start=None)
    return pieces.where("pieces > 1").select("chunk_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every chunk."""
    rows = table(spark, sf_dir, "email_chunks", "chunk_key", "chunk_id", "text", "source_start", "source_end")
    return split.split_oversized(rows).select(
        "chunk_key",
        "chunk_id",
        "piece_no",
        F.col("piece_text").alias("text"),
        F.col("piece_source_start").alias("source_start"),
        F.col("piece_source_end").alias("source_end"),
        F.col("piece_token_count").alias("token_count"),
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.distinct_names(
        table(spark, sf_dir, "entity_mentions", "mailbox_id", "entity_type", "mention_text", "canonical_name"),
        table(spark, sf_dir, "email_messages", "mailbox_id", "sender"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation within a mailbox."""
    return names.linked_pairs(names.link_names(_names(spark, sf_dir)))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical spelling of every name of a mailbox."""
    found = _names(spark, sf_dir)
    return names.canonical_names(names.link_names(found), found)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of e-mail bodies that their sender didn't newly write."""
    messages = table(spark, sf_dir, "email_messages", "msg_key", "mailbox_id", "thread_id", "message_id", "sender", "sent_at", "body_text")
    return quoted.line_classes(messages).where("class <> 'new' and filled").select("msg_key", "line_no")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four segment texts of every message."""
    messages = table(spark, sf_dir, "email_messages", "msg_key", "mailbox_id", "thread_id", "message_id", "sender", "sent_at", "body_text")
    return quoted.segments(messages)


_PAGE_COLUMNS = ("page_key", "attachment_id", "filename", "page_no", "text", "ocr_used")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture lines, broken words and misread words of scanned pages with their repair."""
    return scans.Repair(table(spark, sf_dir, "attachment_pages", *_PAGE_COLUMNS)).found()


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired paragraphs of scanned pages."""
    return scans.Repair(table(spark, sf_dir, "attachment_pages", *_PAGE_COLUMNS)).text()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunk vectors of which one is among the five nearest of the other."""
    near = neighbours.nearest_neighbours(table(spark, sf_dir, "chunk_vectors", "vec_id", "embedding"))
    return neighbours.similar_pairs(near).select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a third or more of an evaluation item."""
    return leakage.leaks(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text")
    ).select("doc_id", "item_id")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole sentence of every document with its language and confidence."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.segments(documents, language.fit(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents that are mixed, or whose label is missing or wrong."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language.document_languages(language.segments(documents, language.fit(documents)))
    return language.mislabelled(documents, found).select("doc_id", "lang")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_canonical": p1_canonical,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
}

ORACLES: dict[str, str] = {
    "p6_found": r"""
        SELECT DISTINCT chunk_id FROM email_chunks
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) > 450
    """,
}
