"""Drafts from retrieved evidence: direct answers, timelines and comparisons.

A draft is a table of clauses (query_id, clause_no, clause, factual, dual, named, kind),
which ``citations.clause_support`` holds against the evidence. hits: query_id, chunk_id,
place, text, subject, attachment_name, kind, sender, recipients, cc, sent_at, support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import COMPARISON, FILE_NAME, TIMELINE, best_sentence, content_tokens, found

# What is said where the evidence holds no answer.
NO_ANSWER = "I could not confirm that from the selected thread."
NO_TIMELINE = "I could not confirm the timeline from the selected thread."
NO_VERSIONS = "I could not confirm both versions from the selected thread."
# Words that ask for one kind of source, and cues that count when question and hit share them.
ATTACHMENT_WORDS = r"attachment|pdf|docx|txt|html"
EMAIL_WORDS = r"email|message"
SHARED_CUES = (("topic", "topic", 4), ("instruction", "instruction", 4), ("deadline", "deadline", 4), ("due", "due", 3))
SENT = r"\b(?:when sent|when was .* sent|sent date|date sent)\b"

_CLAUSE = "array<struct<clause: string, named: array<string>, dual: boolean>>"


def kind_of(question: Column) -> Column:
    """comparison, timeline or direct."""
    q = F.coalesce(question, F.lit(""))
    return F.when(q.rlike(COMPARISON), "comparison").when(q.rlike(TIMELINE), "timeline").otherwise("direct")


def targeted(question: Column) -> Column:
    """Whether a question names one source: one hit answers it, not two."""
    return F.lower(F.coalesce(question, F.lit(""))).rlike(rf"{ATTACHMENT_WORDS}|{EMAIL_WORDS}|{FILE_NAME}")


def preferred_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of each question from the sources it asks for, with a new ``place``.

    The first tier that has any hit wins: the named file, attachments (both latest
    first), e-mails, all hits in their order.
    """
    low = F.lower(F.coalesce("query_text", F.lit("")))
    asked = questions.select("query_id", "query_text", low.alias("low"), F.trim(F.coalesce(F.get(found(low, FILE_NAME), F.lit(0)), F.lit(""))).alias("file"))
    tiered = hits.drop("query_text").join(asked, "query_id").withColumn(
        "tier",
        F.when((F.col("file") != "") & (F.lower("attachment_name") == F.col("file")), 0)
        .when(F.col("low").rlike(ATTACHMENT_WORDS) & (F.col("kind") == "attachment"), 1)
        .when(F.col("low").rlike(EMAIL_WORDS) & (F.col("kind") == "email"), 2)
        .otherwise(3),
    )
    best = F.min("tier").over(Window.partitionBy("query_id"))
    latest = F.when(F.col("tier") <= 1, F.unix_micros("sent_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(latest), "place")
    # where no tier applies, all hits stay, whatever their kind
    kept = tiered.withColumn("best", best).where(F.col("tier") == F.col("best"))
    return kept.withColumn("new_place", F.row_number().over(order)).drop("tier", "best", "low", "file", "place").withColumnRenamed("new_place", "place")


def prioritised(hits: DataFrame) -> DataFrame:
    """Hits reordered by content shared with the question, shared cues, e-mails before attachments, then place."""
    heap = F.concat_ws(" ", F.nullif("subject", F.lit("")), F.nullif("attachment_name", F.lit("")), F.nullif("text", F.lit("")))
    bonus = F.lit(0)
    for asked, held, points in SHARED_CUES:
        bonus = bonus + F.when(F.lower("query_text").contains(asked) & F.lower(heap).contains(held), points).otherwise(0)
    shared = F.size(F.array_intersect(content_tokens(F.col("query_text")), content_tokens(heap)))
    order = Window.partitionBy("query_id").orderBy(F.desc("points"), (F.col("kind") == "attachment").cast("int"), "place")
    ranked = hits.withColumn("points", shared + bonus).withColumn("new_place", F.row_number().over(order))
    return ranked.drop("points", "place").withColumnRenamed("new_place", "place")


def _clause(text: Column, chunk_id: Column, dual: bool = False) -> Column:
    return F.struct(text.alias("clause"), F.array(chunk_id).alias("named"), F.lit(dual).alias("dual"))


def _draft(questions: DataFrame, clauses: DataFrame, kind: str, otherwise: str) -> DataFrame:
    """One row a clause; questions without any say that there is no answer."""
    none = F.array(F.struct(F.lit(otherwise).alias("clause"), F.lit(None).cast("array<string>").alias("named"), F.lit(False).alias("dual"))).cast(_CLAUSE)
    has = F.coalesce(F.size("said"), F.lit(0)) > 0
    return (
        questions.select("query_id")
        .join(clauses, "query_id", "left")
        .withColumn("factual", has)
        .select("query_id", "factual", F.posexplode(F.when(has, F.col("said").cast(_CLAUSE)).otherwise(none)).alias("clause_no", "c"))
        .select("query_id", "clause_no", "c.clause", "factual", "c.dual", "c.named", F.lit(kind).alias("kind"))
    )


def header_clauses(hits: DataFrame) -> DataFrame:
    """(query_id, said): header fields a question asks for, of one e-mail: the latest, the first,
    or where it only asks when something was sent, the best placed."""
    q = F.lower("query_text")
    asks = {name: q.rlike(rf"\b{name}\b") for name in ("from", "to", "cc", "subject")}
    sent = q.rlike(SENT)
    wanted = hits.where((F.col("kind") == "email") & (asks["from"] | asks["to"] | asks["cc"] | asks["subject"] | sent))
    late = q.rlike("latest|final")
    early = ~late & (q.rlike("earlier|first|original") | ~sent)
    at = F.unix_micros("sent_at")
    order = Window.partitionBy("query_id").orderBy(F.when(late, -at).when(early, at).asc_nulls_last(), "place")
    one = wanted.withColumn("n", F.row_number().over(order)).where("n = 1")
    people = lambda c: F.array_join(c, ", ")
    fields = (
        (asks["from"], "From", F.col("sender")),
        (asks["to"], "To", people("recipients")),
        (asks["cc"], "CC", people("cc")),
        (asks["subject"], "Subject", F.col("subject")),
        (sent, "Sent date", F.date_format("sent_at", "yyyy-MM-dd")),
    )
    said = F.array(*[F.when(a & (F.coalesce(v, F.lit("")) != ""), _clause(F.concat(F.lit(f"{name}: "), v), F.col("chunk_id"))) for a, name, v in fields])
    return one.select("query_id", F.filter(said, lambda x: x.isNotNull()).cast(_CLAUSE).alias("said")).where("size(said) > 0")


def direct_draft(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Header fields where the question asks for them, else the best sentence of one or two hits."""
    chosen = prioritised(preferred_hits(questions, hits))
    headers = header_clauses(chosen)
    sentences = (
        chosen.where(F.col("place") <= F.when(targeted(F.col("query_text")), 1).otherwise(2))
        .select("query_id", "place", "chunk_id", best_sentence(F.col("text"), content_tokens(F.col("query_text"))).alias("sentence"))
        .where("sentence is not null")
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence", "chunk_id"))), lambda x: _clause(x["sentence"], x["chunk_id"])).cast(_CLAUSE).alias("spoken"))
    )
    said = sentences.join(headers, "query_id", "full").select("query_id", F.coalesce("said", "spoken").alias("said"))
    return _draft(questions, said, "direct", NO_ANSWER)


def timeline_draft(questions: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """The richest sentence of the first hits by date."""
    none = F.array().cast("array<string>")
    order = Window.partitionBy("query_id").orderBy(F.col("sent_at").asc_nulls_last(), "place")
    said = (
        hits.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= most)
        .select("query_id", "n", "chunk_id", "sent_at", best_sentence(F.col("text"), none).alias("sentence"))
        .where("sentence is not null")
        .withColumn("clause", F.concat(F.lit("On "), F.coalesce(F.date_format("sent_at", "yyyy-MM-dd"), F.lit("an unknown day")), F.lit(", "), "sentence"))
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "clause", "chunk_id"))), lambda x: _clause(x["clause"], x["chunk_id"])).cast(_CLAUSE).alias("said"))
    )
    return _draft(questions, said, "timeline", NO_TIMELINE)


def version_questions(questions: DataFrame, target: Column) -> DataFrame:
    """(query_id, version, query_text): the two searches of a comparison."""
    both = F.array(F.struct(F.lit("earlier").alias("version"), F.lit("earlier draft").alias("words")), F.struct(F.lit("final").alias("version"), F.lit("final version").alias("words")))
    return questions.select("query_id", target.alias("_target"), F.explode(both).alias("v")).select("query_id", "v.version", F.concat_ws(" ", "_target", "v.words").alias("query_text"))


def comparison_draft(questions: DataFrame, earlier: DataFrame, final: DataFrame) -> DataFrame:
    """The earlier and the final version and their difference, which both hits must support."""
    none = F.array().cast("array<string>")

    def version(hits: DataFrame, name: str) -> DataFrame:
        words = F.lower(F.concat_ws(" ", "text", "attachment_name", "subject")).rlike("draft|earlier" if name == "earlier" else "final|latest")
        file = F.col("kind") == "attachment"
        # a file of that version, anything of that version, any file, the first hit
        order = Window.partitionBy("query_id").orderBy(F.when(file & words, 0).when(words, 1).when(file, 2).otherwise(3), "place")
        one = hits.withColumn("n", F.row_number().over(order)).where("n = 1")
        return one.select("query_id", F.col("chunk_id").alias(f"{name}_id"), best_sentence(F.col("text"), none).alias(name)).where(F.col(name).isNotNull())

    both = version(earlier, "earlier").join(version(final, "final"), "query_id")
    difference = F.struct(
        F.concat(F.lit("Difference: "), "earlier", F.lit(" -> "), "final").alias("clause"), F.array("earlier_id", "final_id").alias("named"), F.lit(True).alias("dual")
    )
    said = F.array(
        _clause(F.concat(F.lit("Earlier draft: "), "earlier"), F.col("earlier_id")), _clause(F.concat(F.lit("Final version: "), "final"), F.col("final_id")), difference
    )
    return _draft(questions, both.select("query_id", said.cast(_CLAUSE).alias("said")), "comparison", NO_VERSIONS)
