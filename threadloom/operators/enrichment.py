"""Enrichment of chunks by models whose output is never trusted: context prefixes and graph extractions.

Output comes in as a JSON column. What isn't proven by the chunk's own text is dropped;
what was computed for an older text is refused at the commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import count_tokens, has_update_cue, locate_span, name_key, normalize_name, sha256, shifted_span

# Entity types, and predicates a model may state; SENT, CC and REPLY_TO come from headers alone.
ENTITY_TYPES = ("PERSON", "ORG", "PROJECT", "TOPIC", "DOCUMENT", "MEETING", "COMMITMENT", "DATE", "MONEY")
PREDICATES = ("MENTIONS", "WORKS_ON", "ASSIGNED_TO", "APPROVED", "REJECTED", "REFERS_TO")
# Bounds of a context prefix, its sentence ends, and marks of citations and links.
CONTEXT_TOKENS, CONTEXT_SENTENCES = 80, 2
SENTENCE_END = r"[.!?]+(?:\s|$)"
CITATION_MARK = r"(?i)(\[\d+\]|\[\^?cite|\(\s*source\s*:|\bhttps?://)"
_FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
_ITEM = "array<string>"


def peeled(raw: Column) -> Column:
    """Model output without a code fence around it."""
    return F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), _FENCE, "$1"))


def context_text(raw: Column) -> Column:
    """The context prefix of a model's output on one line; null where there is none."""
    return F.trim(F.regexp_replace(F.get_json_object(peeled(raw), "$.context"), r"\s+", " "))


def context_reason(raw: Column) -> Column:
    """Why a context prefix is refused; null if it may be used."""
    json, text = peeled(raw), context_text(raw)
    whole = F.try_parse_json(json)
    sentences = F.size(F.filter(F.split(text, SENTENCE_END), lambda x: F.trim(x) != ""))
    return (
        F.when(json == "", "empty_output")
        .when(whole.isNull(), "malformed_json")
        .when(~F.schema_of_variant(whole).startswith("OBJECT"), "not_an_object")
        .when(~json.rlike(r'"context"\s*:'), "no_context")
        .when(~F.schema_of_variant(F.try_variant_get(whole, "$.context", "variant")).eqNullSafe("STRING"), "not_a_string")
        .when(text == "", "empty")
        .when(count_tokens(text) > CONTEXT_TOKENS, "too_long")
        .when(sentences > CONTEXT_SENTENCES, "too_many_sentences")
        .when(text.rlike(CITATION_MARK), "citation_marker")
    )


def commit_context(chunks: DataFrame, results: DataFrame, header: Column | None = None) -> DataFrame:
    """Chunks with ``embed_text`` and ``context_method`` after a batch of results.

    chunks: chunk_id, text, embed_text, input_hash, ...; results: chunk_id, input_hash, raw.
    A result counts only while its hash is still the chunk's. A valid prefix goes above the
    embedding text and asks for a new embedding; any other leaves it as it was.
    """
    fresh = results.withColumn("reason", context_reason(F.col("raw"))).select("chunk_id", F.col("input_hash").alias("seen_hash"), context_text(F.col("raw")).alias("prefix"), "reason")
    fresh = fresh.groupBy("chunk_id", "seen_hash").agg(F.min_by(F.struct("prefix", "reason"), F.struct(F.col("reason").isNotNull(), "prefix")).alias("r"))
    joined = chunks.join(fresh, (chunks["chunk_id"] == fresh["chunk_id"]) & (F.col("input_hash") == F.col("seen_hash")), "left").drop(fresh["chunk_id"])
    usable = F.col("r").isNotNull() & F.col("r.reason").isNull()
    base = F.coalesce("embed_text", "text")
    return joined.select(
        *[F.when(usable, F.concat_ws("\n\n", "r.prefix", base)).otherwise(F.col("embed_text")).alias("embed_text") if c == "embed_text" else chunks[c] for c in chunks.columns],
        F.when(usable, "llm").when(F.col("r").isNotNull(), "deterministic").alias("context_method"),
        usable.alias("needs_embedding"),
    )


# --- graph extraction ---


def extracted(chunks: DataFrame, kind: str, fields: tuple[str, ...]) -> DataFrame:
    """(chunk columns, ordinal, fields...): well-formed items of one list of the output.

    An item that isn't an object, or of which a field is missing, blank or no string, is
    dropped by itself. Output that is no JSON object gives no items.
    """
    items = F.try_variant_get(F.try_parse_json(peeled(F.col("raw"))), f"$.{kind}", "array<variant>")
    return (
        chunks.select("*", F.posexplode(items).alias("ordinal", "_item"))
        .select("*", *[F.when(F.schema_of_variant(F.try_variant_get("_item", f"$.{f}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get("_item", f"$.{f}", "string")), F.lit(""))).alias(f) for f in fields])
        .where(" and ".join(f"{f} is not null" for f in fields))
        .drop("_item")
    )


def _proven(rows: DataFrame) -> DataFrame:
    """Items whose evidence stands in the chunk's text, with chunk_start and chunk_end."""
    return rows.withColumn("_span", locate_span(F.col("text"), F.col("evidence"))).where("_span is not null").withColumns(
        {"chunk_start": F.col("_span.start"), "chunk_end": F.col("_span.end")}
    ).drop("_span")


def resolve_extractions(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, relations, facts) that the chunks' own texts prove.

    chunks: chunk_id, text, source_start, raw (JSON of entities, relations and facts).
    A mention needs a known type and its evidence verbatim; a relation one of ``PREDICATES``,
    its evidence and both ends among the chunk's mentions (the first type by name where
    several fit); a fact its evidence. Offsets into the source are null where the chunk has none.
    """
    base = chunks.select("chunk_id", "text", "source_start", "raw")
    source = shifted_span(F.col("source_start"), F.col("chunk_start"), F.col("chunk_end"))
    mentions = _proven(extracted(base, "entities", ("name", "type", "evidence")).where(F.col("type").isin(*ENTITY_TYPES))).select(
        "chunk_id", "ordinal", F.col("type").alias("entity_type"), normalize_name(F.col("name")).alias("canonical_name"), name_key(F.col("name")).alias("normalized_name"),
        F.col("evidence").alias("mention_text"), "chunk_start", "chunk_end", source["start"].alias("source_start"), source["end"].alias("source_end"),
    )
    ends = mentions.groupBy("chunk_id", "normalized_name").agg(F.min("entity_type").alias("type"))
    relations = _proven(extracted(base, "relations", ("subject", "predicate", "object", "evidence")).where(F.col("predicate").isin(*PREDICATES)))
    for side in ("subject", "object"):
        relations = relations.withColumn(f"{side}_key", name_key(F.col(side))).join(
            ends.select("chunk_id", F.col("normalized_name").alias(f"{side}_key"), F.col("type").alias(f"{side}_type")), ["chunk_id", f"{side}_key"]
        )
    relations = relations.select(
        "chunk_id", "ordinal", F.col("subject_key").alias("subject"), "subject_type", "predicate", F.col("object_key").alias("object"), "object_type",
        F.col("evidence").alias("mention_text"), "chunk_start", "chunk_end", F.lit("text").alias("evidence_kind"),
    )
    facts = _proven(extracted(base, "facts", ("subject", "predicate", "object", "evidence"))).select(
        "chunk_id", "ordinal", normalize_name(F.col("subject")).alias("subject"), "predicate", F.col("object").alias("object_value"), name_key(F.col("subject")).alias("normalized_subject"),
        F.lower("predicate").alias("normalized_predicate"), F.col("evidence").alias("evidence_text"), "chunk_start", "chunk_end", source["start"].alias("source_start"), source["end"].alias("source_end"),
        sha256(F.col("evidence")).alias("evidence_hash"), has_update_cue(F.col("evidence")).alias("cue"),
    )
    return mentions, relations, facts


def replace_of_chunks(stored: DataFrame, fresh: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of a table after some chunks were committed again: theirs are replaced as a whole,
    also where the new result holds nothing. done: the committed chunks."""
    return stored.join(done.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def still_current(results: DataFrame, chunks: DataFrame, key: str = "chunk_id", stamp: str = "input_hash") -> DataFrame:
    """Results whose chunk still has the hash they were computed for."""
    return results.join(chunks.select(key, stamp).distinct(), [key, stamp], "left_semi")


def placed_facts(facts: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Facts with status and supersedes: a fact with an update cue replaces the one that was
    active before it in its scope, subject and predicate. A later date alone replaces nothing.

    Every fact joins the active ones; a cue closes only the latest of those still active, so
    an older one without a successor stays active beside it, as a stack would have it.
    """
    w = Window.partitionBy(*scope, "normalized_subject", "normalized_predicate").orderBy(*order)
    key = order[-1]
    # the fact just before a cue is always active, since only a later cue could have closed it
    return facts.withColumn("supersedes", F.when(F.col("cue"), F.lag(key).over(w))).withColumn("status", F.when(F.lead("cue").over(w), "superseded").otherwise("active"))


# --- reads; each within one tenant and mailbox of its input ---

SCOPE = ["tenant_id", "mailbox_id"]


def entities_matching(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, entity columns) of the entities a question names. terms: scope, query_id, term."""
    wanted = terms.select(*SCOPE, "query_id", name_key(F.col("term")).alias("normalized_name")).distinct()
    return wanted.join(entities, [*SCOPE, "normalized_name"])


def entity_evidence(found: DataFrame, mentions: DataFrame, relations: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, chunk_id, rank): chunks that mention a found entity, or hold a relation of it.

    found: scope, query_id, entity_type, normalized_name. Distinct, by chunk id.
    """
    name = [*SCOPE, "entity_type", "normalized_name"]
    ends = [relations.select(*SCOPE, F.col(f"{side}_type").alias("entity_type"), F.col(side).alias("normalized_name"), "chunk_id") for side in ("subject", "object")]
    places = mentions.select(*name, "chunk_id").unionByName(ends[0]).unionByName(ends[1]).distinct()
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    hits = found.select("query_id", *name).distinct().join(places, name).select("query_id", "chunk_id").distinct()
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fact_evidence(questions: DataFrame, facts: DataFrame, limit: int, status: str | None = None, as_of: str | None = None) -> DataFrame:
    """(query_id, chunk_id, rank): chunks that prove facts about a question's subjects.

    questions: scope, query_id, subjects (empty: all), and a date column named ``as_of``
    where only facts in force on that day count; a fact without a date never was in force.
    """
    kept = facts.where(F.col("status") == status) if status else facts
    asked = questions.select(*SCOPE, "query_id", *([as_of] if as_of else []), F.explode_outer("subjects").alias("subject"))
    named = asked.where("subject is not null").withColumn("normalized_subject", name_key(F.col("subject"))).join(kept, [*SCOPE, "normalized_subject"])
    whole = asked.where("subject is null").join(kept, SCOPE)
    hits = named.select("query_id", "chunk_id", *([as_of] if as_of else []), "effective_date").unionByName(whole.select("query_id", "chunk_id", *([as_of] if as_of else []), "effective_date"))
    if as_of:
        hits = hits.where(F.col("effective_date").isNotNull() & (F.to_date("effective_date") <= F.col(as_of)))
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    return hits.select("query_id", "chunk_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def graph_routes(*routes: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank): the lists of several routes one after the other, each chunk once."""
    both = None
    for n, r in enumerate(routes):
        part = r.select("query_id", "chunk_id", F.struct(F.lit(n).alias("route"), "rank").alias("seen"))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("query_id", "chunk_id").agg(F.min("seen").alias("seen"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seen"))).select("query_id", "chunk_id", "rank")


def named_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the display names of both ends."""
    out = relations
    for side in ("subject", "object"):
        names = entities.select(*SCOPE, F.col("entity_type").alias(f"{side}_type"), F.col("normalized_name").alias(side), F.col("canonical_name").alias(f"{side}_name"))
        out = out.join(names, [*SCOPE, f"{side}_type", side])
    return out


def facts_with_evidence(facts: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with an array of their evidence (evidence_id, chunk_id, text), in order of its id."""
    texts = chunks.groupBy("chunk_id").agg(F.min_by("text", "chunk_key").alias("clean_text"))
    nested = evidence.join(texts, "chunk_id").groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", "chunk_id", "clean_text"))).alias("evidence"))
    return facts.join(nested, "fact_id", "left")
