"""Queries of hybrid search, answering, enrichment, corpus building and mailbox synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T
from threadloom.operators import answers, citations, conversation, corpus, enrichment, graph, ingest, search, sync
from threadloom.plans import answering
from threadloom.plans.library import FIRST_SQL, query, tok
from threadloom.runtime import materialize
from threadloom.sources.tables import table

# --- hybrid search: every fiftieth chunk vector asks within its mailbox, every hundredth within its thread ---

CHUNK_SQL = "(SELECT c.*, v.embedding FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS n FROM email_chunks) c LEFT JOIN chunk_vectors v USING (chunk_id) WHERE n = 1)"
ASK_SQL = f"""
    c AS MATERIALIZED {CHUNK_SQL},
    q AS (SELECT v.vec_id AS query_id, coalesce(c.subject, '') AS query_text, c.tenant_id, c.mailbox_id, CASE WHEN v.vec_id % 100 = 0 THEN c.thread_id END AS thread_id, c.chunk_id, v.embedding
          FROM chunk_vectors v JOIN c USING (chunk_id) WHERE v.vec_id % 50 = 0)
"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row a chunk id, with its vector."""
    first = Window.partitionBy("chunk_id").orderBy("chunk_key")
    c = table(spark, d, "email_chunks").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return c.join(table(spark, d, "chunk_vectors", "chunk_id", "embedding", "vec_id"), "chunk_id", "left")


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.coalesce("subject", F.lit("")).alias("query_text"), "tenant_id", "mailbox_id", F.when(F.col("vec_id") % 100 == 0, F.col("thread_id")).alias("thread_id"), "chunk_id", "embedding"
    )


def _mentioned(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank): chunks of the mailbox that mention an entity the asking chunk mentions."""
    m = table(spark, d, "entity_mentions", "tenant_id", "mailbox_id", "chunk_id", "entity_type", "normalized_name").where("entity_type in ('PERSON', 'PROJECT')")
    own = asked.select("query_id", "tenant_id", "mailbox_id", "chunk_id").join(m, ["tenant_id", "mailbox_id", "chunk_id"]).select("query_id", "tenant_id", "mailbox_id", "entity_type", "normalized_name")
    none = spark.createDataFrame([], "tenant_id string, mailbox_id string, subject string, subject_type string, object string, object_type string, chunk_id string")
    return enrichment.entity_evidence(own, m, none, 20)


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, questions, fused hits) of the hybrid search."""
    chunks = materialize(_chunks(spark, d), "chunks")
    asked = _asked(chunks)
    index = materialize(search.scoped_postings(chunks, "chunk_key", F.coalesce("embed_text", "text")), "scoped-postings")
    graph_hits = _mentioned(spark, d, asked).join(chunks.select("chunk_id", "chunk_key"), "chunk_id").select("query_id", "chunk_key", "rank")
    vectors = chunks.where("embedding is not null").select("chunk_key", "tenant_id", "mailbox_id", "thread_id", "embedding")
    return chunks, asked, search.hybrid(chunks, index, vectors, asked, graph_hits)


HYBRID_SQL = f"""
    {ASK_SQL},
    p AS MATERIALIZED (SELECT chunk_key, tenant_id, mailbox_id, thread_id, term, count(*) AS tf, any_value(dl) AS dl FROM
            (SELECT chunk_key, tenant_id, mailbox_id, thread_id, len({tok("lower(coalesce(embed_text, text))")}) AS dl, unnest({tok("lower(coalesce(embed_text, text))")}) AS term FROM c) GROUP BY 1, 2, 3, 4, 5),
    st AS (SELECT count(*)::DOUBLE AS n, (SELECT sum(tf) FROM p) / count(*) AS avgdl FROM c),
    idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, st GROUP BY term, n),
    fl AS (SELECT 0.25 * avg(idf) AS floor FROM idf),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok("lower(query_text)")}) AS term FROM q) GROUP BY 1, 2),
    bm AS (SELECT q.query_id, chunk_key, round(sum(qtf * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
           FROM q JOIN qt USING (query_id) JOIN idf USING (term) JOIN p ON p.term = qt.term AND p.tenant_id = q.tenant_id AND p.mailbox_id = q.mailbox_id AND (q.thread_id IS NULL OR p.thread_id = q.thread_id), st, fl GROUP BY 1, 2),
    lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM bm) WHERE rank <= 40),
    e AS MATERIALIZED (SELECT chunk_key, tenant_id, mailbox_id, thread_id, embedding::DOUBLE[] AS e FROM c WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    qe AS (SELECT query_id, tenant_id, mailbox_id, thread_id, embedding::DOUBLE[] AS e FROM q WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    ds AS (SELECT query_id, chunk_key, round(list_dot_product(qe.e, e.e) / (sqrt(list_dot_product(qe.e, qe.e)) * sqrt(list_dot_product(e.e, e.e))), 6) AS score
           FROM qe JOIN e ON e.tenant_id = qe.tenant_id AND e.mailbox_id = qe.mailbox_id AND (qe.thread_id IS NULL OR e.thread_id = qe.thread_id)),
    dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM ds) WHERE rank <= 40),
    mn AS (SELECT * FROM entity_mentions WHERE entity_type IN ('PERSON', 'PROJECT')),
    gr AS (SELECT DISTINCT q.query_id, b.chunk_id FROM q JOIN mn a ON a.tenant_id = q.tenant_id AND a.mailbox_id = q.mailbox_id AND a.chunk_id = q.chunk_id
           JOIN mn b ON b.tenant_id = a.tenant_id AND b.mailbox_id = a.mailbox_id AND b.entity_type = a.entity_type AND b.normalized_name = a.normalized_name),
    g2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM gr),
    gh AS (SELECT q.query_id, c.chunk_key, row_number() OVER (PARTITION BY q.query_id ORDER BY g2.rank, c.chunk_key) AS rank FROM g2 JOIN q USING (query_id) JOIN c ON c.chunk_id = g2.chunk_id
           AND c.tenant_id = q.tenant_id AND c.mailbox_id = q.mailbox_id AND (q.thread_id IS NULL OR c.thread_id = q.thread_id) WHERE g2.rank <= 20),
    u AS (SELECT query_id, chunk_key, rank, 'bm25' AS branch FROM lx UNION ALL SELECT query_id, chunk_key, rank, 'dense' FROM dn UNION ALL SELECT query_id, chunk_key, rank, 'graph' FROM gh),
    f AS (SELECT query_id, chunk_key, round(sum(1.0 / (60 + rank)), 8) AS score, max(rank) FILTER (branch = 'bm25') AS lexical_rank, max(rank) FILTER (branch = 'dense') AS dense_rank, max(rank) FILTER (branch = 'graph') AS graph_rank FROM u GROUP BY 1, 2),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM f)
"""


@query("topk_hybrid", f"WITH {HYBRID_SQL} SELECT query_id, chunk_key, score, rank::INT AS rank, lexical_rank::INT AS lexical_rank, dense_rank::INT AS dense_rank, graph_rank::INT AS graph_rank FROM h WHERE rank <= 10")
def topk_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Ten chunks of every question from the lexical, dense and graph branches of its mailbox or thread, with the rank in each."""
    return _found(spark, d)[2].select("query_id", "chunk_key", "score", "rank", "lexical_rank", "dense_rank", "graph_rank")


@query("topk_hybrid_scope", f"WITH {ASK_SQL} SELECT query_id, 0::BIGINT AS strangers FROM q WHERE query_text <> '' OR embedding IS NOT NULL")
def topk_hybrid_scope(spark: SparkSession, d: str) -> DataFrame:
    """For every question, how many of its hits lie outside its mailbox or thread: none may."""
    chunks, asked, hits = _found(spark, d)
    out = F.expr("h_tenant <> tenant_id or h_mailbox <> mailbox_id or (thread_id is not null and not (h_thread <=> thread_id))")
    placed = hits.select("query_id", "chunk_key").join(chunks.select("chunk_key", F.col("tenant_id").alias("h_tenant"), F.col("mailbox_id").alias("h_mailbox"), F.col("thread_id").alias("h_thread")), "chunk_key")
    both = asked.where("query_text <> '' or embedding is not null").join(placed, "query_id", "left")
    return both.groupBy("query_id").agg(F.count_if(out).alias("strangers"))


def _evidence(spark: SparkSession, d: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(questions, reranked hits with the fields of their chunks and messages)."""
    chunks, asked, fused = _found(spark, d)
    first = Window.partitionBy("tenant_id", "mailbox_id", "message_id").orderBy("msg_key")
    m = table(spark, d, "email_messages", "tenant_id", "mailbox_id", "message_id", "msg_key", "recipients", "cc").where("message_id is not null")
    m = m.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "msg_key")
    fields = chunks.drop("embedding", "vec_id").join(m, ["tenant_id", "mailbox_id", "message_id"], "left").drop("tenant_id", "mailbox_id", "thread_id")
    hits = fused.select("query_id", "chunk_key", "rank", "bm25_score", "dense_score").join(fields, "chunk_key").join(asked.select("query_id", "query_text"), "query_id")
    return asked, search.reranked(hits, k)


def _judged(asked: DataFrame, hits: DataFrame, draft: DataFrame) -> DataFrame:
    c = F.col
    people = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), ", ")
    evidence = citations.support_text(c("text"), c("attachment_name"), c("subject"), c("sender"), c("sent_at"), ("to", people(c("recipients"))), ("cc", people(c("cc"))))
    return citations.clause_support(draft, hits.select("query_id", "chunk_id", "place", "message_id", "page_no", "kind", evidence.alias("evidence")))


@query("qa_direct")
def qa_direct(spark: SparkSession, d: str) -> DataFrame:
    """Direct answers from the evidence of every question, each clause held against it."""
    asked, hits = _evidence(spark, d)
    return citations.answers(_judged(asked, hits, answers.direct_draft(asked, hits)))


@query("qa_timeline")
def qa_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Timelines from the evidence of every question."""
    asked, hits = _evidence(spark, d)
    return citations.answers(_judged(asked, hits, answers.timeline_draft(asked, hits)))


@query("qa_comparison")
def qa_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons of the earlier and the final version in the evidence of every question."""
    asked, hits = _evidence(spark, d)
    return citations.answers(_judged(asked, hits, answers.comparison_draft(asked, hits, hits)), "\n")


# --- scalar functions of answering ---

SENTENCE_SQL = rf"""
    w AS (SELECT chunk_key, list_filter(list_distinct({tok("lower(coalesce(subject, ''))")}), lambda x: length(x) > 2 AND NOT list_contains(['a','an','and','are','attachment','by','does','email','for','in','is','it','meant','no','of','on','that','the','this','to','what','when','which','who'], x)) AS wanted,
            regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS whole FROM email_chunks),
    s AS (SELECT chunk_key, wanted, unnest(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM w WHERE whole <> ''),
    t AS (SELECT *, list_filter(list_distinct({tok("lower(sentence)")}), lambda x: length(x) > 2 AND NOT list_contains(['a','an','and','are','attachment','by','does','email','for','in','is','it','meant','no','of','on','that','the','this','to','what','when','which','who'], x)) AS own FROM s WHERE trim(sentence) <> ''),
    r AS (SELECT chunk_key, trim(sentence) AS sentence, CASE WHEN len(wanted) > 0 THEN len(list_intersect(own, wanted)) ELSE len(own) END AS shared, len(wanted) AS n,
            row_number() OVER (PARTITION BY chunk_key ORDER BY CASE WHEN len(wanted) > 0 THEN len(list_intersect(own, wanted)) ELSE len(own) END DESC, len(own) DESC, length(sentence) DESC, i) AS place FROM t)
"""


@query("fn_best_sentence", f"WITH {SENTENCE_SQL} SELECT chunk_key, sentence FROM r WHERE place = 1 AND (n = 0 OR shared > 0)")
def fn_best_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of every chunk that says most about its subject."""
    c = table(spark, d, "email_chunks", "chunk_key", "subject", "text")
    return c.select("chunk_key", T.best_sentence(F.col("text"), T.content_tokens(F.col("subject"))).alias("sentence")).where("sentence is not null")


def _values_sql(x: str) -> str:
    return rf"""list_distinct(list_filter(list_concat(
      list_transform(regexp_extract_all({x}, '\$?\d[\d,]*(?:\.\d{{2}})?'), lambda v: lower(trim(replace(replace(v, '$', ''), ',', '')))),
      list_transform(regexp_extract_all({x}, '(?i)\b(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{{1,2}}(?:,\s+\d{{4}})?)\b'), lambda v: lower(trim(v))),
      list_transform(regexp_extract_all({x}, '(?i)\b([\w.\- ]+\.(?:pdf|docx|txt|html|htm))\b'), lambda v: lower(trim(v))),
      list_transform(regexp_extract_all({x}, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}})\b'), lambda v: lower(trim(v)))), lambda v: v <> ''))"""


@query(
    "fn_value_match",
    f"""
    WITH t AS (SELECT chunk_id, arg_min(text, chunk_key) AS text FROM email_chunks GROUP BY 1),
    m AS (SELECT mention_id, {_values_sql("regexp_replace(coalesce(canonical_name, ''), '[^ -~[:space:]]', 'x', 'g')")} AS a, {_values_sql("regexp_replace(coalesce(text, ''), '[^ -~[:space:]]', 'x', 'g')")} AS b FROM entity_mentions JOIN t USING (chunk_id))
    SELECT mention_id, len(a)::INT AS stated, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 6)::DOUBLE AS share FROM m
    """,
)
def fn_value_match(spark: SparkSession, d: str) -> DataFrame:
    """How many values the canonical name of every mention states, and the share its chunk states too."""
    c = table(spark, d, "email_chunks", "chunk_id", "chunk_key", "text").groupBy("chunk_id").agg(F.min_by("text", "chunk_key").alias("text"))
    m = table(spark, d, "entity_mentions", "mention_id", "chunk_id", "canonical_name").join(c, "chunk_id")
    name, text = (F.regexp_replace(F.coalesce(c, F.lit("")), r"[^ -~\s]", "x") for c in ("canonical_name", "text"))  # both engines agree on ASCII word bounds
    return m.select("mention_id", F.size(T.stated_values(name)).alias("stated"), F.round(T.value_match(name, text), 6).alias("share"))


@query(
    "fn_intent",
    r"""
    SELECT msg_key, CASE WHEN regexp_matches(s, 'compare|difference|changed|draft|final') THEN 'comparison' WHEN contains(s, 'instruction') THEN 'instructions' WHEN contains(s, 'topic') THEN 'topic'
      WHEN contains(s, 'audience') THEN 'audience' WHEN regexp_matches(s, 'deadline|due') THEN 'deadline' WHEN regexp_matches(s, 'company|who is requesting') THEN 'company' WHEN contains(s, 'territor') THEN 'territories'
      WHEN contains(s, 'month') THEN 'month' WHEN regexp_matches(s, 'from|to|cc|subject') THEN 'metadata' WHEN regexp_matches(s, 'when|date|sent') THEN 'time' ELSE 'general' END AS intent,
      CASE WHEN regexp_matches(s, 'compare|difference|changed|draft.*final|earlier.*(?:latest|final)|(?:vs|versus)') THEN 'comparison'
           WHEN regexp_matches(s, 'timeline|sequence|chronolog|^\s*when did') THEN 'timeline' ELSE 'direct' END AS answer_kind
    FROM (SELECT msg_key, lower(coalesce(subject, '')) AS s FROM email_messages)
    """,
)
def fn_intent(spark: SparkSession, d: str) -> DataFrame:
    """What the subject of every message would ask for, were it a question, and the kind of answer."""
    m = table(spark, d, "email_messages", "msg_key", "subject")
    return m.select("msg_key", T.intent(F.col("subject")).alias("intent"), answers.kind_of(F.col("subject")).alias("answer_kind"))


@query(
    "fn_marks",
    r"""
    SELECT chunk_key, CASE WHEN kind = 'attachment' AND page_no IS NOT NULL THEN '[msg: ' || message_id || ', page: ' || page_no || ']' ELSE '[msg: ' || message_id || ']' END AS mark,
      '[' || attachment_name || ', page: ' || page_no || CASE WHEN coalesce(ocr_used, false) THEN ' (OCR)' ELSE '' END || ']' AS source,
      coalesce(nullif(regexp_replace(regexp_replace(coalesce(message_id, ''), '^[<>]+|[<>]+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'message') AS safe_id FROM email_chunks
    """,
)
def fn_marks(spark: SparkSession, d: str) -> DataFrame:
    """Citation marks and file-safe ids of every chunk."""
    c = table(spark, d, "email_chunks", "chunk_key", "message_id", "page_no", "kind", "attachment_name", "ocr_used")
    return c.select(
        "chunk_key", T.citation_mark(F.col("message_id"), F.col("page_no"), F.col("kind")).alias("mark"), T.source_mark(F.col("attachment_name"), F.col("page_no"), F.col("ocr_used")).alias("source"), T.sanitize_id(F.col("message_id")).alias("safe_id")
    )


# --- graph reads ---

RELATION_SQL = rf"""
    m AS (SELECT msg_key, tenant_id, mailbox_id, lower(trim(regexp_replace(sender, '\s+', ' ', 'g'))) AS subject, unnest(recipients) AS r FROM email_messages WHERE sender IS NOT NULL AND regexp_full_match(sender, '[ -~]*')),
    r AS (SELECT DISTINCT msg_key, tenant_id, mailbox_id, subject, lower(trim(regexp_replace(r, '\s+', ' ', 'g'))) AS object FROM m WHERE r IS NOT NULL AND regexp_full_match(r, '[ -~]*')),
    n AS (SELECT tenant_id, mailbox_id, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS k, min(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS shown FROM
            (SELECT tenant_id, mailbox_id, sender AS x FROM email_messages UNION ALL SELECT tenant_id, mailbox_id, unnest(recipients) FROM email_messages) WHERE x IS NOT NULL AND regexp_full_match(x, '[ -~]*') GROUP BY 1, 2, 3)
"""


@query("graph_named_relations", f"WITH {RELATION_SQL} SELECT msg_key, s.shown AS subject_name, o.shown AS object_name FROM r JOIN n s ON s.tenant_id = r.tenant_id AND s.mailbox_id = r.mailbox_id AND s.k = r.subject JOIN n o ON o.tenant_id = r.tenant_id AND o.mailbox_id = r.mailbox_id AND o.k = r.object")
def graph_named_relations(spark: SparkSession, d: str) -> DataFrame:
    """Who sent to whom, with the display names of both (of names in ASCII)."""
    m = table(spark, d, "email_messages", "msg_key", "tenant_id", "mailbox_id", "sender", "recipients")
    plain = lambda c: F.col(c).rlike(r"^[\x20-\x7E]*$")
    sent = m.where(plain("sender")).select("msg_key", "tenant_id", "mailbox_id", "sender", F.explode("recipients").alias("to")).where(plain("to"))
    relations = sent.select("msg_key", "tenant_id", "mailbox_id", T.name_key(F.col("sender")).alias("subject"), F.lit("PERSON").alias("subject_type"), T.name_key(F.col("to")).alias("object"), F.lit("PERSON").alias("object_type")).distinct()
    names = m.select("tenant_id", "mailbox_id", "sender").unionByName(m.select("tenant_id", "mailbox_id", F.explode("recipients").alias("sender"))).where(plain("sender"))
    shown = T.normalize_name(F.col("sender"))
    entities = names.groupBy("tenant_id", "mailbox_id", F.lit("PERSON").alias("entity_type"), T.name_key(F.col("sender")).alias("normalized_name")).agg(F.min(shown).alias("canonical_name"))
    return enrichment.named_relations(relations, entities).select("msg_key", "subject_name", "object_name")


FACT_SQL = r"""
    t AS (SELECT chunk_id, arg_min(struct_pack(x := text, h := thread_id), chunk_key) AS c FROM email_chunks GROUP BY 1),
    f AS (SELECT mention_id, tenant_id, mailbox_id, chunk_id, normalized_name, c.h AS thread_id, created_at, regexp_matches(coalesce(c.x, ''), '(?i)\b(replaces|replacing|updated from|instead of|now)\b') AS cue
          FROM entity_mentions JOIN t USING (chunk_id) WHERE entity_type = 'MONEY'),
    s AS (SELECT *, CASE WHEN lead(cue) OVER w THEN 'superseded' ELSE 'active' END AS status, CASE WHEN cue THEN lag(mention_id) OVER w END AS supersedes FROM f WINDOW w AS (PARTITION BY tenant_id, mailbox_id, thread_id ORDER BY created_at, mention_id))
"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts as facts of their thread: subject thread, predicate amount."""
    c = table(spark, d, "email_chunks", "chunk_id", "chunk_key", "text", "thread_id").groupBy("chunk_id").agg(F.min_by(F.struct("text", "thread_id"), "chunk_key").alias("c"))
    m = table(spark, d, "entity_mentions").where("entity_type = 'MONEY'").join(c, "chunk_id")
    rows = m.select(
        "mention_id", "tenant_id", "mailbox_id", "chunk_id", "normalized_name", "created_at", F.col("c.thread_id").alias("normalized_subject"), F.lit("amount").alias("normalized_predicate"),
        F.col("created_at").alias("effective_date"), T.has_update_cue(F.col("c.text")).alias("cue"),
    )
    return enrichment.placed_facts(rows, ["tenant_id", "mailbox_id"], ["created_at", "mention_id"])


@query("graph_placed_facts", f"WITH {FACT_SQL} SELECT mention_id, status, supersedes FROM s")
def graph_placed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every amount as a fact of its thread: active or superseded, and what it supersedes."""
    return _facts(spark, d).select("mention_id", "status", "supersedes")


@query(
    "graph_fact_evidence",
    f"""WITH {FACT_SQL}, q AS (SELECT mailbox_id, tenant_id, thread_id FROM email_messages WHERE thread_id IS NOT NULL GROUP BY 1, 2, 3),
    h AS (SELECT DISTINCT q.thread_id, q.mailbox_id, s.chunk_id FROM q JOIN s ON s.tenant_id = q.tenant_id AND s.mailbox_id = q.mailbox_id AND s.thread_id = q.thread_id WHERE s.status = 'active' AND s.created_at::DATE <= DATE '2032-06-30')
    SELECT thread_id, mailbox_id, chunk_id, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mailbox_id, thread_id ORDER BY chunk_id) AS n FROM h) WHERE n <= 10""",
)
def graph_fact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that prove an active amount of every thread as of a day."""
    q = table(spark, d, "email_messages", "tenant_id", "mailbox_id", "thread_id").where("thread_id is not null").distinct()
    q = q.select("tenant_id", "mailbox_id", F.struct("mailbox_id", "thread_id").alias("query_id"), F.array("thread_id").alias("subjects"), F.lit("2032-06-30").cast("date").alias("as_of"))
    facts = _facts(spark, d)  # thread ids are keys already
    hits = enrichment.fact_evidence(q, facts, 10, "active", "as_of")
    return hits.select("query_id.thread_id", "query_id.mailbox_id", "chunk_id", "rank")


# --- corpus building ---


@query("doc_email_chunks")
def doc_email_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the authored text of every message."""
    return ingest.email_chunks(table(spark, d, "email_messages")).select("chunk_id", "doc_id", "message_id", "source_start", "source_end", "token_count", F.sha2("embed_text", 256).alias("embed_hash"))


@query("doc_corpus")
def doc_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the corpus after threading, segmentation and chunking of messages and attachments."""
    messages, pages = table(spark, d, "email_messages"), table(spark, d, "attachment_pages")
    return ingest.corpus_stats(messages, pages, materialize(ingest.corpus_chunks(messages, pages), "corpus-chunks"))


SLICE_SQL = f"""
    m AS (SELECT msg_key, message_id, thread_id, sent_at, len(coalesce(attachment_ids, [])) AS n FROM {FIRST_SQL} WHERE thread_id IS NOT NULL AND mailbox_id IS NOT NULL),
    t AS (SELECT thread_id, count(*) AS size, sum(n) AS total, min(n) FILTER (n > 0) AS least FROM m GROUP BY 1),
    a AS (SELECT *, row_number() OVER (ORDER BY least, total, size DESC, thread_id) AS pos FROM t WHERE least IS NOT NULL),
    b AS (SELECT *, row_number() OVER (ORDER BY size DESC, thread_id) AS pos FROM t WHERE least IS NULL),
    u AS (SELECT *, CASE WHEN least IS NOT NULL AND pos <= 12 THEN 0 WHEN least IS NULL THEN 1 ELSE 2 END AS g FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY g, pos) AS taken FROM u) WHERE taken <= 20),
    c AS (SELECT *, row_number() OVER (ORDER BY least IS NULL, pos) AS thread_place FROM k),
    r AS (SELECT m.*, thread_place, least, row_number() OVER (PARTITION BY thread_id, n > 0 ORDER BY sent_at NULLS FIRST, message_id) AS nth FROM m JOIN c USING (thread_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY CASE WHEN least IS NULL THEN 1 WHEN n > 0 AND nth <= 1 THEN 0 WHEN n = 0 THEN 1 ELSE 2 END, sent_at NULLS FIRST, message_id) AS pick FROM r)
"""


@query("topk_slice", f"WITH {SLICE_SQL} SELECT msg_key, thread_place::INT AS thread_place, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at NULLS FIRST, message_id)::INT AS place FROM p WHERE pick <= 10")
def topk_slice(spark: SparkSession, d: str) -> DataFrame:
    """A slice of the mail: twenty threads, those with attachments first, ten messages of each."""
    m = corpus.first_per_message(table(spark, d, "email_messages").where("message_id is not null"))
    return ingest.select_messages(m.where("mailbox_id is not null")).select("msg_key", "thread_place", "place")


@query(
    "dml_upsert_chunks",
    """
    WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, mailbox_id, chunk_id ORDER BY chunk_key) AS n FROM email_chunks) WHERE n = 1),
    e AS (SELECT c.*, v.embedding FROM c LEFT JOIN chunk_vectors v USING (chunk_id))
    SELECT chunk_id, mailbox_id, length(CASE WHEN chunk_key % 3 = 0 THEN coalesce(embed_text, '') || '!' ELSE embed_text END)::INT AS indexed, (CASE WHEN chunk_key % 3 = 0 THEN NULL ELSE embedding END) IS NOT NULL AS embedded FROM e
    """,
)
def dml_upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after every third chunk came in with another indexing text, and a third with the same."""
    first = Window.partitionBy("tenant_id", "mailbox_id", "chunk_id").orderBy("chunk_key")
    c = table(spark, d, "email_chunks").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    stored = c.join(table(spark, d, "chunk_vectors", "chunk_id", "embedding"), "chunk_id", "left")
    changed = c.where("chunk_key % 3 = 0").withColumn("embed_text", F.concat(F.coalesce("embed_text", F.lit("")), F.lit("!")))
    after = ingest.upsert_chunks(stored, changed.unionByName(c.where("chunk_key % 3 = 1")))
    return after.select("chunk_id", "mailbox_id", F.length("embed_text").alias("indexed"), F.col("embedding").isNotNull().alias("embedded"))


@query("scan_evidence", "SELECT tenant_id, mailbox_id, chunk_id, arg_min(text, chunk_key) AS text FROM email_chunks WHERE (tenant_id, mailbox_id, chunk_id) IN (SELECT tenant_id, mailbox_id, chunk_id FROM entity_mentions WHERE entity_type = 'MONEY') GROUP BY 1, 2, 3")
def scan_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the chunks that mention an amount."""
    wanted = table(spark, d, "entity_mentions", "tenant_id", "mailbox_id", "chunk_id", "entity_type").where("entity_type = 'MONEY'")
    return ingest.evidence_texts(table(spark, d, "email_chunks", "tenant_id", "mailbox_id", "chunk_id", "chunk_key", "text"), wanted)


# --- conversations ---


@query("qa_sessions")
def qa_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every thread as a conversation of its subjects and first lines: memory after each turn, and the question rewritten from it."""
    m = corpus.first_per_message(table(spark, d, "email_messages").where("message_id is not null and thread_id is not null"))
    n = F.row_number().over(Window.partitionBy("mailbox_id", "thread_id").orderBy(F.col("sent_at").asc_nulls_last(), "msg_key"))
    turns = m.select(F.concat_ws("/", "mailbox_id", "thread_id").alias("session_id"), n.alias("turn_no"), "subject", "body_text", "sender", "message_id", "sent_at").select(
        "session_id", "turn_no", F.when(F.col("turn_no") % 2 == 1, "user").otherwise("assistant").alias("role"), F.when(F.col("turn_no") % 2 == 1, F.col("subject")).otherwise(F.substring_index("body_text", "\n", 1)).alias("text"),
        F.array(F.struct(F.lit(None).cast("string").alias("name"), "subject", "sender", "message_id", F.col("sent_at").cast("string").alias("at"))).alias("hits"),
    )
    states = conversation.session_states(turns)
    return conversation.rewritten(states, F.element_at(F.split("session_id", "/"), -1)).select("session_id", "turn_no", "current_focus", "last_user_intent", F.size("people").alias("people"), "query_text")


# --- synchronisation: the addresses of the notifications as mailboxes ---

BOX_SQL = """
    b AS (SELECT address, row_number() OVER (ORDER BY address) AS mailbox_key FROM (SELECT DISTINCT lower(email_address) AS address FROM gmail_notifications WHERE email_address IS NOT NULL)),
    x AS (SELECT *, CASE mailbox_key % 5 WHEN 1 THEN 'needs_full_sync' WHEN 2 THEN 'disconnected' ELSE 'active' END AS status FROM b),
    j AS (SELECT mailbox_key, mailbox_key AS job_id, (mailbox_key * 7 % 100)::DECIMAL(20,0) AS requested, CASE mailbox_key % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'done' END AS status, (mailbox_key % 6)::INT AS attempts FROM b)
"""


def _mailboxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mailboxes, jobs, notifications) made of the notification table."""
    n = table(spark, d, "gmail_notifications", "delivery_id", "email_address", "history_id", "received_at").where("email_address is not null")
    box = n.select(F.lower("email_address").alias("email_address")).distinct().withColumn("mailbox_key", F.row_number().over(Window.orderBy("email_address")).cast("bigint"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("active", "needs_full_sync", "disconnected", "active", "active")]), (F.col("mailbox_key") % 5 + 1).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    boxes = box.select("mailbox_key", F.lit("t").alias("tenant_id"), F.col("email_address").alias("mailbox_id"), "email_address", status.alias("status"), null("decimal(20,0)").alias("last_history_id"), null("string").alias("error"), null("timestamp").alias("watch_expires_at"))
    job_status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "running", "done")]), (F.col("mailbox_key") % 3 + 1).cast("int"))
    jobs = box.select(
        F.col("mailbox_key").alias("job_id"), "mailbox_key", (F.col("mailbox_key") * 7 % 100).cast("decimal(20,0)").alias("requested_history_id"), job_status.alias("status"), (F.col("mailbox_key") % 6).cast("int").alias("attempts"),
        F.lit(False).alias("needs_full_sync"), null("timestamp").alias("leased_until"), null("string").alias("last_error"), null("timestamp").alias("created_at"),
    )
    return boxes, jobs, n


@query(
    "stream_coalesced_jobs",
    f"""WITH {BOX_SQL}, n AS (SELECT x.mailbox_key, max(history_id) AS wanted, bool_or(status = 'needs_full_sync') AS f FROM gmail_notifications g JOIN x ON x.address = lower(g.email_address) WHERE status <> 'disconnected' GROUP BY 1),
    a AS (SELECT job_id, mailbox_key, CASE WHEN j.status = 'pending' THEN greatest(requested, wanted) ELSE requested END AS requested_history_id, j.status, false AS full_sync FROM j LEFT JOIN n USING (mailbox_key)),
    f AS (SELECT (SELECT max(job_id) FROM j) + row_number() OVER (ORDER BY mailbox_key) AS job_id, mailbox_key, wanted, 'pending', n.f FROM n WHERE mailbox_key NOT IN (SELECT mailbox_key FROM j WHERE status = 'pending'))
    SELECT job_id, mailbox_key, requested_history_id::DECIMAL(20,0) AS requested_history_id, status, full_sync FROM a UNION ALL SELECT * FROM f""",
)
def stream_coalesced_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after all notifications: one pending job a live mailbox with the greatest history id."""
    boxes, jobs, n = _mailboxes(spark, d)
    after = sync.coalesced_jobs(jobs, sync.live_notifications(n, boxes), F.current_timestamp())
    return after.select("job_id", "mailbox_key", "requested_history_id", "status", F.col("needs_full_sync").alias("full_sync"))


@query(
    "stream_failed_jobs",
    f"""WITH {BOX_SQL}, k AS (SELECT * FROM j UNION ALL SELECT mailbox_key, 100000 + mailbox_key, requested + 5, 'pending', 0 FROM j WHERE status = 'running' AND mailbox_key % 2 = 0),
    e AS (SELECT job_id, mailbox_key, requested, attempts, (SELECT min(p.job_id) FROM k p WHERE p.mailbox_key = k.mailbox_key AND p.status = 'pending') AS successor FROM k WHERE status = 'running'),
    m AS (SELECT successor AS job_id, max(requested) AS more FROM e WHERE successor IS NOT NULL GROUP BY 1)
    SELECT k.job_id, greatest(k.requested, m.more)::DECIMAL(20,0) AS requested_history_id, CASE WHEN e.job_id IS NULL THEN k.status WHEN e.attempts >= 5 OR e.successor IS NOT NULL THEN 'failed' ELSE 'pending' END AS status
    FROM k LEFT JOIN e USING (job_id) LEFT JOIN m USING (job_id)""",
)
def stream_failed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after every running one failed: pending again, failed for good, or folded into a newer one."""
    _, jobs, _ = _mailboxes(spark, d)
    newer = jobs.where("status = 'running' and mailbox_key % 2 = 0").withColumns({"job_id": F.col("mailbox_key") + 100000, "requested_history_id": (F.col("requested_history_id") + 5).cast("decimal(20,0)"), "status": F.lit("pending"), "attempts": F.lit(0)})
    both = jobs.unionByName(newer)
    after = sync.failed(both, both.where("status = 'running'").select("job_id", F.lit("timeout").alias("error")))
    return after.select("job_id", "requested_history_id", "status")


@query(
    "scan_rejected_notifications",
    r"""
    WITH p AS (SELECT delivery_id, push_body, CASE WHEN json_valid(push_body) THEN json_extract_string(push_body, '$.message.data') END AS data,
        CASE WHEN json_valid(push_body) THEN coalesce(json_extract_string(push_body, '$.message.messageId'), json_extract_string(push_body, '$.message.message_id')) END AS ident FROM gmail_notifications),
    q AS (SELECT *, translate(translate(data, '-_', '+/'), '=', '') AS raw FROM p),
    j AS (SELECT *, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9+/]*') AND length(raw) % 4 <> 1 THEN decode(from_base64(raw || substr('===', 1, ((4 - length(raw) % 4) % 4)::INT))) END AS body FROM q),
    r AS (SELECT delivery_id, CASE WHEN coalesce(push_body, '') = '' THEN 'no_body' WHEN NOT json_valid(push_body) THEN 'not_json' WHEN coalesce(ident, '') = '' THEN 'no_message_id' WHEN coalesce(data, '') = '' THEN 'no_data' WHEN body IS NULL THEN 'not_base64'
        WHEN NOT json_valid(body) THEN 'data_not_json' WHEN coalesce(json_extract_string(body, '$.emailAddress'), '') = '' THEN 'no_address' WHEN TRY_CAST(json_extract_string(body, '$.historyId') AS DECIMAL(20,0)) IS NULL THEN 'no_history_id' END AS reason FROM j)
    SELECT delivery_id, reason FROM r WHERE reason IS NOT NULL
    """,
)
def scan_rejected_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries whose push body can't be decoded, and why."""
    rows = table(spark, d, "gmail_notifications", "delivery_id", "push_body")
    return rows.select("delivery_id", sync.reject_reason(F.col("push_body")).alias("reason")).where("reason is not null")
