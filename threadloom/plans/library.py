"""Queries over the mail tables for the engine's operators, each with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T
from threadloom.operators import changes, citations, corpus, graph, retrieval, search
from threadloom.plans import answering
from threadloom.runtime import materialize
from threadloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOK = r"regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]+')"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def tok(x: str) -> str:
    return TOK.format(x)


# --- scalar functions ---------------------------------------------------------


@query("fn_tokens", f"SELECT chunk_key, len({tok('text')})::INT AS tokens, len(list_distinct({tok('lower(text)')}))::INT AS distinct_tokens FROM email_chunks")
def fn_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of every chunk."""
    c = table(spark, d, "email_chunks", "chunk_key", "text")
    return c.select("chunk_key", T.count_tokens(F.col("text")).alias("tokens"), F.size(F.array_distinct(T.tokenize(F.lower("text")))).alias("distinct_tokens"))


SUBJECT_SQL = r"regexp_replace(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '^\s*((re|fw|fwd)\s*:\s*)+', '', 'i')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query("fn_subject", f"SELECT msg_key, {SUBJECT_SQL.format('subject')} AS topic FROM email_messages")
def fn_subject(spark: SparkSession, d: str) -> DataFrame:
    """Normalised subject of every message."""
    return table(spark, d, "email_messages", "msg_key", "subject").select("msg_key", T.normalize_subject(F.col("subject")).alias("topic"))


@query(
    "fn_body",
    r"""
    WITH a AS (SELECT msg_key, replace(replace(coalesce(body_text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM email_messages),
    b AS (SELECT msg_key, t, regexp_matches(t, '(?i)<\s*(html|body|div|p|br|table)\b') AS h FROM a),
    c AS (SELECT msg_key, CASE WHEN h THEN
            replace(replace(replace(replace(replace(
              regexp_replace(regexp_replace(regexp_replace(t, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>', '', 'g'),
                '(?i)<br\s*/?>', chr(10), 'g'), '<[A-Za-z/!][^<>]*>', chr(10), 'g'),
              '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') ELSE t END AS t FROM b)
    SELECT msg_key, sha256(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\x0B\f]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+\z', '', 'g')) AS body_hash FROM c
    """,
)
def fn_body(spark: SparkSession, d: str) -> DataFrame:
    """Hash of every normalised body."""
    return table(spark, d, "email_messages", "msg_key", "body_text").select("msg_key", T.sha256(T.normalize_body(F.col("body_text"))).alias("body_hash"))


@query(
    "fn_embed_text",
    """
    WITH h AS (SELECT msg_key, concat_ws(chr(10),
        CASE WHEN coalesce(sender, '') <> '' THEN 'From: ' || sender END,
        CASE WHEN len(coalesce(recipients, [])) > 0 AND array_to_string(list_filter(recipients, lambda x: x IS NOT NULL), ', ') <> '' THEN 'To: ' || array_to_string(list_filter(recipients, lambda x: x IS NOT NULL), ', ') END,
        CASE WHEN len(coalesce(cc, [])) > 0 AND array_to_string(list_filter(cc, lambda x: x IS NOT NULL), ', ') <> '' THEN 'Cc: ' || array_to_string(list_filter(cc, lambda x: x IS NOT NULL), ', ') END,
        CASE WHEN sent_at IS NOT NULL THEN 'Date: ' || strftime(sent_at AT TIME ZONE 'UTC', '%Y-%m-%d') END,
        CASE WHEN coalesce(subject, '') <> '' THEN 'Subject: ' || subject END,
        CASE WHEN coalesce(thread_id, '') <> '' THEN 'Thread-ID: ' || thread_id END,
        CASE WHEN coalesce(in_reply_to, '') <> '' THEN 'In-Reply-To: ' || in_reply_to END) AS head, body_text FROM email_messages)
    SELECT msg_key, sha256(concat_ws(chr(10) || chr(10), nullif(head, ''), body_text)) AS embed_hash FROM h
    """,
)
def fn_embed_text(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the indexing text of every message."""
    m = table(spark, d, "email_messages")
    c = F.col
    return m.select("msg_key", T.sha256(T.embed_text(c("sender"), c("recipients"), c("cc"), c("sent_at"), c("subject"), c("thread_id"), c("in_reply_to"), c("body_text"))).alias("embed_hash"))


@query(
    "fn_entities",
    r"""
    SELECT chunk_key,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\$?\d[\d,]*(?:\.\d{2})?'), lambda x: replace(replace(x, '$', ''), ',', '')))), '|') AS amounts,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2}(?:,\s+\d{4})?)\b'), lambda x: lower(x)))), '|') AS dates,
      regexp_matches(coalesce(text, ''), '(?i)\b(replaces|replacing|updated from|instead of|now)\b') AS cue
    FROM email_chunks
    """,
)
def fn_entities(spark: SparkSession, d: str) -> DataFrame:
    """Amounts, dates and correction cues of every chunk."""
    t = F.coalesce("text", F.lit(""))
    c = table(spark, d, "email_chunks", "chunk_key", "text")
    return c.select("chunk_key", F.array_join(T.amounts(t), "|").alias("amounts"), F.array_join(T.dates(t), "|").alias("dates"), T.has_update_cue(F.col("text")).alias("cue"))


@query(
    "fn_hash_fingerprint",
    """SELECT chunk_key, sha256('{"chunk_id":' || coalesce(to_json(chunk_id), 'null') || ',"subject":' || coalesce(to_json(subject), 'null') || ',"text":' || coalesce(to_json(text), 'null') || ',"thread_id":' || coalesce(to_json(thread_id), 'null') || '}') AS fingerprint FROM email_chunks""",
)
def fn_hash_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Input fingerprint that decides whether a chunk must be enriched again."""
    c = table(spark, d, "email_chunks", "chunk_key", "chunk_id", "thread_id", "subject", "text")
    return c.select("chunk_key", T.fingerprint("chunk_id", "thread_id", "subject", "text").alias("fingerprint"))


@query(
    "fn_locate_span",
    """
    WITH t AS (SELECT chunk_id, arg_min(text, chunk_key) AS text FROM email_chunks GROUP BY 1)
    SELECT mention_id, (CASE WHEN length(mention_text) > 0 AND strpos(text, mention_text) > 0 THEN strpos(text, mention_text) - 1 END)::INT AS span_start,
           (CASE WHEN length(mention_text) > 0 AND strpos(text, mention_text) > 0 THEN strpos(text, mention_text) - 1 + length(mention_text) END)::INT AS span_end
    FROM entity_mentions JOIN t USING (chunk_id)
    """,
)
def fn_locate_span(spark: SparkSession, d: str) -> DataFrame:
    """First occurrence of every mention in its chunk."""
    c = table(spark, d, "email_chunks", "chunk_id", "chunk_key", "text").groupBy("chunk_id").agg(F.min_by("text", "chunk_key").alias("text"))
    m = table(spark, d, "entity_mentions", "mention_id", "chunk_id", "mention_text").join(c, "chunk_id")
    span = T.locate_span(F.col("text"), F.col("mention_text"))
    return m.select("mention_id", span["start"].alias("span_start"), span["end"].alias("span_end"))


@query(
    "fn_clause_support",
    rf"""
    WITH t AS (SELECT chunk_id, arg_min(text, chunk_key) AS text FROM email_chunks GROUP BY 1),
    m AS (SELECT mention_id, list_distinct({tok('lower(canonical_name)')}) AS a, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS f
          FROM entity_mentions JOIN t USING (chunk_id)),
    s AS (SELECT mention_id, a, list_distinct({tok('lower(f)')}) AS b FROM m)
    SELECT mention_id, round(max(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END), 6)::DOUBLE AS f1 FROM s GROUP BY 1
    """,
)
def fn_clause_support(spark: SparkSession, d: str) -> DataFrame:
    """Best fragment F1 of every mention's canonical name against its chunk."""
    c = table(spark, d, "email_chunks", "chunk_id", "chunk_key", "text").groupBy("chunk_id").agg(F.min_by("text", "chunk_key").alias("text"))
    m = table(spark, d, "entity_mentions", "mention_id", "chunk_id", "canonical_name").join(c, "chunk_id")
    return m.select("mention_id", F.round(T.overlap_f1(F.col("canonical_name"), F.col("text")), 6).alias("f1"))


# --- scans, projections, filters ----------------------------------------------


@query(
    "scan_chunks",
    """SELECT chunk_key, chunk_id, coalesce(thread_id, '') AS thread_id, kind, coalesce(source_start, 0)::INT AS source_start,
              length(coalesce(embed_text, text))::INT AS embed_length, coalesce(token_count, 0)::INT AS token_count FROM email_chunks""",
)
def scan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Typed chunk scan: a missing embed text falls back to the text."""
    return table(spark, d, "email_chunks").select(
        "chunk_key",
        "chunk_id",
        F.coalesce("thread_id", F.lit("")).alias("thread_id"),
        "kind",
        F.coalesce("source_start", F.lit(0)).alias("source_start"),
        F.length(F.coalesce("embed_text", "text")).alias("embed_length"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
    )


@query(
    "scan_notifications",
    r"""
    WITH p AS (SELECT delivery_id, email_address, history_id,
        CASE WHEN json_valid(push_body) THEN json_extract_string(push_body, '$.message.data') END AS data FROM gmail_notifications),
    q AS (SELECT *, translate(translate(data, '-_', '+/'), '=', '') AS raw FROM p),
    j AS (SELECT *, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9+/]*') AND length(raw) % 4 <> 1
        THEN decode(from_base64(raw || substr('===', 1, ((4 - length(raw) % 4) % 4)::INT))) END AS body FROM q)
    SELECT delivery_id, coalesce(email_address, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.emailAddress') END) AS email_address,
           coalesce(history_id, TRY_CAST(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.historyId') END AS DECIMAL(20,0)))::VARCHAR AS history_id
    FROM j
    """,
)
def scan_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Notifications with undecoded rows filled from the raw push body."""
    body = T.base64url(F.get_json_object("push_body", "$.message.data"))
    inner = F.get_json_object(body, "$.historyId")
    return table(spark, d, "gmail_notifications", "delivery_id", "email_address", "history_id", "push_body").select(
        "delivery_id",
        F.coalesce("email_address", F.get_json_object(body, "$.emailAddress")).alias("email_address"),
        F.coalesce("history_id", inner.try_cast("decimal(20,0)")).cast("string").alias("history_id"),
    )


@query("scan_threads", "SELECT DISTINCT tenant_id, mailbox_id, thread_id FROM email_chunks WHERE thread_id IS NOT NULL")
def scan_threads(spark: SparkSession, d: str) -> DataFrame:
    """Available threads of each mailbox."""
    return table(spark, d, "email_chunks", "tenant_id", "mailbox_id", "thread_id").where("thread_id is not null").distinct()


@query("filter_scope", "SELECT chunk_key, chunk_id, thread_id FROM email_chunks WHERE mailbox_id = 'mbx-00-000' AND embed_text IS NOT NULL AND trim(text) <> ''")
def filter_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one mailbox with an embedding text."""
    c = table(spark, d, "email_chunks", "chunk_key", "chunk_id", "thread_id", "mailbox_id", "embed_text", "text")
    return c.where("mailbox_id = 'mbx-00-000' and embed_text is not null and trim(text) <> ''").select("chunk_key", "chunk_id", "thread_id")


@query("filter_usable_pages", "SELECT page_key, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]'))::INT AS alnum FROM attachment_pages WHERE len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]')) >= 20")
def filter_usable_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with enough text not to need recognition."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]"))
    return table(spark, d, "attachment_pages", "page_key", "text").select("page_key", n.alias("alnum")).where("alnum >= 20")


@query("filter_date_range", "SELECT msg_key FROM email_messages WHERE sent_at >= TIMESTAMPTZ '2031-06-01 00:00:00+00' AND sent_at <= TIMESTAMPTZ '2032-06-01 00:00:00+00'")
def filter_date_range(spark: SparkSession, d: str) -> DataFrame:
    """Messages of an inclusive date range; the bounds reach the Parquet scan."""
    lo, hi = F.lit("2031-06-01T00:00:00Z").cast("timestamp"), F.lit("2032-06-01T00:00:00Z").cast("timestamp")
    return table(spark, d, "email_messages", "msg_key", "sent_at").where(F.col("sent_at").between(lo, hi)).select("msg_key")


@query(
    "filter_check_violations",
    """
    WITH m AS (SELECT mention_id, source_start, CASE WHEN mention_id % 10 = 3 THEN NULL ELSE source_end END AS source_end, chunk_start,
                 CASE WHEN mention_id % 10 = 5 THEN chunk_start - 1 ELSE chunk_end END AS chunk_end, CASE WHEN mention_id % 10 = 7 THEN 'PLANET' ELSE entity_type END AS entity_type FROM entity_mentions)
    SELECT mention_id, CASE WHEN (source_start IS NULL) <> (source_end IS NULL) THEN 'offsets' WHEN chunk_end < chunk_start THEN 'span'
             WHEN entity_type NOT IN ('PERSON','ORG','PROJECT','TOPIC','DOCUMENT','MEETING','COMMITMENT','DATE','MONEY') THEN 'type' END AS broken
    FROM m WHERE broken IS NOT NULL
    """,
)
def filter_check_violations(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that break the table's checks, of a copy into which some of each kind were put."""
    n = F.col("mention_id") % 10
    m = table(spark, d, "entity_mentions").withColumns(
        {"source_end": F.when(n != 3, F.col("source_end")), "chunk_end": F.when(n == 5, F.col("chunk_start") - 1).otherwise(F.col("chunk_end")), "entity_type": F.when(n == 7, "PLANET").otherwise(F.col("entity_type"))}
    )
    return graph.violations(m).select("mention_id", "broken")


# --- joins --------------------------------------------------------------------

FIRST_SQL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, mailbox_id, message_id ORDER BY ingested_at NULLS LAST, msg_key) AS n FROM email_messages WHERE message_id IS NOT NULL) WHERE n = 1)"


@query("join_parent", f"SELECT m.msg_key, p.sender AS parent_sender, p.sent_at AS parent_sent_at FROM email_messages m LEFT JOIN {FIRST_SQL} p ON m.tenant_id = p.tenant_id AND m.mailbox_id = p.mailbox_id AND m.in_reply_to = p.message_id")
def join_parent(spark: SparkSession, d: str) -> DataFrame:
    """Every message with its parent's sender."""
    m = table(spark, d, "email_messages", "msg_key", "tenant_id", "mailbox_id", "message_id", "in_reply_to", "sender", "sent_at", "ingested_at")
    p = corpus.first_per_message(m.where("message_id is not null")).select("tenant_id", "mailbox_id", F.col("message_id").alias("in_reply_to"), F.col("sender").alias("parent_sender"), F.col("sent_at").alias("parent_sent_at"))
    return m.join(p, ["tenant_id", "mailbox_id", "in_reply_to"], "left").select("msg_key", "parent_sender", "parent_sent_at")


@query(
    "join_header_threads",
    f"""
    WITH l AS (SELECT msg_key, tenant_id, mailbox_id, 0 AS pos, in_reply_to AS target FROM email_messages
               UNION ALL SELECT msg_key, tenant_id, mailbox_id, unnest(range(1, len(reference_ids) + 1)) AS pos, unnest(reference_ids) FROM email_messages WHERE reference_ids IS NOT NULL),
    f AS (SELECT l.msg_key, row_number() OVER (PARTITION BY l.msg_key ORDER BY pos, k.thread_id NULLS FIRST) AS n, k.thread_id
          FROM l JOIN {FIRST_SQL} k ON l.tenant_id = k.tenant_id AND l.mailbox_id = k.mailbox_id AND l.target = k.message_id)
    SELECT m.msg_key, CASE WHEN f.msg_key IS NOT NULL THEN f.thread_id ELSE m.thread_id END AS resolved_thread
    FROM email_messages m LEFT JOIN (SELECT * FROM f WHERE n = 1) f USING (msg_key)
    """,
)
def join_header_threads(spark: SparkSession, d: str) -> DataFrame:
    """Thread of every message by its reply headers."""
    return corpus.header_threads(table(spark, d, "email_messages", "msg_key", "tenant_id", "mailbox_id", "message_id", "thread_id", "in_reply_to", "reference_ids", "ingested_at"))


@query(
    "join_subject_window",
    f"""
    WITH m AS (SELECT msg_key, mailbox_id, {SUBJECT_SQL.format('subject')} AS topic, sent_at,
                      list_filter(list_concat(list_concat(coalesce(recipients, []), coalesce(cc, [])), [sender]), lambda x: x IS NOT NULL) AS ps
               FROM email_messages WHERE sent_at IS NOT NULL)
    SELECT a.msg_key, arg_max(b.msg_key, (b.sent_at, b.msg_key)) AS candidate
    FROM m a JOIN m b ON a.mailbox_id = b.mailbox_id AND a.topic = b.topic AND a.msg_key <> b.msg_key
      AND b.sent_at BETWEEN a.sent_at - INTERVAL 7 DAY AND a.sent_at + INTERVAL 7 DAY AND list_has_any(a.ps, b.ps)
    GROUP BY 1
    """,
)
def join_subject_window(spark: SparkSession, d: str) -> DataFrame:
    """Latest related message by subject, participants and a week's distance."""
    return corpus.subject_candidates(table(spark, d, "email_messages", "msg_key", "mailbox_id", "subject", "sent_at", "sender", "recipients", "cc"))


@query("join_attachment_message", f"SELECT p.page_key, m.sender, m.sent_at FROM attachment_pages p LEFT JOIN (SELECT message_id, arg_min(sender, msg_key) AS sender, arg_min(sent_at, msg_key) AS sent_at FROM {FIRST_SQL} WHERE sender IS NOT NULL AND sent_at IS NOT NULL GROUP BY 1) m USING (message_id)")
def join_attachment_message(spark: SparkSession, d: str) -> DataFrame:
    """Every attachment page with the message that carried it."""
    m = corpus.first_per_message(table(spark, d, "email_messages", "msg_key", "tenant_id", "mailbox_id", "message_id", "ingested_at", "sender", "sent_at").where("message_id is not null"))
    m = m.where("sender is not null and sent_at is not null").groupBy("message_id").agg(F.min_by(F.struct("sender", "sent_at"), "msg_key").alias("m"))
    return table(spark, d, "attachment_pages", "page_key", "message_id").join(m, "message_id", "left").select("page_key", "m.sender", "m.sent_at")


# --- retrieval ----------------------------------------------------------------

BM25_SQL = f"""
    p AS (SELECT chunk_key, term, count(*) AS tf, dl FROM (SELECT chunk_key, len({tok("lower(coalesce(embed_text, text))")}) AS dl, unnest({tok("lower(coalesce(embed_text, text))")}) AS term FROM email_chunks) GROUP BY 1, 2, 4),
    st AS (SELECT count(*) AS n, avg(len({tok("lower(coalesce(embed_text, text))")})) AS avgdl FROM email_chunks),
    idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, st GROUP BY term, n),
    fl AS (SELECT 0.25 * avg(idf) AS floor FROM idf),
    q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok("lower(coalesce(question, text))")}) AS term FROM eval_items) GROUP BY 1, 2),
    bm AS (SELECT query_id, chunk_key, round(sum(qtf * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
           FROM q JOIN idf USING (term) JOIN p USING (term), st, fl GROUP BY 1, 2),
    qd AS (SELECT item_id AS query_id, len(list_distinct({tok("lower(coalesce(question, text))")})) AS n, unnest(list_distinct({tok("lower(coalesce(question, text))")})) AS term FROM eval_items),
    ov AS (SELECT query_id, chunk_key, round(count(*)::DOUBLE / any_value(n), 6) AS score FROM qd JOIN p USING (term) GROUP BY 1, 2)
"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "question", "text").select(F.col("item_id").alias("query_id"), F.coalesce("question", "text").alias("query_text"))


def _hits(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, the k best by BM25, the k best by token recall) of every question."""
    c = table(spark, d, "email_chunks", "chunk_key", "embed_text", "text")
    q = _questions(spark, d)
    index = materialize(retrieval.postings(c, "chunk_key", F.coalesce("embed_text", "text")), "postings")
    return index, search.lexical_top_k(index, c, q, "chunk_key", k, scoped=False), search.recall_top_k(index, q, "chunk_key", k, scoped=False)


@query(
    "topk_lexical",
    f"WITH {BM25_SQL} SELECT query_id, chunk_key, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM bm) WHERE rank <= 15",
)
def topk_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The 15 best chunks of every question by BM25."""
    return _hits(spark, d, 15)[1].select("query_id", "chunk_key", "score", "rank")


@query(
    "topk_fused",
    f"""WITH {BM25_SQL},
    r AS (SELECT query_id, chunk_key, 'lexical' AS branch, 1.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM bm
          UNION ALL SELECT query_id, chunk_key, 'recall', 0.5, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) FROM ov),
    f AS (SELECT query_id, chunk_key, round(sum(w / (60 + rank)), 8) AS score, array_to_string(list_sort(list(branch || ':' || rank)), ',') AS sources FROM r WHERE rank <= 40 GROUP BY 1, 2)
    SELECT query_id, chunk_key, score, sources, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM f) WHERE rank <= 10""",
)
def topk_fused(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best chunks of every question after weighted reciprocal-rank fusion of two branches."""
    _, lexical, recall = _hits(spark, d, 40)
    return retrieval.weighted_rrf({"lexical": (lexical, 1.0), "recall": (recall, 0.5)}, "chunk_key", limit=10)


@query(
    "topk_reranked",
    f"""WITH {BM25_SQL},
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM bm) WHERE rank <= 15),
    n AS (SELECT b.query_id, b.chunk_key, coalesce(ov.score, 0) AS rerank_score, b.rank,
            CASE WHEN max(b.score) OVER w = min(b.score) OVER w THEN CASE WHEN max(b.score) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE (b.score - min(b.score) OVER w) / (max(b.score) OVER w - min(b.score) OVER w) END AS bm25_norm
          FROM b LEFT JOIN ov USING (query_id, chunk_key) WINDOW w AS (PARTITION BY b.query_id)),
    m AS (SELECT *, CASE WHEN max(rerank_score) OVER w = min(rerank_score) OVER w THEN CASE WHEN max(rerank_score) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) END AS rerank_norm
          FROM n WINDOW w AS (PARTITION BY query_id)),
    s AS (SELECT query_id, chunk_key, round(0.5 * rerank_norm + 0.2 * bm25_norm, 6) AS support, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_norm, 6) DESC, rank) AS place FROM m)
    SELECT query_id, chunk_key, support, place::INT AS place FROM s WHERE place <= 5""",
)
def topk_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Five hits of every question after reranking by token recall, with their support."""
    return _reranked(spark, d).where("place <= 5").select("query_id", "chunk_key", "support", "place")


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    """The 15 lexical hits of every question in their reranked order, without a dense branch."""
    hits = _hits(spark, d, 15)[1].withColumnRenamed("score", "bm25_score").withColumn("dense_score", F.lit(None).cast("double"))
    texts = table(spark, d, "email_chunks", "chunk_key", "embed_text", "text").select("chunk_key", F.coalesce("embed_text", "text").alias("text"))
    return search.reranked(hits.join(texts, "chunk_key").join(_questions(spark, d), "query_id"), 15)


@query(
    "topk_dense",
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
    SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 15
    """,
)
def topk_dense(spark: SparkSession, d: str) -> DataFrame:
    """The 15 nearest vectors of every fiftieth vector, exactly."""
    v = table(spark, d, "chunk_vectors", "vec_id", "embedding")
    q = v.where("vec_id % 50 = 0 and embedding is not null").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense_top_k(v, q, "vec_id", "embedding", 15).select("query_id", "vec_id", "score", "rank")


@query(
    "topk_thread_recent",
    f"SELECT thread_id, msg_key, place::INT AS place FROM (SELECT thread_id, msg_key, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC NULLS LAST, msg_key) AS place FROM {FIRST_SQL} WHERE thread_id IS NOT NULL) WHERE place <= 3",
)
def topk_thread_recent(spark: SparkSession, d: str) -> DataFrame:
    """The three latest messages of every thread."""
    m = corpus.first_per_message(table(spark, d, "email_messages", "msg_key", "tenant_id", "mailbox_id", "message_id", "ingested_at", "thread_id", "sent_at").where("message_id is not null")).where("thread_id is not null")
    w = Window.partitionBy("thread_id").orderBy(F.desc_nulls_last("sent_at"), "msg_key")
    return m.withColumn("place", F.row_number().over(w)).where("place <= 3").select("thread_id", "msg_key", "place")


# --- aggregations -------------------------------------------------------------


@query(
    "agg_corpus",
    "SELECT (SELECT count(DISTINCT thread_id) FROM email_messages) AS threads, (SELECT count(*) FROM email_messages) AS messages, (SELECT count(*) FROM email_chunks) AS chunks, (SELECT sum(length(text))::BIGINT FROM email_chunks) AS characters, (SELECT count(*) FROM attachment_pages WHERE ocr_used) AS recognised_pages",
)
def agg_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Size of the corpus in one row."""
    m = table(spark, d, "email_messages", "thread_id").agg(F.count_distinct("thread_id").alias("threads"), F.count("*").alias("messages"))
    c = table(spark, d, "email_chunks", "text").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))
    p = table(spark, d, "attachment_pages", "ocr_used").agg(F.count_if("ocr_used").alias("recognised_pages"))
    one = F.lit(1).alias("k")
    return m.select("*", one).join(c.select("*", one), "k").join(p.select("*", one), "k").drop("k")


@query("agg_thread_attachments", "SELECT mailbox_id, thread_id, count(*) AS messages, count(*) FILTER (len(coalesce(attachment_ids, [])) > 0) AS bearing, sum(len(coalesce(attachment_ids, [])))::BIGINT AS attachments FROM email_messages GROUP BY 1, 2")
def agg_thread_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Attachment counts of every thread."""
    n = F.size(F.coalesce("attachment_ids", F.array().cast("array<string>")))
    return table(spark, d, "email_messages", "mailbox_id", "thread_id", "attachment_ids").groupBy("mailbox_id", "thread_id").agg(F.count("*").alias("messages"), F.count_if(n > 0).alias("bearing"), F.sum(n).alias("attachments"))


@query("agg_term_stats", f"SELECT term, count(DISTINCT chunk_key) AS df, count(*) AS cf FROM (SELECT chunk_key, unnest({tok('lower(coalesce(embed_text, text))')}) AS term FROM email_chunks) GROUP BY 1")
def agg_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document and corpus frequency of every term."""
    c = table(spark, d, "email_chunks", "chunk_key", "embed_text", "text")
    return retrieval.postings(c, "chunk_key", F.coalesce("embed_text", "text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("agg_sender_volume", "SELECT mailbox_id, sender, count(*) AS messages, count(DISTINCT thread_id) AS threads, min(sent_at) AS first_at, max(sent_at) AS last_at FROM email_messages WHERE sender IS NOT NULL GROUP BY 1, 2")
def agg_sender_volume(spark: SparkSession, d: str) -> DataFrame:
    """Activity of every sender."""
    m = table(spark, d, "email_messages", "mailbox_id", "sender", "thread_id", "sent_at").where("sender is not null")
    return m.groupBy("mailbox_id", "sender").agg(F.count("*").alias("messages"), F.count_distinct("thread_id").alias("threads"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))


# --- positional operators -----------------------------------------------------


@query(
    "win_token_windows",
    r"""
    WITH t AS (SELECT page_key, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM attachment_pages),
    s AS (SELECT page_key, ws, unnest(list_filter(range(0, greatest(len(ws), 1), 50), lambda s: len(ws) > 0 AND (s = 0 OR s - 50 + 80 < len(ws)))) AS s FROM t)
    SELECT page_key, (s / 50)::INT AS pos, sha256(array_to_string(ws[s + 1 : s + 80], ' ')) AS window_hash FROM s
    """,
)
def win_token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of 80 tokens, 30 shared, over every page."""
    p = table(spark, d, "attachment_pages", "page_key", "text")
    return p.select("page_key", F.explode(T.token_windows(F.col("text"), 80, 30)).alias("w")).select("page_key", F.col("w.pos").alias("pos"), T.sha256(F.col("w.window")).alias("window_hash"))


@query(
    "win_supersession",
    """
    WITH t AS (SELECT chunk_id, arg_min(text, chunk_key) AS text, arg_min(struct_pack(t := thread_id), chunk_key).t AS thread_id FROM email_chunks GROUP BY 1),
    f AS (SELECT mention_id, mailbox_id, thread_id, canonical_name AS value, created_at, regexp_matches(coalesce(text, ''), '(?i)\\b(replaces|replacing|updated from|instead of|now)\\b') AS cue
          FROM entity_mentions JOIN t USING (chunk_id) WHERE entity_type = 'MONEY')
    SELECT mention_id, value, cue, CASE WHEN cue THEN lag(mention_id) OVER w END AS supersedes, CASE WHEN lead(cue) OVER w THEN lead(mention_id) OVER w END AS superseded_by
    FROM f WINDOW w AS (PARTITION BY mailbox_id, thread_id ORDER BY created_at NULLS FIRST, mention_id)
    """.replace("\\\\", "\\"),
)
def win_supersession(spark: SparkSession, d: str) -> DataFrame:
    """Amount facts of each thread with what they replace."""
    facts = graph.money_facts(
        table(spark, d, "entity_mentions", "mention_id", "mailbox_id", "chunk_id", "entity_type", "canonical_name", "created_at"),
        table(spark, d, "email_chunks", "chunk_key", "chunk_id", "thread_id", "text"),
    )
    return facts.select("mention_id", "value", "cue", "supersedes", "superseded_by")


@query("win_last_turns", "SELECT thread_id, msg_key, (turns - back + 1)::INT AS turn FROM (SELECT thread_id, msg_key, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC NULLS LAST, msg_key DESC) AS back, count(*) OVER (PARTITION BY thread_id) AS turns FROM email_messages WHERE thread_id IS NOT NULL) WHERE back <= 6")
def win_last_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last six turns of every thread with their turn number."""
    w = Window.partitionBy("thread_id")
    m = table(spark, d, "email_messages", "thread_id", "msg_key", "sent_at").where("thread_id is not null")
    back = F.row_number().over(w.orderBy(F.desc_nulls_last("sent_at"), F.desc("msg_key")))
    m = m.withColumn("back", back).withColumn("turns", F.count("*").over(w))
    return m.where("back <= 6").select("thread_id", "msg_key", (F.col("turns") - F.col("back") + 1).cast("int").alias("turn"))


@query(
    "win_ngrams",
    f"""
    WITH q AS (SELECT item_id, {tok("lower(coalesce(question, text))")} AS ts FROM eval_items),
    g AS (SELECT item_id, n, i, array_to_string(ts[i : i + n - 1], ' ') AS gram FROM q, unnest(range(1, 4)) AS a(n), unnest(range(1, 2000)) AS b(i) WHERE i + n - 1 <= len(ts)),
    f AS (SELECT item_id, gram, min(n * 100000 + i) AS ord FROM g GROUP BY 1, 2)
    SELECT item_id, gram, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ord) AS place FROM f) WHERE place <= 16
    """,
)
def win_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """First 16 distinct n-grams (1 to 3 words) of every question."""
    ts = T.tokenize(F.lower(F.coalesce("question", "text")))
    q = table(spark, d, "eval_items", "item_id", "question", "text").select("item_id", ts.alias("ts"))
    grams = F.flatten(
        F.transform(
            F.array(F.lit(1), F.lit(2), F.lit(3)),
            lambda n: F.when(
                F.size("ts") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("ts") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("ts", i, n), " "))
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    return q.select("item_id", F.posexplode(F.slice(F.array_distinct(grams), 1, 16)).alias("place", "gram")).select("item_id", "gram", (F.col("place") + 1).alias("place"))


# --- sets ---------------------------------------------------------------------


@query("set_union_evidence", "SELECT chunk_id FROM entity_mentions WHERE entity_type = 'PROJECT' UNION SELECT chunk_id FROM email_chunks WHERE kind = 'attachment'")
def set_union_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that mention a project or come from an attachment."""
    a = table(spark, d, "entity_mentions", "chunk_id", "entity_type").where("entity_type = 'PROJECT'").select("chunk_id")
    b = table(spark, d, "email_chunks", "chunk_id", "kind").where("kind = 'attachment'").select("chunk_id")
    return a.union(b).distinct()


@query(
    "set_token_overlap",
    f"""SELECT msg_key, len(list_intersect(s, b))::INT AS shared, len(list_distinct(list_concat(s, b)))::INT AS either, len(list_filter(s, lambda x: NOT list_contains(b, x)))::INT AS subject_only
        FROM (SELECT msg_key, list_distinct({tok('lower(subject)')}) AS s, list_distinct({tok('lower(body_text)')}) AS b FROM email_messages)""",
)
def set_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Set sizes between the words of subject and body."""
    words = lambda c: F.array_distinct(T.tokenize(F.lower(c)))
    m = table(spark, d, "email_messages", "msg_key", "subject", "body_text").select("msg_key", words("subject").alias("s"), words("body_text").alias("b"))
    return m.select("msg_key", F.size(F.array_intersect("s", "b")).alias("shared"), F.size(F.array_union("s", "b")).alias("either"), F.size(F.array_except("s", "b")).alias("subject_only"))


@query(
    "set_net_changes",
    """SELECT user_id, k, CASE WHEN arg_max(event_type = 'error', (event_id, (event_type = 'error')::INT)) THEN 'deleted' ELSE 'added' END AS op, count(*) AS events
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('signup', 'purchase', 'error')) GROUP BY 1, 2""",
)
def set_net_changes(spark: SparkSession, d: str) -> DataFrame:
    """Net state of each (user, item) after a history of adds and deletes."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "props").where(F.col("event_type").isin("signup", "purchase", "error"))
    e = e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_type") == "error").alias("gone"))
    return changes.net_changes(e, ["user_id", "k"], ["event_id"], "gone")


# --- changes and tables -------------------------------------------------------


@query("stream_cursor", "SELECT email_address, max(history_id)::VARCHAR AS cursor FROM gmail_notifications WHERE email_address IS NOT NULL GROUP BY 1")
def stream_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Greatest history id of every mailbox, compared as numbers."""
    n = table(spark, d, "gmail_notifications", "email_address", "history_id").where("email_address is not null")
    return changes.cursors(n, "email_address", "history_id").select("email_address", F.col("cursor").cast("string").alias("cursor"))


@query("stream_running_cursor", "SELECT delivery_id, (max(history_id) OVER (PARTITION BY email_address ORDER BY received_at, delivery_id))::VARCHAR AS cursor FROM gmail_notifications WHERE email_address IS NOT NULL")
def stream_running_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Cursor after each notification: late ones never rewind it."""
    n = table(spark, d, "gmail_notifications", "delivery_id", "email_address", "history_id", "received_at").where("email_address is not null")
    return changes.running_max(n, "email_address", "received_at", "delivery_id", "history_id").select("delivery_id", F.col("cursor").cast("string"))


@query("dml_upsert_messages", "SELECT msg_key FROM (SELECT msg_key, row_number() OVER (PARTITION BY tenant_id, mailbox_id, message_id ORDER BY ingested_at DESC NULLS LAST, msg_key DESC) AS n FROM email_messages) WHERE n = 1")
def dml_upsert_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages after last-write-wins by their natural key: even rows stored, odd rows incoming."""
    m = table(spark, d, "email_messages", "msg_key", "tenant_id", "mailbox_id", "message_id", "ingested_at")
    stored, incoming = m.where("msg_key % 2 = 0"), m.where("msg_key % 2 <> 0")
    return changes.upsert(stored, incoming, ["tenant_id", "mailbox_id", "message_id"], ["ingested_at", "msg_key"]).select("msg_key")


@query(
    "dml_delete_stale",
    """
    WITH cur AS (SELECT message_id, chunk_id FROM email_chunks WHERE kind = 'email'),
    s AS (SELECT DISTINCT c.message_id, c.chunk_id FROM email_chunks c WHERE c.message_id IN (SELECT message_id FROM cur) AND NOT EXISTS (SELECT 1 FROM cur u WHERE u.message_id = c.message_id AND u.chunk_id = c.chunk_id))
    SELECT chunk_key FROM email_chunks c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.message_id = c.message_id AND s.chunk_id = c.chunk_id)
    """,
)
def dml_delete_stale(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that survive when messages are reprocessed to their e-mail chunks alone."""
    c = table(spark, d, "email_chunks", "chunk_key", "message_id", "chunk_id", "kind")
    current = c.where("kind = 'email'").select("message_id", "chunk_id")
    return changes.delete_stale(c, current, ["message_id"], "chunk_id").select("chunk_key")


@query("dml_pending_embeddings", "SELECT DISTINCT c.chunk_id FROM email_chunks c WHERE NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.chunk_id = c.chunk_id AND v.embedding IS NOT NULL AND v.embedding_model = 'demo-64') AND c.chunk_id IS NOT NULL")
def dml_pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector of the current model."""
    c = table(spark, d, "email_chunks", "chunk_id").where("chunk_id is not null").distinct()
    v = table(spark, d, "chunk_vectors", "chunk_id", "embedding", "embedding_model").where("embedding is not null and embedding_model = 'demo-64'")
    return changes.pending(c, v, ["chunk_id"])


# --- graph --------------------------------------------------------------------


@query(
    "graph_metadata_relations",
    f"""
    SELECT DISTINCT * FROM (
      SELECT msg_key, 'SENT' AS predicate, sender AS subject, unnest(recipients) AS object FROM email_messages WHERE sender IS NOT NULL
      UNION ALL SELECT msg_key, 'CC', sender, unnest(cc) FROM email_messages WHERE sender IS NOT NULL
      UNION ALL SELECT m.msg_key, 'REPLY_TO', m.sender, p.sender FROM email_messages m JOIN {FIRST_SQL} p ON m.tenant_id = p.tenant_id AND m.mailbox_id = p.mailbox_id AND m.in_reply_to = p.message_id WHERE m.sender IS NOT NULL
    ) WHERE object IS NOT NULL
    """,
)
def graph_metadata_relations(spark: SparkSession, d: str) -> DataFrame:
    """SENT, CC and REPLY_TO relations of every message."""
    return graph.metadata_relations(table(spark, d, "email_messages", "msg_key", "tenant_id", "mailbox_id", "message_id", "in_reply_to", "sender", "recipients", "cc", "ingested_at"))


@query(
    "graph_entities",
    "SELECT tenant_id, mailbox_id, entity_type, normalized_name, arg_min(canonical_name, (created_at IS NULL, created_at, mention_id)) AS canonical_name, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks FROM entity_mentions GROUP BY 1, 2, 3, 4",
)
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their first canonical name."""
    return graph.entities(table(spark, d, "entity_mentions"))


@query(
    "graph_grounded_mentions",
    "WITH t AS (SELECT chunk_id, arg_min(text, chunk_key) AS text FROM email_chunks GROUP BY 1) SELECT mention_id, chunk_id FROM entity_mentions JOIN t USING (chunk_id) WHERE substr(text, chunk_start + 1, chunk_end - chunk_start) = mention_text",
)
def graph_grounded_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions whose span holds in the chunk's text."""
    return graph.grounded_mentions(table(spark, d, "entity_mentions"), table(spark, d, "email_chunks", "chunk_id", "chunk_key", "text")).select("mention_id", "chunk_id")


@query(
    "graph_entity_evidence",
    "SELECT DISTINCT e.mailbox_id, e.normalized_name, e.chunk_id FROM entity_mentions e WHERE EXISTS (SELECT 1 FROM email_chunks c WHERE c.chunk_id = e.chunk_id AND c.mailbox_id = e.mailbox_id) AND e.entity_type IN ('PERSON', 'ORG')",
)
def graph_entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that prove each person and organisation, within the mailbox."""
    e = table(spark, d, "entity_mentions", "mailbox_id", "normalized_name", "chunk_id", "entity_type").where(F.col("entity_type").isin("PERSON", "ORG"))
    c = table(spark, d, "email_chunks", "chunk_id", "mailbox_id")
    return e.join(c, ["chunk_id", "mailbox_id"], "left_semi").select("mailbox_id", "normalized_name", "chunk_id").distinct()


@query(
    "graph_comentions",
    """
    WITH m AS (SELECT DISTINCT mailbox_id, chunk_id, entity_type, normalized_name FROM entity_mentions)
    SELECT a.mailbox_id, a.normalized_name AS project, b.normalized_name AS person, count(*) AS chunks
    FROM m a JOIN m b USING (mailbox_id, chunk_id) WHERE a.entity_type = 'PROJECT' AND b.entity_type = 'PERSON' GROUP BY 1, 2, 3
    """,
)
def graph_comentions(spark: SparkSession, d: str) -> DataFrame:
    """How often each person stands beside each project."""
    m = table(spark, d, "entity_mentions", "mailbox_id", "chunk_id", "entity_type", "normalized_name").distinct()
    a = m.where("entity_type = 'PROJECT'").select("mailbox_id", "chunk_id", F.col("normalized_name").alias("project"))
    b = m.where("entity_type = 'PERSON'").select("mailbox_id", "chunk_id", F.col("normalized_name").alias("person"))
    return a.join(b, ["mailbox_id", "chunk_id"]).groupBy("mailbox_id", "project", "person").agg(F.count("*").alias("chunks"))


# --- documents ----------------------------------------------------------------


@query("doc_paragraph_chunks")
def doc_paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Bodies packed into chunks of whole paragraphs."""
    m = table(spark, d, "email_messages", "msg_key", "body_text")
    return corpus.paragraph_chunks(m.select("msg_key", T.normalize_body(F.col("body_text")).alias("body")), "body").drop("body")


@query(
    "doc_page_chunks",
    r"""
    WITH t AS (SELECT page_key, attachment_id, page_no, text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM attachment_pages),
    s AS (SELECT *, unnest(list_filter(range(0, greatest(len(ws), 1), 200), lambda s: len(ws) > 0 AND (s = 0 OR s - 200 + 250 < len(ws)))) AS s FROM t),
    c AS (SELECT page_key, coalesce(attachment_id, '') || '-page-' || page_no || '-chunk-' || (s // 200) AS chunk_id, (s // 200)::INT AS chunk_index, array_to_string(ws[s + 1 : s + 250], ' ') AS chunk_text, text FROM s)
    SELECT page_key, chunk_id, chunk_index, sha256(chunk_text) AS text_hash, (CASE WHEN strpos(text, chunk_text) > 0 THEN strpos(text, chunk_text) - 1 END)::INT AS source_start FROM c
    """,
)
def doc_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 250 tokens over every attachment page with page-local spans."""
    c = corpus.page_chunks(table(spark, d, "attachment_pages", "page_key", "attachment_id", "page_no", "text"))
    return c.select("page_key", "chunk_id", "chunk_index", T.sha256(F.col("chunk_text")).alias("text_hash"), "source_start")


@query("doc_segments_by_form")
def doc_segments_by_form(spark: SparkSession, d: str) -> DataFrame:
    """Where quotation, disclaimer and signature of every body begin, by form alone."""
    m = table(spark, d, "email_messages", "msg_key", "body_text").select("msg_key", T.normalize_body(F.col("body_text")).alias("body"))
    return corpus.segment_by_rules(m, "body").drop("body")


# --- extensions ---------------------------------------------------------------


@query("ext_event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS hour_start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals by kind (extension)."""
    e = table(spark, d, "events", "event_type", "ts", "value")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "events", "total")


@query(
    "ext_event_sessions",
    """
    WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, value, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts)::TIMESTAMP AS started, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, session
    """,
)
def ext_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with a gap of six hours (extension)."""
    e = table(spark, d, "events", "user_id", "ts", "value")
    return (
        e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
        .agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
        .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "events", "total")
    )


@query(
    "filter_as_of",
    """
    WITH t AS (SELECT chunk_id, arg_min(struct_pack(t := thread_id), chunk_key).t AS thread_id FROM email_chunks GROUP BY 1),
    f AS (SELECT mailbox_id, thread_id, mention_id, canonical_name AS value, row_number() OVER (PARTITION BY mailbox_id, thread_id ORDER BY created_at DESC, mention_id DESC) AS n
          FROM entity_mentions JOIN t USING (chunk_id) WHERE entity_type = 'MONEY' AND created_at IS NOT NULL AND created_at <= TIMESTAMPTZ '2032-06-30 00:00:00+00')
    SELECT mailbox_id, thread_id, mention_id, value FROM f WHERE n = 1
    """,
)
def filter_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last amount known in each thread on a day."""
    texts = table(spark, d, "email_chunks", "chunk_id", "chunk_key", "thread_id").groupBy("chunk_id").agg(F.min_by(F.struct("thread_id"), "chunk_key").alias("c"))
    day = F.lit("2032-06-30T00:00:00Z").cast("timestamp")
    m = table(spark, d, "entity_mentions", "mention_id", "mailbox_id", "chunk_id", "entity_type", "canonical_name", "created_at").where((F.col("entity_type") == "MONEY") & (F.col("created_at") <= day))
    last = m.join(texts, "chunk_id").groupBy("mailbox_id", F.col("c.thread_id").alias("thread_id")).agg(F.max(F.struct("created_at", "mention_id", F.col("canonical_name").alias("value"))).alias("last"))
    return last.select("mailbox_id", "thread_id", "last.mention_id", "last.value")


@query(
    "set_first_seen",
    f"""WITH {BM25_SQL},
    r AS (SELECT query_id, chunk_key, 0 AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS pos FROM ov
          UNION ALL SELECT query_id, chunk_key, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) FROM bm),
    f AS (SELECT query_id, chunk_key, min(route * 1000 + pos) AS seen FROM r WHERE pos <= 5 GROUP BY 1, 2)
    SELECT query_id, chunk_key, (row_number() OVER (PARTITION BY query_id ORDER BY seen))::INT AS place FROM f""",
)
def set_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Ordered union of two routes' lists: first the one, then what the other adds."""
    _, lexical, recall = _hits(spark, d, 5)
    routes = recall.select("query_id", "chunk_key", F.lit(0).alias("route"), "rank").unionByName(lexical.select("query_id", "chunk_key", F.lit(1).alias("route"), "rank"))
    seen = routes.groupBy("query_id", "chunk_key").agg(F.min(F.struct("route", "rank")).alias("seen"))
    return seen.select("query_id", "chunk_key", F.row_number().over(Window.partitionBy("query_id").orderBy("seen")).alias("place"))


@query(
    "agg_support",
    ORACLES["topk_reranked"].replace("SELECT query_id, chunk_key, support, place::INT AS place FROM s WHERE place <= 5", "").replace("AS support, row_number()", "AS support, rerank_norm, row_number()")
    + """ SELECT query_id, max(support) AS top_support, round(max(rerank_norm), 6) AS top_rerank, count(*) FILTER (support >= 0.55) AS supported,
            CASE WHEN count(*) FILTER (support >= 0.55) < 2 THEN 'insufficient_supported_chunks' WHEN max(rerank_norm) < 0.45 THEN 'top_rerank_below_threshold' END AS reason
          FROM s WHERE place <= 5 GROUP BY 1""",
)
def agg_support(spark: SparkSession, d: str) -> DataFrame:
    """Support of every question's evidence and why it would not do."""
    return citations.evidence_reason(_reranked(spark, d).where("place <= 5")).select("query_id", "top_support", F.round("top_rerank", 6).alias("top_rerank"), "supported", "reason")


@query(
    "dml_delete_cascade",
    "SELECT chunk_key FROM email_chunks c WHERE NOT EXISTS (SELECT 1 FROM email_messages m WHERE m.sent_at < TIMESTAMPTZ '2031-07-01 00:00:00+00' AND m.message_id = c.message_id AND m.mailbox_id = c.mailbox_id)",
)
def dml_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left after the messages before a day were deleted with all that depends on them."""
    gone = table(spark, d, "email_messages", "message_id", "mailbox_id", "sent_at").where(F.col("sent_at") < F.lit("2031-07-01T00:00:00Z").cast("timestamp"))
    return table(spark, d, "email_chunks", "chunk_key", "message_id", "mailbox_id").join(gone, ["message_id", "mailbox_id"], "left_anti").select("chunk_key")


@query("doc_hash_vectors")
def doc_hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sparse unit vectors of hashed words of every chunk: 768 buckets."""
    c = retrieval.postings(table(spark, d, "email_chunks", "chunk_key", "embed_text", "text"), "chunk_key", F.coalesce("embed_text", "text"))
    b = c.groupBy("chunk_key", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(768)).cast("int").alias("bucket")).agg(F.sum("tf").alias("n"))
    return b.withColumn("weight", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("chunk_key"))), 6)).drop("n")


@query("qa_plan")
def qa_plan(spark: SparkSession, d: str) -> DataFrame:
    """Routes, entity terms, subject terms and as-of day of every question."""
    q = table(spark, d, "eval_items", "item_id", "question", "text").select(F.col("item_id").alias("query_id"), F.coalesce("question", "text").alias("query_text"))
    return answering.plan_questions(q).drop("query_text")
