"""From messages and attachments to citable chunks: segment texts, chunk ids, selection, and the tables behind search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import alnum_density, count_tokens, embed_text, normalize_body, sanitize_id, token_windows
from threadloom.operators import corpus
from threadloom.operators.changes import delete_stale, upsert

CHUNK = (
    "chunk_id string, doc_id string, thread_id string, message_id string, tenant_id string, mailbox_id string, kind string, attachment_name string, page_no int, sender string, "
    "sent_at timestamp, subject string, text string, embed_text string, source_start int, source_end int, ocr_used boolean, token_count int, source_path string, source_type string"
)
CHUNK_COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
#: letters and digits, and their density, under which a page is recognised anew
LEAST_ALNUM, LEAST_DENSITY = 20, 0.05


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON-lines file or folder; blank lines are skipped, a missing path gives an empty frame."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CHUNK)
    return spark.read.schema(CHUNK).json(path).where("chunk_id is not null")


def segment_texts(messages: DataFrame, body: str = "body_text") -> DataFrame:
    """Messages with authored_text, quoted_text, signature_text, disclaimer_text, authored_start and authored_end.

    Offsets are of the normalised body. Where signature and notice took everything and
    nothing was quoted, the whole body is authored.
    """
    clean = messages.withColumn("_body", normalize_body(F.col(body)))
    cut = corpus.segment_by_rules(clean, "_body")
    lines = F.split("_body", "\n")
    n = F.size(lines)

    def part(a: Column, e: Column) -> Column:
        text = F.array_join(F.slice(lines, a + 1, F.greatest(e - a, F.lit(0))), "\n")
        return F.regexp_replace(text, r"^\s+|\s+$", "")

    or_else = lambda c, e: F.when(F.col(c) >= 0, F.col(c)).otherwise(e)
    quote, notice = or_else("quote_at", n), or_else("disclaimer_at", or_else("quote_at", n))
    sign = or_else("signature_at", notice)
    authored = part(F.lit(0), sign)
    restored = (authored == "") & (F.col("_body") != "") & (F.col("quote_at") < 0)
    start = F.greatest(F.call_function("instr", F.col("_body"), F.col("authored_text")) - 1, F.lit(0))
    return (
        cut.withColumn("authored_text", F.when(restored, F.col("_body")).otherwise(authored))
        .withColumn("quoted_text", F.when(F.col("quote_at") >= 0, part(quote, n)).otherwise(""))
        .withColumn("signature_text", F.when(restored | (F.col("signature_at") < 0), "").otherwise(part(sign, notice)))
        .withColumn("disclaimer_text", F.when(restored | (F.col("disclaimer_at") < 0), "").otherwise(part(notice, quote)))
        .withColumn("authored_start", F.when(F.col("authored_text") == "", 0).otherwise(start))
        .withColumn("authored_end", F.col("authored_start") + F.length("authored_text"))
        .drop("_body", "quote_at", "disclaimer_at", "signature_at")
    )


def email_chunks(messages: DataFrame, limit: int = 450, overlap: int = 50) -> DataFrame:
    """Chunks of the authored text of every message, with ids ``<doc_id>-email-<n>``."""
    m = segment_texts(messages)
    cut = corpus.paragraph_chunks(m, "authored_text", limit, overlap)
    c = F.col
    indexed = embed_text(c("sender"), c("recipients"), c("cc"), c("sent_at"), c("subject"), c("thread_id"), c("in_reply_to"), c("chunk_text"))
    return cut.where("trim(chunk_text) <> ''").select(
        F.concat(F.col("doc_id"), F.lit("-email-"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "thread_id", "message_id", "tenant_id", "mailbox_id",
        F.lit("email").alias("kind"), F.lit(None).cast("string").alias("attachment_name"), F.lit(None).cast("int").alias("page_no"), "sender", "sent_at", "subject",
        F.col("chunk_text").alias("text"), indexed.alias("embed_text"), F.col("chunk_start").alias("source_start"), F.col("chunk_end").alias("source_end"),
        F.lit(False).alias("ocr_used"), count_tokens(F.col("chunk_text")).alias("token_count"), "source_path", "source_type",
    )


def attachment_chunks(pages: DataFrame, messages: DataFrame, size: int = 250, overlap: int = 50) -> DataFrame:
    """Chunks of attachment pages with the fields of their message, ids ``<attachment_id>-page-<p>-chunk-<n>``.

    The message's resolved thread wins over the attachment's own. Offsets are local to the
    page, null where white space made a window unlike it.
    """
    parent = messages.groupBy("message_id").agg(F.min_by(F.struct("tenant_id", "mailbox_id", "thread_id", "sender", "sent_at", "subject", "source_type"), "msg_key").alias("m"))
    joined = pages.join(parent, "message_id", "left").withColumn("w", F.explode(token_windows(F.col("text"), size, overlap)))
    at = F.call_function("instr", F.col("text"), F.col("w.window"))
    header = F.concat(F.lit("Attachment: "), F.coalesce("filename", F.lit("")), F.lit("\nPage: "), F.coalesce(F.col("page_no").cast("string"), F.lit("")))
    return joined.where("trim(w.window) <> ''").select(
        F.concat(F.coalesce("attachment_id", F.lit("")), F.lit("-page-"), F.coalesce(F.col("page_no").cast("string"), F.lit("")), F.lit("-chunk-"), F.col("w.pos").cast("string")).alias("chunk_id"),
        F.col("attachment_id").alias("doc_id"), F.coalesce("m.thread_id", "thread_id").alias("thread_id"), "message_id", "m.tenant_id", "m.mailbox_id", F.lit("attachment").alias("kind"),
        F.col("filename").alias("attachment_name"), "page_no", "m.sender", "m.sent_at", "m.subject", F.col("w.window").alias("text"),
        F.concat(header, F.lit("\n\n"), F.col("w.window")).alias("embed_text"), F.when(at > 0, at - 1).cast("int").alias("source_start"),
        F.when(at > 0, at - 1 + F.length("w.window")).cast("int").alias("source_end"), F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"), count_tokens(F.col("w.window")).alias("token_count"),
        F.lit(None).cast("string").alias("source_path"), "m.source_type",
    )


def threaded(messages: DataFrame) -> DataFrame:
    """Messages with the thread of their headers, else of the latest message of their subject that
    shares a participant within seven days, else their own."""
    by_header = corpus.header_threads(messages)
    joined = messages.join(by_header, "msg_key")
    lonely = joined.where(F.col("resolved_thread").eqNullSafe(F.col("thread_id")))
    near = corpus.subject_candidates(messages).join(by_header.select(F.col("msg_key").alias("candidate"), F.col("resolved_thread").alias("near_thread")), "candidate")
    found = lonely.select("msg_key").join(near, "msg_key").select("msg_key", "near_thread")
    return joined.join(found, "msg_key", "left").withColumn("thread_id", F.coalesce("near_thread", "resolved_thread")).drop("resolved_thread", "near_thread")


def corpus_chunks(messages: DataFrame, pages: DataFrame) -> DataFrame:
    """All chunks of a corpus: threads resolved, e-mails segmented and cut, then their attachments."""
    resolved = threaded(messages)
    return email_chunks(resolved).select(*CHUNK_COLUMNS).unionByName(attachment_chunks(pages, resolved).select(*CHUNK_COLUMNS))


def corpus_stats(messages: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: threads, messages, attachments, chunks, characters indexed, pages recognised."""
    one = F.lit(1).alias("k")
    parts = (
        messages.agg(F.count_distinct("thread_id").alias("threads"), F.count("*").alias("messages")),
        pages.agg(F.count_distinct("attachment_id").alias("attachments"), F.count_if("ocr_used").alias("recognised_pages")),
        chunks.agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters")),
    )
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(p.select("*", one), "k")
    return out.drop("k")


def ingest(messages: DataFrame, pages: DataFrame, path: str) -> DataFrame:
    """Writes chunks (JSON lines) and statistics of a corpus below ``path``; gives the chunks as written."""
    spark = messages.sparkSession
    corpus_chunks(messages, pages).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/chunks")
    chunks = read_chunks(spark, f"{path}/chunks")
    corpus_stats(messages, pages, chunks).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/stats")
    return chunks


# --- the chunk table ---

IDENTITY = ["tenant_id", "mailbox_id", "chunk_id"]


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The chunk table after new chunks: theirs replace those of the same id; the embedding of a
    chunk stays where its indexing text did. stored may hold embedding and embedding_model."""
    kept = [c for c in ("embedding", "embedding_model") if c in stored.columns and c not in incoming.columns]
    old = stored.select(*IDENTITY, F.col("embed_text").alias("_was"), *kept)
    fresh = incoming.join(old, IDENTITY, "left")
    same = F.col("embed_text").eqNullSafe(F.col("_was"))
    fresh = fresh.select(*[c for c in incoming.columns], *[F.when(same, F.col(c)).alias(c) for c in kept])
    return stored.join(incoming.select(*IDENTITY).distinct(), IDENTITY, "left_anti").unionByName(fresh, allowMissingColumns=True)


def reprocess_messages(stored_messages: DataFrame, stored_chunks: DataFrame, messages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, chunks) after some messages were processed anew: both written over, and body
    chunks a message no longer has deleted. Its attachment chunks are left alone."""
    scope = ["tenant_id", "mailbox_id", "message_id"]
    body, rest = stored_chunks.where("kind = 'email'"), stored_chunks.where("kind <> 'email'")
    touched = messages.select(*scope).distinct()
    # a message that has no chunk any more loses those it had
    gone = body.join(touched, scope, "left_semi").join(chunks.select(*IDENTITY), IDENTITY, "left_anti")
    body = body.join(gone.select(*IDENTITY), IDENTITY, "left_anti")
    return upsert(stored_messages, messages, scope, ["ingested_at", "msg_key"]), upsert_chunks(body, chunks).unionByName(rest, allowMissingColumns=True)


def replace_attachment_chunks(stored: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunk table after some attachments (message_id, doc_id) were extracted anew: exactly their chunks are replaced."""
    key = ["message_id", "doc_id"]
    theirs = stored.where("kind = 'attachment'").join(documents.select(*key).distinct(), key, "left_semi").select(*IDENTITY)
    return upsert_chunks(stored.join(theirs, IDENTITY, "left_anti"), chunks)


def drop_stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored chunks without those their reprocessed message no longer has."""
    return delete_stale(stored, current, ["tenant_id", "mailbox_id", "message_id"], "chunk_id")


def canonical_chunks(rows: DataFrame, now: Column) -> DataFrame:
    """Chunks as search gives them back, with defaults for what is missing: document from the
    message id, source manual, tokens by white space, the message as thread, now as date."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    given = {
        "doc_id": F.coalesce("doc_id", F.regexp_replace("message_id", r"^[<>]+|[<>]+$", "")),
        "source_type": F.coalesce("source_type", F.lit("manual")),
        "token_count": F.coalesce("token_count", words),
        "thread_id": F.coalesce("thread_id", "message_id"),
        "sent_at": F.coalesce("sent_at", now),
    }
    return rows.select(*[given[c].alias(c) if c in given else F.col(c) for c in rows.columns])


def evidence_texts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, chunk_id, text) of wanted chunks (scope, chunk_id), one row each."""
    return chunks.join(wanted.select(*IDENTITY).distinct(), IDENTITY, "left_semi").groupBy(*IDENTITY).agg(F.min_by("text", "chunk_key").alias("text"))


def check_schema(df: DataFrame, schema: str) -> DataFrame:
    """The table, if it has every column of the schema with its type; else raises at once."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [c for c in schema.split(", ") if have.get(c.split()[0]) != c.split()[1]]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df


def page_needs_recognition(text: Column, area: Column) -> Column:
    """Whether the text layer of a page is too thin to use."""
    alnum = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]"))
    return (alnum < LEAST_ALNUM) | (alnum_density(text, area) < LEAST_DENSITY)


# --- selection of a slice ---


def select_messages(
    messages: DataFrame, max_threads: int = 20, per_thread: int = 10, attachment_threads: int = 12, attachment_messages: int = 1, prefer_attachments: bool = True,
    message_ids: list[str] | None = None, thread_ids: list[str] | None = None,
) -> DataFrame:
    """(messages, thread_place, place): a slice by threads, those with attachments first.

    messages: msg_key, message_id, thread_id, sent_at, attachment_ids. Explicit message ids
    take just these; explicit threads replace the choice. Threads with attachments come by
    fewest attachments a bearing message, fewest in all, most messages, id; the others by most
    messages, id, and free places go back to the first kind. Of a thread, up to
    ``attachment_messages`` bearing messages come first, then others by time. Order by time.
    """
    if message_ids:
        return messages.where(F.col("message_id").isin(message_ids)).select("*", F.lit(1).alias("thread_place"), F.lit(1).alias("place"))
    n = F.size(F.coalesce("attachment_ids", F.array().cast("array<string>")))
    rows = messages.where("thread_id is not null").withColumn("_n", n)
    threads = rows.groupBy("thread_id").agg(F.count("*").alias("size"), F.sum("_n").alias("total"), F.min(F.when(F.col("_n") > 0, F.col("_n"))).alias("least"))
    everywhere = lambda *by: F.row_number().over(Window.orderBy(*by))  # noqa: E731  a row a thread
    if thread_ids:
        chosen = threads.where(F.col("thread_id").isin(thread_ids)).withColumn("thread_place", everywhere("thread_id"))
    elif prefer_attachments:
        bearing = threads.where("least is not null").orderBy("least", "total", F.desc("size"), "thread_id").limit(max_threads)
        bearing = bearing.withColumn("pos", everywhere("least", "total", F.desc("size"), "thread_id"))
        plain = threads.where("least is null").orderBy(F.desc("size"), "thread_id").limit(max_threads).withColumn("pos", everywhere(F.desc("size"), "thread_id"))
        group = F.when(F.col("least").isNotNull() & (F.col("pos") <= attachment_threads), 0).when(F.col("least").isNull(), 1).otherwise(2)
        ranked = bearing.unionByName(plain).withColumn("_g", group).withColumn("taken", everywhere("_g", "pos")).where(F.col("taken") <= max_threads)
        chosen = ranked.withColumn("thread_place", everywhere(F.col("least").isNull(), "pos"))
    else:
        chosen = threads.withColumn("thread_place", everywhere("thread_id"))
    rows = rows.join(chosen.where(F.col("thread_place") <= max_threads).select("thread_id", "thread_place", F.col("least").isNotNull().alias("_files")), "thread_id")
    time = [F.col("sent_at").asc_nulls_first(), "message_id"]
    nth = F.row_number().over(Window.partitionBy("thread_id", F.col("_n") > 0).orderBy(*time))
    first = F.when(~F.col("_files") | F.lit(not prefer_attachments), 1).when((F.col("_n") > 0) & (F.col("nth") <= attachment_messages), 0).when(F.col("_n") == 0, 1).otherwise(2)
    kept = rows.withColumn("nth", nth).withColumn("_first", first)
    kept = kept.withColumn("_pick", F.row_number().over(Window.partitionBy("thread_id").orderBy("_first", *time))).where(F.col("_pick") <= per_thread)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy(*time))).drop("_n", "nth", "_first", "_pick", "_files")


def slice_manifest(selected: DataFrame) -> DataFrame:
    """(thread_id, messages, attachments, message_ids) of a selection, threads in their order."""
    files = F.size(F.coalesce("attachment_ids", F.array().cast("array<string>")))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "message_id"))), lambda x: x["message_id"])
    return selected.groupBy("thread_id", "thread_place").agg(F.count("*").alias("messages"), F.sum(files).alias("attachments"), ids.alias("message_ids")).orderBy("thread_place").drop("thread_place")


def write_selected(selected: DataFrame, path: str) -> None:
    """One JSON file a message, below a folder of its safe id."""
    named = selected.withColumn("file", sanitize_id(F.col("message_id")))
    named.repartition("file").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("file").json(path)


def mailbox_file_order(path: Column) -> Column:
    """Order of mailbox files: the index, the whole mailbox, then its parts by number."""
    name = F.element_at(F.split(path, "/"), -1)
    part = F.regexp_extract(name, r"^mailbox_part_(\d+)", 1)
    return F.struct(F.when(name == "index.json", 0).when(name == "mailbox.json", 1).when(part != "", 2).otherwise(3).alias("kind"), F.coalesce(part.try_cast("int"), F.lit(0)).alias("part"), name.alias("name"))
