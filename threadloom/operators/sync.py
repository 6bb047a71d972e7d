"""Mailbox synchronisation as table transitions: notifications, jobs, history and cursors.

Each operator takes the tables as they are and gives them as they will be; the caller
writes them (``runtime.materialize``, a versioned folder, or ``foreachBatch``). Spark's
scheduler stands in for workers, so leases are a pure transition here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

from threadloom.functions.text import base64url
from threadloom.operators.changes import net_changes

MAILBOX = "mailbox_key bigint, tenant_id string, mailbox_id string, email_address string, status string, last_history_id decimal(20,0), error string, watch_expires_at timestamp"
JOB = "job_id bigint, mailbox_key bigint, requested_history_id decimal(20,0), status string, attempts int, needs_full_sync boolean, leased_until timestamp, last_error string, created_at timestamp"
#: statuses of a mailbox that still takes mail
LIVE = ("pending", "active", "needs_full_sync", "error")


def reject_reason(body: Column) -> Column:
    """Why a push body is refused; null if it names an address, a history id and a message."""
    whole = F.try_parse_json(body)
    ident = F.coalesce(F.get_json_object(body, "$.message.messageId"), F.get_json_object(body, "$.message.message_id"))
    data = F.get_json_object(body, "$.message.data")
    inner = base64url(data)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(blank(body), "no_body")
        .when(whole.isNull(), "not_json")
        .when(blank(ident), "no_message_id")
        .when(blank(data), "no_data")
        .when(inner.isNull(), "not_base64")
        .when(F.try_parse_json(inner).isNull(), "data_not_json")
        .when(blank(F.get_json_object(inner, "$.emailAddress")), "no_address")
        .when(F.get_json_object(inner, "$.historyId").try_cast("decimal(20,0)").isNull(), "no_history_id")
    )


def live_notifications(notifications: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Notifications of addresses that have a live mailbox, with its key, scope and status."""
    live = mailboxes.where(F.col("status").isin(*LIVE)).select("mailbox_key", "tenant_id", "mailbox_id", F.col("status").alias("mailbox_status"), F.lower("email_address").alias("email_address"))
    return notifications.withColumn("email_address", F.lower("email_address")).join(live, "email_address")


def coalesced_jobs(jobs: DataFrame, notifications: DataFrame, now: Column) -> DataFrame:
    """Jobs after a batch of live, accepted notifications: one pending job a mailbox, whose
    requested history id is the greatest, compared as numbers. Running and ended jobs stay.

    A new job takes the next id after all there are, in order of mailbox.
    """
    wanted = notifications.groupBy("mailbox_key").agg(F.max("history_id").cast("decimal(20,0)").alias("wanted"), F.bool_or(F.col("mailbox_status") == "needs_full_sync").alias("full"))
    pending = jobs.where("status = 'pending'").select("mailbox_key", F.lit(True).alias("has"))
    raised = jobs.join(wanted, "mailbox_key", "left").withColumn(
        "requested_history_id", F.when(F.col("status") == "pending", F.greatest("requested_history_id", "wanted")).otherwise(F.col("requested_history_id"))
    )
    last = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("last"))
    fresh = wanted.join(pending, "mailbox_key", "left_anti").join(F.broadcast(last)).select(
        (F.col("last") + F.row_number().over(Window.orderBy("mailbox_key"))).alias("job_id"), "mailbox_key", F.col("wanted").alias("requested_history_id"), F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), F.col("full").alias("needs_full_sync"), F.lit(None).cast("timestamp").alias("leased_until"), F.lit(None).cast("string").alias("last_error"), now.alias("created_at"),
    )
    return raised.select(*jobs.columns).unionByName(fresh.select(*jobs.columns))


def claimed(jobs: DataFrame, now: Column, limit: int = 1, lease_seconds: int = 300) -> DataFrame:
    """Jobs after the ``limit`` oldest free ones were leased: pending ones, and running ones whose lease ran out."""
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("leased_until") <= now))
    taken = jobs.where(free).orderBy("job_id").limit(limit).select("job_id", F.lit(True).alias("taken"))
    mine = F.coalesce("taken", F.lit(False))
    return jobs.join(F.broadcast(taken), "job_id", "left").select(
        *[
            F.when(mine, {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "leased_until": now + F.make_dt_interval(secs=F.lit(float(lease_seconds)))}[c]).otherwise(F.col(c)).alias(c)
            if c in ("status", "attempts", "leased_until")
            else F.col(c)
            for c in jobs.columns
        ]
    )


def failed(jobs: DataFrame, failures: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Jobs after some failed. failures: job_id, error.

    A job goes back to pending until it has had ``max_attempts``. Where a newer pending job
    of the mailbox exists, it fails at once and folds its history id and its need of a full
    sync into that one, as only one job a mailbox may be pending.
    """
    bad = jobs.join(failures, "job_id")
    pending = jobs.join(failures, "job_id", "left_anti").where("status = 'pending'").select("mailbox_key", F.col("job_id").alias("successor"))
    ended = bad.join(pending, "mailbox_key", "left").withColumn("out", (F.col("attempts") >= max_attempts) | F.col("successor").isNotNull())
    # of several failed jobs of one mailbox without a successor the oldest becomes pending again
    first = Window.partitionBy("mailbox_key", "out").orderBy("job_id")
    ended = ended.withColumn("out", F.col("out") | (F.row_number().over(first) > 1))
    folded = ended.where("successor is not null").groupBy(F.col("successor").alias("job_id")).agg(F.max("requested_history_id").alias("more"), F.bool_or("needs_full_sync").alias("full"))
    changed = ended.select("job_id", F.when(F.col("out"), "failed").otherwise("pending").alias("_status"), F.col("error").alias("_error"))
    both = jobs.join(changed, "job_id", "left").join(folded, "job_id", "left")
    hit = F.col("_status").isNotNull()
    new = {
        "status": F.coalesce("_status", "status"),
        "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")),
        "leased_until": F.when(~hit, F.col("leased_until")),
        "requested_history_id": F.greatest("requested_history_id", "more"),
        "needs_full_sync": F.col("needs_full_sync") | F.coalesce("full", F.lit(False)),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def completed(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs after those in ``done`` (job_id) ended well."""
    hit = F.coalesce("_done", F.lit(False))
    new = {"status": F.when(hit, "done").otherwise(F.col("status")), "last_error": F.when(~hit, F.col("last_error")), "leased_until": F.when(~hit, F.col("leased_until"))}
    return jobs.join(done.select("job_id", F.lit(True).alias("_done")).distinct(), "job_id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest jobs first; ids break ties."""
    return jobs.orderBy(F.desc_nulls_last("created_at"), F.desc("job_id")).limit(limit)


def sync_route(job_full: Column, status: Column, cursor: Column, expired: Column) -> Column:
    """full or delta: full where it was asked for, the mailbox needs it, nothing was committed, or the history ran out."""
    return F.when(F.coalesce(job_full, F.lit(False)) | (status == "needs_full_sync") | cursor.isNull() | F.coalesce(expired, F.lit(False)), "full").otherwise("delta")


def history_window(history: DataFrame, cursors: DataFrame) -> DataFrame:
    """History records of each mailbox after its cursor. history: mailbox_key, history_id, pos, message_id, deleted."""
    return history.join(cursors.select("mailbox_key", F.col("cursor").alias("_from")), "mailbox_key").where(F.col("history_id") > F.coalesce("_from", F.lit(0))).drop("_from")


def apply_history(stored: DataFrame, history: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored messages after a window of history: the last event of a message decides.

    fetched: the added messages as the provider has them now; one that has vanished before
    it could be fetched is no error. Replays change nothing. stored and fetched share columns.
    """
    net = net_changes(history, ["mailbox_key", "message_id"], ["history_id", "pos"], "deleted")
    key = ["mailbox_key", "message_id"]
    added = fetched.join(net.where("op = 'added'").select(*key), key, "left_semi").dropDuplicates(key)
    gone = net.where("op = 'deleted'").select(*key).unionByName(added.select(*key))
    return stored.join(gone.distinct(), key, "left_anti").unionByName(added)


def full_sync(scan: DataFrame, history: DataFrame, checkpoints: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, cursors) after a full scan and the replay of what happened since it began.

    checkpoints: mailbox_key, cursor, taken before the scan, so that nothing that arrived or
    went while it ran is lost.
    """
    since = history_window(history, checkpoints)
    messages = apply_history(scan, since, fetched)
    seen = since.groupBy("mailbox_key").agg(F.max("history_id").cast("decimal(20,0)").alias("seen"))
    cursors = checkpoints.join(seen, "mailbox_key", "left").select("mailbox_key", F.greatest(F.col("cursor").cast("decimal(20,0)"), "seen").alias("cursor"))
    return messages, cursors


def committed(mailboxes: DataFrame, cursors: DataFrame) -> DataFrame:
    """Mailboxes after a run: cursors move forward only, and the mailbox is active."""
    seen = cursors.groupBy("mailbox_key").agg(F.max("cursor").cast("decimal(20,0)").alias("_new"))
    both = mailboxes.join(seen, "mailbox_key", "left")
    ran = F.col("_new").isNotNull()
    new = {"last_history_id": F.greatest("last_history_id", "_new"), "status": F.when(ran, "active").otherwise(F.col("status")), "error": F.when(~ran, F.col("error"))}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in mailboxes.columns])


def seeded(mailboxes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mailboxes whose cursor is set from the provider's profile once; one that has a cursor keeps it."""
    first = profiles.groupBy("mailbox_key").agg(F.min_by("history_id", F.struct("received_at", "history_id")).cast("decimal(20,0)").alias("_seed"))
    both = mailboxes.join(first, "mailbox_key", "left")
    return both.select(*[F.coalesce("last_history_id", "_seed").alias(c) if c == "last_history_id" else F.col(c) for c in mailboxes.columns])


def upserted_mailboxes(mailboxes: DataFrame, events: DataFrame) -> DataFrame:
    """Mailboxes after events (mailbox columns, at, event: connect, expire, fail, disconnect), the last of each key.

    Connecting makes a new mailbox pending and an old one active again with its cursor; an
    expired history asks for a full sync, a failure keeps its error, disconnecting ends it.
    """
    last = events.groupBy("mailbox_key").agg(F.max_by(F.struct("event", "tenant_id", "mailbox_id", "email_address", "error"), F.struct("at", "event")).alias("e"))
    both = mailboxes.join(last, "mailbox_key", "full")
    known = F.col("status").isNotNull()
    event = F.col("e.event")
    status = (
        F.when(event.isNull(), F.col("status")).when((event == "connect") & known, "active").when(event == "connect", "pending").when(event == "expire", "needs_full_sync").when(event == "fail", "error").otherwise("disconnected")
    )
    new = {
        "status": status,
        "error": F.when(event.isNull(), F.col("error")).when(event.isin("fail", "expire"), F.col("e.error")),
        **{c: F.when(event == "connect", F.col(f"e.{c}")).otherwise(F.coalesce(mailboxes[c], F.col(f"e.{c}"))) for c in ("tenant_id", "mailbox_id", "email_address")},
    }
    return both.where(known | (event == "connect")).select(*[new[c].alias(c) if c in new else (F.col(c) if c == "mailbox_key" else mailboxes[c]) for c in mailboxes.columns])


def shared_addresses(mailboxes: DataFrame) -> DataFrame:
    """Addresses that more than one live mailbox claims; expected to be none."""
    live = mailboxes.where(F.col("status").isin(*LIVE)).groupBy(F.lower("email_address").alias("email_address")).agg(F.count("*").alias("mailboxes"))
    return live.where("mailboxes > 1")


def due_watches(mailboxes: DataFrame, until: Column) -> DataFrame:
    """Live mailboxes whose watch ends by a time, the first to end first."""
    return mailboxes.where(F.col("status").isin("active", "needs_full_sync") & F.col("watch_expires_at").isNotNull() & (F.col("watch_expires_at") <= until)).orderBy("watch_expires_at", "mailbox_key")


def enqueued(jobs: DataFrame, chunks: DataFrame, kind: str, enabled: bool = True) -> DataFrame:
    """New enrichment jobs (chunk_id, input_hash, kind, status) for chunks no job of that kind covers with this hash."""
    wanted = chunks.select("chunk_id", "input_hash", F.lit(kind).alias("kind"), F.lit("pending").alias("status")).distinct()
    return wanted.where(F.lit(enabled)).join(jobs.where(F.col("kind") == kind).select("chunk_id", "input_hash"), ["chunk_id", "input_hash"], "left_anti")


def retired(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Open jobs whose chunk is gone or has another hash now become superseded."""
    now = chunks.select("chunk_id", "input_hash", F.lit(True).alias("_current")).distinct()
    stale = F.col("status").isin("pending", "running") & F.col("_current").isNull()
    return jobs.join(now, ["chunk_id", "input_hash"], "left").select(*[F.when(stale, "superseded").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in jobs.columns])


# --- a history log as a data source ---


class _Page(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _records(path: str, start: int, end: int):
    """Rows of a Parquet history log with start < history_id <= end, in order."""
    import pyarrow.dataset as ds

    rows = ds.dataset(path, format="parquet").to_table(filter=(ds.field("history_id") > start) & (ds.field("history_id") <= end)).sort_by([("history_id", "ascending"), ("pos", "ascending")])
    for r in rows.to_pylist():
        yield (r["mailbox_key"], r["history_id"], r["pos"], r["message_id"], r["deleted"])


def _newest(path: str) -> int:
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    ids = ds.dataset(path, format="parquet").to_table(columns=["history_id"])["history_id"]
    return pc.max(ids).as_py() or 0


class HistoryLog(DataSource):
    """``history_log``: a paged mailbox history, read from a start id on; offsets of a stream are history ids.

    Options: path; start (0): the id after which to read; oldest (0): ids that were
    dropped, from which on a start raises HistoryExpired; page (1000): ids a page.
    """

    @classmethod
    def name(cls) -> str:
        return "history_log"

    def schema(self) -> str:
        return "mailbox_key bigint, history_id bigint, pos int, message_id string, deleted boolean"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _LogStream(self.options)


class HistoryExpired(ValueError):
    """The start lies before the oldest record: only a full sync helps."""


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.oldest, self.page = int(options.get("oldest", 0)), int(options.get("page", 1000))

    def partitions(self):
        if self.start < self.oldest:
            raise HistoryExpired(f"history before {self.oldest} is gone")
        end = _newest(self.path)
        return [_Page(at, min(at + self.page, end)) for at in range(self.start, end, self.page)] or [_Page(self.start, self.start)]

    def read(self, partition):
        return _records(self.path, partition.start, partition.end)


class _LogStream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.start, self.page = options["path"], int(options.get("start", 0)), int(options.get("page", 1000))

    def initialOffset(self):  # noqa: N802
        return {"history_id": self.start}

    def read(self, start):
        end = min(max(_newest(self.path), start["history_id"]), start["history_id"] + self.page)
        return iter(list(_records(self.path, start["history_id"], end))), {"history_id": end}  # the source copies it

    def readBetweenOffsets(self, start, end):  # noqa: N802
        return _records(self.path, start["history_id"], end["history_id"])


def history_log(spark: SparkSession, path: str, start: int = 0, oldest: int = 0, page: int = 1000) -> DataFrame:
    """Records of a history log after ``start``."""
    spark.dataSource.register(HistoryLog)
    return spark.read.format("history_log").option("path", path).option("start", start).option("oldest", oldest).option("page", page).load()
