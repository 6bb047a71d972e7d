"""Readers of raw mail and attachments: MIME files, mailbox JSON, provider message JSON, documents.

Files come in as binaryFile rows; parsing uses the standard library over Arrow
batches, a file at a time. A file that can't be parsed gives a row with ``error``.
"""

from __future__ import annotations

import datetime as dt
import email
import hashlib
import html
import io
import json
import re
import zipfile
from collections import deque
from collections.abc import Callable, Iterator
from email import policy
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from threadloom.functions.text import normalize_subject, parse_when, sanitize_id, url_path

ATTACHMENTS = "array<struct<attachment_id: string, filename: string, media_type: string, byte_size: bigint, status: string, text: string>>"
MESSAGE = (
    "source_path string, doc_id string, message_id string, thread_id string, sent_at timestamp, sender string, recipients array<string>, cc array<string>, "
    f"subject string, body_text string, in_reply_to string, reference_ids array<string>, attachments {ATTACHMENTS}, source_type string, error string"
)
MESSAGE_COLUMNS = ["source_path", "doc_id", "message_id", "thread_id", "sent_at", "sender", "recipients", "cc", "subject", "body_text", "in_reply_to", "reference_ids", "attachments", "source_type", "error"]


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """(path, document): whole JSON files, parsed as variants; a file that is no JSON gives null."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("document"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of files below a folder; the listing and the reads are distributed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(markup: str) -> str:
    """Visible text of HTML, a line for each stripped string."""
    p = _Text()
    p.feed(markup)
    p.close()
    return "\n".join(p.parts)


def _utc(value: str | None):
    try:
        at = parsedate_to_datetime(value) if value else None
    except (TypeError, ValueError):
        return None
    if at is None:
        return None
    return at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at.astimezone(dt.timezone.utc)


def _people(values) -> list[str]:
    return [address for _, address in getaddresses([str(v) for v in values]) if address]


def parse_mime(path: str, content: bytes, thread_id: str | None = None) -> dict:
    """A message from MIME bytes: its plain parts joined, else its own payload.

    The thread is the given one, else the normalised subject, else the id. Attachments are
    parsed by their kind and stand in ``attachments``. A missing id is made from the content.
    """
    m = email.message_from_bytes(content, policy=policy.default)
    plain, files = [], []
    ident = str(m.get("Message-ID") or f"<generated-{hashlib.sha256(content).hexdigest()[:32]}>")
    doc = ident.strip("<>")

    def text_of(part) -> str:
        return (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "ignore")

    for n, part in enumerate(m.walk(), 1):
        if part.get_content_disposition() == "attachment":
            raw, name = part.get_payload(decode=True) or b"", part.get_filename() or f"attachment-{n}"
            status, text = attachment_text(name, raw, part.get_content_type())
            files.append({"attachment_id": f"{doc}-att-{n}", "filename": name, "media_type": part.get_content_type(), "byte_size": len(raw), "status": status, "text": text})
        elif m.is_multipart() and part.get_content_type() == "text/plain":
            plain.append(text_of(part))
    subject = str(m.get("Subject", "")).strip()
    return {
        "source_path": path,
        "doc_id": doc,
        "message_id": ident,
        "thread_id": thread_id or _topic(subject) or doc,
        "sent_at": _utc(str(m.get("Date"))) if m.get("Date") else None,
        "sender": str(m.get("From") or "").strip(),
        "recipients": _people(m.get_all("To", [])),
        "cc": _people(m.get_all("Cc", [])),
        "subject": subject,
        "body_text": ("\n".join(plain) if plain else "" if m.is_multipart() else text_of(m)).strip(),
        "in_reply_to": str(m["In-Reply-To"]) if m.get("In-Reply-To") else None,
        "reference_ids": [r for h in m.get_all("References", []) for r in str(h).split()],
        "attachments": files,
        "source_type": "eml",
        "error": None,
    }


def _topic(subject: str) -> str:
    bare = re.sub(r"^\s*((re|fw|fwd)\s*:\s*)+", "", subject, flags=re.I)
    return re.sub(r"\s+", " ", bare.strip().lower())


def read_mime(files: DataFrame) -> DataFrame:
    """Messages of MIME files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out.append(parse_mime(path, bytes(content)))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    out.append(dict.fromkeys(MESSAGE_COLUMNS) | {"source_path": path, "error": type(e).__name__})
            yield pd.DataFrame(out, columns=MESSAGE_COLUMNS)

    return files.select("path", "content").mapInPandas(run, MESSAGE)


# Fields of which a JSON object needs two to count as a message.
MESSAGE_KEYS = ("message_id", "Message-ID", "id", "subject", "body", "plain_text_body", "text")


def walk_messages(value) -> Iterator[dict]:
    """Message-like objects anywhere in a JSON value, outermost first, in document order."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, dict):
            if len(v.keys() & set(MESSAGE_KEYS)) >= 2:
                yield v
            else:
                waiting += reversed(list(v.values()))
        elif isinstance(v, list):
            waiting += reversed(v)


def read_mailbox_json(files: DataFrame) -> DataFrame:
    """(path, ordinal, message_id, message json): messages of JSON files, the first of each id wins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = list(walk_messages(json.loads(bytes(content).decode("utf-8", "replace"))))
                except ValueError:
                    found = []
                for n, m in enumerate(found):
                    ident = str(m.get("message_id") or m.get("Message-ID") or m.get("id") or "").strip()
                    if ident:
                        out.append((path, n, str(ident), json.dumps(m, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["path", "ordinal", "message_id", "message"])

    rows = files.mapInPandas(run, "path string, ordinal int, message_id string, message string")
    first = Window.partitionBy("message_id").orderBy("path", "ordinal")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def _text(message: Column, *fields: str) -> Column:
    """The first of some JSON fields that isn't empty, as text."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(message, f"$['{f}']")), F.lit("")) for f in fields])


def party(value: Column) -> Column:
    """Address or name of a JSON party: its email, else its name, else the text itself."""
    inside = F.coalesce(*[F.nullif(F.trim(F.get_json_object(value, f"$.{f}")), F.lit("")) for f in ("email", "name")])
    return F.when(value.startswith("{"), inside).otherwise(F.nullif(F.trim(value), F.lit("")))


def parties(value: Column) -> Column:
    """Parties of a JSON list, or the one of a JSON value; empty ones are left out."""
    listed = F.from_json(F.when(value.startswith("["), value), "array<string>")
    return F.filter(F.transform(F.coalesce(listed, F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>")), party), lambda x: x.isNotNull())


def _base_name(path: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), F.lit(""))


def normalized_message(message: Column, mailbox: Column) -> Column:
    """struct of a mailbox JSON message: aliases of each field, empty strings skipped.

    The thread key is the given thread, else the normalised subject, else the id, below the
    mailbox. A missing date is the epoch; dates without a zone are UTC.
    """
    ident = _text(message, "message_id", "Message-ID", "id")
    subject = F.coalesce(_text(message, "subject"), F.lit(""))
    body = F.coalesce(_text(message, "body", "plain_text_body", "body_text", "text", "content"), F.lit(""))
    thread = F.coalesce(_text(message, "thread_id", "conversation_id", "thread"), F.nullif(normalize_subject(subject), F.lit("")), ident)
    date = F.get_json_object(message, "$.date")
    when = parse_when(date, "EEE, d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "MM/dd/yyyy")
    listed = F.coalesce(*[F.from_json(F.get_json_object(message, f"$.{f}"), "array<string>") for f in ("attachments", "files")], F.array().cast("array<string>"))
    doc = F.coalesce(_text(message, "doc_id"), sanitize_id(ident))

    def attachment(a: Column, i: Column) -> Column:
        source = F.coalesce(_text(a, "repo_path", "path", "relative_path"), url_path(_text(a, "url")))
        name = F.coalesce(_base_name(_text(a, "filename", "name", "file_name", "basename")), _base_name(source), F.concat(F.lit("attachment-"), (i + 1).cast("string")))
        number = F.concat(sanitize_id(ident), F.lit("-att-"), (i + 1).cast("string"))
        return F.when(
            a.startswith("{"),
            F.struct(F.coalesce(_text(a, "attachment_id"), number).alias("attachment_id"), name.alias("filename"), _text(a, "local_source").alias("local_source"), _text(a, "url").alias("url"), source.alias("repo_path")),
        )

    return F.struct(
        doc.alias("doc_id"),
        ident.alias("message_id"),
        F.concat(mailbox, F.lit(":"), thread).alias("thread_id"),
        F.coalesce(when, F.lit(0).cast("timestamp")).alias("sent_at"),
        F.coalesce(party(F.coalesce(*[F.nullif(F.get_json_object(message, p), F.lit("")) for p in ("$.from", "$.sender")])), F.lit("")).alias("sender"),
        parties(F.get_json_object(message, "$.to")).alias("recipients"),
        parties(F.get_json_object(message, "$.cc")).alias("cc"),
        subject.alias("subject"),
        F.when(body.contains("<") & body.contains(">"), html_to_text(body)).otherwise(body).alias("body_text"),
        _text(message, "in_reply_to", "In-Reply-To").alias("in_reply_to"),
        parties(F.coalesce(F.get_json_object(message, "$.references"), F.get_json_object(message, "$.References"))).alias("reference_ids"),
        F.filter(F.transform(listed, attachment), lambda x: x.isNotNull()).alias("attachments"),
    )


def archive_message(record: Column, path: Column) -> Column:
    """struct of one archived JSON message: like ``normalized_message``, but the thread stands by
    itself, the body is taken as it is, and a missing date stays null."""
    ident = _text(record, "message_id", "Message-ID", "id")
    subject = F.coalesce(F.get_json_object(record, "$.subject"), F.lit(""))
    bare = F.regexp_replace(ident, r"^[<>]+|[<>]+$", "")
    doc = F.coalesce(_text(record, "doc_id"), bare)
    files = F.coalesce(F.from_json(F.get_json_object(record, "$.attachments"), "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        doc.alias("doc_id"),
        ident.alias("message_id"),
        F.coalesce(_text(record, "thread_id"), F.nullif(normalize_subject(subject), F.lit("")), ident).alias("thread_id"),
        parse_when(F.get_json_object(record, "$.date"), "EEE, d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ss").alias("sent_at"),
        F.coalesce(_text(record, "from", "sender"), F.lit("")).alias("sender"),
        parties(F.get_json_object(record, "$.to")).alias("recipients"),
        parties(F.get_json_object(record, "$.cc")).alias("cc"),
        subject.alias("subject"),
        F.coalesce(_text(record, "body", "plain_text_body", "text"), F.lit("")).alias("body_text"),
        F.transform(files, lambda a, i: F.coalesce(_text(a, "attachment_id"), F.concat(doc, F.lit("-att-"), (i + 1).cast("string")))).alias("attachment_ids"),
        _text(record, "in_reply_to", "In-Reply-To").alias("in_reply_to"),
        parties(F.coalesce(F.get_json_object(record, "$.references"), F.get_json_object(record, "$.References"))).alias("reference_ids"),
        path.alias("source_path"),
        F.lit("archive").alias("source_type"),
    )


@F.pandas_udf(StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    """Visible text of HTML, a line for each stripped string."""
    return markup.map(lambda x: None if x is None else html_text(x))


def parts_of(payload: dict, through_named: bool = True) -> Iterator[dict]:
    """Parts of a provider message, breadth first; with ``through_named`` false, named parts and what is in them are left out."""
    queue = deque([payload or {}])
    while queue:
        p = queue.popleft()
        if through_named or not p.get("filename"):
            yield p
            queue.extend(p.get("parts") or [])


def _decoded(data: str | None) -> str:
    import base64

    if not data:
        return ""
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")


def provider_text(payload: dict) -> str:
    """Body of a provider payload: its plain parts joined, else its HTML parts as text; named parts are attachments."""
    found: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for p in parts_of(payload, through_named=False):
        kind = p.get("mimeType")
        if kind in found:
            try:
                text = _decoded((p.get("body") or {}).get("data"))
            except (ValueError, TypeError):  # broken base64 is an empty part
                text = ""
            if text.strip():
                found[kind].append(text)
    if found["text/plain"]:
        return "\n".join(found["text/plain"]).strip()
    return html_text("\n".join(found["text/html"])).strip()


def provider_record(raw: str) -> dict | None:
    """Fields of provider message JSON; None if it is none."""
    try:
        m = json.loads(raw)
        payload = m.get("payload") or {}
        ident = m["id"]
    except (TypeError, ValueError, AttributeError, KeyError):
        return None
    headers = {str(h.get("name") or "").lower(): str(h.get("value") or "") for h in payload.get("headers") or []}
    at = _utc(headers.get("date"))
    if at is None and str(m.get("internalDate") or "").isdigit():
        at = dt.datetime.fromtimestamp(int(m["internalDate"]) / 1000, dt.timezone.utc)
    files = []
    for p in parts_of(payload):
        body, name = p.get("body") or {}, p.get("filename") or ""
        handle = body.get("attachmentId")
        if handle and (p.get("mimeType") == "application/pdf" or name.lower().endswith(".pdf")):
            files.append({"attachment_id": handle, "filename": name or f"{handle}.pdf", "media_type": "application/pdf", "byte_size": body.get("size")})
    return {
        "doc_id": ident,
        "message_id": ident,
        "thread_id": m.get("threadId") or ident,
        "sent_at": at,
        "sender": headers.get("from", ""),
        "recipients": _people([headers["to"]]) if headers.get("to") else [],
        "cc": _people([headers["cc"]]) if headers.get("cc") else [],
        "subject": headers.get("subject", ""),
        "body_text": provider_text(payload),
        "attachments": files,
        "in_reply_to": headers.get("in-reply-to"),
        "reference_ids": (headers.get("references") or "").split(),
    }


PROVIDER = (
    "doc_id string, message_id string, thread_id string, sent_at timestamp, sender string, recipients array<string>, cc array<string>, subject string, body_text string, "
    "attachments array<struct<attachment_id: string, filename: string, media_type: string, byte_size: bigint>>, in_reply_to string, reference_ids array<string>"
)


def provider_messages(messages: DataFrame, column: str = "message", address: str = "email_address") -> DataFrame:
    """Messages of provider JSON (columns message, email_address), keyed by the provider's id.

    The Date header wins over the provider's own time. Only PDF attachments are listed, by
    their metadata. JSON that is no message gives no row.
    """
    names = [c.split()[0] for c in PROVIDER.replace("array<struct<attachment_id: string, filename: string, media_type: string, byte_size: bigint>>", "x").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r | {"source_path": f"mailbox://{who}/{r['doc_id']}"}) for raw, who in zip(batch["message"], batch["address"]) if (r := provider_record(raw))]
            yield pd.DataFrame(out, columns=[*names, "source_path"])

    who = F.col(address) if address in messages.columns else F.lit("")
    return messages.select(F.col(column).alias("message"), who.alias("address")).mapInPandas(run, f"{PROVIDER}, source_path string").withColumn("source_type", F.lit("provider"))


# --- attachments ---


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor document."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return "\n".join(t for t in ("".join(x.text or "" for x in p.iter(f"{w}t")) for p in root.iter(f"{w}p")) if t.strip())


def rtf_text(raw: str) -> str:
    """Rich text without control words and groups."""
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), raw)
    t = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", t)
    t = re.sub(r"\\par[d]?\b ?", "\n", t)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", t)).strip()


# Media types by file name, where a part names none.
MEDIA_TYPES = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".rtf": "application/rtf",
    ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".txt": "text/plain", ".htm": "text/html", ".html": "text/html",
}
_KINDS = {m: k for k, m in MEDIA_TYPES.items()} | {"text/html": ".html", "text/rtf": ".rtf"}


def media_type(name: str) -> str:
    """Media type of a file name."""
    return MEDIA_TYPES.get("." + name.lower().rpartition(".")[2], "application/octet-stream")


def binary_text(content: bytes) -> str:
    """Runs of readable characters in an old binary document, in either width."""
    wide = re.findall(rb"(?:[\x20-\x7e\t\r\n]\x00){6,}", content)
    narrow = re.findall(rb"[\x20-\x7e\t\r\n]{6,}", content)
    runs = [w.decode("utf-16-le") for w in wide] or [n.decode("ascii") for n in narrow]
    return "\n".join(r.strip() for r in runs if re.search(r"[A-Za-z]{3}", r)).strip()


def sheet_text(content: bytes) -> str:
    """Cells of a zipped workbook: a header a sheet, then its rows, cells that aren't empty joined."""
    n = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{n}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{n}si")]
    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{n}sheet")]
    out = []
    for i, name in enumerate(names, 1):
        part = f"xl/worksheets/sheet{i}.xml"
        if part not in z.namelist():
            continue
        out.append(f"Sheet: {name}")
        for row in ElementTree.fromstring(z.read(part)).iter(f"{n}row"):
            cells = []
            for c in row.iter(f"{n}c"):
                v = c.find(f"{n}v")
                inline = "".join(t.text or "" for t in c.iter(f"{n}t"))
                value = inline if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                if value.strip():
                    cells.append(value.strip())
            if cells:
                out.append(" | ".join(cells))
    return "\n".join(out)


#: text of a PDF or an image, from whatever can read it; a library or service is set by the caller
Recogniser = Callable[[bytes, str], str]


def attachment_text(path: str, content: bytes, kind: str | None = None, recognise: Recogniser | None = None) -> tuple[str, str]:
    """(status, text) of an attachment by its media type or suffix; unknown kinds are read as text.

    done, failed (malformed), encrypted, or unsupported where it needs a ``recognise`` that isn't given.
    """
    name = path.lower()
    suffix = _KINDS.get(kind or "") or "." + name.rpartition(".")[2]
    try:
        if suffix == ".docx":
            return "done", docx_text(content)
        if suffix in (".htm", ".html"):
            return "done", html_text(content.decode("utf-8", "replace"))
        if suffix == ".rtf":
            return "done", rtf_text(content.decode("utf-8", "replace"))
        if suffix == ".xlsx" or (suffix == ".xls" and content[:2] == b"PK"):
            return "done", sheet_text(content)
        if suffix in (".doc", ".xls"):
            text = binary_text(content)
            return ("done", text) if text else ("unsupported", "")
        if suffix in (".pdf", ".tif", ".tiff", ".png", ".jpg"):
            if suffix == ".pdf" and not content.startswith(b"%PDF"):
                return "failed", ""
            if suffix == ".pdf" and b"/Encrypt" in content:
                return "encrypted", ""
            return ("done", recognise(content, suffix)) if recognise else ("unsupported", "")
        return "done", content.decode("utf-8", "ignore").strip()
    except Exception:  # noqa: BLE001
        return "failed", ""


def read_attachments(files: DataFrame, oversized: int | None = 25_000_000, recognise: Recogniser | None = None) -> DataFrame:
    """(path, status, text, alnum_count, text_density) of attachment files.

    Files over ``oversized`` bytes get that status and no text; None reads every size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                status, text = ("oversized", "") if oversized is not None and len(content) > oversized else attachment_text(path, bytes(content), recognise=recognise)
                out.append((path, status, html.unescape(text) if path.lower().endswith("html") else text))
            yield pd.DataFrame(out, columns=["path", "status", "text"])

    alnum = F.regexp_count("text", F.lit("[A-Za-z0-9]"))
    return files.mapInPandas(run, "path string, status string, text string").select("path", "status", "text", alnum.alias("alnum_count"), (alnum / F.greatest(F.length("text"), F.lit(1))).alias("text_density"))
