"""Text functions as Column expressions; JVM-side, no Python per row."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"([\p{L}\p{N}_]+)"
# Patterns of amounts, dates, file names, names and correction cues that validation, memory and graph building share.
AMOUNT = r"(\$?\d[\d,]*(?:\.\d{2})?)"
DATE = r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2}(?:,\s+\d{4})?)\b"
FILE_NAME = r"(?i)\b([\w.\- ]+\.(?:pdf|docx|txt|html|htm))\b"
CAPITALISED = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"
MESSAGE_REF = r"(<[^>]+>)"
UPDATE_CUE = r"(?i)\b(replaces|replacing|updated from|instead of|now)\b"


def tokenize(text: Column) -> Column:
    """Unicode word tokens in order; null gives the empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))


def count_tokens(text: Column) -> Column:
    return F.size(tokenize(text))


def normalize_subject(subject: Column) -> Column:
    """Subject without any number of reply and forward prefixes, lower case, single blanks."""
    bare = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*((re|fw|fwd)\s*:\s*)+", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), r"^\s+|\s+$", ""), r"\s+", " ")


def strip_markup(text: Column) -> Column:
    """HTML to text: blocks without content dropped, breaks and tags to line ends, entities undone."""
    t = F.regexp_replace(text, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[A-Za-z/!][^<>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def normalize_body(body: Column) -> Column:
    """Body with unix line ends, no markup, no trailing blanks, at most one empty line in a row."""
    t = F.replace(F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.when(t.rlike(r"(?i)<\s*(html|body|div|p|br|table)\b"), strip_markup(t)).otherwise(t)
    t = F.regexp_replace(t, r"[ \t\x{0B}\f]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def embed_text(
    sender: Column, to: Column, cc: Column, sent_at: Column, subject: Column, thread_id: Column, in_reply_to: Column, text: Column
) -> Column:
    """Indexing text: a header block of the known fields above the citable text."""

    def line(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))

    people = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    header = F.concat_ws(
        "\n",
        line("From", sender),
        line("To", people(to)),
        line("Cc", people(cc)),
        line("Date", F.date_format(sent_at, "yyyy-MM-dd")),
        line("Subject", subject),
        line("Thread-ID", thread_id),
        line("In-Reply-To", in_reply_to),
    )
    return F.concat_ws("\n\n", F.nullif(header, F.lit("")), text)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def amounts(text: Column) -> Column:
    """Distinct amounts without sign and separators, sorted."""
    raw = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda x: F.translate(x, "$,", ""))))


def dates(text: Column) -> Column:
    """Distinct date strings, lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(1)), F.lower)))


def found(text: Column, pattern: str) -> Column:
    """Every match of a pattern's first group, in order; null gives the empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def stated_values(text: Column) -> Column:
    """Distinct amounts, dates, file names and capitalised names of a text, in one spelling, sorted."""
    plain = lambda pattern: F.transform(found(text, pattern), lambda x: F.lower(F.trim(x)))
    numbers = F.transform(found(text, AMOUNT), lambda x: F.lower(F.trim(F.translate(x, "$,", ""))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(numbers, plain(DATE), plain(FILE_NAME), plain(CAPITALISED)), lambda x: x != "")))


def value_match(clause: Column, evidence: Column) -> Column:
    """Share of the values a clause states that the evidence states too; 1 where it states none."""
    mine = stated_values(clause)
    return F.when(F.size(mine) == 0, 1.0).otherwise(F.size(F.array_intersect(mine, stated_values(evidence))) / F.size(mine))


# Words that carry no content when sentences are compared with a question.
FUNCTION_WORDS = ("a", "an", "and", "are", "attachment", "by", "does", "email", "for", "in", "is", "it", "meant", "no", "of", "on", "that", "the", "this", "to", "what", "when", "which", "who")


def content_tokens(text: Column) -> Column:
    """Distinct words of over two letters that aren't function words."""
    words = F.filter(tokenize(F.lower(text)), lambda x: F.length(x) > 2)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in FUNCTION_WORDS]))


def best_sentence(text: Column, wanted: Column) -> Column:
    """The sentence that shares most content words with ``wanted``; of equal ones that with more
    content words, then the longer one, then the first. With no wanted words the richest one;
    null where no sentence shares any. A text without sentences gives its first 240 characters."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    parts = F.filter(F.split(whole, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")

    def scored(x: Column, i: Column) -> Column:
        own = content_tokens(x)
        shared = F.when(F.size(wanted) > 0, F.size(F.array_intersect(own, wanted))).otherwise(F.size(own))
        return F.struct(shared.alias("shared"), F.size(own).alias("words"), F.length(x).alias("length"), (-i).alias("first"), F.trim(x).alias("sentence"))

    best = F.array_max(F.transform(parts, scored))
    return F.when(F.size(parts) == 0, F.nullif(F.substring(whole, 1, 240), F.lit(""))).when((F.size(wanted) == 0) | (best["shared"] > 0), best["sentence"])


def citation_mark(message_id: Column, page_no: Column, kind: Column) -> Column:
    """Mark of a citation: message, and page where an attachment is cited."""
    paged = (kind == "attachment") & page_no.isNotNull()
    return F.when(paged, F.concat(F.lit("[msg: "), message_id, F.lit(", page: "), page_no.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[msg: "), message_id, F.lit("]")))


def source_mark(name: Column, page_no: Column, ocr: Column) -> Column:
    """Mark of an attachment page, told apart where its text was recognised."""
    return F.concat(F.lit("["), name, F.lit(", page: "), page_no.cast("string"), F.when(F.coalesce(ocr, F.lit(False)), F.lit(" (OCR)")).otherwise(F.lit("")), F.lit("]"))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of some columns: keys in order, nulls kept apart from ''."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def checked_vector(vector: Column, dimension: int) -> Column:
    """The vector, which must have ``dimension`` numbers; null stays null."""
    return F.when(vector.isNull() | (F.size(vector) == dimension), vector).otherwise(
        F.raise_error(F.concat(F.lit(f"vector of {dimension} numbers expected, got "), F.size(vector).cast("string")))
    )


def shifted_span(source_start: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the source of a chunk; both null where the chunk has no place in it."""
    return F.struct((source_start + start).alias("start"), (source_start + end).alias("end"))


def intent(text: Column) -> Column:
    """What a question asks for, by the first cue that applies."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("general")
    for name, cues in reversed(INTENT_CUES):
        out = F.when(low.rlike("|".join(cues)), name).otherwise(out)
    return out


# Cues of each intent, in the order in which they are tried.
INTENT_CUES = (
    ("comparison", ("compare", "difference", "changed", "draft", "final")), ("instructions", ("instruction",)), ("topic", ("topic",)), ("audience", ("audience",)),
    ("deadline", ("deadline", "due")), ("company", ("company", "who is requesting")), ("territories", ("territor",)), ("month", ("month",)),
    ("metadata", ("from", "to", "cc", "subject")), ("time", ("when", "date", "sent")),
)
# Wording of questions that compare versions, and that ask for an order of events.
COMPARISON = r"(?i)\bcompare\b|\bdifference\b|\bchanged\b|\bdraft\b.*\bfinal\b|\bearlier\b.*\b(?:latest|final)\b|\b(?:vs|versus)\b"
TIMELINE = r"(?i)\btimeline\b|\bsequence\b|\bchronolog|^\s*when did\b"


def has_update_cue(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(UPDATE_CUE)


def base64url(text: Column) -> Column:
    """Text of base64 in either alphabet, padded or not; null if it isn't any."""
    plain = F.translate(F.translate(text, "-_", "+/"), "=", "")
    padded = F.concat(plain, F.substring(F.lit("==="), 1, F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    good = plain.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(plain) % 4 != 1)
    return F.when(good, F.decode(F.unbase64(padded), "UTF-8"))


def locate_span(text: Column, evidence: Column) -> Column:
    """struct(start, end): first exact occurrence, half-open; null if there is none."""
    at = F.call_function("instr", text, evidence)
    return F.when(
        (F.length(evidence) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(evidence)).alias("end"))
    )


def fragments(text: Column) -> Column:
    """Sentences and lines of a text."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\n"), r"\n+")


def overlap_f1(clause: Column, evidence: Column) -> Column:
    """Best F1 between the token sets of a clause and of a fragment of the evidence."""
    mine = F.array_distinct(tokenize(F.lower(clause)))

    def f1(fragment: Column) -> Column:
        theirs = F.array_distinct(tokenize(F.lower(fragment)))
        shared = F.size(F.array_intersect(mine, theirs))
        return F.when(shared > 0, 2.0 * shared / (F.size(mine) + F.size(theirs))).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(fragments(evidence), f1)), F.lit(0.0))


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<pos, window>>: white-space tokens in overlapping windows, blank-joined.

    The last window is the first that reaches the end.
    """
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    n, step = F.size(tokens), max(1, size - overlap)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (n > 0) & ((s == 0) | (s - step + size < n)))
    return F.transform(starts, lambda s, i: F.struct(i.alias("pos"), F.array_join(F.slice(tokens, s + 1, F.lit(size)), " ").alias("window")))


def parse_when(text: Column, *formats: str) -> Column:
    """Timestamp of a date string in any of the formats, ISO first, or of epoch milliseconds; else null."""
    tries = [text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in formats]]
    digits = F.when(text.rlike(r"^\d{12,14}$"), F.timestamp_millis(text.try_cast("bigint")))
    return F.coalesce(digits, *tries)


def sanitize_id(text: Column) -> Column:
    """Characters that are safe in file names and keys; runs of others become one underscore."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[<>]+|[<>]+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("message"))


def url_path(url: Column) -> Column:
    """Path of an address without its leading slash; null if it is none."""
    return F.ltrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))


def alnum_density(text: Column, area: Column) -> Column:
    """Letters and digits per unit of page area."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]")) / F.greatest(area, F.lit(1.0))


def csv_list(text: Column) -> Column:
    """Trimmed, non-empty parts of a comma-separated string; null gives the empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def normalize_name(name: Column) -> Column:
    """Display form of a name: compatibility characters resolved, single blanks, case kept.

    ASCII names never leave the JVM.
    """
    plain = F.regexp_replace(F.trim(name), r"\s+", " ")
    return F.when(name.rlike(r"^[\x20-\x7E\t\n\r]*$"), plain).otherwise(_compatible(name))


def name_key(name: Column) -> Column:
    """Case-folded key of a normalised name."""
    shown = normalize_name(name)
    return F.when(shown.rlike(r"^[\x20-\x7E]*$"), F.lower(shown)).otherwise(_casefold(shown))
