"""Languages of documents and of their sentences, by compression.

Each language is represented by a raw-content zstandard dictionary; a sentence
belongs to the language whose dictionary makes it smallest. Confidence is the
share of bytes saved against the second smallest; under ``narrow`` the sentence
is rejected (null language). Case and diacritics are folded before, so that
shouted or transliterated text meets the same dictionary.

The dictionaries are fitted on a bounded sample: whole texts of at most ``train_docs``
labelled documents a language, of whose sentences ``dictionary_bytes`` fit a dictionary. As labels can be wrong, the sample is split in two
halves that judge each other: a sentence enters a dictionary only if the other
half's dictionaries agree with its label. All classification covers every row.

A whole sentence starts after a sentence or paragraph end, ends with . ? or !
and has at least ``MIN_WORDS`` words; quote marks and line wraps are undone
first. Header lines, logs, addresses and tags are no sentences.

Defined results
  * null, empty and blank texts, and texts without a sentence: no segments, no language
  * a label in any notation (code, region, ISO 639-2, name, any case) counts as its code
  * repeated rows give their rows each; extra columns are ignored
  * with no labelled rows at all nothing can be fitted, and no language is assigned
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.runtime import spread

# Names and codes of each language in ISO 639-1, 639-2 (B and T) and English/native.
NOTATIONS: dict[str, tuple[str, ...]] = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "francais"),
    "es": ("es", "spa", "spanish", "espanol", "castilian"),
    "pt": ("pt", "por", "portuguese", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
}
UNKNOWN = ("", "und", "xx", "unknown", "none", "null", "n/a", "mul", "zxx", "mis")
MIN_WORDS = 4

_FOLD = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "’": "'"})
_HEADER = re.compile(
    r"^\s*[*_]*(from|to|cc|bcc|sent|date|subject|reply-to|von|an|gesendet|betreff|datum|de|à|a|para|envoyé|objet|enviado|asunto|assunto|da|inviato|oggetto|van|aan|verzonden|onderwerp)[*_]*\s?:[*_]*\s+\S",
    re.I,
)
_NOISE = re.compile(r"https?://\S+|\S+@\S+|<\|[^|>]*\|>|\[[a-z]+: ?[^\]]*\]|<[^<>]{1,200}>|\S*[=|;{}_\\]\S*[=|;{}_\\]\S*", re.I)
_LOG = re.compile(r"^\s*\d{4}-\d\d-\d\dT\S+\s|^\s*[-=*_#~.]{3,}\s*$|^\s*\S+=\S+\s*$|^\s*[\d\s.,:;e+-]+$")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_STOP = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=\S)")
_ABBREVIATION = re.compile(r"(?:\b[A-Za-z]|\b(?:dr|mr|mrs|ms|prof|st|no|nr|tel|inc|ltd|co|bzw|ca|etc|art|dept|ins|log|tech))\.$", re.I)


def label_code(label: Column) -> Column:
    """Two-letter code a label denotes; null where it is missing or denotes no language."""
    plain = F.translate(F.lower(F.trim(label)), "çãáàéêíóôúñ", "caaaeeiooun")
    head = F.regexp_extract(plain, r"^([a-z]+)", 1)
    code = F.lit(None).cast("string")
    for lang, names in NOTATIONS.items():
        code = F.when(head.isin(*names), F.lit(lang)).otherwise(code)
    known_none = plain.isNull() | plain.isin(*UNKNOWN)
    # any other code denotes some other language: kept, so that it counts as wrong
    return F.when(~known_none, F.coalesce(code, F.nullif(head, F.lit(""))))


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_FOLD))
    return "".join(c for c in text if not unicodedata.combining(c))


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, clean text) of each whole sentence; offsets in code points of the text."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int, str]] = []
    block: list[tuple[int, str]] = []  # (offset, line without marks)

    def close() -> None:
        if not block:
            return
        chars, where = [], []
        for at, line in block:
            if chars and chars[-1] == "-" and len(chars) > 1 and chars[-2].isalpha() and line[:1].islower():
                chars.pop(), where.pop()
            elif chars:
                chars.append(" "), where.append(at)
            chars.extend(line)
            where.extend(range(at, at + len(line)))
        joined, begin = "".join(chars), 0
        cuts = [m.start() for m in _STOP.finditer(joined)]
        held = []
        for c in [*cuts, len(joined)]:
            part = joined[begin:c]
            if c < len(joined) and _ABBREVIATION.search(part.rstrip("\"'”’»)]")):
                continue
            held.append((begin, c))
            begin = c
        for a, b in held:
            raw = joined[a:b]
            lead = len(raw) - len(raw.lstrip(" \t-*•–—\"'“«(>)]”’»"))
            a, raw = a + lead, raw[lead:].rstrip()
            clean = _NOISE.sub(" ", raw).strip()
            if re.search(r"[.!?…][\"'”’»)\]]*$", clean) and len(_WORD.findall(clean)) >= MIN_WORDS:
                out.append((where[a], where[min(b, len(where)) - 1] + 1, clean))
        block.clear()

    at = 0
    for line in text.split("\n"):
        body = line.rstrip("\r")
        mark = re.match(r"[\s>|]*", body).end()
        content = body[mark:].rstrip()
        if not content:
            close()
        elif _HEADER.match(content) or _LOG.match(content):
            close()
        else:
            if re.match(r"[-*•–]\s", content):
                close()
            block.append((at + mark, content))
            if content.startswith(("http://", "https://")):
                block.pop()
        at += len(line) + 1
    close()
    return out


class Model:
    """A dictionary a language; ``classify`` gives (language or None, confidence)."""

    def __init__(self, texts: dict[str, list[str]], size: int = 96 * 1024, level: int = 3, narrow: float = 0.06):
        self.content = {}
        for lang in sorted(texts):
            joined, n = [], 0
            for t in texts[lang]:
                b = t.encode() + b"\n"
                if n + len(b) > size:
                    break
                joined.append(b)
                n += len(b)
            if n >= 64:
                self.content[lang] = b"".join(joined)
        self.level, self.narrow, self._own = level, narrow, None

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    def _compressors(self):
        if self._own is None:
            import zstandard as z

            self._own = []
            for lang, content in self.content.items():
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._own.append((lang, z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
        return self._own

    def agreeing(self, texts: list[str], lang: str) -> list[str]:
        """The texts of one document that are of this language, if its main language it is."""
        judged = [(self.classify(t)[0], t) for t in texts]
        length = Counter()
        for found, t in judged:
            length[found] += len(t)
        main = max((n, str(k)) for k, n in length.items())[1] if length else None
        return [t for found, t in judged if found == lang] if main == lang else []

    def classify(self, folded: str) -> tuple[str | None, float]:
        raw = folded.encode()
        sizes = sorted((len(c.compress(raw)), lang) for lang, c in self._compressors())
        if not sizes:
            return None, 0.0
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        # header bytes that every result has carry no evidence
        best, second = max(sizes[0][0] - 6, 1), max(sizes[1][0] - 6, 1)
        confidence = 1.0 - best / second
        return (sizes[0][1] if confidence >= self.narrow else None), confidence


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", train_docs: int = 250, dictionary_bytes: int = 96 * 1024) -> Model:
    """Dictionaries of ``dictionary_bytes`` from at most ``train_docs`` labelled documents a language."""
    low = Window.partitionBy("code").orderBy(F.xxhash64(F.col(key)), F.col(key))
    sample = (
        documents.select(key, F.col(text).alias("text"), label_code(F.col(label)).alias("code"))
        .where(F.col("code").isin(*NOTATIONS) & F.col("text").isNotNull())
        .withColumn("n", F.row_number().over(low))
        .where(F.col("n") <= train_docs)
        .orderBy("code", "n")
        .collect()
    )
    read = [(r["code"], [fold(s) for _, _, s in sentences(r["text"])]) for r in sample]
    # a sentence that stands under several labels counts for the most frequent one only
    votes: dict[str, Counter] = {}
    for code, found in read:
        for t in found:
            votes.setdefault(t, Counter())[code] += 1
    owner = {t: max(sorted(v), key=v.__getitem__) for t, v in votes.items()}
    halves: list[dict[str, list[list[str]]]] = [{}, {}]
    for code, found in read:
        found = [t for t in found if owner[t] == code]
        if found:  # copies of a text fall into the same half
            halves[crc32(found[0].encode()) % 2].setdefault(code, []).append(found)
    kept = [{lang: [t for d in docs for t in d] for lang, docs in h.items()} for h in halves]
    for _ in range(2):
        models = [Model(k, dictionary_bytes) for k in kept]
        kept = [
            {lang: [t for d in docs for t in models[1 - i].agreeing(d, lang)] for lang, docs in halves[i].items()}
            if models[1 - i].content
            else kept[i]
            for i in (0, 1)
        ]
    merged = {}
    for lang in NOTATIONS:
        a, b = (k.get(lang, []) for k in kept)
        merged[lang] = [t for pair in zip(a, b) for t in pair] + a[len(b) :] + b[len(a) :]
    return Model(merged, dictionary_bytes)


def segments(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, segment, start, end, lang, confidence): a row for each whole sentence."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, (a, b, s) in enumerate(sentences(t)):
                    lang, confidence = m.classify(fold(s))
                    rows.append((n, a, b, lang, confidence))
                    at.append(i)
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["key", "segment", "start", "end", "lang", "confidence"],
            )

    kind = documents.schema[key].dataType.simpleString()
    return (
        spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
        .mapInArrow(run, f"key {kind}, segment int, start int, `end` int, lang string, confidence double")
        .withColumnRenamed("key", key)
    )


def document_languages(segmented: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, sentences, characters, confidence): a row for each language of a document."""
    return (
        segmented.where("lang is not null")
        .groupBy(key, "lang")
        .agg(
            F.count("*").alias("sentences"),
            F.sum(F.col("end") - F.col("start")).alias("characters"),
            F.max("confidence").alias("confidence"),
        )
    )


def mislabelled(documents: DataFrame, languages: DataFrame, key: str = "doc_id", label: str = "lang", sure: float = 0.2) -> DataFrame:
    """(key, lang, ...) of documents that are mixed, or whose label is missing or wrong.

    A language that isn't a document's main one counts only with a sentence of
    confidence ``sure`` or more.
    """
    main = Window.partitionBy(key).orderBy(F.desc("characters"), "lang")
    present = (
        languages.withColumn("place", F.row_number().over(main))
        .where((F.col("place") == 1) | (F.col("confidence") >= sure))
        .withColumn("langs", F.count("*").over(Window.partitionBy(key)))
    )
    labels = documents.select(key, label_code(F.col(label)).alias("code"))
    return (
        present.join(labels, key)
        .where((F.col("langs") > 1) | F.col("code").isNull() | (F.col("code") != F.col("lang")))
        .drop("place", "langs", "code")
    )
