"""Corpus encoding with a public byte-level BPE, and its exact inverse.

The tokenizers library runs over Arrow batches; strings that look like special
tokens are ordinary text, and no special token is added. Every token carries its
half-open span in code points and in UTF-8 bytes. Decoding maps each token's
symbols back through the byte table, so a character that was split over several
tokens comes back whole, and a cut inside a character gives U+FFFD there.

Defined results
  * null and empty text both encode to the empty list
  * repeated rows are encoded each; extra columns are ignored by ``encode``
  * unknown or null ids in ``decode`` give null for that row
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from threadloom.runtime import spread

#: where the vocabulary files lie on every node; override per call on a cluster
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: code points handed to the library at once, so that a batch of long texts can't pile up
CHARS_AT_ONCE = 1 << 20


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """Printable symbol of each byte in byte-level BPE vocabularies -> the byte.

    Printable Latin-1 bytes stand for themselves; the others, in order, take the
    code points from 256 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> dict[int, bytes]:
    table = byte_table()
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=False)
    return {i: bytes(table[c] for c in token) for token, i in vocabulary.items() if all(c in table for c in token)}


def _encoded(texts: list[str | None], path: str) -> Iterator[list]:
    """Encodings in order, a bounded number of code points at a time."""
    t, part, held = _tokenizer(path), [], 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= CHARS_AT_ONCE:
            yield from t.encode_batch_fast(part, add_special_tokens=False)
            part, held = [], 0
    if part:
        yield from t.encode_batch_fast(part, add_special_tokens=False)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids array<int>): one row for each input row."""
    key_type = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [e.ids for e in _encoded(batch.column(1).to_pylist(), vocabulary)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    out = StructType([StructField("key", key_type), StructField("ids", ArrayType(IntegerType()))])
    return spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, out).withColumnRenamed("key", key)


def _spans(text: str, encoding, token_bytes: dict[int, bytes]) -> list[tuple[int, int, int, int]]:
    """(char start, char end, byte start, byte end) of each token.

    Byte spans follow from the tokens' own lengths; a code point belongs to every
    token that holds one of its bytes.
    """
    owner = []
    for i, c in enumerate(text):
        owner.extend([i] * len(c.encode("utf-8", "surrogatepass")))
    spans, at = [], 0
    for i in encoding.ids:
        end = at + len(token_bytes[i])
        spans.append((owner[at], owner[end - 1] + 1, at, end))
        at = end
    return spans


def encode_with_offsets(
    documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """(key, ids, char_spans, byte_spans): spans are half-open, a pair for each token."""
    span = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))
    out = StructType([StructField("key", documents.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])
    out = out.add("char_spans", span).add("byte_spans", span)
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = _token_bytes(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, chars, bytes_ = [], [], []
            for text, e in zip(texts, _encoded(texts, vocabulary)):
                spans = _spans(text or "", e, token_bytes)
                ids.append(e.ids)
                chars.append([{"start": a, "end": b} for a, b, _, _ in spans])
                bytes_.append([{"start": a, "end": b} for _, _, a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(chars, pair), pa.array(bytes_, pair)],
                ["key", "ids", "char_spans", "byte_spans"],
            )

    return spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, out).withColumnRenamed("key", key)


def decode(ids: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Text of an id list, byte-exact for the ids of a whole text."""
    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        token_bytes = _token_bytes(vocabulary)

        def one(x):
            if x is None:
                return None
            parts = [token_bytes.get(int(i)) if i is not None else None for i in x]
            return None if None in parts else b"".join(parts).decode("utf-8", "replace")

        return lists.map(one)

    return run(ids)
