"""Evaluation passages inside a corpus, by greedy string tiling.

Texts are compared as folded words. Every window of ``SEED`` words of the items is
a seed; documents meet the seeds through running Karp-Rabin hashes, so a document
is read once and joined with all items. Pairs whose seeds crowd on few diagonals
are tiled: the longest common runs are marked first, never overlapping, down to
``MIN_TILE`` words. Tiles that follow each other in both texts, with only small
gaps, form a passage; a passage must be dense and longer than a stock phrase. The
best two passages, in either order, must hold ``share`` of the item's words.
Sentences that several items share (instructions) never count.

A stock phrase has under ``PHRASE`` words. Where a third of the item is less than that,
a passage of a third of the item is enough, if it holds a seed that no other item has.

The items are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words; the driver
holds one block at a time, and a larger item table takes more passes over the corpus,
never a larger broadcast. Shared sentences are counted by Spark. Nothing of the corpus
is shuffled.

Defined results
  * null, empty and very short texts (under ``SEED`` words) hold and leak nothing: every
    phrase of three words is common
  * repeated documents and items each give their rows; extra columns are ignored
  * equal tiles: the earlier one in the item, then in the document, is marked
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from threadloom.llm.language import fold
from threadloom.runtime import materialize, spread

#: words in a seed; a leaked passage with one word in five altered still has several
SEED = 4
MIN_TILE = 3
#: words of a passage that is more than a stock phrase, and of one that may be joined by a second
PHRASE, LEADING = 12, 15
#: diagonals in a band of seeds
BAND = 12
#: words of items in one broadcast index (a few dozen MB)
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Folded words; a line-end hyphenation is undone, quote marks are dropped."""
    if not text:
        return []
    text = re.sub(r"\n[ \t]*(?:>[ \t]*)+", "\n", "\n" + text)
    text = re.sub(r"(?<=[^\W\d_])[-¬­]\r?\n\s*(?=[^\W\d_])", "", text)
    return _WORD.findall(fold(text))


def _windows(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of each window of SEED ids; 0 where an unknown word is inside."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    x = ids.astype(np.uint64) + np.uint64(1)
    for k in range(SEED):
        h = h * _BASE + x[k : k + n]
        known &= ids[k : k + n] >= 0
    return np.where(known, h, np.uint64(0))


class ItemIndex:
    """Seeds and words of a block of items."""

    def __init__(self, items: list[tuple], shared: set[str]):
        self.vocabulary: dict[str, int] = {}
        self.keys = [k for k, _ in items]
        self.ids, self.counts = [], []
        hashes, owner, place = [], [], []
        for n, (_, text) in enumerate(items):
            ids, counts = [], []
            for s in _SENTENCE.split(text or ""):
                own = words(s)
                ids += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own]
                counts += [" ".join(own) not in shared] * len(own)
            a = np.array(ids, np.int64)
            self.ids.append(a)
            self.counts.append(np.array(counts, bool))
            h = _windows(a)
            hashes.append(h)
            owner.append(np.full(len(h), n))
            place.append(np.arange(len(h)))
        self.sizes = np.array([len(x) for x in self.ids])
        h, o, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owner, place))
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], o[order].astype(np.int64), p[order].astype(np.int64)
        # seeds that one item alone has, by their place in it
        first, last = np.searchsorted(self.hash, self.hash, "left"), np.searchsorted(self.hash, self.hash, "right") - 1
        alone = (self.owner[first] == self.owner[last]) & (self.hash > 0) if len(h) else np.zeros(0, bool)
        self.alone = [np.zeros(len(x), bool) for x in self.ids]
        for n, p in zip(self.owner[alone].tolist(), self.place[alone].tolist()):
            self.alone[n][p] = True

    def least(self, item: int, share: float) -> int:
        """Words a passage of this item must have."""
        return min(PHRASE, max(SEED, math.ceil(share * self.sizes[item])))

    def own(self, item: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Without tiles that a passage of a short item may share with other items."""
        if self.sizes[item] >= 3 * PHRASE:
            return found
        return [t for t in found if self.alone[item][t[0] : t[0] + max(1, t[2] - SEED + 1)].any()]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in item, place in document) of every shared seed."""
        h = _windows(ids)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = np.where(h > 0, hi - lo, 0)
        at = np.repeat(np.arange(len(h)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(lo, n) + step
        return self.owner[row], self.place[row], at

    def candidates(self, ids: np.ndarray, share: float) -> list[int]:
        """Items of which two diagonal bands of seeds cover four fifths of ``share``.

        A passage keeps its diagonal but for inserted and dropped words, so it lies
        within one band of one of the two half-shifted band systems.
        """
        item, place, at = self.hits(ids)
        if not len(item):
            return []
        best = np.zeros(len(self.keys))
        for shift in (0, BAND // 2):
            band = (at - place + len(ids) + 100_000 + shift) // BAND
            order = np.lexsort((place, band, item))
            i, d, p = item[order], band[order], place[order]
            fresh = np.ones(len(i), bool)
            fresh[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1])
            step = np.full(len(i), SEED)
            step[1:] = np.where(fresh[1:], SEED, np.minimum(p[1:] - p[:-1], SEED))
            starts = np.flatnonzero(fresh)
            cover, of = np.add.reduceat(step, starts), i[starts]
            order = np.lexsort((-cover, of))
            cover, of = cover[order], of[order]
            place_in = np.arange(len(of)) - np.searchsorted(of, of, "left")
            two = np.bincount(of, np.where(place_in < 2, cover, 0), len(self.keys))
            best = np.maximum(best, two)
        return np.flatnonzero((best > 0) & (best >= 0.8 * share * self.sizes)).tolist()


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length), longest first.

    Runs are found along the equal positions of both; a run that a longer one has
    cut is shortened and waits its turn again, as in repeated scans with a falling
    length.
    """
    places: dict[int, list[int]] = {}
    for j, w in enumerate(doc.tolist()):
        if w >= 0:
            places.setdefault(w, []).append(j)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    previous: dict[int, int] = {}
    items = item.tolist()
    for i, w in enumerate(items):
        now = {}
        for j in places.get(w, ()):
            now[j] = previous.get(j - 1, 0) + 1
        for j, n in previous.items():  # a run that ends here is maximal
            if n >= least and j + 1 not in now:
                runs.setdefault(n, []).append((i - n, j - n + 1, n))
        previous = now
    for j, n in previous.items():
        if n >= least:
            runs.setdefault(n, []).append((len(items) - n, j - n + 1, n))
    used_i, used_d, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while runs:
        length = max(runs)
        for i, j, n in sorted(runs.pop(length)):
            free = ~(used_i[i : i + n] | used_d[j : j + n])
            if free.all():
                used_i[i : i + n] = used_d[j : j + n] = True
                out.append((i, j, n))
                continue
            k = 0
            while k < n:
                if free[k]:
                    e = k
                    while e < n and free[e]:
                        e += 1
                    if e - k >= least:
                        runs.setdefault(e - k, []).append((i + k, j + k, e - k))
                    k = e
                else:
                    k += 1
    return out


def passages(found: list[tuple[int, int, int]], counts: np.ndarray, gap: int = 4, least: int = PHRASE) -> list[tuple[int, int, int]]:
    """(matched words that count, item start, document start) of dense passages, best first.

    Tiles are chained while both gaps are at most ``gap`` words; a chain counts if
    it matches at least ``least`` words and two thirds of its span in the item.
    """
    rest, out = sorted(found), []
    while rest:
        chain = [rest.pop(0)]
        while True:
            i, j, n = chain[-1]
            after = [t for t in rest if 0 <= t[0] - i - n <= gap and -1 <= t[1] - j - n <= gap]
            if not after:
                break
            nxt = min(after, key=lambda t: (t[0] - i - n) + abs(t[1] - j - n))
            rest.remove(nxt)
            chain.append(nxt)
        i0, j0 = chain[0][:2]
        span = chain[-1][0] + chain[-1][2] - i0
        total = sum(n for _, _, n in chain)
        own = sum(int(counts[i : i + n].sum()) for i, _, n in chain)
        if own >= least and total >= 0.66 * span:
            out.append((own, i0, j0))
    return sorted(out, reverse=True)


def two_best(found: list[tuple[int, int, int]], lead: int = LEADING) -> list[tuple[int, int, int]]:
    """The best passage, and a second one only beside a first longer than stock phrases."""
    return found[: 2 if found and found[0][0] >= lead else 1]


@F.pandas_udf(ArrayType(StringType()))
def _sentence_words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted({" ".join(words(x)) for x in _SENTENCE.split(t or "")} - {""}))


def leaks(
    documents: DataFrame,
    items: DataFrame,
    share: float = 1 / 3,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """(doc_key, item_key, coverage, matched_words, passages) of each leak."""
    spark = documents.sparkSession
    rows = items.select(F.col(item_key).alias("item"), F.col(text).alias("text")).where("item is not null")
    # sentences that more than one item has
    said = rows.select("item", F.explode(_sentence_words("text")).alias("sentence")).groupBy("sentence").agg(F.min("item").alias("a"), F.max("item").alias("b"), F.count("*").alias("n"))
    shared = rows.select("item", F.explode(_sentence_words("text")).alias("sentence")).join(said.where("n > 1"), "sentence").groupBy("item").agg(F.collect_set("sentence").alias("shared"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    blocks = max(1, math.ceil(1.25 * total / BLOCK_WORDS)) if total > BLOCK_WORDS else 1
    held = rows.join(shared, "item", "left").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    if blocks > 1:
        held = materialize(held, "items")
    doc_kind, item_kind = documents.schema[doc_key].dataType, items.schema[item_key].dataType
    schema = f"doc {doc_kind.simpleString()}, item {item_kind.simpleString()}, coverage double, matched_words int, passages int"

    def one(number: int) -> DataFrame:
        block = sorted(((r["item"], r["text"], r["shared"] or []) for r in held.where(F.col("block") == number).toLocalIterator()), key=lambda r: r[0])
        index = spark.sparkContext.broadcast(ItemIndex([r[:2] for r in block], {s for r in block for s in r[2]}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                at, item, coverage, matched, parts = [], [], [], [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    ids = np.array([ix.vocabulary.get(w, -1) for w in words(t)], np.int64)
                    for n in ix.candidates(ids, share):
                        least = ix.least(n, share)
                        best = two_best(passages(ix.own(n, tiles(ix.ids[n], ids)), ix.counts[n], least=least), LEADING if least == PHRASE else least)
                        own, whole = sum(p[0] for p in best), len(ix.ids[n])
                        if best and own >= share * whole:
                            at.append(row)
                            item.append(ix.keys[n])
                            coverage.append(own / whole)
                            matched.append(own)
                            parts.append(len(best))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int32())),
                        pa.array(item, pa.int64() if item_kind.simpleString() == "bigint" else None),
                        pa.array(coverage, pa.float64()),
                        pa.array(matched, pa.int32()),
                        pa.array(parts, pa.int32()),
                    ],
                    ["doc", "item", "coverage", "matched_words", "passages"],
                )

        return spread(documents.select(F.col(doc_key).alias("doc"), F.col(text).alias("text"))).mapInArrow(run, schema)

    parts = [materialize(one(n), "leaks") if blocks > 1 else one(n) for n in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumnRenamed("doc", doc_key).withColumnRenamed("item", item_key)
