"""Lexical and dense top-k, rank fusion and reranking over batches of queries.

Every operator carries a ``query_id``; ranks have a total order (score, then id).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import tokenize
from threadloom.runtime import materialize, spread


def postings(chunks: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, dl): the inverted index; one shuffle on (key, term)."""
    words = spread(chunks).select(key, tokenize(F.lower(text)).alias("ts"))
    return words.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def bm25(
    chunks: DataFrame, queries: DataFrame, key: str, text: Column, query: str = "query_text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25
) -> DataFrame:
    """(query_id, key, score) of every chunk that shares a term with a query (Okapi).

    Statistics cover the whole corpus. A negative idf becomes epsilon times the mean
    idf. Query terms count as often as they occur.
    """
    index = materialize(postings(chunks, key, text), "postings")
    n = chunks.count()
    avgdl = (index.agg(F.sum("tf")).first()[0] or 0) / max(n, 1)
    idf = index.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = (idf.agg(F.avg("idf")).first()[0] or 0.0) * epsilon
    terms = queries.select("query_id", F.explode(tokenize(F.lower(F.col(query)))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weights = terms.join(idf.select("term", "idf"), "term").withColumn("w", F.col("qtf") * F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / float(avgdl or 1.0))
    return (
        weights.join(index, "term")
        .groupBy("query_id", key)
        .agg(F.round(F.sum(F.col("w") * F.col("tf") * (k1 + 1) / norm), 6).alias("score"))
    )


def top_k(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best per query with their rank; the group limit runs before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_recall(chunks: DataFrame, queries: DataFrame, key: str, text: Column, query: str = "query_text") -> DataFrame:
    """(query_id, key, score): share of the distinct query tokens that the chunk has."""
    terms = queries.select("query_id", F.array_distinct(tokenize(F.lower(F.col(query)))).alias("ts")).select(
        "query_id", F.size("ts").alias("n"), F.explode("ts").alias("term")
    )
    return (
        terms.join(postings(chunks, key, text).select(key, "term"), "term")
        .groupBy("query_id", key)
        .agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a whole vector, their matrix) of a list column, from its flat values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    ok = np.flatnonzero(np.asarray(column.is_valid()) & (sizes > 0))
    if not len(ok):
        return ok, np.zeros((0, 0))
    width = np.bincount(sizes[ok]).argmax()
    ok = ok[sizes[ok] == width]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = values[column.offsets.to_numpy()[ok][:, None] + np.arange(width)]
    whole = np.isfinite(x).all(1) & (np.linalg.norm(x, axis=1) > 0)
    return ok[whole], x[whole]


def dense_top_k(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, block: int = 4096, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, key, score, rank): exact cosine of a query set against all rows.

    Queries go out in blocks of ``block`` vectors, so no broadcast grows with the
    data; each task keeps its k best per query before anything is shuffled. Null, zero and
    non-finite vectors take no part, nor do those of another length than most of a batch.
    With ``scope`` a row counts only where its scope columns equal the query's; the last of
    three may be null in the query, which then takes every value.
    """
    spark = vectors.sparkSession
    total = queries.count()
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-total // block)))))
    firm, loose = list(scope[:2]), list(scope[2:])
    tags = [F.xxhash64(*firm) if firm else F.lit(0).cast("bigint"), F.coalesce(F.xxhash64(*loose), F.lit(0)) if loose else F.lit(0).cast("bigint")]
    asked = [tags[0], F.when(F.col(loose[0]).isNotNull(), tags[1]) if loose else F.lit(None).cast("bigint")]
    parts = []
    for n in range(max(1, -(-total // block))):
        found = numbered.where(F.col("block") == n).select(F.col("query_id").cast("bigint"), embedding, asked[0].alias("a"), asked[1].alias("b")).toArrow()
        ok, q = _flat(found.column(1))
        if not len(ok):
            continue
        ids, firm_of = found.column(0).to_numpy()[ok], found.column(2).to_numpy()[ok]
        loose_of = [found.column(3)[int(i)].as_py() for i in ok]
        anywhere, loose_of = np.array([x is None for x in loose_of]), np.array([x or 0 for x in loose_of], np.int64)
        q = q / np.linalg.norm(q, axis=1)[:, None]
        sent = spark.sparkContext.broadcast((ids, q, firm_of, loose_of, anywhere))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, firm_of, loose_of, anywhere = sent.value
            best_s = np.full((len(ids), 0), -np.inf)
            best_i = np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                ok, x = _flat(batch.column(1))
                if not len(ok) or x.shape[1] != q.shape[1]:
                    continue
                rid = batch.column(0).to_numpy(zero_copy_only=False)[ok].astype(np.int64)
                fits = firm_of[:, None] == batch.column(2).to_numpy()[ok][None]
                fits &= anywhere[:, None] | (loose_of[:, None] == batch.column(3).to_numpy()[ok][None])
                scores = np.where(fits, np.round(q @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6), -np.inf)
                s = np.concatenate([best_s, scores], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(rid, (len(ids), len(rid)))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            kept = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, kept.sum(1))), pa.array(best_i[kept]), pa.array(best_s[kept])], ["query_id", "key", "score"]
            )

        rows = vectors.select(F.col(key).cast("bigint"), embedding, tags[0].alias("a"), tags[1].alias("b"))
        parts.append(rows.mapInArrow(run, "query_id bigint, key bigint, score double"))
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key), key, k)


def min_max(ranked: DataFrame, score: str = "score", out: str = "norm") -> DataFrame:
    """Scores of a query scaled to [0, 1]; a constant list gives 1 if positive, else 0."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return ranked.withColumn(out, F.when(hi == lo, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def weighted_rrf(branches: dict[str, tuple[DataFrame, float]], key: str, k: int = 60, limit: int | None = None) -> DataFrame:
    """(query_id, key, score, sources, rank): reciprocal-rank fusion of any number of branches.

    A union and one aggregation, never an outer join. A chunk that a branch lists
    twice keeps its last rank.
    """
    parts = [df.select("query_id", key, F.lit(name).alias("branch"), "rank", F.lit(float(w)).alias("weight")) for name, (df, w) in branches.items()]
    each = reduce(DataFrame.unionByName, parts).groupBy("query_id", key, "branch", "weight").agg(F.max("rank").alias("rank"))
    fused = each.groupBy("query_id", key).agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 8).alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "branch", "rank"))), ",").alias("sources"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    fused = fused.withColumn("rank", F.row_number().over(order))
    return fused.where(F.col("rank") <= limit) if limit else fused


def support(hits: DataFrame) -> DataFrame:
    """Support of a hit from its three norms."""
    return hits.withColumn("support", F.round(0.5 * F.col("rerank_norm") + 0.3 * F.col("dense_norm") + 0.2 * F.col("bm25_norm"), 6))
