"""The k most cosine-similar vectors of every vector: inverted file, exact scores.

1. Vectors of one direction, equal up to an exact factor, are folded into one class
   that keeps its k + 1 smallest ids: no other copy can be among anybody's k nearest
   under the tie rule. Any group of such copies is one indexed vector and one query.
2. Coarse centroids are fitted on a bounded sample (``train_rows``); centroids nearer
   than ``apart`` become one, so copies whose directions differ by float rounding
   only aren't dealt out to more lists than are probed. Every vector has a list.
3. Each vector probes its ``probes`` nearest lists. A (list, member block, query
   block) group holds at most ``block`` members and ``block`` queries; every query is
   scored with every member in double precision, and ties keep the smaller ids.
4. The best k + 1 of all probed lists are merged per query, and each member of the
   query's class leaves itself out.

Defined results
  * null, all-zero, non-finite vectors, and those of another length than most, are
    neither queries nor answers
  * similarity is rounded to 12 digits; ties go to the smaller id
  * fewer than k + 1 usable vectors: all others are answers; an empty table: no rows
  * ids are taken as given: a repeated id with another vector stands for both
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.runtime import materialize, spread


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means in float32, distances in row blocks; empty cells take far rows."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a, far = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        n = np.bincount(a, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    near, gap, half = np.empty(len(x), np.int64), np.empty(len(x), np.float32), (c * c).sum(1) / 2
    for i in range(0, len(x), rows):
        s = half - x[i : i + rows] @ c.T
        near[i : i + rows] = s.argmin(1)
        gap[i : i + rows] = s.min(1)
    return near, gap


class Index:
    """Centroids; a few hundred kB to 2 MB, sent with the tasks."""

    def __init__(self, sample: np.ndarray, lists: int, apart: float, rounds: int = 8):
        unit = _unit(sample).astype(np.float32)
        c = _kmeans(unit, lists, rounds, np.random.default_rng(7))
        keep = np.ones(len(c), bool)
        for at in range(0, len(c), 1024):
            rows = c[at : at + 1024].astype(np.float64)
            gap = (rows**2).sum(1)[:, None] + (c.astype(np.float64) ** 2).sum(1) - 2 * rows @ c.T.astype(np.float64)
            keep[at : at + 1024] = ~np.tril(gap < apart**2, at - 1).any(1)
        self.centroids = c[keep]

    def assign(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Probed lists of each row, nearest first."""
        half = (self.centroids**2).sum(1) / 2
        s = half - unit @ self.centroids.T
        probes = min(probes, s.shape[1])
        top = np.argpartition(s, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def best_of(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest scores, in column order; of equal ones the first columns."""
    k = min(k, score.shape[1])
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    above, equal = score > least, score == least
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)
    return np.nonzero(above | equal)[1].reshape(len(score), k)


def _usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, vec binary, vkey binary): float32 bytes of each non-null, finite, non-zero vector; key of its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, keys = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or len(v) == 0 or v.values.null_count:
                    continue
                a = v.values.to_numpy(zero_copy_only=False).astype(np.float32)
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    out.append((a + np.float32(0)).tobytes())
                    keys.append(md5((np.round(_unit(a[None])[0], 14) + 0.0).tobytes()).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(keys, pa.binary())], ["id", "vec", "vkey"])

    return spread(vectors.select(F.col(key).cast("bigint"), F.col(embedding).cast("array<float>"))).mapInArrow(run, "id bigint, vec binary, vkey binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_neighbours(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    k: int = 5,
    per_list: int = 64,
    max_lists: int = 8192,
    probes: int = 8,
    train_rows: int = 65536,
    block: int = 2048,
    apart: float = 0.01,
) -> DataFrame:
    """(id, neighbour, rank, similarity): the k nearest of every usable vector.

    ``per_list`` fixes the mean list length, so work grows with the number of
    vectors until ``max_lists`` is reached, or a dense group fills a list of its own.
    ``train_rows`` bounds the sample the centroids are fitted on; everything else
    covers all rows.
    """
    spark = vectors.sparkSession
    out = "id bigint, neighbour bigint, rank int, similarity double"
    usable = materialize(_usable(vectors, key, embedding), "vectors")
    sizes = usable.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    usable = usable.where(F.length("vec") == sizes[0]["n"])

    low = Window.partitionBy("vkey").orderBy("id")
    classes = materialize(
        usable.withColumn("n", F.row_number().over(low))
        .where(F.col("n") <= k + 1)
        .groupBy("vkey")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"), F.min_by("vec", "id").alias("vec"))
        .withColumn("cid", F.element_at("ids", 1)),
        "vector-classes",
    )
    total = classes.count()
    part = min(1.0, train_rows / total)
    sampled = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("vec")
    sample = _matrix([r[0] for r in sampled.limit(train_rows).collect()] or [r[0] for r in classes.select("vec").limit(1).collect()])
    lists = int(min(max_lists, max(1, total // per_list), len(sample)))
    index = spark.sparkContext.broadcast(Index(sample, lists, apart))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                top = ix.assign(_unit(_matrix(b.column(1).to_pylist())).astype(np.float32), probes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(list(top.astype(np.int32)), pa.list_(pa.int32()))], ["cid", "vec", "probe"]
                )

    indexed = materialize(classes.select("cid", "vec").mapInArrow(assign, "cid bigint, vec binary, probe array<int>"), "vector-index")
    # a row a list at most: how many blocks its members and its queries make
    load = (
        indexed.select(F.posexplode("probe").alias("pos", "list"))
        .groupBy("list")
        .agg(
            F.ceil(F.count_if(F.col("pos") == 0) / block).cast("int").alias("member_blocks"),
            F.ceil(F.count("*") / block).cast("int").alias("query_blocks"),
        )
    )
    span = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    members = (
        indexed.select("cid", "vec", F.element_at("probe", 1).alias("list"))
        .join(load, "list")
        .withColumn("mb", F.pmod(F.xxhash64("cid"), F.col("member_blocks")).cast("int"))
        .withColumn("qb", span("query_blocks"))
        .select("list", "mb", "qb", "cid", "vec")
        .toDF("list", "mb", "qb", "cid", "vec")  # both sides of the cogroup come from one table
    )
    queries = (
        indexed.select("cid", "vec", F.explode("probe").alias("list"))
        .join(load.where("member_blocks > 0"), "list")
        .withColumn("qb", F.pmod(F.xxhash64("cid"), F.col("query_blocks")).cast("int"))
        .withColumn("mb", span("member_blocks"))
        .select("list", "mb", "qb", "cid", "vec")
        .toDF("list", "mb", "qb", "cid", "vec")
    )
    found_schema = "cid bigint, other bigint, similarity double"

    def search(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"cid": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64"), "similarity": pd.Series([], dtype="float64")})
        if not len(q) or not len(m):
            return empty
        m = m.sort_values("cid")
        mx, mid = _unit(_matrix(m["vec"].tolist())), m["cid"].to_numpy()
        parts = []
        for at in range(0, len(q), 512):
            qs = q.iloc[at : at + 512]
            qx, qid = _unit(_matrix(qs["vec"].tolist())), qs["cid"].to_numpy()
            exact = np.round(qx @ mx.T, 12)
            order = best_of(exact, k + 1)
            ids = mid[order]
            parts.append(
                pd.DataFrame(
                    {"cid": np.repeat(qid, order.shape[1]), "other": ids.ravel(), "similarity": np.take_along_axis(exact, order, 1).ravel()}
                )
            )
        return pd.concat(parts)

    block_key = ["list", "mb", "qb"]
    found = queries.groupBy(*block_key).cogroup(members.groupBy(*block_key)).applyInPandas(search, found_schema)
    best = Window.partitionBy("cid").orderBy(F.desc("similarity"), "other")
    nearest = (
        found.withColumn("n", F.row_number().over(best))
        .where(F.col("n") <= k + 1)
        .join(classes.select(F.col("cid").alias("other"), "ids"), "other")
        .select("cid", F.explode("ids").alias("id"), F.negative("similarity").alias("far"))
        .groupBy("cid")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("near"))
        .join(classes.select("cid", "vkey"), "cid")
        .select("vkey", "near")
    )
    return (
        usable.select("id", "vkey")
        .join(nearest, "vkey")
        .select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
        .select("id", F.posexplode("near").alias("pos", "x"))
        .select(
            "id",
            F.col("x.id").alias("neighbour"),
            (F.col("pos") + 1).cast("int").alias("rank"),
            F.negative("x.far").alias("similarity"),
        )
    )


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b) with a < b: one is among the nearest of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
