"""Writers: JSON lines, scoped tables, and the persisted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import tokenize
from threadloom.operators.retrieval import postings


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a row; nulls are kept, so every line has every field."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_scoped(rows: DataFrame, path: str, scope: tuple[str, ...] = ("tenant_id", "mailbox_id")) -> None:
    """Parquet partitioned by scope; only the scopes in ``rows`` are replaced.

    Rows are gathered by scope before the write, so a scope gets few files; a scope
    that is too large for one is split by its rows' hash.
    """
    (
        rows.repartition(*scope, F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(*scope)
        .parquet(path)
    )


def write_lexical_index(chunks: DataFrame, path: str, key: str, text: Column, buckets: int = 64) -> None:
    """postings (by term bucket), terms and lengths: what scoring needs, written once."""
    index = postings(chunks, key, text)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    index.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{path}/terms")
    chunks.select(key, F.size(tokenize(F.lower(text))).alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")


def read_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """Postings of a few terms: only their buckets are read."""
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(terms)).drop("bucket")
