"""Hybrid search: lexical, dense and graph branches within a scope, fused and reranked.

Every question carries tenant_id and mailbox_id, which restrict all branches, and a
thread_id that restricts them where it isn't null. Statistics cover the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import tokenize
from threadloom.operators.retrieval import dense_top_k, min_max, support, weighted_rrf
from threadloom.runtime import materialize

SCOPE = ("tenant_id", "mailbox_id")
#: candidates of a branch for ``limit`` fused hits
LEAST_CANDIDATES, PER_HIT = 40, 4


def scoped_postings(chunks: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, tenant_id, mailbox_id, thread_id, term, tf, dl): the inverted index with the scope of each posting."""
    words = chunks.select(key, *SCOPE, "thread_id", tokenize(F.lower(text)).alias("ts"))
    exploded = words.select(key, *SCOPE, "thread_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return exploded.groupBy(key, *SCOPE, "thread_id", "term", "dl").agg(F.count("*").alias("tf"))


def term_weights(index: DataFrame, chunks: DataFrame, questions: DataFrame, query: str = "query_text", epsilon: float = 0.25) -> tuple[DataFrame, float]:
    """((query_id, term, w), mean length): Okapi weights of every question's terms.

    A negative idf becomes ``epsilon`` times the mean idf over all terms.
    """
    n = chunks.count()
    total = index.agg(F.sum("tf")).first()[0] or 0
    idf = index.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = (idf.agg(F.avg("idf")).first()[0] or 0.0) * epsilon
    terms = questions.select("query_id", F.explode(tokenize(F.lower(F.col(query)))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return terms.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.when(F.col("idf") < 0, floor).otherwise(F.col("idf"))).alias("w")), total / max(n, 1)


def impact_top_k(index: DataFrame, weights: DataFrame, questions: DataFrame, key: str, k: int, impact: Column, scoped: bool = True) -> DataFrame:
    """(query_id, key, score, rank): the k best chunks of every question by summed term impacts.

    Exact, without scoring every chunk that shares a common word: the rarest terms of a
    question give a k-th score no worse than ``theta``; terms whose greatest impacts in the
    corpus together stay below it can't bring a new chunk among the k best, so only the
    other terms propose chunks, of which only those that can still reach it are completed.
    impact: of one posting with weight 1, from tf and dl. Ties by key.
    """
    scope = [*SCOPE, "thread_id"] if scoped else []
    asked = questions.select("query_id", *scope).withColumnsRenamed({c: f"_{c}" for c in scope})
    postings = index if scoped else index.select(key, "term", "tf", "dl")
    inside = F.expr("tenant_id = _tenant_id and mailbox_id = _mailbox_id and (_thread_id is null or thread_id = _thread_id)") if scoped else F.lit(True)
    df = postings.join(weights.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.max(impact).alias("most"))
    rare = Window.partitionBy("query_id").orderBy("df", "term")
    known = materialize(weights.join(df, "term").withColumn("before", F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "query-terms")

    def matched(terms: DataFrame) -> DataFrame:
        return terms.join(asked, "query_id").join(postings, "term").where(inside)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    first = matched(known.where(F.col("before") < 20 * k)).groupBy("query_id", key).agg(F.sum(F.col("w") * impact).alias("score"))
    theta = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", (F.col("score") - 1e-6).alias("theta"))
    low = Window.partitionBy("query_id").orderBy(F.col("w") * F.col("most"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = materialize(known.join(theta, "query_id", "left").withColumn("ceiling", F.sum(F.col("w") * F.col("most")).over(low)), "ranked-terms")
    needed = F.col("theta").isNull() | (F.col("ceiling") >= F.col("theta"))
    partial = matched(ranked.where(needed).select("query_id", "term", "w")).groupBy("query_id", key).agg(F.sum(F.col("w") * impact).alias("part"))
    # what the terms left out can add at most decides which chunks are worth completing
    rest = ranked.where(~needed)
    bounds = ranked.groupBy("query_id").agg(F.max("theta").alias("theta"), F.coalesce(F.max(F.when(~needed, F.col("ceiling"))), F.lit(0.0)).alias("more"))
    near = partial.join(bounds, "query_id").where(F.col("theta").isNull() | (F.col("part") + F.col("more") >= F.col("theta"))).select("query_id", key, "part")
    added = (
        near.select("query_id", key).join(rest.select("query_id", "term", "w"), "query_id").join(postings.select(key, "term", "tf", "dl"), [key, "term"]).select("query_id", key, (F.col("w") * impact).alias("part"))
    )
    scored = near.unionByName(added).groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def lexical_top_k(index: DataFrame, chunks: DataFrame, questions: DataFrame, key: str, k: int, k1: float = 1.5, b: float = 0.75, scoped: bool = True) -> DataFrame:
    """(query_id, key, score, rank): BM25 over chunks that share a term with the question."""
    weights, mean = term_weights(index, chunks, questions)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / float(mean or 1.0))
    return impact_top_k(index, weights, questions, key, k, F.col("tf") * (k1 + 1) / norm, scoped)


def recall_top_k(index: DataFrame, questions: DataFrame, key: str, k: int, scoped: bool = True) -> DataFrame:
    """(query_id, key, score, rank): share of the distinct question tokens that a chunk has."""
    terms = questions.select("query_id", F.array_distinct(tokenize(F.lower("query_text"))).alias("ts"))
    weights = terms.select("query_id", (1.0 / F.size("ts")).alias("w"), F.explode("ts").alias("term"))
    return impact_top_k(index, weights, questions, key, k, F.lit(1.0), scoped)


def filled(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, key: str, k: int) -> DataFrame:
    """A list shorter than k goes on with chunks of the scope that match nothing, score 0, by key.

    Only the first k chunks of a scope (and of a thread) can be needed, so no question
    meets its whole mailbox.
    """
    scope = Window.partitionBy(*SCOPE).orderBy(key)
    thread = Window.partitionBy(*SCOPE, "thread_id").orderBy(key)
    rows = chunks.select(key, *SCOPE, "thread_id")
    # k matches and k first chunks can overlap, so 2k firsts are enough for k others
    firsts = rows.withColumn("n", F.row_number().over(scope)).where(F.col("n") <= 2 * k).drop("n")
    firsts_of_threads = rows.where("thread_id is not null").withColumn("n", F.row_number().over(thread)).where(F.col("n") <= 2 * k).drop("n")
    whole = questions.where("thread_id is null").select("query_id", *SCOPE).join(firsts, list(SCOPE)).select("query_id", key)
    narrow = questions.where("thread_id is not null").select("query_id", *SCOPE, "thread_id").join(firsts_of_threads, [*SCOPE, "thread_id"]).select("query_id", key)
    rest = whole.unionByName(narrow).join(ranked.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return ranked.select("query_id", key, "score").unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_share(query: Column, passage: Column) -> Column:
    """Rerank score without a model: share of the distinct question tokens that a passage has."""
    asked = F.array_distinct(tokenize(F.lower(query)))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokenize(F.lower(passage)))) / F.size(asked)).otherwise(0.0)


def reranked(fused: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k best fused hits by rerank score, with norms, support and place; ties keep the fused rank.

    fused: query_id, query_text, text, rank, bm25_score, dense_score (null where a branch
    hasn't the hit). ``score`` may come from any model; the default is ``token_share``.
    """
    hits = fused.withColumn("rerank_score", F.round(score if score is not None else token_share(F.col("query_text"), F.col("text")), 6))
    for c, out in (("bm25_score", "bm25_norm"), ("dense_score", "dense_norm"), ("rerank_score", "rerank_norm")):
        hits = min_max(hits.withColumn(c, F.coalesce(c, F.lit(0.0))), c, out)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_norm", 6)), "rank")
    return support(hits).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hybrid(
    chunks: DataFrame,
    index: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    graph: DataFrame | None = None,
    key: str = "chunk_key",
    limit: int = 10,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    rrf_k: int = 60,
) -> DataFrame:
    """(query_id, key, score, rank, lexical_rank, dense_rank, graph_rank, sources, bm25_score, dense_score).

    chunks: key, scope, thread_id; vectors: key, scope, thread_id, embedding; questions:
    query_id, query_text, scope, thread_id, embedding (null: no dense branch); graph: query_id,
    key, rank, whose chunks are scoped again here. A question without graph evidence is
    plain hybrid search. No chunk of another tenant, mailbox or wanted thread is ever returned.
    """
    candidates = max(LEAST_CANDIDATES, PER_HIT * limit)
    lexical = lexical_top_k(index, chunks, questions, key, candidates).withColumnRenamed("score", "bm25_score")
    dense = dense_top_k(vectors, questions.where("embedding is not null"), key, "embedding", candidates, scope=(*SCOPE, "thread_id")).withColumnRenamed("score", "dense_score")
    lexical, dense = materialize(lexical, "lexical-branch"), materialize(dense, "dense-branch")
    branches = {"bm25": (lexical, weights[0]), "dense": (dense, weights[1])}
    listed = [lexical.select("query_id", key, F.col("rank").alias("lexical_rank"), "bm25_score"), dense.select("query_id", key, F.col("rank").alias("dense_rank"), "dense_score")]
    if graph is not None:
        asked = questions.select("query_id", *[F.col(c).alias(f"_{c}") for c in (*SCOPE, "thread_id")])
        inside = F.expr("tenant_id = _tenant_id and mailbox_id = _mailbox_id and (_thread_id is null or thread_id = _thread_id)")
        own = graph.join(chunks.select(key, *SCOPE, "thread_id"), key).join(asked, "query_id").where(inside)
        order = Window.partitionBy("query_id").orderBy("rank", key)
        own = materialize(own.select("query_id", key, F.row_number().over(order).alias("rank")), "graph-branch")
        branches["graph"] = (own, weights[2])
        listed.append(own.select("query_id", key, F.col("rank").alias("graph_rank")))
    fused = weighted_rrf(branches, key, rrf_k, limit)
    for part in listed:
        fused = fused.join(part, ["query_id", key], "left")
    return fused if graph is not None else fused.withColumn("graph_rank", F.lit(None).cast("int"))


def first_seen_rrf(lists: list[tuple[str, DataFrame]], key: str, k: int = 60, limit: int = 10) -> DataFrame:
    """(query_id, key, score, rank, sources, metrics): unweighted fusion that keeps the greatest of each metric.

    Ties go to the chunk that an earlier list has first. metrics are the columns the lists
    have beside query_id, key and rank; a list without a metric counts as 0.
    """
    metrics = sorted({c for _, df in lists for c in df.columns} - {"query_id", key, "rank"})
    parts = None
    for n, (name, df) in enumerate(lists):
        own = df.select("query_id", key, "rank", F.lit(name).alias("source"), F.struct(F.lit(n), F.col("rank")).alias("seen"), *[F.col(m) if m in df.columns else F.lit(0.0).alias(m) for m in metrics])
        parts = own if parts is None else parts.unionByName(own)
    fused = parts.groupBy("query_id", key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("seen").alias("seen"), *[F.max(m).alias(m) for m in metrics]
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("seen")
