"""Support of drafted clauses by retrieved evidence, and what follows from it.

A clause is held against the evidence its draft names, else against all hits of its
question. Candidates of a clause are the few hits of one question, so everything
about a clause is one group of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import citation_mark, overlap_f1, value_match

#: support a clause needs, and share of factual clauses an answer needs
SUPPORT, COVERAGE = 0.65, 0.70
#: thresholds of a question's evidence: supported hits, support of one, best rerank norm
LEAST_HITS, HIT_SUPPORT, TOP_RERANK = 2, 0.55, 0.45
# Fixed value: the answer that is given instead of one without enough support.
ABSTAINED = "I could not support enough of that answer from the selected evidence."


def support_text(text: Column, attachment_name: Column, subject: Column, sender: Column, sent_at: Column, *metadata: tuple[str, Column]) -> Column:
    """All a hit can support: its text, then what is known about it, a line each; empty parts left out."""
    def kept(c):
        return F.nullif(c, F.lit(""))

    def rendered(name: str, c: Column) -> Column:
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))

    return F.concat_ws(
        "\n", kept(text), kept(attachment_name), kept(subject), rendered("from", sender), kept(sender), F.date_format(sent_at, "yyyy-MM-dd"),
        *[rendered(name, c) for name, c in metadata],
    )


def clause_support(clauses: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, clause_no, clause, factual, dual, kept, support, f1, match, marks, chunk_ids).

    clauses: query_id, clause_no, clause, factual, dual (needs two hits together), named
    (chunk ids, or null for all hits). hits: query_id, chunk_id, place, evidence (what
    it can support), message_id, page_no, kind.
    """
    said = F.regexp_replace(F.regexp_replace("clause", r"(?s)^[^:]*:", ""), r"^\s+|\s+$", "")
    named = F.coalesce(F.size("named"), F.lit(0)) > 0
    candidates = (
        clauses.select("query_id", "clause_no", "clause", "factual", "dual", "named")
        .where("factual")
        .withColumn("said", F.when(F.col("clause").contains(":"), said).otherwise(F.col("clause")))
        .join(hits, "query_id")
        .where(~named | F.array_contains("named", F.col("chunk_id")))
        .withColumn("f1", overlap_f1(F.col("said"), F.col("evidence")))
        .withColumn("match", value_match(F.col("said"), F.col("evidence")))
        .withColumn("support", 0.6 * F.col("f1") + 0.4 * F.col("match"))
        .withColumn("mark", citation_mark(F.col("message_id"), F.col("page_no"), F.col("kind")))
    )
    one = F.struct(F.negative("support").alias("low"), "place", "f1", "match", "support", "chunk_id", "mark", "evidence")
    ranked = candidates.groupBy("query_id", "clause_no", "said").agg(F.slice(F.sort_array(F.collect_list(one)), 1, 2).alias("best"))
    both = F.array_join(F.transform("best", lambda x: x["evidence"]), " ")
    judged = (
        clauses.join(ranked, ["query_id", "clause_no"], "left")
        .withColumn("first", F.get("best", F.lit(0)))
        .withColumn("pair", F.coalesce(F.col("dual") & (F.size("best") == 2), F.lit(False)))
        .withColumn("f1", F.when(F.col("pair"), overlap_f1(F.col("said"), both)).otherwise(F.coalesce("first.f1", F.lit(0.0))))
        .withColumn("match", F.when(F.col("pair"), value_match(F.col("said"), both)).otherwise(F.coalesce("first.match", F.lit(0.0))))
        .withColumn("support", F.round(0.6 * F.col("f1") + 0.4 * F.col("match"), 6))
    )
    enough = (F.col("support") >= SUPPORT) & F.col("best").isNotNull() & (~F.col("dual") | F.col("pair"))
    cited = F.when(F.col("kept") & F.col("factual"), F.slice("best", F.lit(1), F.when(F.col("dual"), 2).otherwise(1)))
    empty = F.array().cast("array<string>")
    return judged.withColumn("kept", ~F.col("factual") | enough).select(
        "query_id", "clause_no", "clause", "factual", "dual", "kept", "support", F.round("f1", 6).alias("f1"), F.round("match", 6).alias("match"),
        F.coalesce(F.transform(cited, lambda x: x["mark"]), empty).alias("marks"),
        F.coalesce(F.transform(cited, lambda x: x["chunk_id"]), empty).alias("chunk_ids"),
    )


def answers(judged: DataFrame, separator: str = " ") -> DataFrame:
    """(query_id, answer, support, coverage, evidence): the kept clauses with their marks.

    support: mean of the kept factual clauses; coverage: their share of the factual ones;
    evidence: distinct chunks cited. Under ``COVERAGE`` the answer abstains.
    """
    line = F.concat_ws(" ", "clause", F.array_join("marks", " "))
    kept = F.col("kept") & F.col("factual")
    each = judged.withColumn("line", F.when(F.size("marks") > 0, line).otherwise(F.col("clause")))
    whole = each.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("clause_no", "line")))), lambda x: x["line"]), separator).alias("said"),
        F.round(F.coalesce(F.avg(F.when(kept, F.col("support"))), F.lit(0.0)), 6).alias("support"),
        F.count_if("factual").alias("factual"),
        F.round(F.coalesce(F.count_if(kept) / F.nullif(F.count_if("factual"), F.lit(0)), F.lit(0.0)), 6).alias("coverage"),
        F.size(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("evidence"),
    )
    answer = F.when((F.col("factual") > 0) & (F.col("coverage") < COVERAGE), ABSTAINED).otherwise(F.trim("said"))
    return whole.select("query_id", answer.alias("answer"), "support", "coverage", "evidence")


def evidence_reason(hits: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """(query_id, supported, top_support, top_rerank, coverage, reason): why the evidence of a
    question would not do, by the first rule that fails; null if it does."""
    found = hits.groupBy("query_id").agg(
        F.count_if(F.col("support") >= HIT_SUPPORT).alias("supported"), F.max("support").alias("top_support"), F.max("rerank_norm").alias("top_rerank")
    )
    found = found.join(coverage.select("query_id", "coverage"), "query_id", "left") if coverage is not None else found.withColumn("coverage", F.lit(None).cast("double"))
    reason = (
        F.when(F.col("supported") < LEAST_HITS, "insufficient_supported_chunks")
        .when(F.col("top_rerank") < TOP_RERANK, "top_rerank_below_threshold")
        .when(F.col("coverage") < COVERAGE, "citation_coverage_below_threshold")
    )
    return found.withColumn("reason", reason)


def first_hits(*lists: DataFrame) -> DataFrame:
    """Hits of several lists, one after the other, each chunk once: the first list that has it wins."""
    numbered = [x.withColumn("list_no", F.lit(n)) for n, x in enumerate(lists)]
    out = numbered[0]
    for x in numbered[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    w = Window.partitionBy("query_id", "chunk_id").orderBy("list_no", "place")
    order = Window.partitionBy("query_id").orderBy("list_no", "old_place")
    kept = out.withColumn("n", F.row_number().over(w)).where("n = 1").withColumnRenamed("place", "old_place")
    return kept.withColumn("place", F.row_number().over(order)).drop("n", "list_no", "old_place")
