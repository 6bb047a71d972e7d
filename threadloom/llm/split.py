r"""Splitting oversized texts at natural boundaries, with overlap.

A text over ``limit`` tokens (maximal runs of letters, digits and underscores) is
consumed from left to right by one regular expression whose alternatives are
ordered by the strength of the boundary they end at: end of text, paragraph,
sentence, line, white space, any token end, and single characters as the last
resort. Bounded quantifiers hold each step to at most ``limit - overlap`` tokens
and, but for the weak alternatives, at least half of that. Each later piece then
reaches back over up to ``overlap`` tokens of the step before, starting after a
sentence or line end where one lies in the nearer part of that stretch. All of it
is JVM-side: no Python process, no shuffle.

Every piece is a substring of the text, the steps without their overlap joined
give the text again, and no token is ever cut (a token is never longer than the
limit, which counts tokens).

Defined results
  * null text: no piece; empty or blank text, and a text within the limit: one piece
  * null source_start: offsets count from the start of the text itself
  * repeated rows give their pieces each; extra columns pass through
  * runs without any token are cut at ``max_gap`` characters
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.runtime import spread

TOKEN = r"[\p{L}\p{N}_]"
GAP = r"[^\p{L}\p{N}_]"


def step_pattern(most: int, least: int, max_gap: int = 4000) -> str:
    """One step: at most ``most`` tokens, at the strongest boundary after ``least``."""
    run = rf"(?:{GAP}*+{TOKEN}++)"
    line_gap = r"[^\p{L}\p{N}_\n]*+"
    sentence_end = r"(?:[^\p{L}\p{N}_\s]*+(?<=[.!?…:;][^\p{L}\p{N}_\s]{0,4})\s++)"
    return "|".join(
        [
            rf"(?s:(?=.){run}{{0,{most}}}+{GAP}{{0,{max_gap}}}+\z)",
            rf"{run}{{{least},{most}}}{line_gap}\n[ \t\r]*+\n\s*+",
            rf"{run}{{{least},{most}}}{sentence_end}",
            rf"{run}{{{least},{most}}}{line_gap}\n",
            rf"{run}{{{least},{most}}}[^\p{{L}}\p{{N}}_\s]*+\s++",
            rf"{run}{{1,{most}}}",
            rf"(?s:{GAP}{{1,{max_gap}}})",
        ]
    )


def _lookback_patterns(overlap: int) -> list[str]:
    """Patterns for the start of the reversed step before a cut, strongest first."""
    run = rf"(?:{GAP}*+{TOKEN}++)"
    near = max(1, overlap * 3 // 5)
    return [
        rf"^({run}{{{near},{overlap}}})(?=[^\p{{L}}\p{{N}}_]*?\s[\"'”’)\]]*[.!?…])",
        rf"^({run}{{{near},{overlap}}})(?=[^\p{{L}}\p{{N}}_\n]*\n)",
        rf"^({run}{{1,{overlap}}})",
    ]


def token_count(text: Column) -> Column:
    """Tokens of a text: maximal runs of letters, digits and underscores."""
    return F.regexp_count(text, F.lit(rf"{TOKEN}+"))


def split_oversized(
    rows: DataFrame, text: str = "text", limit: int = 450, overlap: int = 50, source_start: str | None = "source_start"
) -> DataFrame:
    """Input columns plus piece_no, pieces, piece_start, piece_end, piece_source_start,
    piece_source_end, piece_text and piece_token_count; a row for each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    most = limit - overlap
    pattern = step_pattern(most, max(1, most // 2))
    over = token_count(F.col(text)) > limit
    steps = F.when(over, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array(F.col(text)))
    # code-point offsets of the steps: a running sum
    starts = F.aggregate(
        F.transform("_steps", F.length),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    before = F.reverse(F.get("_steps", F.col("piece_no") - 1))
    back = F.lit(0)
    if overlap:
        found = [F.length(F.regexp_extract(before, p, 1)) for p in _lookback_patterns(overlap)]
        back = F.coalesce(*[F.when(f > 0, f) for f in found], F.lit(0))
    kept = [c for c in rows.columns if c != "_steps" and c != "_starts"]
    cut = (
        spread(rows.where(F.col(text).isNotNull()))
        .withColumn("_steps", steps)
        .withColumn("_starts", starts)
        .select("*", F.posexplode("_steps").alias("piece_no", "_step"))
        .withColumn("_back", F.when(F.col("piece_no") > 0, back).otherwise(0))
        .withColumn("piece_start", F.get("_starts", F.col("piece_no")) - F.col("_back"))
        .withColumn("piece_end", F.get("_starts", F.col("piece_no") + 1))
        .withColumn("piece_text", F.substring(F.col(text), F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")))
    )
    base = F.coalesce(F.col(source_start), F.lit(0)) if source_start else F.lit(0)
    return cut.select(
        *kept,
        "piece_no",
        F.size("_steps").alias("pieces"),
        "piece_start",
        "piece_end",
        (base + F.col("piece_start")).alias("piece_source_start"),
        (base + F.col("piece_end")).alias("piece_source_end"),
        "piece_text",
        token_count(F.col("piece_text")).alias("piece_token_count"),
    )
