"""Conversation state over turns, and questions rewritten from it.

Turns are folded per session in order. What a turn states (amounts, dates, names, intent,
focus, correction) is read from its text by column expressions; only the fold that carries
slots from turn to turn runs per session, in Arrow batches of one session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import AMOUNT, CAPITALISED, DATE, FILE_NAME, MESSAGE_REF, found, intent

# Wording of follow-ups, corrections, focus phrases and decisions.
FOLLOW_UP = r"(?i)^and\s+\w+|^(what|when|who)\s+about\b|^(and when|and who|and where)\??$|^(no,\s*)?i meant\b"
CORRECTION = r"^(?:(?:no,\s*)?i meant (.+)|not that (.+)|the (earlier attachment|earlier email|latest attachment|final version))$"
FOCUS_ABOUT = r"(?i)what (?:were|was) the (.+?) about$|what does the (attachment|email|pdf|docx|document) say$|which (territories) are mentioned(?: in the attachment)?$"
FOCUS_NOUN = r"(?i)\b(?:about|regarding|for)\s+(.+)$"
FOCUS_NONE = ("and ", "when ", "who ", "what about")
COMPARING = r"compare|difference|changed|draft|final"
DECISION = r"(?i)\b(approved|rejected|finalized|signed off|selected)\b"
LABELLED = r"(?i)^(?:Instructions|Topic|Audience|Company|Territories|Supply request month|Deadline|Email due date|From|To|CC|Subject|Sent date):\s*(.+)$"
# Marks of a prompt that a rewritten question must not repeat, and words it must keep.
LEAKED = ("active thread:", "recent turns:", "current focus:", "memory:", "question:", "rewrite:", "user:", "assistant:", "people=", "dates=", "amounts=", "filenames=", "last_attachment=", "last_user_intent=", "last_answer_focus=", "current_focus=", "comparison_target=", "correction_override=")
ANCHORS = ("from", "to", "cc", "subject", "attachment", "email", "pdf")
SLOTS = ("amounts", "dates", "filenames", "message_ids", "people")
STATE = (
    "amounts array<string>, dates array<string>, filenames array<string>, message_ids array<string>, people array<string>, "
    "last_user_intent string, comparison_target string, correction_override string, current_focus string, last_answer_focus string, "
    "last_attachment string, last_subject string, last_decision string"
)
_KEPT = [x.strip().split()[0] for x in STATE.split(", ")]


def _some(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _groups(text: Column, pattern: str, n: int) -> Column:
    return _some(*[F.trim(F.regexp_extract(text, pattern, i + 1)) for i in range(n)])


def turn_signals(turns: DataFrame) -> DataFrame:
    """Turns with what each states. turns: session_id, turn_no, role (user, assistant, switch or reset), text."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(F.trim(text))
    bare = F.regexp_replace(F.trim(text), r"[?.!]+$", "")
    starts = F.lit(False)
    for word in FOCUS_NONE:
        starts = starts | F.lower(bare).startswith(word)
    answer = F.trim(F.regexp_replace(text, r"\s*\[msg:[^\]]+\]", ""))
    said = F.when(~F.lower(answer).startswith("i could not confirm"), _some(F.trim(F.regexp_extract(answer, LABELLED, 1)), F.trim(F.substring_index(answer, ".", 1))))
    return turns.select(
        "*",
        *[found(text, p).alias(f"_{slot}") for slot, p in zip(SLOTS, (AMOUNT, DATE, FILE_NAME, MESSAGE_REF, CAPITALISED))],
        intent(text).alias("_intent"),
        low.rlike(FOLLOW_UP).alias("_follow_up"),
        low.rlike(COMPARING).alias("_compares"),
        _groups(low, CORRECTION, 3).alias("_correction"),
        F.coalesce(_groups(F.lower(bare), FOCUS_ABOUT, 3), F.when(~starts, _groups(bare, FOCUS_NOUN, 1))).alias("_focus"),
        low.contains("pdf").alias("_pdf"),
        low.contains("docx").alias("_docx"),
        said.alias("_said"),
        F.lower(F.regexp_extract(text, DECISION, 1)).alias("_decision"),
    )


def fold_session(turns: list[dict]) -> list[dict]:
    """State after each turn of one session, in order; ``hits`` of a turn are (name, subject, sender, message_id, at)."""
    blank = lambda: {k: ([] if k in SLOTS else None) for k in _KEPT}
    state, out = blank(), []

    def gather(slot: str, values) -> None:
        state[slot] = list(dict.fromkeys([*state[slot], *(v.strip() for v in values if v and v.strip())]))

    for t in turns:
        if t["role"] in ("switch", "reset"):
            state = blank()
        elif t["role"] == "user":
            for slot in SLOTS:
                gather(slot, t[f"_{slot}"])
            follow = bool(t["_follow_up"])
            if not (follow and t["_intent"] in ("time", "general") and state["last_user_intent"]):
                state["last_user_intent"] = t["_intent"]
            if t["_compares"]:
                state["comparison_target"] = t["text"].strip()
            ending = ".pdf" if t["_pdf"] else ".docx" if t["_docx"] else None
            named = [f for f in state["filenames"] if ending and f.lower().endswith(ending)]
            correction = t["_correction"] or (named[-1] if named else "pdf" if t["_pdf"] else None)
            if correction:
                state["correction_override"] = state["current_focus"] = correction
            elif follow:
                known = (state[k] for k in ("correction_override", "last_answer_focus", "last_attachment", "last_subject", "current_focus"))
                state["current_focus"] = next((k for k in known if k), None)
            elif t["_focus"]:
                state["current_focus"] = t["_focus"]
        else:
            hits = t.get("hits")
            hits = [] if hits is None else list(hits)
            files = [h for h in hits if h["name"]]
            if files:
                newest = max(files, key=lambda h: h["at"])
                state["last_attachment"] = state["current_focus"] = newest["name"]
                gather("filenames", [h["name"] for h in files])
            if hits and hits[0]["subject"]:
                state["last_subject"] = hits[0]["subject"]
                state["current_focus"] = state["current_focus"] or hits[0]["subject"]
            gather("message_ids", [h["message_id"] for h in hits])
            gather("people", [h["sender"] for h in hits])
            if t["_decision"]:
                state["last_decision"] = t["_decision"]
            if t["_said"]:
                state["last_answer_focus"] = state["current_focus"] = t["_said"]
        out.append({k: list(v) if isinstance(v, list) else v for k, v in state.items()})
    return out


def session_states(turns: DataFrame) -> DataFrame:
    """(session_id, turn_no, role, text, slots...): the state after every turn of every session."""
    signals = turn_signals(turns)
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    schema = f"session_id {kinds['session_id']}, turn_no {kinds['turn_no']}, role string, text string, {STATE}"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("turn_no").to_dict("records")
        for r in rows:
            r["text"] = r["text"] or ""
        states = fold_session(rows)
        return pd.DataFrame([{k: r[k] for k in ("session_id", "turn_no", "role", "text")} | s for r, s in zip(rows, states)])

    return signals.groupBy("session_id").applyInPandas(run, schema)


def rewritten(states: DataFrame, thread: Column) -> DataFrame:
    """Adds ``query_text`` to user turns: pronouns and bare follow-ups filled in from the state."""
    text = F.trim("text")
    focus = _some(*[F.col(c) for c in ("correction_override", "current_focus", "last_answer_focus", "last_attachment", "last_subject", "last_decision", "comparison_target")], thread)
    place = _some(F.col("last_subject"), thread)
    filled = F.when(focus.isNotNull(), F.regexp_replace(text, F.lit(r"(?i)\b(it|that|this|those)\b"), F.regexp_replace(focus, r"([\\$])", r"\\$1"))).otherwise(text)
    # Words of time and what they stand for in a search.
    for word, whole in (("earlier", "earlier version"), ("previous", "previous message"), ("latest", "latest version"), ("final", "final version")):
        filled = F.regexp_replace(filled, rf"(?i)\b{word}\b", whole)
    corrected = F.nullif(F.col("correction_override"), F.lit(""))
    filled = F.when(corrected.isNotNull(), F.concat(filled, F.lit(" focus on "), corrected)).otherwise(filled)
    query = (
        F.when(text.rlike(r"(?i)^and when\??$"), F.when((F.col("last_user_intent") == "deadline") & focus.isNotNull(), F.concat(F.lit("When is the deadline for "), focus, F.lit("?"))).otherwise(F.concat(F.lit("When was "), focus, F.lit(" mentioned in "), place, F.lit("?"))))
        .when(text.rlike(r"(?i)^compare it\??$"), F.concat(F.lit("Compare "), focus, F.lit(" earlier draft versus final version")))
        .when(text.rlike(r"(?i)^and who\??$"), F.concat(F.lit("Who is associated with "), focus, F.lit(" in "), place, F.lit("?")))
        .otherwise(filled)
    )
    return states.withColumn("query_text", F.when(F.col("role") == "user", query))


def usable_rewrite(output: Column, question: Column) -> Column:
    """Whether a model's rewritten question may be used: new, short, one line, no trace of the prompt."""
    text = F.trim(F.coalesce(output, F.lit("")))
    leaked = F.lit(False)
    for mark in LEAKED:
        leaked = leaked | F.lower(text).contains(mark)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        (text != "") & (F.lower(text) != F.lower(F.trim(question))) & ~leaked & (F.length(text) <= 240) & (F.size(F.split(text, r"\s+")) <= 40) & (lines <= 1) & F.lower(text).rlike("[a-z0-9]")
    )


def anchored(rewrite: Column, question: Column) -> Column:
    """A rewritten question with the words of intent it has lost in front of it."""
    lost = F.filter(F.array(*[F.when(question.rlike(rf"(?i)\b{a}\b") & ~F.lower(rewrite).contains(a), F.lit(a)) for a in ANCHORS]), lambda x: x.isNotNull())
    return F.concat_ws(" ", F.nullif(F.array_join(lost, " "), F.lit("")), rewrite)


def recent_turns(turns: DataFrame, most: int = 8) -> DataFrame:
    """The last turns of each session since its last switch or reset, in order."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_no"))
    cleared = F.sum(F.col("role").isin("switch", "reset").cast("int")).over(w)
    return turns.withColumn("_cleared", cleared).where("_cleared = 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n", "_cleared")
