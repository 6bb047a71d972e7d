"""Search, answers, citations, enrichment, conversations, synchronisation and corpus building on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import answers, citations, conversation, enrichment, ingest, search, sync

DAY = dt.datetime(2031, 1, 1)


def test_pruned_lexical_search_equals_scoring_everything(spark):
    import math
    import re

    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(4000)]
    docs = [(i, "t", f"m{i % 2}", f"th{i % 5}", " ".join(words[rng.randrange(3000) :][: rng.randrange(3, 40)])) for i in range(150)]
    chunks = spark.createDataFrame(docs, "k long, tenant_id string, mailbox_id string, thread_id string, text string")
    asked = [(j, " ".join(rng.sample(words, 5)), "t", f"m{j % 2}", f"th{j % 5}" if j % 3 == 0 else None) for j in range(20)]
    questions = spark.createDataFrame(asked, "query_id long, query_text string, tenant_id string, mailbox_id string, thread_id string")
    index = search.scoped_postings(chunks, "k", F.col("text"))
    tok = {i: re.findall(r"\w+", t) for i, _, _, _, t in docs}
    n, mean = len(docs), sum(map(len, tok.values())) / len(docs)
    df = {}
    for ts in tok.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for j, q, _, box, th in asked:
        scores = []
        for i, _, b, h, _ in docs:
            if b == box and th in (None, h):
                s = sum((floor if idf[t] < 0 else idf[t]) * tok[i].count(t) * 2.5 / (tok[i].count(t) + 1.5 * (0.25 + 0.75 * len(tok[i]) / mean)) for t in q.split() if t in tok[i])
                if set(q.split()) & set(tok[i]):
                    scores.append((-round(s, 6), i))
        want[j] = [i for _, i in sorted(scores)[:4]]
    got = {}
    for r in search.lexical_top_k(index, chunks, questions, "k", 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["k"]
    assert {j: [got.get(j, {}).get(r + 1) for r in range(len(want[j]))] for j in want} == want
    full = search.filled(search.lexical_top_k(index, chunks, questions, "k", 4), chunks, questions, "k", 50)
    sizes = {r["query_id"]: r["count"] for r in full.groupBy("query_id").count().collect()}
    assert sizes == {j: min(50, sum(b == box and th in (None, h) for _, _, b, h, _ in docs)) for j, _, _, box, th in asked}


def test_first_seen_fusion(spark):
    a = spark.createDataFrame([(1, 7, 1, 0.5), (1, 8, 2, 0.4)], "query_id long, k long, rank int, bm25 double")
    b = spark.createDataFrame([(1, 9, 1, 0.9), (1, 8, 2, 0.7)], "query_id long, k long, rank int, dense double")
    got = [(r["k"], r["sources"], r["bm25"], r["dense"]) for r in search.first_seen_rrf([("bm25", a), ("dense", b)], "k").orderBy("rank").collect()]
    assert got == [(8, "bm25,dense", 0.4, 0.7), (7, "bm25", 0.5, 0.0), (9, "dense", 0.0, 0.9)]


HITS = "query_id long, chunk_id string, place int, text string, subject string, attachment_name string, kind string, sender string, recipients array<string>, cc array<string>, sent_at timestamp, message_id string, page_no int"


def hits(spark):
    rows = [
        (1, "a", 1, "The budget is 500 euros. It was approved by Ann Lee.", "Budget", None, "email", "ann@x", ["bob@x"], [], DAY + dt.timedelta(days=3), "m1", None),
        (1, "b", 2, "An earlier draft said 400 euros.", "Budget draft", "budget.pdf", "attachment", "bob@x", ["ann@x"], ["c@x"], DAY, "m2", 4),
        (2, "a", 1, "The budget is 500 euros.", "Budget", None, "email", "ann@x", ["bob@x"], [], DAY, "m1", None),
    ]
    return spark.createDataFrame(rows, HITS)


def test_direct_timeline_and_comparison_drafts(spark):
    q = spark.createDataFrame([(1, "what is the budget"), (2, "to whom and from whom"), (3, "nothing")], "query_id long, query_text string")
    said = lambda df: [(r["query_id"], r["clause"], r["factual"], r["dual"]) for r in df.orderBy("query_id", "clause_no").collect()]
    assert said(answers.direct_draft(q, hits(spark))) == [(1, "The budget is 500 euros.", True, False), (2, "From: ann@x", True, False), (2, "To: bob@x", True, False), (3, answers.NO_ANSWER, False, False)]
    assert said(answers.timeline_draft(q, hits(spark)))[:2] == [(1, "On 2031-01-01, An earlier draft said 400 euros.", True, False), (1, "On 2031-01-04, It was approved by Ann Lee.", True, False)]
    c = said(answers.comparison_draft(q, hits(spark), hits(spark)))
    assert c[0][1] == "Earlier draft: An earlier draft said 400 euros." and c[2][3] and c[-1] == (3, answers.NO_VERSIONS, False, False)
    named = spark.createDataFrame([(1, "what does budget.pdf say")], "query_id long, query_text string")
    assert [r["chunk_id"] for r in answers.preferred_hits(named, hits(spark)).collect()] == ["b"]
    assert answers.direct_draft(q, hits(spark).limit(0)).where("factual").count() == 0


def test_clause_support_and_abstention(spark):
    c = F.col
    evidence = hits(spark).withColumn("evidence", citations.support_text(c("text"), c("attachment_name"), c("subject"), c("sender"), c("sent_at"), ("to", F.array_join("recipients", ", "))))
    assert evidence.where("chunk_id = 'b'").first()["evidence"] == "An earlier draft said 400 euros.\nbudget.pdf\nBudget draft\nfrom: bob@x\nbob@x\n2031-01-01\nto: ann@x"
    rows = [(1, 0, "The budget is 500 euros.", True, False, ["a"]), (1, 1, "Difference: The budget is 500 euros. -> An earlier draft said 400 euros.", True, True, ["a", "b"]), (1, 2, "Bananas cost 9 dollars.", True, False, None), (2, 0, "No answer.", False, False, None), (3, 0, "Gone.", True, False, None)]
    clauses = spark.createDataFrame(rows, "query_id long, clause_no int, clause string, factual boolean, dual boolean, named array<string>")
    judged = citations.clause_support(clauses, evidence)
    got = {(r["query_id"], r["clause_no"]): r for r in judged.collect()}
    assert got[1, 0]["kept"] and got[1, 0]["support"] == 1.0 and got[1, 0]["marks"] == ["[msg: m1]"]
    assert sorted(got[1, 1]["marks"]) == ["[msg: m1]", "[msg: m2, page: 4]"] and not got[1, 2]["kept"] and got[2, 0]["kept"] and not got[3, 0]["kept"]
    out = {r["query_id"]: r for r in citations.answers(judged).collect()}
    assert out[1]["answer"] == citations.ABSTAINED and out[2]["answer"] == "No answer." and out[2]["coverage"] == 0.0 and out[3]["answer"] == citations.ABSTAINED
    whole = citations.answers(judged.where("query_id = 1 and clause_no = 0")).first()
    assert whole["answer"] == "The budget is 500 euros. [msg: m1]" and whole["evidence"] == 1


def test_evidence_reasons_in_order(spark):
    rows = [(1, 0.9, 0.9), (2, 0.6, 0.2), (2, 0.6, 0.3), (3, 0.6, 0.5), (3, 0.7, 1.0), (4, 0.6, 0.5), (4, 0.7, 1.0)]
    h = spark.createDataFrame(rows, "query_id long, support double, rerank_norm double")
    cov = spark.createDataFrame([(3, 0.5), (4, 0.7)], "query_id long, coverage double")
    got = {r["query_id"]: r["reason"] for r in citations.evidence_reason(h, cov).collect()}
    assert got == {1: "insufficient_supported_chunks", 2: "top_rerank_below_threshold", 3: "citation_coverage_below_threshold", 4: None}


def test_context_reasons(spark):
    j = lambda x: json.dumps({"context": x})
    cases = {j("About Atlas."): None, "x": "malformed_json", j(" "): "empty", j("A. B. C."): "too_many_sentences", j("A one. B two. C three without a stop"): "too_many_sentences", j("see https://x"): "citation_marker", j("w " * 90): "too_long",
             "": "empty_output", '["a"]': "not_an_object", '{"other": 1}': "no_context", '{"context": 5}': "not_a_string", "```json\n" + j("Fine.") + "\n```": None}
    df = spark.createDataFrame(list(cases.items()), "o string, want string")
    assert [(r[0], r[1]) for r in df.select("o", enrichment.context_reason(df["o"])).collect()] == list(cases.items())


def test_context_commit_refuses_stale_results(spark):
    chunks = spark.createDataFrame([("a", "t", "e", "h1"), ("b", "t", None, "h2"), ("c", "t", "e", "h3")], "chunk_id string, text string, embed_text string, input_hash string")
    results = spark.createDataFrame([("a", "h1", '{"context": "On Atlas."}'), ("b", "old", '{"context": "On B."}'), ("c", "h3", "broken")], "chunk_id string, input_hash string, raw string")
    got = {r["chunk_id"]: (r["embed_text"], r["context_method"], r["needs_embedding"]) for r in enrichment.commit_context(chunks, results).collect()}
    assert got == {"a": ("On Atlas.\n\ne", "llm", True), "b": (None, None, False), "c": ("e", "deterministic", False)}


def test_extraction_keeps_only_what_the_text_proves(spark):
    ent = lambda n, t, e: {"name": n, "type": t, "evidence": e}
    rel = lambda s, p, o, e: {"subject": s, "predicate": p, "object": o, "evidence": e}
    raw = {
        "entities": [ent("Ann Lee", "PERSON", "Ann Lee"), ent("Atlas", "TOPIC", "Atlas"), ent("Ghost", "PERSON", "Ghost"), ent("x", "PLANET", "Ann"), {"name": "Atlas", "type": "PROJECT"}, "no object", ent("Lee", "PERSON", 5)],
        "relations": [rel("ann  lee", "APPROVED", "Atlas", "approved Atlas"), rel("Ann Lee", "SENT", "Atlas", "approved Atlas"), rel("Ghost", "APPROVED", "Atlas", "approved Atlas"), rel("Ann Lee", "APPROVED", "Atlas", "rejected Atlas")],
        "facts": [rel("Atlas", "budget", "5", "now 5"), rel("Atlas", "budget", "7", "7")],
    }
    text = "Ann Lee approved Atlas. It is now 5."
    df = spark.createDataFrame([("c", text, 10, json.dumps(raw)), ("d", text, None, "broken"), ("e", text, None, "```json\n" + json.dumps({"entities": [ent("Atlas", "TOPIC", "Atlas")]}) + "\n```"), ("f", None, None, None)], "chunk_id string, text string, source_start int, raw string")
    mentions, relations, facts = enrichment.resolve_extractions(df)
    got = {(r["chunk_id"], r["normalized_name"], r["entity_type"], r["source_start"]) for r in mentions.collect()}
    assert got == {("c", "ann lee", "PERSON", 10), ("c", "atlas", "TOPIC", 27), ("e", "atlas", "TOPIC", None)}
    assert [(r["subject"], r["predicate"], r["object"], r["object_type"]) for r in relations.collect()] == [("ann lee", "APPROVED", "atlas", "TOPIC")]
    f = facts.collect()
    assert [(r["object_value"], r["cue"], r["chunk_start"]) for r in f] == [("5", True, 30)]


def test_graph_commit_and_fact_reads(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    fresh = spark.createDataFrame([("a", 9)], "chunk_id string, v int")
    done = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert [tuple(r) for r in enrichment.replace_of_chunks(stored, fresh, done).collect()] == [("a", 9)]
    facts = spark.createDataFrame([("t", "m", "atlas", "c2", "active", DAY), ("t", "m", "atlas", "c1", "superseded", DAY), ("t", "m", "atlas", "c3", "active", None), ("t", "n", "atlas", "c4", "active", DAY)], "tenant_id string, mailbox_id string, normalized_subject string, chunk_id string, status string, effective_date timestamp")
    q = spark.createDataFrame([("t", "m", 1, ["Atlas"], DAY.date()), ("t", "m", 2, [], DAY.date()), ("t", "m", 3, ["other"], DAY.date())], "tenant_id string, mailbox_id string, query_id long, subjects array<string>, day date")
    rows = lambda **k: sorted((r["query_id"], r["chunk_id"]) for r in enrichment.fact_evidence(q, facts, 5, **k).collect())
    assert rows() == [(1, "c1"), (1, "c2"), (1, "c3"), (2, "c1"), (2, "c2"), (2, "c3")]
    assert rows(status="active") == [(1, "c2"), (1, "c3"), (2, "c2"), (2, "c3")] and rows(as_of="day") == [(1, "c1"), (1, "c2"), (2, "c1"), (2, "c2")]


def test_conversation_memory_and_rewriting(spark):
    hit = [("plan.pdf", "Silo plan", "ann@x", "<m1>", "2031")]
    turns = [(1, "user", "What is the deadline for the silo?", []), (2, "assistant", "Deadline: 5 May. [msg: m1]", hit), (3, "user", "and when?", []), (4, "assistant", "I could not confirm that.", []), (5, "user", "I meant the north silo", []), (6, "user", "is it approved in the final report", []), (7, "switch", "t2", []), (8, "user", "compare it", [])]
    df = spark.createDataFrame([("s", *t) for t in turns], "session_id string, turn_no int, role string, text string, hits array<struct<name: string, subject: string, sender: string, message_id: string, at: string>>")
    got = {r["turn_no"]: r for r in conversation.rewritten(conversation.session_states(df), F.lit("t1")).collect()}
    assert got[1]["last_user_intent"] == "deadline" and got[1]["current_focus"] == "the silo"
    assert got[2]["last_attachment"] == "plan.pdf" and got[2]["last_answer_focus"] == "5 May." and got[2]["people"][-1] == "ann@x"
    assert got[3]["query_text"] == "When is the deadline for 5 May.?" and got[4]["last_answer_focus"] == "5 May."
    assert got[5]["correction_override"] == "the north silo" and got[6]["query_text"] == "is the north silo approved in the final version report focus on the north silo"
    assert got[7]["people"] == [] and got[8]["query_text"] == "Compare compare it earlier draft versus final version"
    assert [r["turn_no"] for r in conversation.recent_turns(df, 3).orderBy("turn_no").collect()] == [8]
    gate = spark.createDataFrame([("silo deadline", "when?"), ("when?", "When?"), ("memory: x", "q"), ("w " * 41, "q"), ("a\nb\nc", "q"), (None, "q"), ("...", "q")], "o string, q string")
    assert [r[0] for r in gate.select(conversation.usable_rewrite(F.col("o"), F.col("q"))).collect()] == [True, False, False, False, False, False, False]
    kept = spark.createDataFrame([("deadline", "what pdf from ann"), ("the email", "which email")], "o string, q string")
    assert [r[0] for r in kept.select(conversation.anchored(F.col("o"), F.col("q"))).collect()] == ["from pdf deadline", "the email"]


def test_jobs_claim_fail_and_complete(spark):
    now = F.lit(DAY).cast("timestamp")
    rows = [(1, 1, 5, "pending", 0, False, None, None, None), (2, 2, 5, "running", 1, True, DAY, "x", None), (3, 3, 5, "running", 1, False, DAY + dt.timedelta(days=1), None, None), (4, 4, 9, "running", 5, False, None, None, None), (5, 5, 9, "running", 1, True, None, None, None), (6, 5, 3, "pending", 0, False, None, None, None)]
    jobs = spark.createDataFrame([(a, b, __import__("decimal").Decimal(c), *r) for a, b, c, *r in rows], sync.JOB)
    claimed = {r["job_id"]: (r["status"], r["attempts"]) for r in sync.claimed(jobs, now, 2).collect()}
    assert claimed[1] == ("running", 1) and claimed[2] == ("running", 2) and claimed[6] == ("pending", 0) and claimed[3] == ("running", 1)
    bad = spark.createDataFrame([(3, "e"), (4, "e"), (5, "e")], "job_id long, error string")
    after = {r["job_id"]: (r["status"], int(r["requested_history_id"]), r["needs_full_sync"], r["last_error"]) for r in sync.failed(jobs, bad).collect()}
    assert after[3] == ("pending", 5, False, "e") and after[4][0] == "failed" and after[5][0] == "failed" and after[6] == ("pending", 9, True, None)
    done = {r["job_id"]: (r["status"], r["last_error"]) for r in sync.completed(jobs, spark.createDataFrame([(2,)], "job_id long")).collect()}
    assert done[2] == ("done", None) and done[1][0] == "pending"


def test_sync_applies_history_and_moves_cursors_forward(spark):
    msg = "mailbox_key long, message_id string, v int"
    stored = spark.createDataFrame([(1, "a", 0), (1, "b", 0)], msg)
    history = spark.createDataFrame([(1, 5, 0, "a", True), (1, 6, 0, "c", False), (1, 7, 0, "b", False), (1, 8, 0, "b", True), (1, 9, 0, "b", False), (1, 9, 1, "gone", False)], "mailbox_key long, history_id long, pos int, message_id string, deleted boolean")
    fetched = spark.createDataFrame([(1, "b", 1), (1, "c", 1)], msg)
    once = sync.apply_history(stored, history, fetched)
    assert sorted(map(tuple, once.collect())) == [(1, "b", 1), (1, "c", 1)] == sorted(map(tuple, sync.apply_history(once, history, fetched).collect()))
    start = spark.createDataFrame([(1, 6)], "mailbox_key long, cursor long")
    messages, cursors = sync.full_sync(stored, history, start, fetched)
    assert sorted(r["message_id"] for r in messages.collect()) == ["a", "b"] and int(cursors.first()["cursor"]) == 9
    boxes = spark.createDataFrame([(1, "t", "m", "A@x", "needs_full_sync", __import__("decimal").Decimal(20), "old", None), (2, "t", "n", "a@X", "active", None, None, DAY)], sync.MAILBOX)
    after = {r["mailbox_key"]: (int(r["last_history_id"] or 0), r["status"], r["error"]) for r in sync.committed(boxes, cursors).collect()}
    assert after == {1: (20, "active", None), 2: (0, "active", None)}  # an older id never rewinds
    assert sync.shared_addresses(boxes).collect()[0]["mailboxes"] == 2 and [r["mailbox_key"] for r in sync.due_watches(boxes, F.lit(DAY)).collect()] == [2]
    profiles = spark.createDataFrame([(1, 3, DAY), (2, 4, DAY)], "mailbox_key long, history_id long, received_at timestamp")
    assert {r["mailbox_key"]: int(r["last_history_id"]) for r in sync.seeded(boxes, profiles).collect()} == {1: 20, 2: 4}
    routes = spark.createDataFrame([(False, "active", 5, False), (True, "active", 5, False), (False, "needs_full_sync", 5, False), (False, "active", None, False), (False, "active", 5, True)], "f boolean, s string, c int, e boolean")
    assert [r[0] for r in routes.select(sync.sync_route(*map(F.col, "fsce"))).collect()] == ["delta", "full", "full", "full", "full"]
    events = spark.createDataFrame([(1, "t", "m", "A@x", "e1", DAY, "expire"), (3, "t", "o", "c@x", None, DAY, "connect"), (2, "t", "n", "a@x", None, DAY, "disconnect")], "mailbox_key long, tenant_id string, mailbox_id string, email_address string, error string, at timestamp, event string")
    assert {r["mailbox_key"]: (r["status"], r["error"]) for r in sync.upserted_mailboxes(boxes, events).collect()} == {1: ("needs_full_sync", "e1"), 2: ("disconnected", None), 3: ("pending", None)}


def test_history_log_source(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(1, i, 0, f"m{i}", i % 2 == 0) for i in range(1, 8)]
    spark.createDataFrame(rows, "mailbox_key long, history_id long, pos int, message_id string, deleted boolean").coalesce(1).write.parquet(path)
    assert [r["history_id"] for r in sync.history_log(spark, path, 3, page=2).orderBy("history_id").collect()] == [4, 5, 6, 7]
    with pytest.raises(Exception, match="history before 5"):
        sync.history_log(spark, path, 3, oldest=5).collect()
    q = spark.readStream.format("history_log").option("path", path).option("page", 3).load().writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("log_rows").count() == 7


def test_segments_and_email_chunks(spark):
    bodies = ["Hello\nplease see\n\nRegards,\nAnn\nThis message is confidential\nOn Monday Bob wrote:\n> old", "Thanks,\nAnn", "> only quoted", None, "w " * 500]
    rows = [(i, f"d{i}", f"<m{i}>", "th", "t", "b", DAY, DAY, "ann@x", ["bob@x"], None, "S", b, None, None, "p", "x") for i, b in enumerate(bodies)]
    m = spark.createDataFrame(rows, "msg_key long, doc_id string, message_id string, thread_id string, tenant_id string, mailbox_id string, sent_at timestamp, ingested_at timestamp, sender string, recipients array<string>, cc array<string>, subject string, body_text string, in_reply_to string, reference_ids array<string>, source_path string, source_type string")
    got = {r["msg_key"]: (r["authored_text"], r["quoted_text"], r["signature_text"], r["disclaimer_text"], r["authored_end"]) for r in ingest.segment_texts(m).collect()}
    assert got[0] == ("Hello\nplease see", "On Monday Bob wrote:\n> old", "Regards,\nAnn", "This message is confidential", 16)
    assert got[1] == ("Thanks,\nAnn", "", "", "", 11) and got[2] == ("", "> only quoted", "", "", 0) and got[3][0] == ""
    chunks = {r["chunk_id"]: r for r in ingest.email_chunks(m).collect()}
    assert set(chunks) == {"d0-email-0", "d1-email-0", "d4-email-0", "d4-email-1"} and chunks["d0-email-0"]["embed_text"].startswith("From: ann@x\nTo: bob@x\nDate: 2031-01-01") and chunks["d4-email-0"]["token_count"] == 450
    pages = spark.createDataFrame([(1, "a1", "<m0>", "old", "f.pdf", 2, "one  two", None), (2, "a1", "<m0>", "old", "f.pdf", 3, " ", True)], "page_key long, attachment_id string, message_id string, thread_id string, filename string, page_no int, text string, ocr_used boolean")
    a = ingest.attachment_chunks(pages, m).collect()
    assert [(r["chunk_id"], r["thread_id"], r["source_start"], r["embed_text"]) for r in a] == [("a1-page-2-chunk-0", "th", None, "Attachment: f.pdf\nPage: 2\n\none two")]


def test_chunk_table_transitions_and_round_trip(spark, tmp_path):
    row = lambda i, kind, text, doc="d", msg="m": (i, doc, "th", msg, "t", "b", kind, None, None, "s", DAY, "x", text, text, 0, 1, False, 1, None, None)
    stored = spark.createDataFrame([row("1", "email", "a"), row("2", "email", "b"), row("3", "attachment", "c"), row("4", "email", "z", msg="n")], ingest.CHUNK).withColumn("embedding", F.array(F.lit(1.0)))
    new = spark.createDataFrame([row("1", "email", "a2")], ingest.CHUNK)
    messages = spark.createDataFrame([("t", "b", "m", 1, DAY)], "tenant_id string, mailbox_id string, message_id string, msg_key long, ingested_at timestamp")
    _, chunks = ingest.reprocess_messages(messages, stored, messages, new)
    assert {r["chunk_id"]: (r["text"], r["embedding"]) for r in chunks.collect()} == {"1": ("a2", None), "3": ("c", [1.0]), "4": ("z", [1.0])}
    other = ingest.replace_attachment_chunks(stored, spark.createDataFrame([row("9", "attachment", "n")], ingest.CHUNK), spark.createDataFrame([("m", "d")], "message_id string, doc_id string"))
    assert sorted(r["chunk_id"] for r in other.collect()) == ["1", "2", "4", "9"]
    assert ingest.read_chunks(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c.jsonl").write_text(json.dumps({"chunk_id": "1", "text": "a"}) + "\n\n")
    assert [r["text"] for r in ingest.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()] == ["a"]
    with pytest.raises(ValueError, match="text"):
        ingest.check_schema(stored.drop("text"), ingest.CHUNK)
    files = spark.createDataFrame([("a/mailbox_part_10.json",), ("a/mailbox_part_2.json",), ("a/mailbox.json",), ("a/index.json",)], "p string")
    assert [r[0] for r in files.orderBy(ingest.mailbox_file_order(F.col("p"))).collect()] == ["a/index.json", "a/mailbox.json", "a/mailbox_part_2.json", "a/mailbox_part_10.json"]


def test_values_sentences_and_fingerprints(spark):
    df = spark.createDataFrame([("On 2031-01-02 Ann Lee sent report.pdf for $1,200.50.", "")], "a string, b string")
    r = df.select(T.stated_values(F.col("a")).alias("v"), T.fingerprint("a", "b").alias("x"), T.best_sentence(F.lit("One. Two words here."), F.array().cast("array<string>")).alias("s")).first()
    assert "1200.50" in r["v"] and "2031-01-02" in r["v"] and "ann lee" in r["v"] and r["s"] == "Two words here."
    null = spark.createDataFrame([("On 2031-01-02 Ann Lee sent report.pdf for $1,200.50.", None)], "a string, b string").select(T.fingerprint("a", "b")).first()[0]
    assert null != r["x"]
    with pytest.raises(Exception, match="vector of 3 numbers"):
        spark.createDataFrame([([1.0],)], "v array<double>").select(T.checked_vector(F.col("v"), 3)).collect()
