import base64
import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from threadloom.operators import changes, delivery_dedup
from threadloom.plans import answering as A
from threadloom.sources import mail
from threadloom.streaming import changes as stream

EML = b"""From: Ann Lee <ann@x.example>
To: Bob <bob@x.example>, c@x.example
Subject: Plan
Date: Fri, 05 Jan 2024 10:00:00 +0200
Message-ID: <m1@x>
References: <m0@x> <m00@x>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/plain; charset=utf-8

Hello there
--b
Content-Type: text/plain; name=note.txt
Content-Disposition: attachment; filename=note.txt

note
--b--
"""


def files(tmp_path, **content):
    for name, raw in content.items():
        (tmp_path / name.replace("__", ".")).write_bytes(raw)
    return str(tmp_path)


def test_mime(spark, tmp_path):
    r = mail.read_mime(mail.binary_files(spark, files(tmp_path, a__eml=EML), "*.eml")).first()
    assert (r["message_id"], r["doc_id"], r["sender"], r["recipients"], r["thread_id"]) == ("<m1@x>", "m1@x", "Ann Lee <ann@x.example>", ["bob@x.example", "c@x.example"], "plan")
    assert r["body_text"] == "Hello there" and r["sent_at"] == dt.datetime(2024, 1, 5, 8, 0) and r["reference_ids"] == ["<m0@x>", "<m00@x>"]
    assert [(a["filename"], a["status"], a["text"]) for a in r["attachments"]] == [("note.txt", "done", "note")] and r["attachments"][0]["attachment_id"] == "m1@x-att-3"


def test_mailbox_json(spark, tmp_path):
    raw = json.dumps({"box": [{"id": "1", "subject": "a", "from": {"email": "x@y"}, "body": "hi"}, {"deep": [{"id": "1", "subject": "again"}, {"message_id": "2", "body": "", "text": "t"}]}, {"subject": "no id", "body": "z"}]})
    found = mail.read_mailbox_json(mail.binary_files(spark, files(tmp_path, a__json=raw.encode(), b__json=b"{broken")))
    got = {r["message_id"]: r["m"] for r in found.select("message_id", mail.normalized_message(found["message"], F.lit("box")).alias("m")).collect()}
    assert set(got) == {"1", "2"} and got["1"]["sender"] == "x@y" and got["1"]["subject"] == "a" and got["2"]["body_text"] == "t"
    assert got["1"]["thread_id"] == "box:a" and got["2"]["thread_id"] == "box:2" and got["1"]["sent_at"] == dt.datetime(1970, 1, 1)


def test_mailbox_message_aliases(spark):
    m = {"Message-ID": "<q 1@x>", "subject": "RE: Big  Plan", "plain_text_body": "<p>one</p><script>no</script><p>two</p>", "conversation_id": "", "from": {"email": "", "name": "Ann"}, "to": [{"email": "b@x"}, "", "c@x"], "cc": "d@x",
         "date": "2001-02-03T04:05:06+01:00", "References": ["<r1>", "<r2>"], "files": [{"name": "dir/a.pdf"}, "no object", {"url": "https://h.example/p/b.txt?x=1"}, {}]}
    r = spark.createDataFrame([(json.dumps(m),)], "m string").select(mail.normalized_message(F.col("m"), F.lit("allen")).alias("x")).first()["x"]
    assert (r["doc_id"], r["thread_id"], r["sender"], r["recipients"], r["cc"]) == ("q_1_x", "allen:big plan", "Ann", ["b@x", "c@x"], ["d@x"])
    assert r["body_text"] == "one\ntwo" and r["sent_at"] == dt.datetime(2001, 2, 3, 3, 5, 6) and r["reference_ids"] == ["<r1>", "<r2>"]
    assert [(a["attachment_id"], a["filename"], a["repo_path"]) for a in r["attachments"]] == [("q_1_x-att-1", "a.pdf", None), ("q_1_x-att-3", "b.txt", "p/b.txt"), ("q_1_x-att-4", "attachment-4", None)]
    a = spark.createDataFrame([(json.dumps(m),)], "m string").select(mail.archive_message(F.col("m"), F.lit("p")).alias("x")).first()["x"]
    assert (a["doc_id"], a["thread_id"], a["source_path"]) == ("q 1@x", "big plan", "p")


def test_provider_message(spark):
    data = base64.urlsafe_b64encode("größer".encode()).decode().rstrip("=")
    m = {"id": "g1", "threadId": "t", "internalDate": "1000", "payload": {"headers": [{"name": "FROM", "value": "a@x"}, {"name": "To", "value": "b@x, c@x"}], "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": data}}, {"mimeType": "text/html", "body": {"data": data}}]}]}}
    m["payload"]["headers"] += [{"name": "Date", "value": "Mon, 01 Jan 2024 10:00:00 +0200"}, {"name": "Cc", "value": '"Doe, Jane" <jane@x>, bob@x'}, {"name": "References", "value": "<r1> <r2>"}]
    m["payload"]["parts"] += [{"filename": "x.PDF", "mimeType": "application/octet-stream", "body": {"attachmentId": "A1", "size": 7}}, {"filename": "y.txt", "mimeType": "text/plain", "body": {"data": data, "attachmentId": "A2"}}]
    broken = {"id": "g2", "internalDate": "1000", "payload": {"mimeType": "text/plain", "body": {"data": "%%%=!"}, "headers": [{"name": "Date", "value": "never"}]}}
    rows = [(json.dumps(m), "me@x"), ("broken", "me@x"), (json.dumps(broken), "me@x"), (None, "me@x")]
    r = {x["message_id"]: x for x in mail.provider_messages(spark.createDataFrame(rows, "message string, email_address string")).collect()}
    assert set(r) == {"g1", "g2"}  # a broken part fails no job
    assert (r["g1"]["sender"], r["g1"]["recipients"], r["g1"]["cc"], r["g1"]["body_text"], r["g1"]["sent_at"]) == ("a@x", ["b@x", "c@x"], ["jane@x", "bob@x"], "größer", dt.datetime(2024, 1, 1, 8, 0))
    assert [a["filename"] for a in r["g1"]["attachments"]] == ["x.PDF"] and r["g1"]["reference_ids"] == ["<r1>", "<r2>"] and r["g1"]["source_path"] == "mailbox://me@x/g1"
    assert r["g2"]["body_text"] == "" and r["g2"]["sent_at"] == dt.datetime(1970, 1, 1, 0, 0, 1) and r["g2"]["thread_id"] == "g2"


def test_attachments(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>')
    path = files(tmp_path, a__docx=buffer.getvalue(), b__html=b"<p>x<script>no</script> &amp; y</p>", c__rtf=rb"{\rtf1 hello\par world}", d__txt=b" plain \xff", e__pdf=b"%PDF", f__docx=b"broken", g__doc=b"\xd0\xcf\x00\x01" + "Quarterly figures".encode("utf-16-le") + b"\x00\x07", h__pdf=b"no pdf", i__pdf=b"%PDF /Encrypt")
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["text"]) for r in mail.read_attachments(mail.binary_files(spark, path)).collect()}
    assert got["a.docx"] == ("done", "one two\nthree") and got["b.html"] == ("done", "x\n& y") and got["d.txt"] == ("done", "plain")
    assert got["c.rtf"][1].split() == ["hello", "world"] and got["e.pdf"][0] == "unsupported" and got["f.docx"][0] == "failed"
    assert got["g.doc"] == ("done", "Quarterly figures") and got["h.pdf"][0] == "failed" and got["i.pdf"][0] == "encrypted"
    assert mail.attachment_text("s.pdf", b"%PDF", recognise=lambda raw, kind: f"{len(raw)} {kind}") == ("done", "4 .pdf")
    whole = {r["path"].rsplit("/", 1)[1]: r["status"] for r in mail.read_attachments(mail.binary_files(spark, path), oversized=3).collect()}
    assert whole["d.txt"] == "oversized" and mail.media_type("A.PDF") == "application/pdf"


def test_plans(spark):
    qs = [(1, 'Which crane did "Project Atlas" rent as of January 5, 2026?'), (2, "what is the current budget"), (3, None), (4, "What Acme said; acme and Acme?")]
    got = {r["query_id"]: r for r in A.plan_questions(spark.createDataFrame(qs, "query_id long, query_text string")).collect()}
    assert got[1]["routes"] == ["hybrid", "graph_as_of", "graph_entity"] and got[1]["as_of"] == dt.date(2026, 1, 5) and got[1]["entity_terms"][0] == "Project Atlas"
    assert got[2]["routes"] == ["hybrid", "graph_current"] and got[2]["subject_terms"] == ["current", "budget", "current budget"]
    assert got[3]["routes"] == ["hybrid"] and got[4]["entity_terms"] == ["Acme"]
    assert got[3]["rules"] == ["no_graph_signal_hybrid_only"] and got[1]["rules"][0] == "as_of_date_parsed:2026-01-05" and got[4]["subject_terms"][:3] == ["acme", "acme acme", "acme acme acme"]
    off = A.plan_questions(spark.createDataFrame(qs, "query_id long, query_text string"), enabled=False).where("query_id = 1").first()
    assert off["routes"] == ["hybrid"] and off["rules"] == ["planner_disabled"] and off["entity_terms"] == []


def test_draft_validation(spark):
    cite = lambda **k: json.dumps({"answer": "a", "claims": [{"text": "t", "citations": [k]}]})
    drafts = {
        1: cite(chunk_id="c1", quote="the budget"), 2: cite(chunk_id="c9", quote="the"), 3: cite(chunk_id="c1", quote="the  budget\nis"), 4: cite(chunk_id="c1", quote="nothing"),
        5: cite(chunk_id="c1", quote="budget", start=3), 6: "no json", 7: '{"answer": "a", "claims": []}', 8: '{"answer": "a", "claims": [{"text": "t", "citations": []}]}', 9: "```json\n" + cite(chunk_id="c1", quote="budget", start=4) + "\n```", 10: cite(chunk_id="c1", quote=""),
        11: "Here it is: " + cite(chunk_id="c1", quote="budget") + " Bye.", 12: cite(chunk_id="c1", quote="budget")[:-1] + ', "is_useful": false}',
    }
    d = spark.createDataFrame(list(drafts.items()), "query_id long, draft string")
    e = spark.createDataFrame([(i, "c1", "the budget is 5") for i in drafts], "query_id long, chunk_id string, text string")
    got = {r["query_id"]: r["reason"] for r in A.validate_drafts(d, e).collect()}
    assert got == {1: None, 2: "invented_chunk_id", 3: None, 4: "quote_not_found", 5: "offset_mismatch", 6: "malformed_json", 7: "no_claims", 8: "uncited_claim", 9: None, 10: "malformed_citation", 11: None, 12: "model_flagged_insufficient"}
    spans = {r["query_id"]: (r["start"], r["end"], r["quote"]) for r in A.cited_spans(d.where("query_id in (1, 3)"), e).collect()}
    assert spans == {1: (0, 10, "the budget"), 3: (0, 13, "the budget is")}


def test_attempts_settle(spark):
    rows = [(1, 1, 3, False, "d1", False, "no_claims"), (1, 2, 5, False, "d2", True, None), (2, 1, 0, False, None, False, None), (2, 2, 0, False, None, False, None), (3, 1, 2, True, None, False, None), (4, None, None, None, None, None, None), (5, 1, 2, False, "d", True, None), (5, 2, 9, False, "late", False, "x")]
    got = {r["query_id"]: tuple(r)[1:] for r in A.settle_attempts(spark.createDataFrame(rows, "query_id long, attempt int, evidence int, error boolean, draft string, accepted boolean, reason string")).collect()}
    assert got == {1: ("answered", 2, "d2", None), 2: ("abstained", 2, None, "no_evidence"), 3: ("abstained", 1, None, "provider_error"), 4: ("abstained", 0, None, "provider_disabled"), 5: ("answered", 1, "d", None)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 7}", i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, k string, gone boolean")
    src, target = str(tmp_path / "src"), str(tmp_path / "out")
    for n in range(3):
        df.where(f"seq % 3 = {n}").coalesce(1).write.mode("append").parquet(src)
    q = stream.net_changes(stream.source(spark, src, df.schema, 1), ["k"], ["seq"], "gone", target, str(tmp_path / "cp"))
    q.awaitTermination()
    got = {tuple(r) for r in stream.state_of(spark, target, 2, ["k"]).collect()}
    assert got == {(r["k"], r["op"]) for r in changes.net_changes(df, ["k"], ["seq"], "gone").collect()}


def test_notification_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2032, 1, 1) + dt.timedelta(seconds=i), f"91000000000000000{i % 4}", None) for i in range(12)]
    df = spark.createDataFrame(rows, "delivery_id long, received_at timestamp, pubsub_message_id string, push_body string")
    src, target = str(tmp_path / "src"), str(tmp_path / "out")
    for n in range(2):
        df.where(f"delivery_id div 6 = {n}").coalesce(1).write.mode("append").parquet(src)
    stream.accepted_notifications(stream.source(spark, src, df.schema, 1), target, str(tmp_path / "cp")).awaitTermination()
    accepted = lambda: sorted(tuple(r) for r in delivery_dedup.accepted_rows(spark, target).select("pubsub_message_id", "delivery_id").collect())
    once = accepted()
    assert len({i for i, _ in once}) == len(once) == 4
    # a restart on the same checkpoint: the repeats that come now are still repeats
    df.withColumn("delivery_id", df["delivery_id"] + 100).coalesce(1).write.mode("append").parquet(src)
    more = spark.createDataFrame([(300, None, "odd", None), (301, None, "910000000000000009", None)], df.schema)
    more.coalesce(1).write.mode("append").parquet(src)
    stream.accepted_notifications(stream.source(spark, src, df.schema, 1), target, str(tmp_path / "cp")).awaitTermination()
    assert accepted() == sorted([*once, ("odd", 300), ("910000000000000009", 301)])
    # a batch that is replayed after a failure changes nothing
    again = accepted()
    delivery_dedup.foreach_batch(target)(df.where("delivery_id div 6 = 1"), 1)
    assert accepted() == again
