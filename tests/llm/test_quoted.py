import datetime as dt

from threadloom.llm import quoted as Q

SCHEMA = "msg_key long, mailbox_id string, thread_id string, message_id string, sender string, sent_at timestamp, body_text string, extra string"


def test_forms():
    body = "Hi Ann,\nwe signed the contract.\n> 40 units in one bay is more than it can carry.\nOn Tuesday the caretaker wrote: no entry after 16:00.\n\nBest regards,\nBob Smith\n\nOn Jul 3, 2031, Ann Lee\n<ann@x.example> wrote:\n> old\n> text"
    kinds, _, _ = Q.classify(body, "Bob Smith <bob@x.example>")
    assert kinds[:4] == ["new"] * 4 and kinds[5:7] == ["signature"] * 2 and kinds[8:] == ["quoted"] * 4


def test_html_and_crlf():
    body = "<html><body>\r\n<p>Dear Ann,</p>\r\n<p>all good</p>\r\n<blockquote type=\"cite\">\r\n<p>old</p>\r\n</blockquote>\r\n<div class=\"ms-sig\">\r\nBob<br/>\r\n</div>\r\n</body></html>"
    kinds, _, text = Q.classify(body, None)
    assert [k for k, t in zip(kinds, text) if t.strip()] == ["new", "new", "quoted", "signature"]


def test_notices_and_headers():
    body = "Caution: the sender of this message has not been verified by the gateway.\n\nFrom: the gate to the silo it is a walk.\n\nFrom: A <a@x.example>\nSent: 1.2.2031 10:00\nTo: b@x.example\nSubject: x\n\nold text"
    told = Q.Seen(notices=frozenset(u.code for u in Q.sentences(body.split("\n")[:1])))  # what the windows tell
    kinds, proof, _ = Q.classify(body, None, told)
    assert proof[0] and kinds[0] == "notice" and kinds[2] == "new" and kinds[4:8] == ["quoted"] * 4 and kinds[9] == "quoted"


def test_open_quotation_ends_with_what_was_sent_before(spark):
    old = "Hi all,\nthe night shift moved the boxes to the old silo on Monday. Nobody has seen the second key since the end of March.\n\nThanks,\nAnn"
    new = "On Jan 2, 2031, Ann Lee <ann@x.example> wrote:\nthe night shift moved the boxes to the old\nsilo on Monday. Nobody has seen the second key since the end of March.\nThanks,\nAnn\n\nThe key lies in my drawer and nobody needs another one.\nRegards,\nBob"
    t = dt.datetime(2031, 1, 1)
    rows = [(1, "m", "t", "a", "Ann Lee <ann@x.example>", t, old, ""), (2, "m", "t", "b", "Bob <bob@x.example>", t + dt.timedelta(days=1), new, ""), (3, "m", None, "c", None, None, None, ""), (4, None, None, None, None, t, "", ""), (5, "m", "t", "b", "Bob <bob@x.example>", t + dt.timedelta(days=1), new, "")]
    got = {}
    for r in Q.line_classes(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["msg_key"], {})[r["line_no"]] = r["class"]
    assert [got[2][i] for i in (0, 1, 2, 3, 4)] == ["quoted"] * 5 and got[2][6] == "new" and got[2][7] == "signature"
    assert got[5] == got[2] and 3 not in got and set(got[1].values()) == {"new", "signature"}
    parts = {r["msg_key"]: r for r in Q.segments(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert parts[2]["authored_text"] == "The key lies in my drawer and nobody needs another one." and parts[3]["authored_text"] == ""
    assert len(parts) == 5


def test_recurring_closing(spark):
    rows = [(i, "m", None, f"id{i}", "zz@x.example", dt.datetime(2031, 1, 1 + i), f"Number {i} of the report is ready for you.\n\nTeam Orange Desk", "") for i in range(4)]
    got = {(r["msg_key"], r["line_no"]): r["class"] for r in Q.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i, 0] == "new" and got[i, 2] == "signature" for i in range(4))


def test_empty(spark):
    assert Q.line_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    kinds, _, _ = Q.classify("x" * 100_000 + "\n" + "word " * 50_000, None)
    assert kinds == ["new", "new"]


def test_windows_decide_where_forms_show_nothing(spark):
    """No quote mark, no introduction: the thread alone tells what was said before."""
    t = dt.datetime(2031, 1, 1)
    first = "The crane on pier four was checked on Monday by two fitters.\nIts brake needs a new lining before the winter comes again."
    later = "I have ordered the lining and expect it within nine working days.\n\n" + first
    rows = [(1, "m", "t", "a", "a@x.example", t, first, ""), (2, "m", "t", "b", "b@x.example", t + dt.timedelta(days=1), later, ""), (3, "n", "t", "c", "c@x.example", t, later, "")]
    got = {(r["msg_key"], r["line_no"]): (r["class"], r["by_window"]) for r in Q.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2, 0] == ("new", False) and got[2, 2] == got[2, 3] == ("quoted", True)
    assert got[1, 0][0] == got[1, 1][0] == "new" and got[3, 2][0] == "new"  # the first author, and another mailbox


def test_notices_are_known_by_their_place_under_many_senders(spark):
    note = "We process what you send us by the rules printed on our gate.\nThe gate is open."
    rows = [(i, "m", None, f"id{i}", f"s{i}@x.example", dt.datetime(2031, 1, 1 + i), f"Number {i} of {i + 7} reports lies on your desk since {i} o'clock.\n\nRegards,\nAda {i}\n\n{note}", "") for i in range(5)]
    rows += [(9, "m", None, "id9", "s9@x.example", dt.datetime(2031, 2, 1), "One line that no other message has in this mailbox.\n\n" + note, "")]
    got = {(r["msg_key"], r["line_no"]): r["class"] for r in Q.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i, 0] == "new" and got[i, 5] == got[i, 6] == "notice" for i in range(5))
    assert got[9, 2] == got[9, 3] == "notice"


def test_long_recurring_signature_and_lone_recurring_text(spark):
    sign = "\n".join(["Orange Desk"] + [f"Room {c}, floor {c}{c}" for c in "abcdefghijk"] + ["Pier Street 9, Floor 2"])
    rows = [(i, "m", None, f"id{i}", "o@x.example", dt.datetime(2031, 1, 1 + i), f"Number {i} of the report is ready for you.\n\n{sign}", "") for i in range(4)]
    rows += [(10 + i, "m", None, f"no{i}", "p@x.example", dt.datetime(2031, 1, 1 + i), "All pumps run", "") for i in range(4)]
    got = {(r["msg_key"], r["line_no"]): r["class"] for r in Q.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i, 0] == "new" and all(got[i, j] == "signature" for j in range(2, 15)) for i in range(4))
    assert all(got[10 + i, 0] == "new" for i in range(4))


def test_a_sentence_of_a_third_of_all_messages(spark):
    line = "The lift in building nine is out of order until Friday noon."
    rows = [(i, "m", "t", f"id{i}", f"s{i % 7}@x.example", dt.datetime(2031, 1, 1) + dt.timedelta(minutes=i), f"> {line}\n\nAnswer {i} of mine is that I take the stairs every day.", "") for i in range(300)]
    got = {(r["msg_key"], r["line_no"]): r["class"] for r in Q.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i, 0] == "quoted" and got[i, 2] == "new" for i in range(300))
