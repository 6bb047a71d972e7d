import datetime as dt

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import changes, corpus, graph, retrieval


def one(spark, column, **values):
    kinds = {k: v[1] if isinstance(v, tuple) else "string" for k, v in values.items()}
    data = [tuple(v[0] if isinstance(v, tuple) else v for v in values.values())]
    return spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, t in kinds.items())).select(column.alias("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, T.normalize_subject(F.col("s")), s=" RE: fwd:  Budget   Review ") == "budget review"
    assert one(spark, T.tokenize(F.col("s")), s="Zoë's plan_2, ok?") == ["Zoë", "s", "plan_2", "ok"]
    assert one(spark, T.normalize_body(F.col("s")), s="a  \r\nb\r\n\r\n\r\n\r\nc\n\n") == "a\nb\n\nc"
    assert "x & y" in one(spark, T.normalize_body(F.col("s")), s="<html><body><p>x &amp; y</p><script>z</script></body></html>")
    assert one(spark, T.base64url(F.col("s")), s="eyJhIjoxfQ") == '{"a":1}'
    assert one(spark, T.base64url(F.col("s")), s="%%%") is None
    assert one(spark, T.amounts(F.col("s")), s="$1,200 and 1200 or 3.50") == ["1200", "3.50"]
    span = one(spark, T.locate_span(F.col("s"), F.col("e")), s="😀 abc abc", e="abc")
    assert (span["start"], span["end"]) == (2, 5)
    assert one(spark, T.locate_span(F.col("s"), F.col("e")), s="abc", e="") is None
    assert abs(one(spark, T.overlap_f1(F.col("c"), F.col("s")), c="budget approved", s="No. The budget was approved") - 2 * 2 / 6) < 1e-9


def test_token_windows_stop_at_the_end(spark):
    w = one(spark, T.token_windows(F.col("s"), 4, 1), s="a b c d e f g")
    assert [x["window"] for x in w] == ["a b c d", "d e f g"]
    assert one(spark, T.token_windows(F.col("s"), 4, 1), s="  ") == []


def test_embed_text_omits_absent_fields(spark):
    row = spark.createDataFrame([("a@x", ["b@x"], None, dt.datetime(2031, 1, 2), None, "t1", None, "body")], "f string, t array<string>, c array<string>, d timestamp, s string, th string, r string, b string")
    c = F.col
    got = row.select(T.embed_text(c("f"), c("t"), c("c"), c("d"), c("s"), c("th"), c("r"), c("b"))).first()[0]
    assert got == "From: a@x\nTo: b@x\nDate: 2031-01-02\nThread-ID: t1\n\nbody"


def test_fusion_scores_ties_and_last_duplicate(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 5)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, id long, rank int")
    got = {r["id"]: (r["score"], r["rank"], r["sources"]) for r in retrieval.weighted_rrf({"a": (a, 1.0), "b": (b, 2.0)}, "id").collect()}
    assert got[11] == (round(1 / 62 + 2 / 61, 8), 1, "a:2,b:1")
    assert got[10] == (round(1 / 65, 8), 2, "a:5")


def test_min_max_of_constant_lists(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (3, 1.0), (3, 3.0)], "query_id long, score double")
    got = sorted((r["query_id"], r["score"], r["norm"]) for r in retrieval.min_max(df).collect())
    assert got == [(1, 2.0, 1.0), (1, 2.0, 1.0), (2, 0.0, 0.0), (3, 1.0, 0.0), (3, 3.0, 1.0)]


def test_dense_top_k_in_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id <= 4").withColumnRenamed("vec_id", "query_id")
    want = {(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 3, 1), (3, 1, 2)}
    for block in (1, 100):
        got = {(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.dense_top_k(v, q, "vec_id", "embedding", 2, block).collect()}
        assert got == want


def test_paragraph_packing_round_trip():
    paragraphs = [" ".join(f"w{i}_{j}" for j in range(120)) for i in range(12)]
    text = "\n\n".join(paragraphs)
    got = corpus.pack_paragraphs(text, 450, 50)
    assert all(text[a:b] == c for c, a, b in got)
    assert got[0][1] == 0 and got[-1][2] == len(text)
    assert corpus.pack_paragraphs("", 450) == [] and corpus.pack_paragraphs("short") == [("short", 0, 5)]
    big = " ".join(f"x{i}" for i in range(1000))
    assert len(corpus.pack_paragraphs("intro\n\n" + big)) == 4


def test_segment_rules(spark):
    body = "Hello\nplease see\n\nRegards,\nAnn\nThis message is confidential\nOn Monday Bob wrote:\n> old"
    r = corpus.segment_by_rules(spark.createDataFrame([(body,), ("plain",)], "b string"), "b").collect()
    assert (r[0]["quote_at"], r[0]["disclaimer_at"], r[0]["signature_at"]) == (6, 5, 3)
    assert (r[1]["quote_at"], r[1]["disclaimer_at"], r[1]["signature_at"]) == (-1, -1, -1)


def test_net_changes_last_event_wins(spark):
    e = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 3, False), ("c", 3, True)], "id string, seq int, gone boolean")
    got = {r["id"]: r["op"] for r in changes.net_changes(e, ["id"], ["seq"], "gone").collect()}
    assert got == {"a": "deleted", "b": "added", "c": "deleted"}


def test_upsert_and_stale(spark):
    old = spark.createDataFrame([("m", "a", 1), ("m", "b", 1), ("n", "c", 1)], "message string, chunk string, v int")
    new = spark.createDataFrame([("m", "a", 2)], "message string, chunk string, v int")
    assert sorted(map(tuple, changes.upsert(old, new, ["message", "chunk"], ["v"]).collect())) == [("m", "a", 2), ("m", "b", 1), ("n", "c", 1)]
    assert sorted(map(tuple, changes.delete_stale(old, new, ["message"], "chunk").collect())) == [("m", "a", 1), ("n", "c", 1)]


def test_cursor_compares_numbers(spark):
    e = spark.createDataFrame([("a", "9"), ("a", "10"), ("b", None), ("b", "")], "k string, h string")
    got = {r["k"]: int(r["cursor"]) for r in changes.cursors(e, "k", "h").collect()}
    assert got == {"a": 10, "b": 0}


def test_supersession_equals_fold(spark):
    import random

    rng = random.Random(5)
    facts = [(i, rng.randrange(3), rng.random() < 0.4) for i in range(60)]
    got = {r["id"]: r["supersedes"] for r in graph.supersession(spark.createDataFrame(facts, "id long, scope int, cue boolean"), ["scope"], ["id"], "cue").collect()}
    active = {}
    for i, s, cue in facts:
        assert got[i] == (active.get(s) if cue else None)
        active[s] = i
