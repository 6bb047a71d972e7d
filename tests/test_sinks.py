import json

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import retrieval
from threadloom.sources import sinks


def test_json_lines_and_scopes(spark, tmp_path):
    df = spark.createDataFrame([("t", "m1", 1, None), ("t", "m2", 2, "x")], "tenant_id string, mailbox_id string, k int, v string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    sinks.write_json_lines(df, str(tmp_path / "j"), append=True)
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 4 and all("v" in x for x in lines)
    sinks.write_scoped(df, str(tmp_path / "s"))
    sinks.write_scoped(df.where("mailbox_id = 'm2'").withColumn("k", F.lit(9)), str(tmp_path / "s"))
    assert sorted((r["mailbox_id"], r["k"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("m1", 1), ("m2", 9)]


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "red red boat"), (2, "blue boat")], "id long, t string")
    sinks.write_lexical_index(chunks, str(tmp_path), "id", F.col("t"), 4)
    got = {tuple(r) for r in sinks.read_postings(spark, str(tmp_path), ["red", "boat"], 4).select("id", "term", "tf").collect()}
    assert got == {(r["id"], r["term"], r["tf"]) for r in retrieval.postings(chunks, "id", F.col("t")).collect() if r["term"] != "blue"}


def test_more_text_functions(spark):
    df = spark.createDataFrame([("Ａnn   Straße", "1000000000000", " a, ,b ", "https://x.example/p/a.pdf?q=1", "A b/C!!"), (None, "2031-02-03T04:05:06Z", None, "no url", None)], "n string, w string, c string, u string, i string")
    c = F.col
    a, b = df.select(T.normalize_name(c("n")), T.name_key(c("n")), T.parse_when(c("w"), "dd.MM.yyyy").cast("string"), T.csv_list(c("c")), T.url_path(c("u")), T.sanitize_id(c("i"))).collect()
    assert tuple(a) == ("Ann Straße", "ann strasse", "2001-09-09 01:46:40", ["a", "b"], "p/a.pdf", "A_b_C_")
    assert tuple(b)[:4] == (None, None, "2031-02-03 04:05:06", [])
