import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.sources import articles, exchange
from lexmill.streaming import board, limiter


def test_markdown_round_trip(spark, tmp_path):
    text = '---\nslug: "a-b"\ntitle: Plain title\ndate: 2018\ndate: "2019"\nword_count: 7\nprovenance:\n  original_url: "https://x"\n  http_status: 200\n---\n\nBody “here”\n\nmore\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(text)
    (tmp_path / "in" / "b.md").write_text("no front matter")
    r = articles.read_markdown(spark, str(tmp_path / "in")).collect()
    assert len(r) == 1 and (r[0].slug, r[0].title, r[0].date, r[0].word_count) == ("a-b", "Plain title", "2019", 7)
    assert r[0].provenance == {"original_url": "https://x", "http_status": "200"} and r[0].body == "Body “here”\n\nmore"
    df = spark.createDataFrame([("s1", 'He said "no"', "x\ny"), ("s2", None, None)], "slug string, title string, body string")
    articles.write_markdown(df, str(tmp_path / "out"))
    raw = spark.read.text(str(tmp_path / "out"), wholetext=True, recursiveFileLookup=True)
    back = {r.meta["slug"]: (r.meta.get("title"), r.body) for r in articles.parse_front_matter(raw).collect()}
    assert back == {"s1": ('He said "no"', "x\ny"), "s2": (None, "")}


def test_exchange(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"articles": [{"url": "u", "n": 1}, {"url": None, "n": 2}]}))
    assert exchange.read_json_document(spark, str(tmp_path / "doc.json"), "articles", "url string, n bigint").count() == 2
    (tmp_path / "r1.csv").write_text("full_name,player_name,first_name,last_name,football_name\nA B,A.B,A,B,A\nA B,A.B,A,B,A\n")
    assert exchange.read_roster(spark, str(tmp_path / "r1.csv")).count() == 1
    assert exchange.unpack(exchange.pack({"ä": [1, "<"]})) == {"ä": [1, "<"]} and exchange.pack([1]) == exchange.pack([1])
    d = spark.createDataFrame([("text",), (None,)], "x string")
    assert [r.y for r in d.select(exchange.unpacked(exchange.packed("x")).alias("y")).collect()] == ["text", None]
    assert spark.range(1).select(exchange.json_for_page(F.struct(F.lit("<b>").alias("t"))).alias("j")).first().j == '{"t":"\\u003cb>"}'
    exchange.write_json(d, str(tmp_path / "o"))
    assert spark.read.schema("x string").json(str(tmp_path / "o")).count() == 2


def test_capture_index(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps([["timestamp", "original", "statuscode"], ["20150101000000", "http://a", "200"], ["20150102000000", "http://b", "404"], ["20150103000000", "http://c"]]))
    spark.dataSource.register(exchange.CaptureIndex)
    df = spark.read.format("capture_index").load(str(f))
    assert df.count() == 3 and [r.original for r in df.where("statuscode = '200'").collect()] == ["http://a"]


def test_limiter_in_batch_and_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("c1", t0 + timedelta(seconds=s)) for s in (1, 2, 3, 4, 905)] + [("c2", t0 + timedelta(seconds=5))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, client string, ts timestamp")
    assert [r.allowed for r in limiter.decisions(df, "id", 900, 2).orderBy("id").collect()] == [True, True, False, False, True, True]
    assert {(r.client, r.attempts, r.stored) for r in limiter.windows(df, 900, 2).collect()} == {("c1", 4, 2), ("c1", 1, 1), ("c2", 1, 1)}
    df.drop("id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "in"))
    q = limiter.decide_stream(stream, 900, 2).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.client, r.ts, r.allowed) for r in spark.table("decided").collect())
    assert [x[2] for x in got] == [True, True, False, False, True, True]


def test_board(spark, tmp_path):
    schema = "at string, phase string, outcome string, url string"
    spark.createDataFrame([("t1", "fetch", "ok", "u"), ("t2", "fetch", "failed", "u"), ("t3", "fetch", "ok", "v")], schema).write.parquet(str(tmp_path / "in"))
    events = board.read_events(spark, str(tmp_path / "in"), schema)
    board.run_once(board.counts(events), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.outcome, r.n) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("ok", 2), ("failed", 1)}
    board.audit_log(events, str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).where("ok").count() == 2
