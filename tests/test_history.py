import base64
import hashlib
import hmac
from datetime import datetime

from pyspark.sql import functions as F

from lexmill.functions import digests, text
from lexmill.operators import history as H
from lexmill.operators import overlap


def test_rules(spark):
    r = spark.range(1).select(
        H.newer_byline(F.lit("a"), F.lit("")).alias("a"), H.newer_byline(F.lit(""), F.lit("")).alias("b"), H.newer_byline(F.lit("a"), F.lit("c")).alias("c"),
        H.accept_repair(F.lit("x" * 400), F.lit("y" * 500), F.lit(".s (all blocks)")).alias("d"), H.accept_repair(F.lit("x" * 400), F.lit("y" * 500), F.lit(".s")).alias("e"),
        H.accept_repair(F.lit(None).cast("string"), F.lit("y" * 300), F.lit(".s")).alias("f"), H.accept_repair(F.lit(""), F.lit("y" * 299), F.lit(".s")).alias("g"),
        H.first_title(F.lit(""), F.lit(None).cast("string"), F.lit(" T ")).alias("h"), H.tidy_byline(F.lit("By N/A")).alias("i"), H.tidy_byline(F.lit("by Jane")).alias("j"), H.keep_first(F.lit(None), F.lit(1)).alias("k"),
    ).first()
    assert tuple(r) == ("a", "", "c", True, False, True, False, "T", "", "Jane", 1)
    f = spark.range(1).select(H.byline_fields(F.lit("Jane Roe"), F.array(F.lit("/author/roe-1"), F.lit("/news/my-desk/3")), "roe", "my-desk").alias("f")).first().f
    assert tuple(f) == ("roe", "author-page", "roe")


def test_routes_and_changes(spark):
    c = spark.createDataFrame([("k", "archive", "2"), ("k", "live", "9"), ("k", "live", "5"), ("m", "archive", "1")], "k string, route string, ts string")
    got = {(r.k, r.route, r.ts) for r in H.best_route(c, "k", F.when(F.col("route") == "live", 0).otherwise(1), "ts").collect()}
    assert got == {("k", "live", "5"), ("m", "archive", "1")}
    assert [r.k for r in H.still_to_do(c.select("k").distinct(), spark.createDataFrame([("k",)], "k string"), "k").collect()] == ["m"]
    b = spark.createDataFrame([("1", ["A", "B"]), ("2", ["C"])], "slug string, names array<string>")
    a = spark.createDataFrame([("1", ["B", "D"]), ("2", ["C"]), ("3", ["E"])], "slug string, names array<string>")
    assert {(r.slug, tuple(r.added), tuple(r.dropped)) for r in H.name_changes(b, a, "slug").collect()} == {("1", ("D",), ("A",)), ("3", ("E",), ())}


def test_quotation_audit(spark):
    lines = spark.createDataFrame([("::quote It’s a “test” | Big Day | 2018",), ("plain",), ("::quote never said | Big Day | x",), ("::quote x | Other | y",)], "value string")
    arts = spark.createDataFrame([("s", "Big day!", "He said: it's a test, maybe.")], "slug string, title string, body string")
    got = {(r.quote, r["class"]) for r in overlap.audit(overlap.quotes(lines), arts).collect()}
    assert got == {("It’s a “test”", "verbatim"), ("never said", "altered"), ("x", "unknown")}
    pub = overlap.words(spark.createDataFrame([("p", "one two three four five big foxes")], "p string, t string"), "p", text.canon(F.col("t")))
    priv = overlap.words(spark.createDataFrame([("q", "x one two three four y big foxes")], "q string, t string"), "q", text.canon(F.col("t")))
    assert [(r.run, r.words) for r in overlap.leak_check(pub, priv, "p", "q", 2, [], F.array(F.lit("big"), F.lit("foxes"))).collect()] == [("one two three four", 4)]
    assert overlap.leak_check(pub, priv, "p", "q", 3, ["one two three four five"]).count() == 0


def test_digests(spark):
    r = spark.createDataFrame([("a?>", datetime(2024, 1, 1), datetime(2024, 1, 1, 11)), (None, datetime(2024, 1, 1), datetime(2024, 1, 1, 13))], "x string, i timestamp, t timestamp")
    got = r.select(digests.base64url(F.col("x").cast("binary")).alias("b"), digests.hmac_sha256("k")("x").alias("h"), digests.token_valid(F.col("i"), F.col("t")).alias("v")).collect()
    want = base64.urlsafe_b64encode(hmac.new(b"k", b"a?>", hashlib.sha256).digest()).rstrip(b"=").decode()
    assert [tuple(x) for x in got] == [("YT8-", want, True), (None, None, False)]
