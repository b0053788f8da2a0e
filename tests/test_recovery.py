import json
import re
import unicodedata
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text, urls
from lexmill.operators import cohorts, corpus, entities, frontier, history, overlap, records, search
from lexmill.sources import articles, exchange


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0xABFF), st.sampled_from("éßﬁ½Ａế²№ﷺя́"))), min_size=1, max_size=30))
def test_decomposition_is_the_whole_one(spark, xs):
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x string")
    for r in df.select("i", text.fold_compatible(F.col("x")).alias("f"), text.index_tokens(F.col("x")).alias("t")).collect():
        d = unicodedata.normalize("NFKD", xs[r.i])
        assert r.f == d.encode("ascii", "ignore").decode()
        if xs[r.i].isascii() or all(c in "éßﬁ½Ａế²№я" for c in xs[r.i]):
            assert r.t == list(dict.fromkeys(re.findall(r"[^\W_]+", d.lower())))


def test_accents_split_index_terms(spark):
    d = spark.createDataFrame([("1", "Résumé café ﬁne ＡＢＣ")], "id string, text string")
    assert {r.term for r in search.postings(d, (), tokens=text.index_tokens).collect()} == {"sume", "cafe", "fine", "abc"}
    assert "only" in search.READER_STOP and "coach" not in search.READER_STOP
    many = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("word").alias("text"))
    s = search.shards(search.postings(many), 100).collect()
    assert len(s) == 10 and sorted(i for r in s for i in r.ids) == sorted(map(str, range(1000)))
    assert spark.range(1).select(text.plain_prose(F.lit("See [the map](https://a.b/c) at https://x.y/z now"))).first()[0].split() == ["See", "the", "map", "at", "now"]


@pytest.mark.parametrize("href", ["../z", "./z", "a/../b", "/r/../s", "..", "//c.example/d/./e", "http://e/x/../y", "#g", "z?x=/../y", "../../../q", ""])
def test_resolve(spark, href):
    base = "https://a.example/news/x/y.html?q"
    assert spark.range(1).select(urls.resolve(F.lit(base), F.lit(href))).first()[0] == urljoin(base, href)


def test_numbering_survives_merged_partitions(spark):
    df = spark.range(0, 997).repartition(13)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        for size in ("1KB", "64MB"):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            assert [(r.pos, r.id) for r in search.numbered(df, [F.desc("id")], "pos").orderBy("pos").collect()] == [(i, 996 - i) for i in range(997)]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_counts_inside_documents(spark):
    docs = spark.createDataFrame([("a", "x y. x y x", "t"), ("b", "Y x", "t"), ("c", None, "t"), ("d", "", "c"), ("e", "x", "c")], "slug string, body string, side string")
    got = {(r.term, r.side): (r.tf, r.df) for r in corpus.whole_term_counts(docs, ["side"], "body", (1, 2)).collect()}
    assert got == {("x", "t"): (4, 2), ("y", "t"): (3, 2), ("x y", "t"): (2, 1), ("y x", "t"): (2, 2), ("x", "c"): (1, 1)}
    assert {r.term: r.df for r in corpus.document_counts(docs, "body", (1,)).collect()} == {"x": 3, "y": 2}
    assert corpus.document_counts(docs.limit(0), "body", (1,)).count() == 0


def test_shared_windows_by_any_join(spark):
    a = spark.createDataFrame([(1, "x a b c d e f y".split()), (2, ["q"])], "i int, w array<string>")
    b = spark.createDataFrame([(7, "a b c d e f".split()), (8, "b c d z a b c".split())], "j int, w array<string>")
    for most in (0, 5, 100):
        assert {(r.i, r.j, r.grams) for r in overlap.pairs(a, b, "i", "j", 3, most).collect()} == {(1, 7, 4), (1, 8, 2)}
        assert overlap.maximal_runs(a, b, "i", "j", 3, most).count() == 3


def test_classes_of_runs(spark):
    d = spark.createDataFrame([("a b c",), ("d e f",), ("x y z",)], "run string")
    got = [r.c for r in d.select(overlap.classify(F.col("run"), ["z a b c"], F.array(F.lit("d e f g"), F.lit(""))).alias("c")).collect()]
    assert got == ["quotation", "headline", "collision"]
    found = spark.createDataFrame([("k", "a b"), ("k", "c d"), ("l", "a b")], "id string, run string")
    private = spark.createDataFrame([("k", "x a b y"), ("l", None)], "id string, title string")
    assert {tuple(r) for r in overlap.own_matter(found, private, "id", F.col("title")).collect()} == {("k", "c d"), ("l", "a b")}
    q = spark.createDataFrame([("It's so", "H"), ("its so", "H"), ("x", "none")], "quote string, headline string")
    arts = spark.createDataFrame([("s", "H", "He said: It's so, then.")], "slug string, title string, body string")
    assert {(r.quote, r.held) for r in overlap.verbatim(q, arts).collect()} == {("It's so", True), ("its so", False), ("x", False)}


def test_mentions_of_any_length(spark):
    docs = spark.createDataFrame([("1", "Then A. B. St. Brown Jr. of ﬁnes ran"), ("2", None), ("3", "")], "slug string, body string")
    names = spark.createDataFrame([("Brown", "A. B. St. Brown Jr."), ("Fines", "of fines"), ("Gone", ""), (None, "ran")], "name string, alias string")
    assert {(r.slug, r.name) for r in entities.mentions(docs, "slug", F.col("body"), names, 2).collect()} == {("1", "Brown"), ("1", "Fines")}
    assert entities.mentions(docs, "slug", F.col("body"), names.limit(0)).count() == 0


def test_merged_records(spark):
    schema = "url string, title string, status string, discovered_via string, observed_urls array<string>"
    rows = [("http://a.example/news/story/0B1/comments/x", "T", "pending", "/s", ["u2", "u1"]), ("https://a.example/news/story/0b1/article/x", "Longer", "ok", None, None), ("https://a.example/z", None, None, None, None)] * 2
    e = spark.createDataFrame(rows, schema)
    got = {r.key: r for r in records.merged_records(e).collect()}
    r = got["legacy:0b1"]
    assert (r.title, r.status, r.statuses, r.entries, len(r.records)) == ("Longer", "ok", ["ok", "pending"], 4, 2) and r.url.endswith("/article/x")
    assert r.observed_urls == ["https://a.example/news/story/0B1/comments/x", "https://a.example/news/story/0b1/article/x", "u1", "u2"]
    assert got["https://a.example/z"].status == "pending" and records.merged_records(e.limit(0)).count() == 0
    entries = spark.createDataFrame([("u", "b", "article", "ok"), ("v", "u", "index", "x"), ("w", None, "article", "y")], "url string, body_url string, kind string, status string")
    res = spark.createDataFrame([(1, "b"), (2, "u"), (3, "?"), (4, None)], "id int, url string")
    assert {(r.id, r.entry) for r in records.by_either_address(res, entries).collect()} == {(1, "u"), (2, "u"), (3, None), (4, None)}


def test_daily_outcomes(spark):
    days = records.calendar(spark, "2014-01-01", "2015-12-31")
    answers = spark.createDataFrame([(2014,)], "year int")
    caps = spark.createDataFrame([("2014-03-01", 3)], "d string, captures bigint").select(F.to_date("d").alias("day"), "captures")
    got = {str(r.day): r for r in records.daily_outcomes(days, answers, caps).collect()}
    assert (got["2014-03-01"].outcome, got["2014-03-02"].outcome, got["2015-03-01"].outcome) == ("captured", "no_capture", "query_failed")
    assert (got["2014-01-01"].place, got["2014-02-28"].place, got["2014-08-01"].place, got["2014-03-01"].place) == (1, 59, 60, 213)


@pytest.mark.parametrize("legacy,modern,k", [(30, 50, 10), (3, 50, 11), (30, 0, 10), (2, 2, 10), (0, 0, 4)])
def test_halves(spark, legacy, modern, k):
    rows = [(f"l{i:03}", True) for i in range(legacy)] + [(f"m{i:03}", False) for i in range(modern)]
    df = spark.createDataFrame(rows, "u string, old boolean")
    got = sorted(r.u for r in records.halves(df, F.col("old"), [F.col("u")], k).collect())
    want = []
    for group, n in ((rows[:legacy], (k + 1) // 2), (rows[legacy:], k // 2)):
        n = min(n, len(group))
        want += [group[i * len(group) // n][0] for i in range(n)]
    want += [u for u, _ in sorted(rows) if u not in want][: max(0, k - len(want))]
    assert got == sorted(want)


def test_frontier(spark):
    page = '<a href="../story-one" title="Story  one">x</a><a href="http://a.example/news/story/0B1/article/x?y">Old</a><a href="/shop">no</a><a href="https://b.example/news/x-y">no</a><a>none</a>'
    caps = spark.createDataFrame([("s", "2014", "https://www.a.example/news/index/", page), ("t", "2015", "https://www.a.example/", ""), ("u", "2016", "https://www.a.example/", None)], "seed string, timestamp string, original string, html string")
    none = spark.createDataFrame([], "url string, title string, status string, discovered_via string, observed_urls array<string>")
    got = {r.key: (r.kind, r.title, r.status) for r in frontier.expand(none, caps, ["www.a.example", "a.example"], ["/news"], ["/news/"]).collect()}
    assert got == {"https://www.a.example/news/story-one": ("article", "Story one", "pending"), "legacy:0b1": ("article", "Old", "pending")}


def test_layouts(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", 1)], "k string, dek string, n int")
    new = spark.createDataFrame([("a", 5, "z"), ("c", None, "w")], "k string, n int, extra string")
    assert {tuple(r) for r in history.updated(old, new, "k").collect()} == {("a", "x", 5, "z"), ("b", "y", 1, None), ("c", None, None, "w")}
    m = history.migrated(history.redacted(old, "dek"), {"n": F.lit(9), "scope": F.lit("unresolved")}, ["k"])
    assert m.columns == ["dek", "n", "scope"] and {tuple(r) for r in m.collect()} == {("", None, "unresolved"), ("", 1, "unresolved")}


def test_sources(spark, tmp_path):
    f = tmp_path / "c.json"
    rows = [["timestamp", "original", "statuscode"], ["20150101000000", "http://a/01-02-2015", "200"], ["20150102000000", "http://a/01-02-2015", "200"], ["20150201000000", "http://a/01-02-2015", "404"], ["20150103000000", "http://c", "200"]]
    f.write_text(json.dumps(rows))
    spark.dataSource.register(exchange.CaptureIndex)
    read = spark.read.format("capture_index").option("match", r".*/[0-9]{2}-[0-9]{2}-2015").option("collapse", "6").load(str(f))
    assert sorted(r.timestamp for r in read.collect()) == ["20150101000000", "20150201000000"]
    df = spark.createDataFrame([("s1", "T", ["A B"], {"original_url": 'x"y', "http_status": "200"}, "body")], "slug string, title string, teams array<string>, provenance map<string,string>, body string")
    df = df.withColumn("entities", F.struct("teams", F.array().cast("array<string>").alias("players"))).drop("teams")
    value = df.select(articles.to_markdown(df).alias("value"))
    back = articles.parse_front_matter(value).first()
    assert back.provenance == {"original_url": 'x"y', "http_status": "200"} and json.loads(back.meta["entities"])["teams"] == ["A B"] and back.body == "body"
    out = str(tmp_path / "o")
    exchange.write_json(spark.range(3), out)
    with pytest.raises(Exception):
        exchange.write_json(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), out)
    assert spark.read.json(out).count() == 3
    exchange.write_json(spark.range(5), out)
    assert spark.read.json(out).count() == 5 and sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("o.old")) == []


def test_matched_terms(spark):
    m = spark.createDataFrame([("s", "First-round picks. A rash  of wideouts; CB and QB, said Jane Doe of The Daily Post.")], "side string, body string")
    got = {r.label: r.occurrences for r in cohorts.measure(m, ["side"], cohorts.MATCHED).collect()}
    assert len(got) == 32 and (got["first-round pick"], got["a rash of"], got["wide receiver / wideout"], got["[position abbreviations]"], got["[reporter named with paper]"], got["war"]) == (1, 1, 1, 2, 1, 0)


def test_cut_tables_are_released(spark):
    from lexmill.session import cut, release

    release(spark)
    df = cut(spark.range(5))
    assert df.count() == 5 and release(spark) == 1 and release(spark) == 0
