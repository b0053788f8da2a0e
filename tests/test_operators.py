import pytest
from pyspark.sql import functions as F

from lexmill.operators import cohorts, corpus, entities, overlap, records, search
from lexmill.session import cut


def test_log_odds(spark):
    c = spark.createDataFrame([("x", "target", 3, 3), ("x", "control", 1, 1), ("y", "target", 4, 4), ("y", "control", 6, 6), ("z", "target", 2, 2)], "term string, side string, tf bigint, df bigint")
    got = {r.term: r.z for r in corpus.log_odds(c, "tf").collect()}
    assert got["x"] == pytest.approx(0.802684, abs=1e-6) and got["y"] == pytest.approx(-1.284294, abs=1e-6) and "z" not in got
    assert corpus.log_odds(c.where("term = 'x'")).first().z == 0.0
    assert corpus.log_odds(c.limit(0)).count() == 0


def test_collapse(spark):
    s = spark.createDataFrame([("a rash of", 9, 2.0), ("rash of", 10, 3.0), ("rash", 12, 1.0), ("a", 50, 0.0), ("b c", 8, 1.0), ("b", 10, 2.0)], "term string, df bigint, z double")
    assert {r.term for r in corpus.collapse_nested(s).collect()} == {"a rash of", "a", "b c", "b"}
    assert {r.term for r in corpus.collapse_nested(s, strict=True).collect()} == {"a rash of", "rash of", "a", "b c", "b"}


def test_runs_break_at_names_and_years(spark):
    s = spark.createDataFrame([("d", 0, ["Then", "Burrow", "threw", "in", "2022", "and", "won"])], "doc string, s int, tokens array<string>")
    p = spark.createDataFrame([("burrow",)], "token string")
    assert sorted(r.tokens for r in corpus.runs(s, "doc", p).collect()) == [["and", "won"], ["then"], ["threw", "in"]]
    # A sentence's first token is no evidence of case.
    t = spark.createDataFrame([("d", 0, ["Mark", "saw", "Mark"]), ("d", 1, ["Saw", "mark", "Bob", "Mark"])], "doc string, s int, tokens array<string>")
    assert {(r.token, r.caps, r.total) for r in corpus.case_profile(t).collect()} == {("bob", 1, 1)}


def test_maximal_phrases(spark):
    docs = [(f"d{i}", 0, 0, ["one", "mary", "kay", "cabot", "of", "the", "plain", "dealer", f"w{i}"]) for i in range(5)] + [("e", 0, 0, ["of", "the", "town"])]
    runs = spark.createDataFrame(docs, "slug string, s int, run int, tokens array<string>")
    terms = spark.createDataFrame([("kay cabot", 2.0, 5), ("cabot of the", 3.0, 5), ("of the", 1.0, 6), ("town", 0.5, 1)], "term string, z double, df bigint")
    got = {(r.phrase, r.term) for r in corpus.maximal_phrases(terms, runs, "slug", cut).collect()}
    assert ("one mary kay cabot of the plain dealer", "cabot of the") in got and ("of the town", "town") in got and len(got) == 2 + (("of the", "of the") in got)
    short = {r.phrase for r in corpus.maximal_phrases(terms.where("term = 'kay cabot'"), runs, "slug", cut, limit=4).collect()}
    assert short == {"kay cabot of the"}


def test_ranked_phrases_keep_the_tail(spark):
    docs = [(f"d{i}", 0, 0, ["kay", "cabot", "of", "town", f"w{i}"]) for i in range(5)]
    runs = spark.createDataFrame(docs, "slug string, s int, run int, tokens array<string>")
    terms = [("cabot of", 3.0, 5), ("kay cabot of town", 2.0, 5), ("town", 1.0, 5), ("kay", 0.5, 5)]
    df = spark.createDataFrame(terms, "term string, z double, df bigint")
    got = {tuple(r) for r in corpus.ranked_phrases(df, runs, "slug", cut, pool=1).select("phrase", "term", "z", "df").collect()}
    assert got == {("kay cabot of town", "cabot of", 3.0, 5), ("town", "town", 1.0, 5), ("kay", "kay", 0.5, 5)}


def test_profile(spark):
    rows = [("a", "x\n" + " ".join(["w"] * n) + ".") for n in (1, 2, 3, 4)] + [("a", None), ("b", "I don't know. We do")]
    df = spark.createDataFrame(rows, "g string, body string")
    got = {r.g: r for r in cohorts.final_profile(df, ["g"], F.col("body")).collect()}
    assert (got["a"].n, got["a"].median_words, got["a"].pct_short) == (4, 3, 100.0) and got["b"].pct_first_person == 100.0
    m = cohorts.measure(spark.createDataFrame([("g", "Late on time, late  on. " + "w " * 395)], "g string, body string"), ["g"], [("late", r"(?i)\blate\s+on\b", "habit")]).first()
    assert (m.occurrences, m.words, m.per_10k) == (2, 400, 50.0)


def test_search(spark):
    d = spark.createDataFrame([("1", "The red fox"), ("2", "red RED wolf"), ("3", None)], "id string, text string")
    assert {(r.term, tuple(r.ids)) for r in search.index(d).collect()} == {("red", ("1", "2")), ("fox", ("1",)), ("wolf", ("2",))}
    assert [r.id for r in search.all_of(search.postings(d), ["red", "fox"]).collect()] == ["1"]
    n = spark.range(100).repartition(7)
    assert [(r.id, r.pos) for r in search.numbered(n, [F.desc("id")], "pos").orderBy("pos").collect()] == [(99 - i, i) for i in range(100)]


def test_records(spark):
    n = spark.range(7).select(F.col("id").alias("k"))
    assert [r["count"] for r in records.bands(n, [F.col("k")], 3, 7).groupBy("band").count().orderBy("band").collect()] == [2, 2, 3]
    assert records.systematic(spark.range(103), [F.col("id")], 10, 103).count() == 10
    b = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("band"))
    s = records.stratified(b, "band", "k", 10, 1)
    assert [r["count"] for r in s.groupBy("band").count().collect()] == [10] * 3 and {r.k for r in s.collect()} == {r.k for r in records.stratified(b.repartition(5), "band", "k", 10, 1).collect()}
    e = spark.createDataFrame([("http://a.example/news/story/0B1/article/x", "T", ["u"]), ("https://a.example/news/story/0b1", "Longer", None), ("https://a.example/z", None, None)], "url string, title string, observed_urls array<string>")
    got = {r.key: r for r in records.merge_entries(e).collect()}
    assert got["legacy:0b1"].title == "Longer" and got["legacy:0b1"].entries == 2 and got["https://a.example/z"].title == ""


def test_overlap(spark):
    a = spark.createDataFrame([(1, "x a b c d e f y".split()), (2, ["q"])], "i int, w array<string>")
    b = spark.createDataFrame([(7, "a b c d e f".split()), (8, "b c d z a b c".split())], "j int, w array<string>")
    runs = {(r.i, r.j, r.a_pos, r.b_pos, r.words) for r in overlap.maximal_runs(a, b, "i", "j", 3).collect()}
    assert runs == {(1, 7, 1, 0, 6), (1, 8, 2, 0, 3), (1, 8, 1, 4, 3)}
    assert {(r.i, r.j, r.grams) for r in overlap.pairs(a, b, "i", "j", 3).collect()} == {(1, 7, 4), (1, 8, 2)}
    x = spark.range(1).select(overlap.entity_only(F.lit("big foxes"), F.array(F.lit("foxes"), F.lit("big"))).alias("e"), overlap.suppressed(F.lit("b c"), ["a b c d"]).alias("s"), overlap.suppressed(F.lit("b z"), ["b c"]).alias("t")).first()
    assert (x.e, x.s, x.t) == (True, True, False)


def test_entities(spark):
    d = spark.createDataFrame([("1", "The Dust-Devils beat St. Mary's Foxes"), ("2", "dusty devils")], "slug string, body string")
    t = spark.createDataFrame([("Umber Dust Devils", "Dust Devils"), ("Foxes", "foxes"), ("Alpha", "foxes"), (None, "x")], "name string, alias string")
    got = {(r.slug, r.name) for r in entities.matches(d, "slug", F.col("body"), entities.aliases(t, "name", "alias")).collect()}
    assert got == {("1", "Umber Dust Devils"), ("1", "Alpha")}
    r = spark.range(1).select(entities.article_format(F.lit("Top 10 things"), F.lit("")).alias("a"), entities.article_format(F.lit("X"), F.lit("w " * 700)).alias("b"), entities.byline_names(F.lit("A B and C D, A B")).alias("n")).first()
    assert (r.a, r.b, r.n) == ("ranking", "column", ["A B", "C D"])
