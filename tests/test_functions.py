import pytest
from pyspark.sql import functions as F

from lexmill.functions import dates, html, text, urls


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_clean_url(spark):
    u = "https://web.archive.org/web/20150605201612id_/http://www.pigskin-ledger.example:80/news/story/0BX1/article/x?y#z"
    got = one(spark, urls.clean_url, u, "http://pigskin-ledger.example/a/", "https://pigskin-ledger.example.org/a", "")
    assert got == ["https://www.pigskin-ledger.example/news/story/0BX1/article/x", "https://www.pigskin-ledger.example/a", "https://pigskin-ledger.example.org/a", ""]
    assert one(spark, urls.canonical, got[0], got[1]) == ["legacy:0bx1", got[1]]


@pytest.mark.parametrize(
    "path,kind",
    [
        ("/news/story/0bx1/article/x", "article"), ("/news/story/0bx1", "index"), ("/news/around-the-gridiron/01-05-2014", "index"), ("/news/around-the-gridiron_11/959", "pagination"),
        ("/videos/x", "nav"), ("/news/some-slug", "article"), ("/foo", "unknown"), ("/news", "index"), ("/news/{x}", "nav"), ("/blogs/around-the-gridiron/7", "index"),
    ],
)
def test_kind(spark, path, kind):
    assert one(spark, lambda c: urls.kind(c, urls.clean_url(c)), "https://a.example" + path) == [kind]


def test_more_urls(spark):
    assert one(spark, urls.slugify, "https://a.example/News/A%20b/")[0].startswith("a-20b-")
    assert one(spark, urls.archive_stamp, "https://x/web/20150605201612id_/y", "z") == ["20150605201612", ""]
    j = lambda h: one(spark, lambda c: urls.join_url(F.lit("https://a.example/news/x.html?q#f"), c), h)[0]
    assert (j("/b"), j("//c.example/d"), j("http://e"), j("f")) == ("https://a.example/b", "https://c.example/d", "http://e", "https://a.example/news/f")
    links = spark.range(1).select(urls.action_links(F.lit("https://a/b"), F.lit("https://arc/b"), F.lit("live"), F.lit("2018-07-11"), "https://arc").alias("x")).first().x
    assert [x.label for x in links][3] == "Captures in publication month" and links[3].url.endswith("&from=201807&to=201807") and links[0].url == "https://a/b"


def test_norm_date(spark):
    got = one(spark, dates.norm_date, "2018-07-11T10:00:00Z", "7/11/2018", "11 July 2018", "Sept. 5th, 2018", "2018-02-30", "", "2018-02-30 or 3/4/2019", "May 5, 2018")
    assert got == ["2018-07-11"] * 3 + ["2018-09-05", "", "", "2019-03-04", "2018-05-05"]


def test_sentences_and_ngrams(spark):
    assert one(spark, text.sentences, "He can’t stop. It — works", "It`s 1; two -- three", "") == [[["He", "cant", "stop"], ["It", "works"]], [["It's", "1"], ["two"], ["three"]], []]
    assert one(spark, lambda c: text.ngrams(F.split(c, " "), (1, 2, 3)), "a rash of", "a") == [["a", "rash", "of", "a rash", "rash of", "a rash of"], ["a"]]
    assert one(spark, text.search_tokens, "Résumé café") == [["résumé", "café"]]
    assert one(spark, text.word_count, "", " a b  c ") == [0, 3]
    assert one(spark, text.normal_text, "Größe: “Ñandú” ﬁx!") == ["groe nandu x"]
    assert one(spark, text.canon, "“It’s—A”  test, ok") == ["it's-a test ok"]


def test_furniture(spark):
    body = "Keep this.\n17 games | 67.1 pct | 5,250 pass yds\n- A ▶ B\nFollow me on Twitter @x\n2014 stats: 1\nKeep | that | too and more words here"
    assert one(spark, lambda c: text.strip_furniture(c, "around the gridiron"), body) == ["Keep this.\n\nKeep | that | too and more words here"]
    assert one(spark, lambda c: F.array_join(text.drop_repeats(F.split(c, ",")), ","), "a,a,b,a") == ["a,b,a"]
    assert one(spark, text.last_sentence, "One. Two!\n\nThree? Four it is.  ", "\n", "x") == ["Four it is.", None, "x"]


PAGE = """<html><head><title>T</title><meta property="og:title" content="The title"><meta name="author" content="By Jane Doe">
<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "datePublished": "2018-07-11", "author": [{"name": "X"}]}]}</script></head>
<body><nav><a href="/a">Home</a></nav><div class="article-body-text"><h2>Head</h2><p>One <b>bold</b> word.</p><p>One <b>bold</b> word.</p><p>Subscribe to us</p><ul><li>item one<li>item two</ul><blockquote>said</blockquote></div></body></html>"""


def test_html(spark):
    r = spark.createDataFrame([(PAGE,), ("",), ("<div><p>a b</p><p>c d</p></div>",), (None,)], "h string").select(html.extract("h").alias("x"), html.page_links("h").alias("l")).collect()
    x = r[0].x
    assert (x.title, x.date, x.date_selector, x.byline, x.byline_selector, x.body_selector) == ("The title", "2018-07-11", "jsonld:datePublished", "Jane Doe", "meta", ".article-body-text")
    assert x.body == "### Head\n\nOne bold word.\n\n- item one\n\n- item two\n\n> said"
    assert [(a.href, a.title) for a in r[0].l] == [("/a", "Home")]
    assert r[1].x.body is None and r[2].x.body_selector == "heuristic:densest-p-container" and r[3].x.title == ""
