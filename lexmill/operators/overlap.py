"""Runs of words shared between two text collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import widen


def words(df: DataFrame, key: str, canon: Column) -> DataFrame:
    """key, w: words of the canonical text."""
    return widen(df).select(F.col(key), F.filter(F.split(canon, " "), lambda x: x != "").alias("w"))


def grams(w: DataFrame, key: str, n: int) -> DataFrame:
    """key, pos, gram (its 128-bit hash) of every n-word window."""
    made = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    hashed = F.transform(made, lambda g: F.struct(F.xxhash64(g).alias("x"), F.xxhash64(F.lit(7), g).alias("y")))
    return w.where(F.size("w") >= n).select(key, F.posexplode(hashed).alias("pos", "gram"))


def _meet(a: DataFrame, b: DataFrame, wa: DataFrame, wb: DataFrame, n: int, most: int) -> DataFrame:
    """a joined with b by gram.  A side of at most ``most`` windows, which are counted, is sent to the other's tasks, which then
    isn't shuffled; otherwise both go by gram."""
    size = lambda w: w.agg(F.sum(F.greatest(F.size("w") - n + 1, F.lit(0)))).first()[0] or 0
    if size(wb) <= most:
        return a.join(F.broadcast(b), "gram")
    return F.broadcast(a).join(b, "gram") if size(wa) <= most else a.join(b, "gram")


def pairs(a: DataFrame, b: DataFrame, ka: str, kb: str, n: int, most: int = 500_000) -> DataFrame:
    """ka, kb, grams: how many different n-word windows both hold."""
    ga = grams(a, ka, n).select(ka, "gram")
    gb = grams(b, kb, n).select(kb, "gram")
    return _meet(ga, gb, a, b, n, most).groupBy(ka, kb).agg(F.countDistinct("gram").alias("grams"))


def maximal_runs(a: DataFrame, b: DataFrame, ka: str, kb: str, n: int, most: int = 500_000) -> DataFrame:
    """ka, kb, a_pos, b_pos, words of every maximal run of n or more shared words: windows on one diagonal that follow one
    another are one run (token-aligned, every pair of places, so independent of the order of files)."""
    ga = grams(a, ka, n).select(ka, F.col("pos").alias("a_pos"), "gram")
    gb = grams(b, kb, n).select(kb, F.col("pos").alias("b_pos"), "gram")
    d = _meet(ga, gb, a, b, n, most).withColumn("diag", F.col("b_pos") - F.col("a_pos"))
    w = Window.partitionBy(ka, kb, "diag").orderBy("a_pos")
    isle = d.withColumn("isle", F.col("a_pos") - F.row_number().over(w))
    return isle.groupBy(ka, kb, "diag", "isle").agg(F.min("a_pos").cast("bigint").alias("a_pos"), F.min("b_pos").cast("bigint").alias("b_pos"), (F.count("*") + n - 1).alias("words")).drop("diag", "isle")


def entity_only(run: Column, names: Column) -> Column:
    """Whether every word of a run is one of the names' words."""
    return F.size(F.array_except(F.split(run, " "), names)) == 0


def suppressed(run: Column, approved: list[str]) -> Column:
    """Whether a run is part of an approved phrase or holds one."""
    out = F.lit(False)
    for p in approved:
        out = out | F.contains(F.lit(p), run) | F.contains(run, F.lit(p))
    return out


def own_matter(found: DataFrame, private: DataFrame, key: str, matter: Column) -> DataFrame:
    """Runs without those that stand in the front matter (canonical) of the private text they were found in: what a title or a
    teaser says was published with it."""
    m = private.select(key, matter.alias("_matter"))
    return found.join(m, key, "left").where(~F.coalesce(F.contains("_matter", F.col("run")), F.lit(False))).drop("_matter")


def name_words(names: DataFrame, name: str) -> list[str]:
    """Words of all names, for ``entity_only``: a closed vocabulary, whose distinct words come to the driver."""
    return sorted(r.w for r in names.select(F.explode(F.split(F.col(name), " ")).alias("w")).where("w <> ''").distinct().collect())


def classify(run: Column, quoted: list[str], headlines: Column) -> Column:
    """'quotation' for a run inside a quoted phrase or around one, 'headline' the same of the headlines, else 'collision'."""
    headline = F.exists(headlines, lambda h: (h != "") & (F.contains(h, run) | F.contains(run, h)))
    return F.when(suppressed(run, quoted), "quotation").when(F.coalesce(headline, F.lit(False)), "headline").otherwise("collision")


def quotes(lines: DataFrame, value: str = "value") -> DataFrame:
    """quote, headline, date of '::quote a | b | c' lines."""
    body = F.regexp_extract(value, r"^::quote\s+(.*)$", 1)
    parts = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
    return lines.where(F.col(value).startswith("::quote ")).select(F.get(parts, F.lit(0)).alias("quote"), F.get(parts, F.lit(1)).alias("headline"), F.get(parts, F.lit(2)).alias("date"))


def audit(found: DataFrame, articles: DataFrame) -> DataFrame:
    """quote, slug, class: 'verbatim' where the article of that headline holds the quote (both canonical), 'altered' where it
    doesn't, 'unknown' without such an article.  found: quote, headline; articles: slug, title, body."""
    from lexmill.functions import text

    q = found.select("quote", "headline", text.canon(F.col("headline")).alias("h"), text.canon(F.col("quote")).alias("q"))
    a = articles.select("slug", text.canon(F.col("title")).alias("h"), text.canon(F.col("body")).alias("b"))
    j = q.join(a, "h", "left")
    held = F.max(F.when(F.contains(F.concat(F.lit(" "), "b", F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" "))), 1).otherwise(0))
    g = j.groupBy("quote", "headline").agg(F.min("slug").alias("slug"), held.alias("held"))
    return g.select("quote", "headline", "slug", F.when(F.col("slug").isNull(), "unknown").when(F.col("held") == 1, "verbatim").otherwise("altered").alias("class"))


def verbatim(found: DataFrame, articles: DataFrame) -> DataFrame:
    """quote, headline, slug, held: whether the article of exactly that headline holds the quotation to the letter (``audit``
    compares canonical texts)."""
    j = found.select("quote", "headline").distinct().join(articles.select("slug", F.col("title").alias("headline"), "body"), "headline", "left")
    return j.groupBy("quote", "headline").agg(F.min("slug").alias("slug"), F.coalesce(F.bool_or(F.contains("body", F.col("quote"))), F.lit(False)).alias("held"))


def leak_check(public: DataFrame, private: DataFrame, kp: str, ks: str, n: int, approved: list[str], names: Column | None = None) -> DataFrame:
    """Runs of n or more words of private texts in public ones, without approved phrases and runs of names only.

    public, private: key and w (words).  Result: keys, run, words."""
    runs = maximal_runs(public, private, kp, ks, n)
    spelled = runs.join(public, kp).select(kp, ks, F.array_join(F.slice("w", F.col("a_pos").cast("int") + 1, F.col("words").cast("int")), " ").alias("run"), "words")
    out = spelled.where(~suppressed(F.col("run"), approved))
    return out.where(~entity_only(F.col("run"), names)) if names is not None else out
