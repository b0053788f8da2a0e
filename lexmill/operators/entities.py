"""Names from dictionaries in texts, and rules on titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text


def aliases(df: DataFrame, name: str, alias: str) -> DataFrame:
    """name, alias (normalised), words; an alias of several names goes to the smallest name."""
    a = df.select(F.col(name).alias("name"), text.normal_text(F.col(alias)).alias("alias")).where("name is not null and alias <> ''")
    return a.groupBy("alias").agg(F.min("name").alias("name")).withColumn("words", F.size(F.split("alias", " ")))


def matches(docs: DataFrame, key: str, body: Column, dictionary: DataFrame, longest: int = 4, least: int = 1) -> DataFrame:
    """(key, name) of documents that hold an alias as whole words: an equi-join on word n-grams instead of a search per alias."""
    w = docs.select(key, F.split(text.normal_text(body), " ").alias("w"))
    sizes = range(least, longest + 1)
    g = w.select(key, F.explode(F.array_distinct(text.ngrams(F.col("w"), tuple(sizes)))).alias("alias"))
    return g.join(dictionary.where(F.col("words").between(least, longest)).select("alias", "name"), "alias").select(key, "name").distinct()


def mentions(docs: DataFrame, key: str, body: Column, names: DataFrame, least: int = 1) -> DataFrame:
    """(key, name) of the documents that hold an alias of ``least`` words or more, however many it has.  names: name, alias (an
    alias table, several rows a name); texts and aliases are compared by the full decomposition.

    A document's n-grams only have the lengths that the dictionary has."""
    a = names.select("name", text.normal_words(F.col("alias")).alias("alias")).where("name is not null and alias <> ''")
    a = a.groupBy("alias").agg(F.min("name").alias("name")).withColumn("words", F.size(F.split("alias", " "))).where(F.col("words") >= least)
    sizes = tuple(sorted(r.words for r in a.select("words").distinct().collect()))  # a handful of numbers
    w = docs.select(key, F.split(text.normal_words(body), " ").alias("w"))
    if not sizes:
        return w.limit(0).select(key, F.lit(None).cast("string").alias("name"))
    g = w.select(key, F.explode(F.array_distinct(text.ngrams(F.col("w"), sizes))).alias("alias"))
    return g.join(a.select("alias", "name"), "alias").select(key, "name").distinct()


# Title patterns of series, in order.
SERIES = [(r"(?i)^QB Almanac\b", "QB Almanac"), (r"(?i)^Roster Reset\b", "Roster Reset"), (r"(?i)^Hot or Not\b", "Hot or Not")]


def series(title: Column) -> Column:
    out = F.lit("")
    for pattern, name in reversed(SERIES):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


# What a title says of an article's format, in order, and the words from which on an article is a column.
FORMATS = [
    (r"(?i)\b(dies|died|obituary|remembering|passes away|dead at)\b", "obituary"),
    (r"(?i)\b(rankings?|ranking|ranked|top \d+|QB Index|best and worst)\b", "ranking"),
    (r"(?i)\b(dispatch|from the (?:combine|sidelines)|on the scene|training camp report)\b", "dispatch"),
    (r"(?i)\b(on my radar|why|what we learned|my favorite)\b", "column"),
]
COLUMN_WORDS = 700


def article_format(title: Column, body: Column) -> Column:
    """The first rule that fits; a series or a long text is a column, anything else a news brief."""
    long = (series(title) != "") | (F.coalesce(text.word_count(body), F.lit(0)) >= COLUMN_WORDS)
    rules = [(title.rlike(p) | long if name == "column" else title.rlike(p), name) for p, name in FORMATS]
    return F.coalesce(*[F.when(fits, name) for fits, name in rules], F.when(long, "column"), F.lit("news brief"))


def byline_names(raw: Column) -> Column:
    """Distinct names of a byline split at commas, 'and' and '&'."""
    return F.array_distinct(F.filter(F.transform(F.split(raw, r",\s*|\s+and\s+|\s*&\s*"), lambda x: F.trim(x)), lambda x: x != ""))
