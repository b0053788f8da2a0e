"""Rates of patterns and sentence profiles on cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text

# Label, pattern and kind of what is counted per 10,000 words.
TERMS = [
    ("quarter", r"(?i)\bquarters?\b", "plain"),
    ("season", r"(?i)\bseasons?\b", "plain"),
    ("coordinator", r"(?i)\bcoordinators?\b", "plain"),
    ("scout named", r"(?i)\bscout\s+named\b", "habit"),
    ("against the", r"(?i)\bagainst\s+the\b", "habit"),
    ("late on", r"(?i)\blate\s+on\b", "habit"),
    ("stubborn", r"(?i)\bstubborn\b", "elevated"),
    ("rookie", r"(?i)\brookies?\b", "plain"),
    ("abbreviations", r"\b(?:CB|WR|OC|DC|DB|RB|TE|QB|LB|OL)\b", "abbreviation"),
    ("attribution", r"\b[A-Z][a-z]+ [A-Z][a-z]+ said\b", "attribution"),
]


# Label, pattern and kind of the terms whose rates are compared on matched cohorts.
MATCHED = [
    ("first-round pick", r"(?i)\bfirst[\s-]round\s+picks?\b", "plain"), ("first-rounder", r"(?i)\bfirst[\s-]rounders?\b", "elevated"),
    ("cornerback", r"(?i)\bcornerbacks?\b", "plain"), ("wide receiver / wideout", r"(?i)\b(?:wide\s+receivers?|wideouts?)\b", "plain"),
    ("season", r"(?i)\bseasons?\b", "plain"), ("offensive coordinator", r"(?i)\boffensive\s+coordinators?\b", "plain"),
    ("cover man", r"(?i)\bcover\s+m(?:a|e)n\b", "elevated"), ("play caller", r"(?i)\bplay[\s-]callers?\b", "elevated"),
    ("passer", r"(?i)\bpassers?\b", "elevated"), ("pass catcher", r"(?i)\bpass[\s-]catchers?\b", "elevated"),
    ("under center", r"(?i)\bunder\s+center\b", "elevated"), ("signal-caller", r"(?i)\bsignal[\s-]callers?\b", "elevated"),
    ("autumn", r"(?i)\bautumns?\b", "elevated"), ("campaign", r"(?i)\bcampaigns?\b", "elevated"),
    ("looms as", r"(?i)\blooms\s+as\b", "habit"), ("that saw", r"(?i)\bthat\s+saw\b", "habit"),
    ("rough and tumble", r"(?i)\brough[\s-]and[\s-]tumble\b", "habit"), ("rugged", r"(?i)\brugged\b", "habit"),
    ("league wide", r"(?i)\bleague[\s-]wide\b", "habit"), ("finest", r"(?i)\bfinest\b", "habit"), ("a rash of", r"(?i)\ba\s+rash\s+of\b", "habit"),
    ("chaos", r"(?i)\bchaos\b", "died"), ("starry", r"(?i)\bstarry\b", "died"), ("a flock of", r"(?i)\ba\s+flock\s+of\b", "died"),
    ("eons", r"(?i)\beons\b", "died"), ("earth", r"(?i)\bearth\b", "died"), ("dark", r"(?i)\bdark\b", "died"), ("war", r"(?i)\bwar\b", "died"),
    ("battle", r"(?i)\bbattle\b", "died"), ("armed with", r"(?i)\barmed\s+with\b", "died"),
    ("[position abbreviations]", r"\b(?:CB|WR|OC|DC|DB|RB|TE|QB|LB|OL)\b", "abbreviation"),
    ("[reporter named with paper]", r"\b[A-Z][a-z]+(?: [A-Z][a-z'.]+){1,2} of The [A-Z][A-Za-z. ]{2,30}", "attribution"),
]


def measure(members: DataFrame, by: list[str], terms: list[tuple[str, str, str]]) -> DataFrame:
    """by, label, occurrences, words, per_10k: all patterns in one pass over the texts, then turned into rows."""
    counts = [F.sum(F.regexp_count("body", F.lit(p))).alias(f"c{i}") for i, (_, p, _) in enumerate(terms)]
    wide = members.groupBy(*by).agg(F.sum(text.word_count("body")).cast("bigint").alias("words"), *counts)
    rows = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"c{i}").cast("bigint").alias("occurrences")) for i, (label, _, _) in enumerate(terms)]))
    long = wide.select(*by, "words", rows.alias("x")).select(*by, "x.label", "x.occurrences", "words")
    return long.withColumn("per_10k", F.when(F.col("words") > 0, F.round(10000.0 * F.col("occurrences") / F.col("words"), 3)).otherwise(0.0))


FIRST_PERSON = r"\b(I|we|We|my|our|I'm|I'd|we'll|We'll|don't|Don't)\b"


def final_profile(members: DataFrame, by: list[str], body: Column) -> DataFrame:
    """by, n, median_words (the upper median), pct_short (12 words or fewer), pct_first_person of the last sentences.

    The median comes from counts by length, so no cohort's rows are gathered."""
    last = members.select(*by, text.last_sentence(body).alias("s")).where("s is not null")
    each = last.select(*by, text.word_count("s").alias("words"), F.col("s").rlike(FIRST_PERSON).alias("fp"))
    per = each.groupBy(*by, "words").agg(F.count("*").alias("n"), F.sum(F.col("fp").cast("int")).alias("fp"))
    lens = F.array_sort(F.collect_list(F.struct("words", "n")))  # one entry per distinct length
    g = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("fp").alias("fp"), F.sum(F.when(F.col("words") <= 12, F.col("n")).otherwise(0)).alias("short"), lens.alias("lens"))
    at = F.floor(F.col("n") / 2)
    found = F.aggregate("lens", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("m")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["m"], F.when(a["seen"] + x["n"] > at, x["words"])).alias("m")))
    return g.select(*by, "n", found["m"].cast("bigint").alias("median_words"), F.round(100.0 * F.col("short") / F.col("n"), 1).alias("pct_short"), F.round(100.0 * F.col("fp") / F.col("n"), 1).alias("pct_first_person"))
