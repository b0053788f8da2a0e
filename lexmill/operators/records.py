"""Records by identity: merge, earliest and latest, bands and samples, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import urls
from lexmill.operators.search import numbered
from lexmill.session import cut


def merge_entries(entries: DataFrame) -> DataFrame:
    """One row per identity: longest title (ties: the smaller), all addresses seen, how many entries.  entries: url, title, observed_urls."""
    e = entries.withColumn("clean", urls.clean_url(F.col("url"))).withColumn("key", urls.canonical(F.col("clean")))
    seen = F.transform(F.array_append(F.coalesce("observed_urls", F.array().cast("array<string>")), F.col("clean")), lambda u: F.trim(u))
    base = e.groupBy("key").agg(F.max(F.struct(F.length(F.coalesce("title", F.lit(""))).alias("n"), F.coalesce("title", F.lit("")).alias("title"))).alias("t"), F.min("clean").alias("url"), F.count("*").alias("entries"))
    observed = e.select("key", F.explode(seen).alias("u")).distinct().groupBy("key").agg(F.count("*").alias("observed"), F.min("u").alias("first_seen"))
    return base.join(observed, "key").select("key", "url", F.col("t.title").alias("title"), "entries", "observed", "first_seen")


def merged_records(entries: DataFrame) -> DataFrame:
    """One row per identity with everything its entries brought along: longest title, an article view's address before others,
    sorted distinct addresses and statuses ('ok' settles it), and the alternate records.

    entries: url, title, status, discovered_via, observed_urls.  Spellings, statuses and records are made distinct before they are
    gathered, so an address with a tenth of all rows brings a handful of each."""
    e = entries.withColumn("clean", urls.clean_url(F.col("url"))).withColumn("key", urls.canonical(F.col("clean")))
    view = urls.path_of(F.col("clean")).rlike(r"(?i)/article(?:/|$)")
    base = e.groupBy("key").agg(
        F.max(F.struct(F.length(F.coalesce("title", F.lit(""))).alias("n"), F.coalesce("title", F.lit("")).alias("title"))).alias("t"), F.min(F.struct((~view).alias("other"), F.col("clean").alias("url"))).alias("u"), F.count("*").alias("entries")
    )
    gathered = lambda df, name: df.distinct().groupBy("key").agg(F.array_sort(F.collect_list(name)).alias(name))
    seen = gathered(e.select("key", F.explode(F.array_append(F.coalesce("observed_urls", F.array().cast("array<string>")), F.col("clean"))).alias("observed_urls")).select("key", F.trim("observed_urls").alias("observed_urls")), "observed_urls")
    states = gathered(e.where("status is not null").select("key", F.col("status").alias("statuses")), "statuses")
    records = gathered(e.select("key", F.struct("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("discovered_via", F.lit("")).alias("discovered_via")).alias("records")), "records")
    out = base.join(seen, "key").join(states, "key", "left").join(records, "key")
    status = F.when(F.array_contains("statuses", "ok"), "ok").otherwise(F.coalesce(F.get("statuses", F.lit(0)), F.lit("pending")))
    return out.select("key", F.col("u.url").alias("url"), F.col("t.title").alias("title"), "entries", status.alias("status"), F.coalesce("statuses", F.array().cast("array<string>")).alias("statuses"), "observed_urls", "records")


def by_either_address(results: DataFrame, entries: DataFrame, key: str = "url") -> DataFrame:
    """Results with the entry whose url or body_url they carry (the smaller entry where several do), null where none does."""
    both = entries.select(F.explode(F.array("url", "body_url")).alias("_k"), F.struct(F.col("url").alias("entry"), F.col("kind").alias("entry_kind"), F.col("status").alias("entry_status")).alias("_e")).where("_k is not null")
    one = both.groupBy("_k").agg(F.min("_e").alias("_e"))
    return results.join(one, results[key] == F.col("_k"), "left").select(*results.columns, "_e.entry", "_e.entry_kind", "_e.entry_status")


SEASON = (8, 9, 10, 11, 12, 1, 2)


def daily_outcomes(days: DataFrame, answers: DataFrame, captures: DataFrame, season: tuple[int, ...] = SEASON) -> DataFrame:
    """day, year, place, outcome, captures for every candidate day.  answers: year (of the listings that were answered); captures:
    day, captures.  place: the order of trying within the year, months of the season first."""
    d = days.withColumn("year", F.year("day"))
    first = ~F.month("day").isin(*season)
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(first, "day")))  # a year's days
    j = d.join(answers.select("year", F.lit(True).alias("_ok")).distinct(), "year", "left").join(captures, "day", "left")
    outcome = F.when(F.col("_ok").isNull(), "query_failed").when(F.col("captures").isNull(), "no_capture").otherwise("captured")
    return j.select("day", "year", "place", outcome.alias("outcome"), F.when(F.col("_ok").isNotNull(), F.coalesce("captures", F.lit(0))).otherwise(0).cast("bigint").alias("captures"))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order, without sorting groups: a minimum of structs that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*keys, *[f"x.{c}" for c in [*order, *rest]])


def bands(df: DataFrame, order: list[Column], n: int, total: int) -> DataFrame:
    """band: rows in n bands of positions, band i holding [i * total // n, (i + 1) * total // n)."""
    return numbered(df, order, "pos").withColumn("band", (F.ceil(F.lit(n) * (F.col("pos") + 1) / total) - 1).cast("bigint"))


def stratified(df: DataFrame, band: str, key: str, per: int, seed: int) -> DataFrame:
    """``per`` rows of each band by a seeded hash.  A threshold on the hash first keeps a margin, so no band is sorted whole."""
    n = df.groupBy(band).agg(F.count("*").alias("_n"))
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30))
    margin = F.least(F.lit(1.0), (per + 12 * F.sqrt(F.lit(float(per))) + 40) / F.col("_n")) * (1 << 30)
    near = df.join(F.broadcast(n), band).withColumn("_h", h).where(F.col("_h") <= margin)  # one row per band
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(band).orderBy("_h", key))).where(F.col("_r") <= per).drop("_n", "_h", "_r")


def systematic(df: DataFrame, order: list[Column], k: int, total: int) -> DataFrame:
    """k rows evenly spaced in an order."""
    k = min(k, total)
    p = numbered(df, order, "pos")
    picks = (F.floor(F.col("pos") * k / total) != F.floor((F.col("pos") - 1) * k / total)) | (F.col("pos") == 0)
    return p.where(picks)


def halves(df: DataFrame, legacy: Column, order: list[Column], k: int) -> DataFrame:
    """k rows: half of them (the odd one too) evenly spaced among the legacy rows, half among the others, and where one kind has
    too few, topped up with the first rows that aren't taken yet.  Adds kind and pos, the place among its kind."""
    kinds = df.withColumn("kind", F.when(F.coalesce(legacy, F.lit(False)), "legacy").otherwise("modern"))
    totals = {r.kind: r.n for r in kinds.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    parts = []
    for kind, want in (("legacy", (k + 1) // 2), ("modern", k // 2)):
        total = totals.get(kind, 0)
        n = min(want, total)
        p = numbered(kinds.where(F.col("kind") == kind), order, "pos")
        # Place i of n is at i * total // n, so it is taken where the number of places up to it grows.
        up_to = lambda c: F.ceil((c + 1) * F.lit(n) / F.lit(max(1, total)))  # noqa: E731, B023
        parts.append(p.withColumn("taken", F.lit(n > 0) & (up_to(F.col("pos")) > up_to(F.col("pos") - 1))))
    every = cut(parts[0].unionByName(parts[1]), "halves")
    missing = min(k, sum(totals.values())) - min((k + 1) // 2, totals.get("legacy", 0)) - min(k // 2, totals.get("modern", 0))
    taken = every.where("taken").withColumn("topped_up", F.lit(False))
    if missing:
        taken = taken.unionByName(every.where("not taken").orderBy(*order).limit(missing).withColumn("topped_up", F.lit(True)))
    return taken.drop("taken")


def calendar(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
