"""Rules on records that are fetched again: what replaces what, which retrieval counts, what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bylines that name nobody.
PLACEHOLDERS = ["no author name", "unknown", "n/a", "none"]


def keep_first(old: Column, new: Column) -> Column:
    """The old value unless it is missing."""
    return F.coalesce(old, new)


def updated(df: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Fields merged by key, the later table's values winning where they say something; its new columns are added."""
    old = df.join(incoming.select(key, F.struct(*[c for c in incoming.columns if c != key]).alias("_new")), key, "full_outer")
    names = [c for c in df.columns if c != key] + [c for c in incoming.columns if c not in df.columns]
    pick = lambda c: F.coalesce(*([F.col("_new")[c]] if c in incoming.columns else []), *([F.col(c)] if c in df.columns else [])).alias(c)
    return old.select(key, *[pick(c) for c in names])


def migrated(df: DataFrame, added: dict[str, Column], retired: list[str]) -> DataFrame:
    """Records brought to another layout: missing fields added (existing ones keep their values), retired ones dropped."""
    return df.withColumns({k: v for k, v in added.items() if k not in df.columns}).drop(*retired)


def redacted(df: DataFrame, *fields: str) -> DataFrame:
    """The fields blanked, as in a published copy."""
    return df.withColumns({f: F.lit("") for f in fields})


def tidy_byline(raw: Column) -> Column:
    """Without a leading 'By', '' for a placeholder."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?i)^By\s+", ""))
    return F.when(F.lower(t).isin(*PLACEHOLDERS), "").otherwise(t)


def newer_byline(old: Column, new: Column) -> Column:
    """A new byline replaces the old one only if it says something or there was none."""
    return F.when((new != "") | (F.coalesce(old, F.lit("")) == ""), new).otherwise(old)


def accept_repair(old: Column, new: Column, selector: Column, all_blocks: str = "(all blocks)", least: int = 300) -> Column:
    """Whether a body extracted again is taken: long enough and, where there was one, by the all-blocks selector and longer."""
    long = F.length(F.coalesce(new, F.lit(""))) >= least
    return long & (F.coalesce(old, F.lit("")) == "") | long & selector.endswith(all_blocks) & (F.length(new) > F.length(old))


def byline_fields(raw: Column, sources: Column, target: str, section: str) -> Column:
    """struct(verdict, source, scope) of a byline by who it names and where its address was found."""
    seen = F.exists(sources, lambda s: s.contains(target) & (s.contains("/author/") | s.contains("/writer/")))
    inside = F.exists(sources, lambda s: s.rlike(rf"/(?:news|blogs)/{section}(?:[/_]|$)"))
    mine = raw.rlike(rf"(?i)\b{target}\b")
    return F.struct(
        F.when(mine, target).when(raw != "", "other").otherwise("unparsed").alias("verdict"),
        F.when(F.coalesce(seen, F.lit(False)), "author-page").otherwise("section-page").alias("source"),
        F.when(mine, target).when((raw != "") & F.coalesce(inside, F.lit(False)), "section").otherwise("unresolved").alias("scope"),
    )


def best_route(candidates: DataFrame, key: str, priority: Column, stamp: str) -> DataFrame:
    """One candidate per key: the first route in order of preference, of that the earliest stamp."""
    rest = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.min(F.struct(priority.alias("_p"), F.col(stamp).alias("_s"), *rest)).alias("x")).select(key, *[f"x.{c}" for c in rest])


def still_to_do(entries: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Entries without a finished result; failed ones come again."""
    return entries.join(done.select(key).distinct(), key, "left_anti")


def name_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, added, dropped of two (key, names) tables: what an audit with another dictionary changes."""
    a, b = before.select(key, F.col("names").alias("old")), after.select(key, F.col("names").alias("new"))
    none = F.array().cast("array<string>")
    j = a.join(b, key, "full_outer").select(key, F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    return j.select(key, F.array_sort(F.array_except("new", "old")).alias("added"), F.array_sort(F.array_except("old", "new")).alias("dropped")).where((F.size("added") > 0) | (F.size("dropped") > 0))


def first_title(*titles: Column) -> Column:
    """The first title that says something."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in titles])
