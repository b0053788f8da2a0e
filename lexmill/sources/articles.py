"""Articles as Markdown files with front matter, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["slug", "site", "title", "dek", "date", "byline", "byline_status", "byline_raw", "byline_verdict", "byline_source", "content_id", "series", "format", "scope"]


def _value(c: Column) -> Column:
    """A front-matter value: JSON if it parses, else the raw text; a JSON string without its quotes."""
    return F.coalesce(F.when(c.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")), c)


def parse_front_matter(df: DataFrame, value: str = "value") -> DataFrame:
    """Add meta and provenance (map<string,string>) and body to whole-file texts; files without front matter are left out.

    Keys are [a-z_]+; indented ones belong to provenance; of a key given twice the last counts."""
    m = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    lines = F.split(F.regexp_extract(value, m, 1), "\n")

    def pairs(pattern: str) -> Column:
        own = F.filter(lines, lambda x: x.rlike(pattern))
        made = F.transform(own, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), _value(F.trim(F.regexp_extract(x, pattern, 2))).alias("value")))
        # The last of a key: entries in reverse, first kept.
        back = F.reverse(made)
        keys = F.transform(back, lambda x: x["key"])
        return F.map_from_entries(F.filter(back, lambda x, i: F.array_position(keys, x["key"]) == i + 1))

    ok = df.where(F.col(value).rlike(m))
    return ok.withColumns({"meta": pairs(r"^([a-z_]+):(.*)$"), "provenance": pairs(r"^\s+([a-z_]+):(.*)$"), "body": F.trim(F.regexp_extract(value, m, 2), F.lit("\n "))})


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row per *.md file below path: the known fields, the entities' lists, provenance and body, by slug."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    p = parse_front_matter(raw)
    return p.select(*[F.col("meta")[f].alias(f) for f in FIELDS], F.col("meta")["word_count"].try_cast("bigint").alias("word_count"), F.from_json(F.col("meta")["entities"], "struct<teams: array<string>, players: array<string>>").alias("entities"), "provenance", "body")


def _as_json(field: str) -> Column:
    whole = F.to_json(F.struct(F.col(field).alias("v")))
    return F.substring(whole, 6, F.length(whole) - 6)


def to_markdown(df: DataFrame, fields: list[str] = FIELDS) -> Column:
    """Each row as a front-matter text with JSON values, the provenance map as an indented block; null fields are left out."""
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f + ": "), _as_json(f))) for f in fields if f in df.columns]
    if "entities" in df.columns:
        parts.append(F.when(F.col("entities").isNotNull(), F.concat(F.lit("entities: "), F.to_json("entities"))))
    if "provenance" in df.columns:
        own = F.transform(F.map_entries("provenance"), lambda e: F.concat(F.lit("\n  "), e["key"], F.lit(": "), F.substring(F.to_json(F.struct(e["value"].alias("v"))), 6, 1_000_000_000)))
        own = F.transform(F.filter(own, lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, r"\}$", ""))
        parts.append(F.when(F.size("provenance") > 0, F.concat(F.lit("provenance:"), F.array_join(own, ""))))
    head = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))


def write_bundles(df: DataFrame, path: str) -> None:
    """The same texts in files of many, a JSON line (slug, value) each: for corpora too large for a file per article."""
    df.withColumn("value", to_markdown(df)).select("slug", "value").write.mode("overwrite").json(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """A directory per slug with its text, as the single articles are published; ``write_bundles`` scales."""
    df.withColumn("value", to_markdown(df)).select("slug", "value").repartition("slug").write.mode("overwrite").partitionBy("slug").text(path)
