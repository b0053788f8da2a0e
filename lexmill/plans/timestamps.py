"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import timestamps
from lexmill.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(table(spark, d, "articles"), table(spark, d, "provenance"), table(spark, d, "sites"))


def p4_zones(spark: SparkSession, d: str) -> DataFrame:
    """The offset history estimated for each site, without use of the declared one, beside it."""
    a = table(spark, d, "articles").select("slug", "site", "date").where("date is not null").distinct()
    place = table(spark, d, "sites")
    a = timestamps.parse_stamps(a.join(place.select("site", "date_order"), "site", "left"), "date", "date_order")
    w = table(spark, d, "provenance").select("prov_id", "slug", "wayback_timestamp").where("wayback_timestamp is not null").distinct()
    seen = timestamps.first_seen(timestamps.parse_stamps(w.withColumn("ord", F.lit("mdy")), "wayback_timestamp", "ord"))
    stamps = a.where("timed").join(seen, "slug", "left").select(F.col("site").alias("source"), "local", "zone", "seen")
    undeclared = place.select(F.col("site").alias("source"), F.lit(None).cast("string").alias("zone"))
    est = timestamps.estimate_zones(stamps, undeclared).drop("declared")
    return est.join(place.select(F.col("site").alias("source"), F.col("tz").alias("declared")), "source", "left")


QUERIES = {"p4_found": p4_found, "p4_zones": p4_zones}
SQL: dict[str, str] = {}
