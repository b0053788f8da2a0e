"""One hop of links from captured pages: what they point to, classified and merged into the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import html, urls
from lexmill.operators import records
from lexmill.session import widen


def links_of(captures: DataFrame, hosts: list[str], exact: list[str], prefixes: list[str]) -> DataFrame:
    """seed, timestamp, url, title of the links on whitelisted hosts and paths.  captures: seed, timestamp, original, html.

    Pages without a link are gone through like any other and give no rows; null pages are left out."""
    c = widen(captures.where("html is not null").select("seed", "timestamp", "original", "html"))
    a = c.select("seed", "timestamp", "original", F.inline(html.page_links("html")))
    a = a.select("seed", "timestamp", urls.clean_url(urls.resolve(F.col("original"), F.trim("href"))).alias("url"), "title")
    return a.where(urls.allowed(F.col("url"), hosts, exact, prefixes))


def expand(entries: DataFrame, captures: DataFrame, hosts: list[str], exact: list[str], prefixes: list[str]) -> DataFrame:
    """The merged records of the entries and of what the captures link to, with their kind; new ones are pending.

    entries: url, title, status, discovered_via, observed_urls."""
    found = links_of(captures, hosts, exact, prefixes).select("url", "title", F.lit("pending").alias("status"), F.col("seed").alias("discovered_via"), F.lit(None).cast("array<string>").alias("observed_urls"))
    merged = records.merged_records(entries.select("url", "title", "status", "discovered_via", "observed_urls").unionByName(found))
    return merged.withColumn("kind", urls.kind(F.col("url"), F.col("url")))
