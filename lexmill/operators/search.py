"""Inverted index, search over it, and numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.session import cut

# Words that aren't indexed, the short list and the reader's.
STOP = ("the", "and", "for", "that", "with", "was", "his", "her", "has", "had", "but", "not", "from", "this", "are", "have", "they", "you", "who", "will")
READER_STOP = tuple(
    "the and for are but not you all any can had her was one our out has have this that with from they will been were their would there what when which your into than them then its who how she his him about also just more some only very".split()
)


def postings(docs: DataFrame, stop: tuple[str, ...] = STOP, least: int = 3, tokens: Callable[[Column], Column] = text.search_tokens) -> DataFrame:
    """docs: id, text.  (term, id) once each, without stop words and terms shorter than ``least`` letters.

    tokens: ``text.search_tokens`` keeps letters with their marks, ``text.index_tokens`` takes them apart."""
    p = docs.where("text is not null").select("id", F.explode(tokens(F.col("text"))).alias("term")).where(F.length("term") >= least)
    return p.where(~F.col("term").isin(*stop)) if stop else p


def shards(p: DataFrame, size: int = 100_000) -> DataFrame:
    """(term, shard, ids): posting lists in shards by a hash of the id, as many as a term's documents need, so that no list is
    longer than about ``size`` however common its term."""
    n = p.groupBy("term").agg(F.ceil(F.count("*") / size).alias("n"))
    placed = p.join(n, "term").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    return placed.groupBy("term", "shard").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index(docs: DataFrame, **how) -> DataFrame:
    """term, ids (sorted); the lists are only made here, at the sink."""
    return postings(docs, **how).groupBy("term").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def all_of(p: DataFrame, words: list[str]) -> DataFrame:
    """Ids of the documents that have every word."""
    return p.where(F.col("term").isin(*words)).groupBy("id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(set(words))).select("id")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a total order: counts before each range partition are added to a number inside it, so no task
    holds all rows.  The ordered rows are written once with the partition they fell into; both readings see the same."""
    part = cut(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ordered")
    inside = part.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_i")))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return inside.join(F.broadcast(before), "_p").select(*df.columns, (F.col("_b") + F.col("_n") - 1).cast("bigint").alias(name))  # one row per partition


def page(numbered_rows: DataFrame, number: str, page_no: int, size: int = 60) -> DataFrame:
    """One page of numbered rows."""
    return numbered_rows.where(F.col(number).between(page_no * size, (page_no + 1) * size - 1))


def year_band(df: DataFrame, filters: dict[str, Column], year: str) -> DataFrame:
    """Counts per year under all filters but the year's own."""
    for name, f in filters.items():
        if name != year:
            df = df.where(f)
    return df.groupBy(year).agg(F.count("*").alias("n"))
