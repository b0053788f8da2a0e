"""Frequency of every distinct term (problem 6): burst-trie counting.

Each task keeps a burst trie: containers of terms under a prefix; a container that grows beyond ``burst`` terms bursts
into containers with one more character, so hot prefixes get deep routes and rare ones stay flat.  The counters in a
container are the occurrences and the records.  A trie that reaches ``limit`` terms is emptied into the output, so a
task's memory is bounded whatever the vocabulary.  Emitted subtrees are already combined: a term, however common, leaves
a task once per flush, and matching entries of all workers merge in one hash aggregation on the term.

Null records and null texts are left out; an empty text has no terms.  A record delivered again counts once in ``words``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread

_WORD = re.compile(r"[^\W_]+")
_GONE = {0xAD: None, 0x200B: None}


def words_of(text: str) -> list[str]:
    """Longest runs of letters or digits after NFC, removal of soft hyphens and zero-width spaces, and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(_GONE)
    return _WORD.findall(text.lower())


class BurstTrie:
    """Terms with two counters, in containers by adaptive prefix."""

    def __init__(self, burst: int = 2048):
        self.burst, self.size = burst, 0
        self.root: dict = {}
        self.flat = True

    def add(self, occurrences: Counter, records: Counter) -> None:
        for term, n in occurrences.items():
            self._put(term, n, records[term])

    def _put(self, term: str, n: int, r: int) -> None:
        node, depth = self.root, 0
        while True:
            kind = node.get(0)
            if kind is None:  # an unburst container
                e = node.get(term)
                if e is not None:
                    e[0] += n
                    e[1] += r
                    return
                node[term] = [n, r]
                self.size += 1
                if len(node) > self.burst and depth < 64:
                    self._burst(node, depth)
                return
            node = node.setdefault(("/", term[depth : depth + 1]), {})
            depth += 1

    @staticmethod
    def _burst(node: dict, depth: int) -> None:
        entries = list(node.items())
        node.clear()
        node[0] = True
        for term, e in entries:
            node.setdefault(("/", term[depth : depth + 1]), {})[term] = e

    def items(self) -> Iterator[tuple[str, int, int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if 0 in node:
                stack.extend(v for k, v in node.items() if k != 0)
            else:
                for term, (n, r) in node.items():
                    yield term, n, r


_OUT = "term string, occurrences bigint, records bigint"


def _frame(trie: BurstTrie) -> pd.DataFrame:
    return pd.DataFrame(list(trie.items()), columns=["term", "occurrences", "records"])


def _merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def count_words(df: DataFrame, record: str, text: str, limit: int = 300_000) -> DataFrame:
    """term, occurrences, records over the words of a text column; all rows of one record count as its first row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, before = BurstTrie(), None
        occ, rec, held = Counter(), Counter(), 0
        for pdf in batches:
            for key, body in zip(pdf["r"], pdf["t"]):
                if key == before:
                    continue
                before = key
                ws = words_of(body)
                occ.update(ws)
                rec.update(set(ws))
                held += 1
                if held >= 2000:
                    trie.add(occ, rec)
                    occ, rec, held = Counter(), Counter(), 0
                    if trie.size >= limit:
                        yield _frame(trie)
                        trie = BurstTrie()
        trie.add(occ, rec)
        yield _frame(trie)

    # Copies of a record meet in one task and there in a row, so nothing has to be remembered but the record before.
    src = df.select(F.col(record).alias("r"), F.col(text).alias("t")).where("r is not null and t is not null")
    return _merge(spread(src, "r").sortWithinPartitions("r").mapInPandas(run, _OUT))


def count_values(df: DataFrame, record: str, value: Column, limit: int = 300_000) -> DataFrame:
    """term, occurrences, records where the whole value is the term; value is null or empty where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = BurstTrie()
        for pdf in batches:
            for term, n in zip(pdf["term"], pdf["n"]):
                trie._put(term, n, 1)
            if trie.size >= limit:
                yield _frame(trie)
                trie = BurstTrie()
        yield _frame(trie)

    pairs = df.select(F.col(record).alias("r"), value.alias("term")).where("r is not null and term is not null and term <> ''")
    once = pairs.groupBy("r", "term").agg(F.count("*").alias("n")).select("term", "n")
    return _merge(once.mapInPandas(run, _OUT))


def tidy_value(c: Column) -> Column:
    """Trimmed, lower-cased, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def marked(counts: DataFrame, n_records: int, least: int = 3, most: float = 0.6) -> DataFrame:
    """Add mark: 'rare' in fewer than ``least`` records, 'common' in more than ``most`` of all, else null."""
    return counts.withColumn("mark", F.when(F.col("records") < least, "rare").when(F.col("records") > most * n_records, "common"))


def term_frequencies(articles: DataFrame, voice: DataFrame) -> DataFrame:
    """field, term, occurrences, records, mark of articles.body and analysis_voice.term."""
    n_articles = articles.select("slug").where("slug is not null").distinct().count()
    n_runs = voice.select("run_id").where("run_id is not null").distinct().count()
    a = marked(count_words(articles, "slug", "body"), n_articles).withColumn("field", F.lit("articles.body"))
    v = marked(count_values(voice, "run_id", tidy_value(F.col("term"))), n_runs).withColumn("field", F.lit("analysis_voice.term"))
    return a.unionByName(v)
