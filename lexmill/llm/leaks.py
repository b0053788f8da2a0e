"""Evaluation passages in training text (problem 7): a prefix-filtered set join on word shingles.

The words of the evaluation items are ordered by how many documents of the corpus hold them.  A shared stretch of n words
holds every word of one of the item's n-word shingles, so also that shingle's rarest word: those words, the prefix, are the
only ones that are joined.  A hit fixes the position in item and document (the positional bound); the run of equal words
around it is then read off exactly, and an item is reported where the run has n words or more.

The evaluation set is the stated query set; it is worked off in blocks whose words are of bounded size, against all rows.
Null ids and null or empty texts give nothing; items of fewer than n words can't leak.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import widen

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


def document_counts(docs: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; all documents are read, the result has the vocabulary's size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                n.update(vocabulary.intersection(words_of(t)))
        yield pd.DataFrame(list(n.items()), columns=["w", "n"])

    got = docs.select(F.col("t")).mapInPandas(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r.w: r.n for r in got}


def prefix_index(items: dict, counts: dict[str, int], n: int) -> dict[str, list[tuple]]:
    """word -> [(item, position)]: for every n-word window of every item its rarest word (ties: the first position)."""
    index: dict[str, list[tuple]] = {}
    for item, ws in items.items():
        chosen = {min(range(o, o + n), key=lambda p: (counts.get(ws[p], 0), ws[p], p)) for o in range(len(ws) - n + 1)}
        for p in sorted(chosen):
            index.setdefault(ws[p], []).append((item, p))
    return index


def leaked_items(words: list[str], index: dict[str, list[tuple]], items: dict, n: int) -> set:
    """The items of which the words hold n in a row."""
    found: set = set()
    if index.keys().isdisjoint(words):
        return found
    size = len(words)
    for q, w in enumerate(words):
        for item, p in index.get(w, ()):
            if item in found:
                continue
            ws = items[item]
            a = 1
            while a <= p and a <= q and ws[p - a] == words[q - a]:
                a += 1
            b = 1
            while p + b < len(ws) and q + b < size and ws[p + b] == words[q + b]:
                b += 1
            if a + b - 1 >= n:
                found.add(item)
    return found


def leaks(docs: DataFrame, items: DataFrame, n: int = 10, block_chars: int = 20_000_000, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc id, item id) for each document that holds at least n consecutive words of an item."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("d"), F.col("text").alias("t")).where("d is not null and t is not null")
    d = widen(d)
    i = items.select(F.col(item_col).alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    chars = i.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = chars // block_chars + 1
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = f"{id_col} {kind.simpleString()}, {item_col} {item_kind.simpleString()}"
    out = None
    for b in range(blocks):
        own = i if blocks == 1 else i.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        words: dict = {}
        for r in own.collect():
            ws = words_of(r.t)
            if len(ws) >= n:
                words.setdefault(r.i, ws)
        vocabulary = frozenset(w for ws in words.values() for w in ws)
        index = prefix_index(words, document_counts(d, vocabulary), n)
        shared = spark.sparkContext.broadcast((index, words))  # at most block_chars of text

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, words = shared.value
            for pdf in batches:
                rows = [(k, x) for k, t in zip(pdf["d"], pdf["t"]) for x in leaked_items(words_of(t), index, words, n)]
                yield pd.DataFrame(rows, columns=[id_col, item_col])

        part = d.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
