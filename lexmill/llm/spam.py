"""Keyword-stuffed and link-list pages (problem 9).

Two measures are taken of every page and joined word by word.

* Repetition: the page's suffix automaton over words gives, for every position, the longest substring ending there that is
  repeated: of at least ``span`` words, at least ``times`` times, and making up ``2 sqrt(words)`` words (16 at least) of the
  page with all its occurrences, so one sentence over and over counts as much as a keyword in every line.  Its words are
  covered.  A clause of whose characters ``stuffed`` or more are covered, and whose other words are mostly repeated on the page too, is a
  stuffed one (a chant or refrain brings new words each time).
* Missing clause structure: lines that are links, hashtags, product rows or bare keywords, and sentences that are lists of
  short items.  A sentence ends at a terminator of any script, however long it is; Thai and Lao, which have none, at spaces.

A page is spam if more than ``share`` of its words stand in stuffed clauses or outside clauses and it has ``least`` words
or more.  Tables of figures, quoted passages and link lists between comments keep their words as ordinary.  Characters of
Chinese and Japanese are words by themselves.

Null, empty and short texts are no cases; a document id delivered again gives one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import widen

_EACH = "\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"  # kana and ideographs
_WORD = re.compile(rf"[{_EACH}]|[^\W_{_EACH}]+")
_LINK = re.compile(r"https?://|www\.|<a\s|\[[^\]]*\]\(")
_TAG = re.compile(r"#\w")
_DIGIT = re.compile(r"\d")
_MONEY = re.compile(r"[$€£¥]\s?\d|\d\s?[€£]|\bUSD\b|\bEUR\b")
#: The end of a clause: a terminator after a word, before white space, a quote or the end; one of a script that leaves no
#: space after it; a space after a stretch of Thai or Lao.
_STOP = re.compile(r"(?<=[\w)\]”\"'’*])(?:[.!?…؟۔։]+|;|:| --| —)(?=[\s”\"'’*)\]]|$)|[。！？；｡।॥።။។]+|(?<=[\u0e01-\u0eff]{8})\s")
_ITEMS = re.compile(r"[,;|•·、，/]\s*")
_QUOTED = re.compile(r"^[\s>*_-]+")


def _suffix_array(tokens: list) -> np.ndarray:
    """Suffixes in order, by doubling."""
    known: dict = {}
    rank = np.array([known.setdefault(t, len(known)) for t in tokens], dtype=np.int64)
    n, k = len(tokens), 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.ones(n, dtype=np.int64)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        k *= 2
        if k >= n or rank[order[-1]] == n - 1:
            return order


def _cover_by_array(tokens: list, repeats: int, span: int, mass: float) -> bytearray:
    """What ``repeated_cover`` marks, by suffix array and common prefixes: for pages too long for an automaton in a worker."""
    n = len(tokens)
    order = _suffix_array(tokens)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    order, place, common, h = order.tolist(), place.tolist(), [0] * (n + 1), 0
    for i in range(n):
        if place[i] == 0:
            h = 0
            continue
        j = order[place[i] - 1]
        while i + h < n and j + h < n and tokens[i + h] == tokens[j + h]:
            h += 1
        common[place[i]] = h
        h = max(0, h - 1)
    stretches: list[tuple[int, int, int]] = []  # (length, first, end) of suffixes with a prefix of that length in common
    stack: list[tuple[int, int]] = []
    for k in range(1, n + 1):
        first = k - 1
        while stack and stack[-1][0] > common[k]:
            length, first = stack.pop()
            if length >= span and k - first >= repeats and (k - first) * length >= mass:
                stretches.append((length, first, k))
        if common[k] and (not stack or stack[-1][0] < common[k]):
            stack.append((common[k], first))
    marks = bytearray(n)
    after = list(range(n + 1))  # the next suffix that has no length yet

    def find(k: int) -> int:
        while after[k] != k:
            after[k] = k = after[after[k]]
        return k

    until = np.zeros(n + 1, dtype=np.int64)
    for length, first, end in sorted(stretches, reverse=True):
        k = find(first)
        while k < end:
            until[order[k]] = length
            after[k] = k + 1
            k = find(k)
    reach = 0
    for i in range(n):
        if until[i]:
            reach = max(reach, i + int(until[i]))
        marks[i] = i < reach
    return marks


def repeated_cover(tokens: list, repeats: int, span: int = 2, longest: int = 100_000, mass: float = 0.0) -> bytearray:
    """Marks the tokens in maximal substrings of at least ``span`` tokens that occur ``repeats`` times, by a suffix automaton, and
    that make up ``mass`` tokens with all occurrences.  Beyond ``longest`` tokens a suffix array gives the same set."""
    n = len(tokens)
    marks = bytearray(n)
    if n < span + repeats - 1:
        return marks
    windows = Counter(zip(*(tokens[i:] for i in range(span))))
    if max(windows.values()) < repeats:
        return marks
    # Every window inside a repeated substring is repeated as often: what lies in no such window is left out, with a symbol of
    # its own in its place, and so is what stands between two neighbours that no such window joins.
    inside, joined = bytearray(n), bytearray(n)
    for i, w in enumerate(zip(*(tokens[i:] for i in range(span)))):
        if windows[w] >= repeats:
            inside[i : i + span] = b"\1" * span
            joined[i : i + span - 1] = b"\1" * (span - 1)
    if span < 2:
        joined = bytearray(a & b for a, b in zip(inside, inside[1:] + b"\0"))
    kept: list = []
    at: list[int] = []
    for i in range(n):
        if inside[i]:
            kept.append(tokens[i])
            at.append(i)
            if not joined[i]:
                kept.append(-i - 1)  # tokens aren't negative numbers
                at.append(i)
    cover = _cover_by_array if len(kept) > longest else _cover_by_automaton
    for i, m in zip(at, cover(kept, repeats, span, mass)):
        marks[i] |= m
    return marks


def _cover_by_automaton(tokens: list, repeats: int, span: int, mass: float) -> bytearray:
    n = len(tokens)
    marks = bytearray(n)
    nxt: list[dict] = [{}]
    link, length, count = [-1], [0], [0]
    last, ends = 0, []
    for c in tokens:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        count.append(1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                count.append(0)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        ends.append(cur)
    order = sorted(range(1, len(nxt)), key=length.__getitem__)
    for v in reversed(order):
        if link[v] > 0:
            count[link[v]] += count[v]
    best = [0] * len(nxt)
    for v in order:
        best[v] = length[v] if count[v] >= repeats and count[v] * length[v] >= mass else best[link[v]]
    start = n
    for i in range(n - 1, -1, -1):
        if (m := best[ends[i]]) >= span:
            start = min(start, i - m + 1)
        if i >= start:
            marks[i] = 1
    return marks


def _figures(cells: list[str]) -> bool:
    """A table's row: at least half of the cells hold a number, none is repeated, none is a sentence."""
    return 2 * sum(bool(_DIGIT.search(c)) for c in cells) >= len(cells) and len({c.strip() for c in cells}) == len(cells) and max(map(len, cells)) <= 40


def _plain_lines(line: str) -> str:
    """'link', 'tags', 'product', 'table' or 'text'."""
    if _LINK.search(line):
        return "link"
    if "#" in line and 2 * len(_TAG.findall(line)) > len(line.split()):
        return "tags"
    if "|" in line or "\t" in line:
        cells = [c for c in re.split(r"[|\t]", line) if c.strip()]
        if len(cells) >= 3:
            if _MONEY.search(line):
                return "product"
            if _figures(cells):
                return "table"
    elif line.count(",") >= 2 and _figures(line.split(",")):
        return "table"
    return "text"


def _is_list(sentence: str) -> bool:
    """Whether a sentence consists of six items or more, half of them of three words or fewer."""
    if len(items := _ITEMS.split(sentence)) < 6:
        return False
    sizes = sorted(n for x in items if (n := len(_WORD.findall(x))))
    return len(sizes) >= 6 and sizes[len(sizes) // 2] <= 3


def outside_clauses(text: str) -> list[tuple[int, str]]:
    """(words, 'clause', 'outside' or 'table') for each stretch of the text in order: outside where it is no part of a clause.

    Text lines without a blank line between them are one block, so wrapped and quoted sentences stay whole."""
    out: list[tuple[int, str]] = []
    block: list[str] = []

    def close() -> None:
        if not block:
            return
        joined = " ".join(block)
        at, ended = 0, 0
        for m in _STOP.finditer(joined):
            n = len(_WORD.findall(joined, at, m.end()))
            if n:
                listed = _is_list(joined[at : m.end()])
                out.append((n, "outside" if listed else "clause"))
                ended += not listed
            at = m.end()
        n = len(_WORD.findall(joined, at))
        if n:
            out.append((n, "clause" if ended and not _is_list(joined[at:]) else "outside"))
        block.clear()

    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            close()
            continue
        kind = _plain_lines(line)
        if kind == "text":
            block.append(_QUOTED.sub("", line))
        else:
            close()
            n = len(_WORD.findall(line))
            if n:
                out.append((n, "table" if kind == "table" else "outside"))
    close()
    return out


def spam_share(text: str, times: int = 8, span: int = 2, stuffed: float = 0.3, stale: float = 0.75) -> tuple[int, float, float, float]:
    """(words, share of characters repeated, share of words outside clauses, share outside or in stuffed clauses)."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0, 0.0, 0.0, 0.0
    n = len(words)
    marks = repeated_cover(words, times, span, mass=max(16.0, 2 * math.sqrt(n)))
    seen = Counter(words)
    sizes = [len(w) for w in words]
    held = [k * m for k, m in zip(sizes, marks)]
    at = outside = either = 0
    for k, state in outside_clauses(text):
        bad = state == "outside"
        outside += k * bad
        either += k * (bad or state == "clause" and (sum(held[at : at + k]) >= stuffed * sum(sizes[at : at + k]) and sum(seen[w] > 2 for w in words[at : at + k]) >= stale * k))
        at += k
    n = max(n, at)
    return n, sum(held) / sum(sizes), outside / n, either / n


def spam_scores(docs: DataFrame, times: int = 8, span: int = 2, id_col: str = "doc_id") -> DataFrame:
    """id, words, repeated, outside, either for every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *spam_share(t, times, span)) for k, t in zip(pdf["d"], pdf["t"])]
            yield pd.DataFrame(rows, columns=[id_col, "words", "repeated", "outside", "either"])

    src = docs.select(F.col(id_col).alias("d"), F.col("text").alias("t")).where("d is not null and t is not null")
    return widen(src).mapInPandas(run, f"{id_col} {kind}, words bigint, repeated double, outside double, either double")


def spam_pages(docs: DataFrame, share: float = 0.5, least: int = 30, id_col: str = "doc_id") -> DataFrame:
    return spam_scores(docs, id_col=id_col).where((F.col("words") >= least) & (F.col("either") > share)).select(id_col).distinct()
