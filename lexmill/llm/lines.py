"""Lines repeated across one source's documents (problem 5).

Within a source (site and byline verdict, null being a value) lines are masked and hashed into locality-sensitive buckets by
the minimum over their five-word shingles, twice: with numbers and dates masked, whatever the case, so that lines of one
identity always share this bucket, and with capitalised names masked too; lines of similarity 0.8 share at least one of the
two in 96 of 100 cases.  A bucket holds at least as many rows as it has documents, so buckets with too few rows are left
behind by one combining count; in the few that remain the exact document frequency of every line is counted.  Near-duplicates of every excessive line in its
bucket are checked by their shingles before they are removed as well; and so are templates, lines of masked names and
numbers whose near-duplicates, all counted together, are excessive though no literal form may be.

Only hashes are shuffled, never text, and every count combines before it is shuffled, so a hot source or line is no hot spot.
Null slugs and bodies give nothing; blank lines are no lines; a slug that is delivered again counts once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import widen

SHINGLE = 5
_DIGITS = re.compile(r"[0-9]+")
# Words that name a part of a date, by their first three letters.
_DATES = {"jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun"}


def line_key(line: str) -> str:
    """A line's identity: trimmed, lower-cased, white space as one space, digits as one 0."""
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def mask_word(word: str, names: bool = True) -> str:
    bare = word.strip(".,:;!?()[]\"'“”‘’*_>-–—•|")
    if any(c.isdigit() for c in bare):
        return "0"
    low = bare.lower()
    if low[:3] in _DATES and len(low) <= 9:
        return "D"
    return "N" if names and bare[:1].isupper() else low


_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Signatures:
    """Minimum hashes of lines over their masked shingles; a line shorter than a shingle is one shingle."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        h = self.known.get(w)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = self.known[w] = tuple(xxhash.xxh64_intdigest(mask_word(w, n)) | 1 for n in (False, True))
        return h

    def of(self, lines: list[list[str]], seeds: tuple[int, int] = (0x51ED2701, 0x2545F491)) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        pad = [(0, 0)] * (SHINGLE - 1)
        word = self.word
        flat: list[tuple[int, int]] = []
        for ws in lines:
            flat.extend(map(word, ws))
            flat.extend(pad)
        both = np.array(flat, dtype=np.uint64)
        m = len(both) - SHINGLE + 1
        starts = np.concatenate(([0], np.cumsum(sizes + SHINGLE - 1)[:-1]))
        pos = np.arange(m) - np.repeat(starts, sizes + SHINGLE - 1)[:m]
        valid = pos <= np.repeat(np.maximum(0, sizes - SHINGLE), sizes + SHINGLE - 1)[:m]
        out = []
        for col, seed in enumerate(seeds):
            x = _mix(both[:, col], 0)
            sh = np.zeros(m, dtype=np.uint64)
            for k in range(SHINGLE):
                sh += x[k : k + m] * _MUL[k]
            h = np.where(valid, _mix(sh, seed), np.uint64(2**64 - 1))
            out.append(np.minimum.reduceat(h, starts).view(np.int64))
        return out


def source_of(site: Column, verdict: Column) -> Column:
    """One name for a source; null differs from every text."""
    return F.concat(*[F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c, F.lit("\u0001"))) for c in (site, verdict)])


_LINES = "slug string, source string, line_no bigint, line bigint, c1 bigint, c2 bigint"


def line_rows(articles: DataFrame) -> DataFrame:
    """slug, source, line_no, line (hash of the line's identity), c1, c2 (buckets) for every line that isn't blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sig = Signatures()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                slug, source, no, key, words = [], [], [], [], []
                for s, g, body in zip(part["slug"], part["source"], part["body"]):
                    for i, line in enumerate(body.split("\n")):
                        ws = line.split()
                        if ws:
                            slug.append(s)
                            source.append(g)
                            no.append(i)
                            key.append(xxhash.xxh64_intdigest(_DIGITS.sub("0", " ".join(ws).lower())))
                            words.append(ws)
                if words:
                    c1, c2 = sig.of(words)
                    yield pd.DataFrame({"slug": slug, "source": source, "line_no": no, "line": np.array(key, dtype=np.uint64).view(np.int64), "c1": c1, "c2": c2})

    src = articles.where("slug is not null and body is not null").select("slug", source_of(F.col("site"), F.col("byline_verdict")).alias("source"), "body")
    return widen(src).mapInPandas(run, _LINES)


def source_sizes(articles: DataFrame) -> DataFrame:
    """source, slugs."""
    return articles.where("slug is not null").select(source_of(F.col("site"), F.col("byline_verdict")).alias("source"), "slug").distinct().groupBy("source").agg(F.count("*").alias("slugs"))


def frequent_lines(articles: DataFrame, cut: Callable, least: int = 4, share: float = 0.04, table: str = "c1") -> tuple[DataFrame, DataFrame]:
    """(rows, frequent): all line rows, and (source, line, slugs) of the lines in ``least`` documents and ``share`` of the source's."""
    need = source_sizes(articles).select("source", F.greatest(F.lit(float(least)), F.col("slugs") * share).alias("need")).where(F.col("slugs") >= least)
    rows = cut(line_rows(articles), "lines")
    full = rows.groupBy("source", table).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    full = full.join(need, "source").where(F.col("n") >= F.col("need")).select("source", table, "need")
    inside = rows.join(full, ["source", table]).select("source", "line", "slug", "need").distinct()
    return rows, inside.groupBy("source", "line").agg(F.count("*").alias("slugs"), F.max("need").alias("need")).where(F.col("slugs") >= F.col("need") - 1e-9).select("source", "line", "slugs")


def repeated_lines(articles: DataFrame, cut: Callable, least: int = 4, share: float = 0.04, start: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(slug, line_no) of every line that is excessive in its source.  start: what ``frequent_lines`` gave, if it has run."""
    rows, frequent = start or frequent_lines(articles, cut, least, share)
    return rows.select("source", "line", "slug", "line_no").join(frequent.select("source", "line"), ["source", "line"]).select("slug", "line_no").distinct()


def without_lines(articles: DataFrame, dropped: DataFrame) -> DataFrame:
    """slug, body without the dropped (slug, line_no), dropped lines; one row per slug."""
    one = articles.where("slug is not null").select("slug", "body").dropDuplicates(["slug"])
    nos = dropped.groupBy("slug").agg(F.collect_set(F.col("line_no").cast("int")).alias("nos"))
    kept = F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("nos", i))
    out = one.join(nos, "slug", "left")
    return out.select("slug", F.when(F.col("nos").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("body"), F.coalesce(F.size("nos"), F.lit(0)).alias("dropped"))


# Words that say nothing of a template, as they stand before any name.
_BARE = {"the", "a", "an", "0", "D", "N"}


class Masked(Signatures):
    """Signatures of words that are masked already, under two seeds; remembers masks."""

    def __init__(self) -> None:
        super().__init__()
        self.masks: dict[tuple[str, bool], str] = {}

    def mask(self, word: str, names: bool = True) -> str:
        m = self.masks.get((word, names))
        if m is None:
            if len(self.masks) > 500_000:
                self.masks.clear()
            m = self.masks[word, names] = mask_word(word, names)
        return m

    def word(self, w: str) -> tuple[int, int]:
        h = self.known.get(w)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = self.known[w] = (xxhash.xxh64_intdigest(w) | 1,) * 2
        return h


def templates(words: list[str], mask: Callable = mask_word) -> list[list[str]]:
    """The line with runs of names as one N, numbers 0 and parts of dates D: with its first word kept, which has its capital
    from its place ("Photo: N for N"), and with it masked ("N is a writer for N").  Only forms that hold at least as many
    plain words as masks are templates; others would make one of all names, headings and results."""
    out: list[list[str]] = []
    rest = [mask(w) for w in words[1:]]
    for first in dict.fromkeys((mask(words[0], False), mask(words[0]))):
        form = [first]
        form += [w for w, before in zip(rest, [first, *rest]) if not (w == before == "N")]
        plain = sum(w not in _BARE and (w.isalnum() or any(map(str.isalnum, w))) for w in form)
        if plain and plain >= sum(w in ("0", "D", "N") for w in form):
            out.append(form)
    return out


def shingle_hashes(words: list[str]) -> set[int]:
    return {xxhash.xxh64_intdigest("\0".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))}


def template_rows(articles: DataFrame) -> DataFrame:
    """slug, source, line_no, way (0 or 1, the place in ``templates``), form (hash of the template), c1, c2 (its buckets by two
    minimum hashes) for every template of every line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sig = Masked()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                slug, source, no, ways, forms = [], [], [], [], []
                for s, g, body in zip(part["slug"], part["source"], part["body"]):
                    for i, line in enumerate(body.split("\n")):
                        if ws := line.split():
                            for way, form in enumerate(templates(ws, sig.mask)):
                                slug.append(s)
                                source.append(g)
                                no.append(i)
                                ways.append(way)
                                forms.append(form)
                if forms:
                    key = np.array([xxhash.xxh64_intdigest("\0".join(f)) for f in forms], dtype=np.uint64).view(np.int64)
                    c1, c2 = sig.of(forms)
                    yield pd.DataFrame({"slug": slug, "source": source, "line_no": no, "way": ways, "form": key, "c1": c1, "c2": c2})

    src = articles.where("slug is not null and body is not null").select("slug", source_of(F.col("site"), F.col("byline_verdict")).alias("source"), "body")
    return widen(src).mapInPandas(run, "slug string, source string, line_no bigint, way int, form bigint, c1 bigint, c2 bigint")


def _buckets(rows: DataFrame, *cols: str) -> DataFrame:
    """A row for each of the two buckets: the columns, t, c."""
    both = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"c{t}").alias("c")) for t in (1, 2)])
    return rows.select(*cols, F.explode(both).alias("b")).select(*cols, "b.t", "b.c")


def _with_shingles(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: slug, line_no, way.  With them shingles, hashed: of the template, or of the masked line as it is where way is -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sh = []
            for x, way in zip(pdf["text"], pdf["way"]):
                ws = x.split()
                h = shingle_hashes([mask_word(w) for w in ws] if way < 0 else templates(ws)[way])
                sh.append(np.fromiter(h, dtype=np.uint64).view(np.int64))
            yield pdf[["slug", "line_no", "way"]].assign(sh=sh)

    texts = articles.where("slug is not null and body is not null").select("slug", "body").dropDuplicates(["slug"])
    text = F.get(F.split("body", "\n"), F.col("line_no").cast("int"))
    return wanted.distinct().join(texts, "slug").select("slug", "line_no", "way", text.alias("text")).mapInPandas(run, "slug string, line_no bigint, way int, sh array<bigint>")


def _similar(a: str, b: str, least: float) -> Column:
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (F.least(x, y) >= least * F.greatest(x, y)) & (both >= least * (x + y - both))


def near_lines(articles: DataFrame, cut: Callable, least: int = 4, share: float = 0.04, similarity: float = 0.8, start: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(slug, line_no) of lines that aren't excessive themselves but near-duplicates of one that is, found in its buckets, or
    of a template whose near-duplicates stand in an excessive number of documents taken together.

    A bucket's excessive lines and its other lines meet by (source, bucket), templates of buckets of enough rows by their
    rarest shingles; one text per
    distinct line or template is fetched for the check.  start: what ``frequent_lines`` gave, if it has run."""
    rows, frequent = start or frequent_lines(articles, cut, least, share)
    frequent = cut(frequent.select("source", "line"), "frequent")
    one = _buckets(rows, "source", "line", "slug", "line_no").groupBy("source", "t", "c", "line").agg(F.min(F.struct("slug", "line_no", F.lit(-1).alias("way"))).alias("at"))
    hot = one.join(frequent, ["source", "line"], "left_semi").select("source", "t", "c", F.col("at").alias("hot_at"))
    others = cut(one.join(frequent, ["source", "line"], "left_anti").join(hot, ["source", "t", "c"]).select("source", "line", "at", "hot_at").distinct(), "others")

    need = source_sizes(articles).select("source", F.greatest(F.lit(float(least)), F.col("slugs") * share).alias("need")).where(F.col("slugs") >= least)
    forms = cut(template_rows(articles), "forms")
    keyed = _buckets(forms, "source", "form", "slug", "line_no", "way")
    full = keyed.groupBy("source", "t", "c").agg(F.count("*").alias("n")).join(need, "source").where(F.col("n") >= F.col("need") - 1e-9).select("source", "t", "c")
    inside = keyed.join(full, ["source", "t", "c"]).groupBy("source", "form", "t").agg(F.min(F.struct("slug", "line_no", "way")).alias("at"), F.count("*").alias("n"))
    inside = cut(inside.groupBy("source", "form").agg(F.min("at").alias("at"), F.max("n").alias("n")), "inside")

    ats = [others.select("at.*"), others.select("hot_at.*"), inside.select("at.*")]
    sh = cut(_with_shingles(articles, ats[0].unionByName(ats[1]).unionByName(ats[2])), "shingles")
    of = lambda at, name: sh.select(F.struct("slug", "line_no", "way").alias(at), F.col("sh").alias(name))
    close = others.join(of("at", "x"), "at").join(of("hot_at", "y"), "hot_at").where(_similar("x", "y", similarity)).select("source", "line").distinct()

    # Similar sets share one of the rarest (1 - similarity) of their shingles, and one: only those meet.
    member = inside.join(of("at", "x"), "at").select("source", "form", "n", "x")
    spread = member.select("source", "form", F.size("x").alias("k"), F.explode("x").alias("h"))
    rarity = spread.groupBy("source", "h").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("source", "form").orderBy("df", "h"))
    prefix = spread.join(rarity, ["source", "h"]).withColumn("rank", rank).where(F.col("rank") <= F.col("k") - F.ceil(F.col("k") * similarity - 1e-9) + 1)
    a = prefix.select("source", "h", "k", "form")
    b = prefix.select("source", "h", F.col("k").alias("l"), F.col("form").alias("near"))
    met = a.join(b, ["source", "h"]).where((F.col("form") < F.col("near")) & (F.least("k", "l") >= similarity * F.greatest("k", "l"))).select("source", "form", "near").distinct()
    other = member.select("source", F.col("form").alias("near"), F.col("n").alias("m"), F.col("x").alias("y"))
    alike = cut(met.join(member, ["source", "form"]).join(other, ["source", "near"]).where(_similar("x", "y", similarity)).select("source", "form", "near", "n", "m"), "alike")
    back = alike.select("source", F.col("near").alias("form"), F.col("form").alias("near"), F.col("n").alias("m"))
    pairs = member.select("source", "form", F.col("form").alias("near"), F.col("n").alias("m")).unionByName(alike.drop("n")).unionByName(back)
    pairs = cut(pairs, "pairs")
    # Rows are at least documents, so only forms with enough rows around them are counted.
    able = pairs.groupBy("source", "form").agg(F.sum("m").alias("m")).join(need, "source").where(F.col("m") >= F.col("need") - 1e-9).select("source", "form", "need")
    pairs = pairs.join(able, ["source", "form"]).select("source", "form", "near", "need")
    docs = forms.select("source", F.col("form").alias("near"), "slug").join(pairs, ["source", "near"]).select("source", "form", "need", "slug").distinct()
    over = docs.groupBy("source", "form").agg(F.count("*").alias("slugs"), F.max("need").alias("need")).where(F.col("slugs") >= F.col("need") - 1e-9).select("source", "form")
    gone = pairs.join(over, ["source", "form"]).select("source", F.col("near").alias("form")).distinct()
    by_form = forms.join(gone, ["source", "form"]).select("slug", "source", "line_no").distinct()
    exact = rows.join(frequent, ["source", "line"]).select("slug", "source", "line_no")
    by_form = by_form.join(exact, ["slug", "source", "line_no"], "left_anti").select("slug", "line_no")
    return rows.select("source", "line", "slug", "line_no").join(close, ["source", "line"]).select("slug", "line_no").unionByName(by_form).distinct()
