"""Long exact spans shared between records (problem 2): recompression.

Every distinct line is parsed bottom-up.  The first symbols are its words with what follows them.  Then rounds alternate:
runs of one symbol become one symbol, and pairs become one symbol where the left one falls into the round's left class and
the right one into its right class.  A symbol's name is a hash of what it was made of, so equal strings get equal names in
every task without an exchange, and a name's class is read off the name: equal substrings have equal symbols inside.

Which context a symbol depends on is tracked exactly.  Every window of the least length chooses, of the symbols of the
highest level whose context lies inside the window, those of the lowest sixteenth of names; two lines that share the window choose the same.  So lines that share a long
enough span meet under one symbol name, whatever stands around the span.  Names that occur in one line only are dropped; where
lines meet, their texts around the symbol are compared and the common stretch is read off, in both directions.

Identical lines are one line until the end (a copied page costs one parse), a name that very many lines share is not
compared pair by pair but by hashes of all windows around it, which combine in the shuffle.

Positions are code points.  Null slugs or bodies give nothing; a slug delivered again is one record; shorter lines share nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import widen

U = np.uint64
_WORD_CHAR = np.zeros(0x110000, dtype=bool)
_READY = False


def _word_chars() -> np.ndarray:
    global _READY
    if not _READY:
        for c in range(0x3000):
            _WORD_CHAR[c] = chr(c).isalnum()
        _WORD_CHAR[0x3000:] = False
        _READY = True
    return _WORD_CHAR


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


WIDE = U(1)  # the last bit of a name tells that it stands for a long run
_BASE = 0x9E3779B97F4A7C15


class Parse:
    """Symbols of a batch of lines in one array each: name, start, end, and the context [left, right) that decides them."""

    def __init__(self, texts: list[str], most: int):
        self.most = most
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.line_end = np.cumsum(sizes + 1) - 1
        self.line_start = self.line_end - sizes
        self._prefix_sums(codes)
        self._first(codes)

    def _prefix_sums(self, codes: np.ndarray) -> None:
        n = len(codes)
        power, self.inverse = (np.cumprod(np.concatenate(([U(1)], np.full(n, b, dtype=U)))) for b in (_BASE, pow(_BASE, -1, 2**64)))
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_mix(codes.astype(U) + U(0x632BE59BD9B4E019)) * power[:n], out=self.sums[1:])

    def named(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Names of stretches of text: equal for equal text, wherever it stands."""
        left, right = np.maximum(left, 0), np.minimum(right, len(self.sums) - 1)
        return _mix((self.sums[right] - self.sums[left]) * self.inverse[left] + (right - left).astype(U))

    def _first(self, codes: np.ndarray) -> None:
        n = len(codes)
        word = _word_chars()[codes]
        brk = codes == 10
        # A symbol begins where a word begins, and after a line's end; a stretch longer than 24 is taken by characters.
        begin = np.zeros(n, dtype=bool)
        begin[0] = True
        begin[1:] = word[1:] & ~word[:-1]
        begin[1:] |= brk[:-1]
        begin |= brk
        at = np.flatnonzero(begin)
        size = np.diff(np.append(at, n))
        if (size > 24).any():
            inside = np.repeat(size > 24, size)
            begin |= inside
            at = np.flatnonzero(begin)
            size = np.diff(np.append(at, n))
            # The decision that a stretch is long enough to be cut depends on 24 characters either way.
            wide = np.add.reduceat(inside.astype(np.int64), at) > 0
        else:
            wide = np.zeros(len(at), dtype=bool)
        off = np.arange(n) - np.repeat(at, size)
        power = _mix(np.arange(1, int(size.max()) + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
        name = _mix(np.add.reduceat(_mix(codes.astype(U) + U(0x632BE59BD9B4E019)) * power[off], at) + size.astype(U))
        line_brk = brk[at]
        self.name, self.start, self.end = name, at, at + size
        self.left = at - 1 - 25 * wide
        self.right = at + size + 1 + 25 * wide
        # Lines are apart: a line's end has a name of its own, and nothing beyond it is looked at.
        self.name[line_brk] = _mix(at[line_brk].astype(U) * U(0xA24BAED4963EE407) + U(7))
        self.stop = line_brk
        self.line = np.cumsum(line_brk) - line_brk
        self._clip()

    def _clip(self) -> None:
        # One beyond the line: what depends on the line's own border is in no window's inside.
        lo, hi = self.line_start[self.line] - 1, self.line_end[self.line] + 1
        self.left = np.maximum(self.left, lo)
        self.right = np.minimum(self.right, hi)

    def _group(self, head: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Join symbols: head marks the first of each group; name, left and right are the new symbols'."""
        at = np.flatnonzero(head)
        self.end = self.end[np.append(at[1:], len(head)) - 1]
        self.start, self.stop, self.line = self.start[at], self.stop[at], self.line[at]
        self.name, self.left, self.right = name, left, right

    def runs(self) -> None:
        name = self.name
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | self.stop[1:]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(name)))
        # A symbol is known to end its run by its neighbours, which are looked at on both sides.
        lo = np.minimum.reduceat(self.left, at)
        hi = np.maximum.reduceat(self.right, at)
        many = count > 1
        joined = np.where(many, _mix(name[at] * U(0x9FB21C651E98DF25) + count.astype(U)), name[at])
        before, after = np.concatenate((lo[:1], lo[:-1])), np.concatenate((hi[1:], hi[-1:]))
        self._group(new, joined, np.where(self.stop[at], lo, np.minimum(lo, before)), np.where(self.stop[at], hi, np.maximum(hi, after)))
        self.count = count
        self.unit = name[at]
        self._clip()

    def pairs(self, level: int) -> None:
        name = self.name
        is_left = (_mix(name + U((level * 2 + 1) * 0x2127599BF4325C37 % 2**64)) & U(1)).astype(bool)
        stop = self.stop
        takes = np.zeros(len(name), dtype=bool)  # is the left one of a pair
        takes[:-1] = is_left[:-1] & ~is_left[1:] & ~stop[:-1] & ~stop[1:]
        taken = np.zeros(len(name), dtype=bool)
        taken[1:] = takes[:-1]
        # A left symbol looks to its right, a right symbol to its left.
        left, right = self.left.copy(), self.right.copy()
        left[1:] = np.where(~is_left[1:], np.minimum(self.left[1:], self.left[:-1]), self.left[1:])
        right[:-1] = np.where(is_left[:-1], np.maximum(self.right[:-1], self.right[1:]), self.right[:-1])
        left, right = np.where(stop, self.left, left), np.where(stop, self.right, right)
        head = ~taken
        at = np.flatnonzero(head)
        pair = takes[at]
        nxt = np.minimum(at + 1, len(name) - 1)
        joined = np.where(pair, _mix(_mix(name[at] + U(0x5851F42D4C957F2D)) + name[nxt] * U(0x14057B7EF767814F)), name[at])
        self._group(head, joined, np.where(pair, np.minimum(left[at], left[nxt]), left[at]), np.where(pair, np.maximum(right[at], right[nxt]), right[at]))
        self._clip()


def chosen_symbols(texts: list[str], least: int, context: int | None = None, levels: int = 40) -> dict[str, np.ndarray]:
    """line, name, start, end: the symbols that windows of ``least`` characters choose, named by all of their context.

    context: the longest context of a symbol that is considered; every window has shorter ones, by default two fifths of a window."""
    context = context or least * 2 // 5
    p = Parse(texts, least)
    kept: list[tuple[np.ndarray, ...]] = []

    def take() -> bool:
        fits = ~p.stop & (p.right - p.left <= context)
        i = np.flatnonzero(fits)
        lo = np.maximum(p.right[i] - least, p.line_start[p.line[i]])
        hi = np.minimum(p.left[i], p.line_end[p.line[i]] - least)
        ok = hi >= lo
        i = i[ok]
        kept.append((p.line[i], p.named(p.left[i], p.right[i]) & ~WIDE, p.start[i], p.end[i], lo[ok], hi[ok]))
        return bool(fits.any())

    take()
    for level in range(levels):
        p.runs()
        # A run longer than the window has no name inside it that depends on its length; its unit stands for it.
        big = np.flatnonzero((p.end - p.start >= least) & (p.count > 1) & ~p.stop)
        if len(big):
            # Such a run has the same windows at many places, so it is entered at every ``least`` characters, for windows.
            name = _mix(p.unit[big] ^ U(0x8CB92BA72F3D8DD7)) | WIDE
            times = (p.end[big] - p.start[big] + least - 1) // least
            at = np.repeat(p.start[big], times) + least * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            r = lambda v: np.repeat(v, times)
            kept.append((r(p.line[big]), r(name), at, at + 1, r(p.start[big]), r(p.end[big]) - least))
        p.pairs(level)
        if not take():
            break
    out: list[tuple[np.ndarray, ...]] = []
    cover_lo, cover_hi = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for rows in reversed(kept):
        rank = (rows[1] >> U(60)).astype(np.int8)
        for r in range(16):
            m = rank == r
            lo, hi = rows[4][m], rows[5][m]
            if not len(lo):
                continue
            if len(cover_lo):
                k = np.searchsorted(cover_lo, lo, side="right") - 1
                need = (k < 0) | (cover_hi[np.maximum(k, 0)] < hi)
                if not need.any():
                    continue
            else:
                need = np.ones(len(lo), dtype=bool)
            out.append(tuple(c[m][need] for c in rows))
            a, b = np.concatenate((cover_lo, lo[need])), np.concatenate((cover_hi, hi[need]))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.ones(len(a), dtype=bool)
            new[1:] = a[1:] > b[:-1] + 1
            first = np.flatnonzero(new)
            cover_lo, cover_hi = a[first], b[np.append(first[1:], len(a)) - 1]
    cols = [np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out) if out else [()] * 6)]
    line = cols[0].astype(np.int64)
    base = p.line_start[line] if len(line) else line
    return {"line": line, "name": cols[1].astype(U), "start": cols[2] - base, "end": cols[3] - base}


def common(a: str, i: int, b: str, j: int) -> int:
    """How many characters are equal from a[i:] and b[j:] on."""
    n = min(len(a) - i, len(b) - j)
    if a[i : i + n] == b[j : j + n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[i + lo : i + mid] == b[j + lo : j + mid]:
            lo = mid
        else:
            hi = mid
    return lo


def common_back(a: str, i: int, b: str, j: int) -> int:
    """How many characters are equal before a[i] and b[j]."""
    n = min(i, j)
    if a[i - n : i] == b[j - n : j]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[i - mid : i - lo] == b[j - mid : j - lo]:
            lo = mid
        else:
            hi = mid
    return lo


_SYMBOLS = "name bigint, line bigint, rec bigint, slug string, line_no bigint, off bigint, start int"


def symbol_rows(articles: DataFrame, least: int, batch_chars: int = 600_000) -> DataFrame:
    """One row for each chosen symbol of each line of ``least`` characters or more; off is where the line begins in the body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> Iterator[pd.DataFrame]:
            texts = list(held)
            got = chosen_symbols(texts, least)
            where = np.searchsorted(got["line"], np.arange(len(texts) + 1)) if (np.diff(got["line"]) >= 0).all() else None
            if where is None:
                order = np.argsort(got["line"], kind="stable")
                got = {k: v[order] for k, v in got.items()}
                where = np.searchsorted(got["line"], np.arange(len(texts) + 1))
            own = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
            cols: list[list] = [[], [], [], [], [], []]
            names, starts = [], []
            for k, t in enumerate(texts):
                a, b = where[k], where[k + 1]
                if a == b:
                    continue
                for s, r, no, off in held[t]:
                    n = b - a
                    names.append(got["name"][a:b])
                    starts.append(got["start"][a:b])
                    for c, v in zip(cols, (own[k], r, s, no, off, n)):
                        c.append(v)
            if not names:
                return
            reps = np.array(cols[5])
            rep = lambda v, dt: np.repeat(np.array(v, dtype=dt), reps)
            yield pd.DataFrame({
                "name": np.concatenate(names).view(np.int64), "line": rep(cols[0], np.uint64).view(np.int64), "rec": rep(cols[1], np.int64), "slug": rep(cols[2], object),
                "line_no": rep(cols[3], np.int64), "off": rep(cols[4], np.int64), "start": np.concatenate(starts).astype(np.int32),
            })

        held: dict[str, set] = {}
        size = 0
        for pdf in batches:
            for slug, rec, body in zip(pdf["slug"], pdf["rec"], pdf["body"]):
                off = 0
                for no, line in enumerate(body.split("\n")):
                    if len(line) >= least:
                        if line not in held:
                            held[line] = set()
                            size += len(line)
                        held[line].add((slug, rec, no, off))
                    off += len(line) + 1
                if size >= batch_chars:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    src = articles.where("slug is not null and body is not null").where(F.length("body") >= least).select("slug", F.xxhash64("slug").alias("rec"), "body")
    return widen(src).mapInPandas(run, _SYMBOLS)


_MET = "name bigint, line bigint, start int, text string, r1 bigint, r2 bigint"


def _compare(least: int) -> Callable:
    """Lines that meet under a name, compared around it: (line, lo, hi) of every common stretch of ``least`` characters."""

    def of_group(rows: list[tuple]) -> Iterator[tuple]:
        for x in range(len(rows)):
            _, la, sa, ta, a1, a2 = rows[x]
            for y in range(x):
                _, lb, sb, tb, b1, b2 = rows[y]
                if a1 == a2 == b1 == b2 or (la == lb and sa == sb):
                    continue
                back, on = common_back(ta, sa, tb, sb), common(ta, sa, tb, sb)
                if back + on >= least:
                    yield la, sa - back, sa + on
                    yield lb, sb - back, sb + on

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if group and group[0][0] != row[0]:
                    out.extend(of_group(group))
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=["line", "lo", "hi"])
        yield pd.DataFrame(list(of_group(group)), columns=["line", "lo", "hi"])

    return run


def _windows(least: int) -> Callable:
    """All windows around a symbol by hash, for names that too many lines share to compare them pair by pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, line, start, text, r1, r2 in pdf.itertuples(index=False, name=None):
                for s in range(max(0, start - least + 1), min(start, len(text) - least) + 1):
                    w = text[s : s + least].encode("utf-8", "surrogatepass")
                    h = xxhash.xxh128_intdigest(w)
                    rows.append((h >> 64, h & (2**64 - 1), line, s, r1, r2))
            cols = list(zip(*rows)) if rows else [()] * 6
            as_int = lambda v: np.array(v, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"w1": as_int(cols[0]), "w2": as_int(cols[1]), "line": np.array(cols[2], dtype=np.int64), "s": np.array(cols[3], dtype=np.int32), "r1": np.array(cols[4], dtype=np.int64), "r2": np.array(cols[5], dtype=np.int64)})

    return run


def shared_spans(articles: DataFrame, cut: Callable, least: int = 200, pairwise: int = 64, small: int = 100_000) -> DataFrame:
    """(slug, span_start, span_end): the longest runs of characters that lie in stretches of ``least`` characters, inside one
    line, which stand in another slug's body too.

    pairwise: names shared by more lines are compared by windows.  small: up to so many slugs are broadcast to fetch their text."""
    symbols = cut(symbol_rows(articles, least), "symbols")
    shared = symbols.groupBy("name").agg(F.min("rec").alias("a"), F.max("rec").alias("b")).where("a <> b").select("name")
    met = cut(symbols.join(shared, "name"), "met")
    lines = met.groupBy("line").agg(F.min(F.struct("slug", "line_no")).alias("at"), F.min("rec").alias("r1"), F.max("rec").alias("r2"))
    # The text of one occurrence of every line that met another.
    wanted = lines.select("line", F.col("at.slug").alias("slug"), F.col("at.line_no").cast("int").alias("no"), "r1", "r2")
    bodies = articles.where("slug is not null and body is not null").select("slug", "body")
    slugs = wanted.select("slug").distinct()
    few = cut(slugs, "slugs")
    if few.limit(small + 1).count() <= small:
        bodies = bodies.join(F.broadcast(few), "slug", "left_semi")
    texts = cut(wanted.join(bodies, "slug").select("line", "r1", "r2", F.get(F.split("body", "\n"), F.col("no")).alias("text")).dropDuplicates(["line"]), "texts")
    whole = texts.where("r1 <> r2").select("line", F.lit(0).alias("lo"), F.length("text").alias("hi"))
    places = met.select("name", "line", "start").distinct()
    crowd = places.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    meeting = places.join(crowd, "name").join(texts, "line").select("name", "line", "start", "text", "r1", "r2", "n")
    by_windows = (F.col("n") > pairwise) | (F.col("name") % 2 != 0)
    few_rows = meeting.where(~by_windows).drop("n").repartition("name").sortWithinPartitions("name")
    pairs = few_rows.mapInPandas(_compare(least), "line bigint, lo int, hi int")
    w = meeting.where(by_windows).drop("n").mapInPandas(_windows(least), "w1 bigint, w2 bigint, line bigint, s int, r1 bigint, r2 bigint")
    both = w.groupBy("w1", "w2").agg(F.min("r1").alias("a"), F.max("r2").alias("b")).where("a <> b").select("w1", "w2")
    windows = w.join(both, ["w1", "w2"]).select("line", F.col("s").alias("lo"), (F.col("s") + least).alias("hi"))
    found = whole.unionByName(pairs).unionByName(windows).distinct()
    spots = met.select("line", "slug", "line_no", "off").distinct()
    at = spots.join(found, "line").select("slug", "line_no", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi")).distinct()
    order = Window.partitionBy("slug", "line_no").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = at.withColumn("before", before).withColumn("isle", F.sum(F.when(F.col("before") >= F.col("lo"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("slug", "line_no", "isle").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end")).select("slug", "span_start", "span_end")


def shared_amounts(articles: DataFrame, spans: DataFrame) -> DataFrame:
    """slug, characters, shared, share: how much of each record's text stands elsewhere too."""
    size = articles.where("slug is not null").groupBy("slug").agg(F.max(F.length("body")).cast("bigint").alias("characters"))
    got = spans.groupBy("slug").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    both = size.join(got, "slug", "left").select("slug", F.coalesce("characters", F.lit(0)).alias("characters"), F.coalesce("shared", F.lit(0)).alias("shared"))
    return both.withColumn("share", F.when(F.col("characters") > 0, F.round(F.col("shared") / F.col("characters"), 6)).otherwise(0.0))
