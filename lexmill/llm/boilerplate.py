"""Page boilerplate mixed with main content (problem 1).

The text of a page is read as a tree: the page, blocks (a label with its list, a menu, a poll, a comment thread, or a line
by itself) and lines.  Every line node gets features of its own (density of words, punctuation and links, attribute tokens:
list mark, learned weights of its words, what is known of its template), of its depth, of its siblings before and after,
and of its block's subtree.  Gradient-boosted trees turn them into log-odds.  A hierarchical decoding then chooses the
labels of the page, its blocks and their lines together: a block that goes takes all of its lines with it, a block that
stays isn't left with stray removals the evidence doesn't pay for, and a page is touched only if that pays as well.

What a page says about itself is learned from the data, all of it: no page, template or word is left out of what is learned.
Lines are reduced to templates (names and numbers masked), and each template that recurs is tested: does it stand under the
selectors in proportion to their pages, as content does, or in proportion to what recurs under them, as furniture does?  The
log-likelihood ratio of the two labels every line, beside plain rules for the kinds that every selector lets through (credits,
prompts, notices); words that stand in labelled lines then carry the labels on to lines whose template is rare.  The trees
are fitted on every line of every page by tasks that run side by side and add up their histograms.

Null slugs and bodies give nothing, blank lines are no lines, a slug delivered again counts once.  A page without a
retrieval, or without a selector, counts under no selector.
"""

from __future__ import annotations

import json
import pickle
import re
import secrets
import socket
import struct
import tempfile
from collections.abc import Callable, Container, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut, widen

_BULLETS = frozenset("•·*>»–-")
_MARK = re.compile(r"^(?:([•·*>»–-])|(#{1,6})|(\d{1,2}[.)]))\s+(?=\S)")
_END = re.compile(r"[.!?…][”\"'’)\]]*$")
_SEPARATORS = re.compile(r"\s[|·▶►/>»•–-]\s|\s?[|·▶►»]\s?")
_SEPARATOR = re.compile(r"[|·▶►/>»•–-]")
_TAIL = re.compile(r"\((?:video|photos?|audio)\)$|\b\d+\s?(?:h|m|d|hours?|min(?:utes)?|days?) ago$", re.I)
_HANDLE = re.compile(r"^[a-z][a-z0-9_]{2,20}: \S")
_PAIR = re.compile(r"^\**\w+:\**\s")
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W_]+|©")
#: A template is known as furniture if its log-likelihood ratio is more than this.
KNOWN = 2.0

WORD_FEATURES = 6


def visible(line: str) -> str:
    return line if line.isascii() else line.replace("\xad", "").replace("\u200b", "")


def tidy(line: str) -> str:
    return " ".join(visible(line).split())


class Memo(dict):
    """What a function gives, remembered; emptied when it has grown."""

    def __init__(self, of: Callable[[str], object], most: int = 500_000):
        self.of, self.most = of, most

    def __missing__(self, key: str) -> object:
        if len(self) > self.most:
            self.clear()
        value = self[key] = self.of(key)
        return value


_CAPITAL = Memo(lambda c: c.isupper() or not c.isalpha())


class Line:
    """What a line is by itself.  llr: how much more likely its template is as furniture than as content, 0 if unknown."""

    __slots__ = ("caps", "count", "ends", "feats", "handle", "headline", "label", "llr", "low", "mark", "said", "tail", "text", "words")

    def __init__(self, raw: str, llr: float = 0.0):
        t = tidy(raw)
        m = _MARK.match(t)
        self.mark = 0 if not m else 4 if m[2] else 5 if m[3] else 1 + "•-*".find(m[1]) if m[1] in "•-*" else 6
        rest = t[m.end() :] if m else t
        self.text, self.llr, self.said = rest, llr, None
        words = rest.split()
        self.count = n = len(words)
        self.low = low = rest.lower()
        self.words = _TOKEN.findall(low)
        self.ends = bool(_END.search(rest))
        caps = sum(map(_CAPITAL.__getitem__, [w[0] for w in words]))
        self.caps = caps / n if n else 0.0
        self.handle = bool(_HANDLE.match(rest))
        self.tail = tail = low.endswith((")", "ago")) and bool(_TAIL.search(rest))
        self.label = n <= 6 and not self.mark and not self.ends and not self.handle and (llr > KNOWN or not 0.15 < self.caps < 0.98 or n < 3)
        self.headline = n >= 3 and self.mark != 4 and not self.label and "|" not in rest and (tail or (not self.ends and 0.15 < self.caps < 0.98 and not _PAIR.match(rest)))
        colon = rest.find(":")
        self.feats = [
            n, len(rest), self.ends, rest.count(". ") + rest.count("? ") + rest.count("! "), rest.count(","), self.mark, self.caps, len(_DIGIT.findall(rest)) / max(1, len(rest)), len(_SEPARATORS.findall(rest)) if _SEPARATOR.search(rest) else 0, "©" in rest,
            tail, self.handle, rest.isupper(), rest.count(" ", 0, colon) + 1 if 0 <= colon < 40 else 0, llr, "“" in rest or '"' in rest, self.headline, "?" in rest,
        ]

    @property
    def worded(self) -> bool:
        """Whether it is worded as what selectors let through; found once for a line that recurs."""
        if self.said is None:
            t = self.low
            self.said = bool(_PAGE.match(t) or (any(x in t for x in _IN_NOTICES) and _NOTICE.match(t)) or (any(x in t for x in _IN_CONSENT) and _CONSENT.search(t) and _TO_READER.search(t)))
        return self.said


N_OWN = 18 + WORD_FEATURES


def blocks_of(lines: list[Line]) -> list[tuple[int, int, str]]:
    """(first, end, kind) of the page's blocks in order: 'list' (label, items, lines between items), 'items' (without a label), 'thread', 'poll', 'run' or 'line'."""
    out: list[tuple[int, int, str]] = []
    n, i = len(lines), 0

    def items_from(j: int) -> tuple[int, int]:
        """Where a list that begins at line j ends (one plain line may stand between two items), and how many items it has."""
        mark, k, end, count = lines[j].mark, j, j, 0
        while k < n:
            c = lines[k]
            if c.headline and c.mark == mark:
                k += 1
                end = k
                count += 1
            elif k == end and c.ends and not c.mark and c.count > 3 and k + 1 < n and lines[k + 1].headline and lines[k + 1].mark == mark:
                k += 1
            else:
                break
        return end, count

    while i < n:
        a = lines[i]
        if i + 1 < n and a.label:
            b = lines[i + 1]
            if b.handle:
                j = i + 1
                while j < n and lines[j].handle:
                    j += 1
                out.append((i, j, "thread"))
                i = j
                continue
            if b.headline:
                j, _ = items_from(i + 1)
                out.append((i, j, "list"))
                i = j
                continue
        if a.headline:
            j, count = items_from(i)
            if count > 1:
                out.append((i, j, "items"))
                i = j
                continue
        if a.text.endswith("?") and not a.mark and a.count <= 16 and i + 2 < n and "," not in lines[i + 1].text and lines[i + 1].mark and lines[i + 1].count <= 3 and lines[i + 2].mark == lines[i + 1].mark:
            j = i + 1
            while j < n and lines[j].mark == lines[i + 1].mark and lines[j].count <= 3:
                j += 1
            if j < n and not lines[j].mark and lines[j].count <= 3 and lines[j].feats[7] > 0:
                j += 1
            out.append((i, j, "poll"))
            i = j
            continue
        if not a.ends and a.count <= 4 and a.mark != 4:
            j = i + 1
            while j < n and not lines[j].ends and lines[j].count <= 4 and lines[j].mark == a.mark and not (lines[j].mark == 0 and j + 1 < n and lines[j + 1].headline):
                j += 1
            if j - i > 1:
                out.append((i, j, "run"))
                i = j
                continue
        out.append((i, i + 1, "line"))
        i += 1
    return out


_KINDS_OF_BLOCK = {"line": 0, "run": 1, "list": 2, "poll": 3, "thread": 4, "items": 5}
N_FEATURES = N_OWN + 22


def features(own: np.ndarray, per_page: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, ws: np.ndarray, per_line: np.ndarray) -> np.ndarray:
    """One row per line of some pages: its own features, its siblings', its block's and its place.

    own: the lines' ``feats``; per_page: lines of each page; sizes, kinds: of all blocks in order; ws: what the words weigh,
    per_line (1 at least) of each line.  Values are kept to eight binary digits, here as where the trees are fitted."""
    n = len(own)
    x = np.zeros((n, N_FEATURES), dtype=np.float64)
    if not n:
        return x.astype(np.float32)
    x[:, :18] = own
    at = np.cumsum(per_line) - per_line
    x[:, 18] = np.add.reduceat(ws, at) / per_line
    x[:, 19], x[:, 20] = np.maximum.reduceat(ws, at), np.minimum.reduceat(ws, at)
    x[:, 21], x[:, 22] = ws[at], ws[at + per_line - 1]
    x[:, 23] = np.add.reduceat((ws > 1).astype(np.float64), at) / per_line
    first = np.repeat(np.cumsum(per_page) - per_page, per_page)
    k, m = np.arange(n) - first, np.repeat(per_page, per_page)
    beside = x[:, [0, 2, 18, 5, 14]]
    x[1:, 24:29] = beside[:-1] * (k[1:] > 0)[:, None]
    x[:-1, 29:34] = beside[1:] * (k[:-1] < m[:-1] - 1)[:, None]
    a = np.cumsum(sizes) - sizes
    of, size, a_of, kind = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes), np.repeat(a, sizes), np.repeat(kinds, sizes)
    x[:, 34], x[:, 35] = kind, size
    for to, c in ((36, 0), (37, 18), (38, 14), (39, 2)):
        x[:, to] = (np.add.reduceat(x[:, c], a) / sizes)[of]
    x[:, 40], x[:, 41] = np.where(size > 1, x[a_of, 18], 0), np.where(size > 1, x[a_of, 14], 0)
    x[:, 42] = np.arange(n) - a_of
    x[:, 43] = ((kind == 2) | (kind == 5)) & (x[:, 42] > 0) & (x[:, 2] > 0) & (x[:, 5] == 0)
    x[:, 44], x[:, 45] = k / m, np.minimum(k, m - 1 - k)
    return value_of(code_of(x.astype(np.float32)))


def code_of(x: np.ndarray) -> np.ndarray:
    """float32 rounded to eight binary digits, as 16-bit numbers of the same order."""
    u = (x + np.float32(0)).view(np.uint32)
    u = ((u + 0x7FFF + ((u >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(u & 0x8000, ~u, u | 0x8000)


def value_of(code: np.ndarray) -> np.ndarray:
    u = np.where(code & 0x8000, code & 0x7FFF, ~code).astype(np.uint16)
    return (u.astype(np.uint32) << 16).view(np.float32)


# --- gradient-boosted trees -------------------------------------------------------------------------------------------


class Trees:
    """Binary boosting with histogram splits; a tree is arrays of feature, threshold, children and leaf values."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, ...]]):
        self.base, self.trees = base, trees

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        flat, at = x.ravel(), np.arange(len(x)) * x.shape[1]
        for feature, threshold, left, value, depth in self.trees:
            leaf = feature < 0  # leads to itself
            f, t = np.where(leaf, 0, feature).astype(np.intp), np.where(leaf, np.float32(np.inf), threshold)
            to = np.where(leaf, np.arange(len(feature)), left).astype(np.intp)
            node = np.zeros(len(x), dtype=np.intp)
            for _ in range(int(depth)):
                node = to.take(node) + (flat.take(at + f.take(node)) > t.take(node))
            out += value.take(node)
        return out


def edges_of(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature may be split: between all its values (ascending, each ``counts`` times) if they are few, else at quantiles."""
    if len(values) <= bins:
        return values[:-1]
    upto = np.cumsum(counts)
    return np.unique(values[np.searchsorted(upto, np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1), side="right")])


def packed(edges: list[np.ndarray], most: int = 2500) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Features side by side in one number: the group and the stride of each, its width, and the cells of each group, so that
    one count over a group gives the sums of all its features."""
    width = np.array([len(e) + 1 for e in edges])
    group, stride, cells = np.zeros(len(edges), dtype=np.int64), np.ones(len(edges), dtype=np.int64), []
    for f in np.argsort(-width, kind="stable").tolist():
        k = next((k for k, c in enumerate(cells) if c * width[f] <= most), len(cells))
        if k == len(cells):
            cells.append(1)
        group[f], stride[f] = k, cells[k]
        cells[k] *= int(width[f])
    return group, stride, width, cells


class Rows:
    """The rows that one task fits on, features packed, a group after the other in each piece; in files, so memory doesn't bound
    them."""

    def __init__(self, edges: list[np.ndarray], piece: int = 50_000):
        self.packing = self.group, self.stride, self.width, self.cells = packed(edges)
        self.file, self.pieces, self.n, self.piece, self.held = tempfile.TemporaryFile(), [], 0, piece, []

    def add(self, bins: np.ndarray, y: np.ndarray, salt: np.ndarray) -> None:
        """bins: uint8, a row per line; salt: uint32, what draws the lines."""
        keys = np.zeros((len(self.cells), len(bins)), dtype=np.uint16)
        for f, (k, s) in enumerate(zip(self.group, self.stride)):
            keys[k] += bins[:, f] * np.uint16(s)
        self.held.append((keys, y.astype(np.float32), salt))
        if sum(len(x[1]) for x in self.held) >= self.piece:
            self._write()

    def _write(self) -> None:
        if self.held:
            keys, y, salt = (np.concatenate(x, axis=-1) for x in zip(*self.held))
            at = self.file.tell()
            self.file.write(np.ascontiguousarray(keys))
            self.pieces.append((at, len(y), self.n, y, salt))
            self.n, self.held = self.n + len(y), []

    def seal(self) -> list[tuple]:
        """(keys, y, salt, score, g, h, node, drawn) of each piece."""
        self._write()
        self.file.flush()
        if not self.n:
            return []
        held = [np.memmap(tempfile.TemporaryFile(), dtype=t, mode="w+", shape=(self.n,)) for t in (np.float32, np.float32, np.float32, np.uint8, np.bool_)]
        return [tuple(np.asarray(x) for x in (np.memmap(self.file, dtype=np.uint16, mode="r", offset=at, shape=(len(self.cells), m)), y, salt, *(h[o : o + m] for h in held))) for at, m, o, y, salt in self.pieces]


def grow(rows: Rows, edges: list[np.ndarray], n: int, positive: int, gather: Callable[[np.ndarray], np.ndarray], rounds: int = 70, depth: int = 5, rate: float = 0.25, ridge: float = 1.0, part: float = 0.5) -> Trees:
    """Boost over the rows of all tasks.  ``gather`` adds an array up over them, so every task grows the same trees; n and
    positive are of all.  Each tree's splits see a seeded ``part`` of the rows, its leaves all.  Of two siblings only the
    histogram of the one with fewer rows is counted; the other's is what is left of their parent's."""
    m = len(edges)
    p = float(np.clip(positive / n, 1e-6, 1 - 1e-6))
    base = float(np.log(p / (1 - p)))
    pieces = rows.seal()
    group, stride, widths, cells = rows.packing
    width = max(len(e) for e in edges) + 1
    for _, _, _, score, *_ in pieces:
        score[:] = base
    trees: list[tuple] = []
    rnd = np.random.default_rng(0)

    def histograms(nodes: list[int]) -> np.ndarray:
        sums = [np.zeros((2, len(nodes), c)) for c in cells]
        slot = np.full(256, -1, dtype=np.int64)
        slot[nodes] = np.arange(len(nodes))
        for keys, _, _, _, g, h, node, drawn in pieces:
            s = slot.take(node)
            at = np.flatnonzero(drawn & (s >= 0))
            if not len(at):
                continue
            gs, hs, s = g.take(at).astype(np.float64), h.take(at).astype(np.float64), s.take(at)
            for k, c in enumerate(cells):
                key = keys[k].take(at) if len(nodes) == 1 else keys[k].take(at) + s * c
                sums[k][0] += np.bincount(key, gs, len(nodes) * c).reshape(-1, c)
                sums[k][1] += np.bincount(key, hs, len(nodes) * c).reshape(-1, c)
        out = np.zeros((2, len(nodes), m, width))
        for f in range(m):
            k, w, t = group[f], widths[f], stride[f]
            out[:, :, f, :w] = sums[k].reshape(2, len(nodes), -1, w, t).sum((2, 4))
        return gather(out)

    for _ in range(rounds):
        turn = rnd.integers(1 << 31, size=2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        drawn_n = 0
        for _, y, salt, score, g, h, node, drawn in pieces:
            prob = 1 / (1 + np.exp(-score))
            g[:], h[:], node[:] = y - prob, prob * (1 - prob), 0
            z = (salt + np.uint32(1)) * turn[0]  # wraps
            z = (z ^ (z >> np.uint32(15))) * turn[1]
            drawn[:] = z ^ (z >> np.uint32(13)) < np.uint32(part * (2**32 - 1))
            drawn_n += int(drawn.sum())
        feature, threshold, left, at_bin = [-1], [0.0], [0], [0]
        size = {0: int(gather(np.array([drawn_n], dtype=np.float64))[0])}
        hist = {0: histograms([0])[:, 0]}
        for level in range(depth):
            split = []
            for v in sorted(hist):
                if size[v] < 8:
                    continue
                gs, hs = hist[v].cumsum(2)
                gt, ht = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -1
                f, b = divmod(int(gain.argmax()), width)
                if gain[f, b] < 1e-3 or b >= len(edges[f]):
                    continue
                feature[v], threshold[v], left[v], at_bin[v] = f, float(edges[f][b]), len(feature), b
                for x, first in ((feature, -1), (threshold, 0.0), (left, 0), (at_bin, 0)):
                    x += [first, first]
                split.append(v)
            if not split:
                break
            new, of, begin, where = np.zeros(len(feature), dtype=bool), np.zeros(len(feature), dtype=np.intp), np.zeros(len(feature), dtype=np.intp), []
            for v in split:  # the child that each cell of the node's group leads to
                f = feature[v]
                new[v], of[v], begin[v] = True, group[f], sum(map(len, where))
                where.append((left[v] + (np.arange(cells[group[f]]) // stride[f] % widths[f] > at_bin[v])).astype(np.uint8))
            child = np.concatenate(where)
            counts = np.zeros(len(feature))
            for keys, _, _, _, _, _, node, drawn in pieces:
                go = np.flatnonzero(new.take(node))
                nd = node.take(go)
                nd = child.take(begin.take(nd) + keys.ravel().take(of.take(nd) * len(node) + go))
                node[go] = nd
                counts += np.bincount(nd[drawn.take(go)], minlength=len(feature))
            if level + 1 == depth:
                break
            counts = gather(counts)
            size = {c: int(counts[c]) for v in split for c in (left[v], left[v] + 1)}
            small = [left[v] + (counts[left[v] + 1] < counts[left[v]]) for v in split]
            found = histograms([int(c) for c in small])
            parents, hist = hist, {}
            for k, v in enumerate(split):
                hist[int(small[k])] = found[:, k]
                hist[2 * left[v] + 1 - int(small[k])] = parents[v] - found[:, k]
        sums = np.zeros((2, len(feature)))
        for _, _, _, _, g, h, node, _ in pieces:
            sums += np.bincount(node, g, len(feature)), np.bincount(node, h, len(feature))
        gs, hs = gather(sums)
        value = rate * gs / (hs + ridge)
        for _, _, _, score, _, _, node, _ in pieces:
            score += value.astype(np.float32)[node]
        trees.append((np.array(feature, dtype=np.int32), np.array(threshold, dtype=np.float32), np.array(left, dtype=np.int32), value, depth))
    return Trees(base, trees)


def fit_trees(x: np.ndarray, y: np.ndarray, bins: int = 48, **how: float) -> Trees:
    """Fit on rows x (float32) and labels y (0 or 1) that are here."""
    if len(x) == 0:
        return Trees(-20.0, [])
    if y.min() == y.max():
        return Trees(20.0 if y[0] else -20.0, [])
    edges = [edges_of(*np.unique(x[:, f], return_counts=True), bins) for f in range(x.shape[1])]
    rows = Rows(edges)
    rows.add(np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8), y, np.arange(len(x), dtype=np.uint32))
    return grow(rows, edges, len(x), int(y.sum()), lambda a: a, **how)


def decode(odds: np.ndarray, blocks: list[tuple[int, int, str]], stray: float = 2.0, page: float = 0.5) -> np.ndarray:
    """Which lines go.  A block goes whole, stays whole, or stays with single lines removed, each of which costs ``stray``;
    a page that loses anything costs ``page``, so one that is clean but for a doubtful line stays whole."""
    out = np.zeros(len(odds), dtype=bool)
    gain = 0.0
    for a, e, _ in blocks:
        o = odds[a:e]
        if e - a == 1:
            out[a] = o[0] > 0
            gain += max(0.0, o[0])
            continue
        total = o.sum()
        alone = o > stray
        mixed = (o[alone] - stray).sum()
        if total > 0 and total >= mixed:
            out[a:e] = True
            gain += total
        elif mixed > 0:
            out[a:e] = alone
            gain += mixed
    if gain <= page:
        out[:] = False
    return out


# --- labels ------------------------------------------------------------------------------------------------------------

# How pages on the web commonly word what selectors let through: for labelling only.
_PAGE = re.compile(
    r"^(?:skip to (?:main )?content|back to top|(?:home\s*[>/»|]|you are here:).*|advertisement|(?:article|story) continues.*"
    r"|(?:most read|most popular|related (?:links|stories|articles)|you may also like|recommended for you|trending now|popular now|latest news)"
    r"|(?:accept|allow|reject)(?: all| non-essential)?|manage (?:choices|settings|cookies)"
    r"|(?:share|tweet|print|e-?mail|copy|save|pin) (?:this|link|to|for later|it|\d).{0,60}|like what you (?:read|see)\b.*|have a (?:news )?tip\b.*"
    r"|follow .* (?:on|for) .*|comments? \(\d+\)|\d[\d,]* (?:comments?|votes?|shares?)|poll: .*"
    r"|(?:download|get) the .*\b(?:app|inbox|newsletter)\b.*|subscribe(?: now| today| here| to our .*)?[.!]?|listen to the .*\b(?:episode|podcasts?)\b.*|.* podcast is out now\.?|(?:find|read|see) more .* (?:on|at) the .*|join [\d,]+ .*"
    r"|click here .*|(?:watch|see|play) .* (?:above|below)\.?|photo(?:s|graph)?:.*|more to come\.?|this (?:story|article|post) (?:will be|was|has been) updated.*|corrections? (?:to|and) .*|contributing: .*|this report was compiled .*|about the author.*"
    r"|©.*)$"
)
_NOTICE = re.compile(r"^(?:.*\ball rights reserved\b.*|.*\bviews expressed\b.*|.*\bfor information only\b.*|.*\bregistered (?:in|under)\b.*|.*\bwrites\b.*\bpodcast\.?)$")
# What a match of _NOTICE or _CONSENT contains; they are tried only where it stands.
_IN_NOTICES = ("all rights reserved", "views expressed", "for information only", "registered ", "writes")
_IN_CONSENT = ("cookie", "local storage", "device identifiers", "small ", "tracking tools", "consent choices", "store information", "pixel", "session data", "similar technolog")
_CONSENT = re.compile(r"\bcookies?\b|\blocal storage\b|\bdevice identifiers\b|\bsmall (?:text )?files\b|\btracking tools\b|\bconsent choices\b|\bstore information on your device\b|\bpixels?\b|\bsession data\b|\bsimilar technolog", re.I)
_TO_READER = re.compile(r"\b(?:we|our|us|wir|site|website|pages? load|browser|settings|privacy|count visits|tap|you|your|sie|measurement|device|relevant offers|policy)\b", re.I)
_CREDIT = re.compile(r"^(?:by|words:|posted by|written by|text:|von)\s", re.I)


def labels(lines: list[Line], blocks: list[tuple[int, int, str]]) -> list[bool]:
    """Label a page's lines, true for a line that isn't the article's own: its template is known as furniture, or it
    reads as a credit, a prompt or a notice; what a known label heads goes with it."""
    out = [False] * len(lines)
    for a, e, kind in blocks:
        for k in range(a, e):
            x = lines[k]
            if x.mark == 4:
                continue
            t = x.low
            if x.llr > KNOWN or x.worded:
                out[k] = True
            elif kind == "items" or x.tail and x.headline:
                out[k] = True
            elif _CREDIT.match(x.text) and not x.mark and x.count <= 12:
                named = [w for w in x.text.split()[1:] if w.lower() not in ("by", "and", "&", "|", "the")]
                weekday = re.match(r"by (?:mon|tues|wednes|thurs|fri|satur|sun)day\b", t)
                out[k] = not weekday and (not named or t.startswith(("posted by", "written by", "words:")) or sum(w[0].isupper() for w in named) >= 0.6 * len(named) or not x.ends)
        head = out[a]
        if kind == "run" and 2 * sum(out[a:e]) >= e - a and lines[a].mark not in (4,):
            out[a:e] = [True] * (e - a)
        if kind == "list" and not head and sum(x.headline for x in lines[a + 1 : e]) > 1:
            out[a + 1 : e] = [True] * (e - a - 1)
        if kind == "list" and head or kind == "poll" and lines[a].low.startswith("poll") or kind == "thread" and head:
            out[a:e] = [True] * (e - a)
    return out


class Table:
    """Values by 64-bit hash, kept as sorted arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, 0 where there are none."""
        if not len(self.keys):
            return np.zeros((len(keys), *self.values.shape[1:]), dtype=self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return self.values[at] * (found[:, None] if self.values.ndim > 1 else found)


NO_WORD = 0  # stands in for the words of a line without any, and counts the lines


def word_weights(kept: np.ndarray, labelled: np.ndarray, lines: tuple[int, int], least: int = 5) -> np.ndarray:
    """Log-odds of words between labelled and other lines, by the lines of either kind that hold each; 0 for one in fewer than ``least``."""
    odds = np.log((labelled + 0.5) / (lines[1] + 1.0)) - np.log((kept + 0.5) / (lines[0] + 1.0))
    return np.where(kept + labelled >= least, odds, 0.0)


class Chunk:
    """Lines of some pages, as arrays: slugs, half (of each page), counts (whether a page is to be learned from), per_page, nos
    (line numbers), own (``Line.feats``), sizes and kinds of blocks, bad (labels), words (places in vocab, a hash each) and
    per_line."""

    __slots__ = ("bad", "blocks", "counts", "half", "kinds", "nos", "own", "per_line", "per_page", "sizes", "slugs", "vocab", "words")

    def __init__(self, pages: list[tuple[str, bool, list[int], list[Line], list[tuple[int, int, str]]]]):
        flat = [w for *_, lines, _ in pages for x in lines for w in (x.words or ("",))]
        ids = {w: i for i, w in enumerate(dict.fromkeys(["", *flat]))}
        self.slugs = [slug for slug, *_ in pages]
        self.half = np.array([xxhash.xxh64_intdigest(slug) & 1 for slug in self.slugs], dtype=np.int8)
        self.counts = np.array([c for _, c, *_ in pages], dtype=bool)
        self.per_page = np.array([len(nos) for _, _, nos, _, _ in pages], dtype=np.int64)
        self.nos = np.array([i for _, _, nos, _, _ in pages for i in nos], dtype=np.int32)
        self.own = np.array([x.feats for *_, lines, _ in pages for x in lines], dtype=np.float32).reshape(-1, 18)
        self.blocks = np.array([len(b) for *_, b in pages], dtype=np.int32)
        self.sizes = np.array([e - a for *_, b in pages for a, e, _ in b], dtype=np.int64)
        self.kinds = np.array([_KINDS_OF_BLOCK[kind] for *_, b in pages for _, _, kind in b], dtype=np.int8)
        self.bad = np.array([y for *_, lines, b in pages for y in labels(lines, b)], dtype=bool)
        self.words = np.fromiter(map(ids.__getitem__, flat), dtype=np.int32, count=len(flat))
        self.per_line = np.array([len(x.words) or 1 for *_, lines, _ in pages for x in lines], dtype=np.int64)
        self.vocab = np.array([NO_WORD, *(xxhash.xxh64_intdigest(w) for w in list(ids)[1:])], dtype=np.uint64).view(np.int64)

    def line(self, of_pages: np.ndarray) -> np.ndarray:
        return np.repeat(of_pages, self.per_page)

    def heavy(self, first: Table) -> np.ndarray:
        """Lines that the label is carried on to: not labelled, their template not known as content, and most of their words
        and their words together weigh much."""
        ws, at = first.of(self.vocab)[self.words], np.cumsum(self.per_line) - self.per_line
        has = self.vocab[self.words[at]] != NO_WORD
        much = (np.add.reduceat(ws, at) > 1.5 * self.per_line) & (np.add.reduceat((ws > 1).astype(np.int64), at) >= 0.7 * self.per_line)
        return ~self.bad & has & much & (self.own[:, 5] != 4) & (self.own[:, 2] == 0) & (self.own[:, 14] >= 0)

    def tally(self, lines: np.ndarray, bad: np.ndarray, sign: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, 2 * half + label, how many of the lines hold the word); the lines themselves under NO_WORD."""
        lines = lines & self.line(self.counts)
        cls = 2 * self.line(self.half).astype(np.int64) + bad
        v = len(self.vocab)
        taken = np.repeat(lines, self.per_line)
        held = np.sort(np.repeat(np.arange(len(lines)), self.per_line)[taken] * v + self.words[taken])
        held = held[np.diff(held, prepend=-1) > 0]  # once for each line
        n = np.bincount(cls[held // v] * v + held % v, minlength=4 * v).reshape(4, v)
        n[:, 0] = np.bincount(cls[lines], minlength=4)
        c, w = np.nonzero(n)
        return self.vocab[w], c.astype(np.int32), sign * n[c, w]

    def weighed(self, values: np.ndarray) -> np.ndarray:
        """The lines' features; values: what each word weighs."""
        return features(self.own, self.per_page, self.sizes, self.kinds, values, self.per_line)

    def gone(self, odds: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Slugs and numbers of the lines that go."""
        out = np.zeros(len(odds), dtype=bool)
        at = b = 0
        for n, of in zip(self.per_page.tolist(), self.blocks.tolist()):
            o = 0
            blocks = [(o, o := o + size, "") for size in self.sizes[b : b + of].tolist()]
            out[at : at + n] = decode(odds[at : at + n], blocks)
            at, b = at + n, b + of
        pages = self.line(np.arange(len(self.slugs)))[out]
        return [self.slugs[k] for k in pages.tolist()], self.nos[out].astype(np.int64)

    def dumps(self) -> bytes:
        return pickle.dumps([getattr(self, k) for k in self.__slots__], protocol=5)

    @classmethod
    def loads(cls, b: bytes) -> Chunk:
        z = cls.__new__(cls)
        for k, v in zip(cls.__slots__, pickle.loads(b)):
            setattr(z, k, v)
        return z


class Templates:
    """Lines reduced to templates: without a bullet, numbers as 0, (runs of) words after the first that begin with a capital as
    one mask.  known: log-likelihood ratio by a template's hash."""

    def __init__(self, known: Table | None = None):
        self.known, self.masks, self.here = known, Memo(self.mask), {}

    @staticmethod
    def mask(word: str) -> str:
        return "0" if any(map(str.isdigit, word)) else "\0" if word.lstrip("“”\"'‘’([*_")[:1].isupper() else word

    def words(self, line: str) -> list[str]:
        ws = visible(line).split()
        return ws[1:] if len(ws) > 1 and ws[0] in _BULLETS else ws

    def hash(self, ws: list[str]) -> int:
        first = ws[0]
        t = " ".join(["0" if any(map(str.isdigit, first)) else first, *map(self.masks.__getitem__, ws[1:])])
        while "\0 \0" in t:
            t = t.replace("\0 \0", "\0")
        h = xxhash.xxh64_intdigest(t)
        return h - (1 << 64) if h >> 63 else h

    def look_up(self, bodies: Iterable[str], known: Container[str]) -> None:
        """Find the ratios of the bodies' lines at once, but for lines that are known."""
        at = {line: self.hash(ws) for line in {x for body in bodies for x in body.split("\n")} if line not in known and (ws := self.words(line))}
        self.here = dict(zip(at, self.known.of(np.array(list(at.values()), dtype=np.int64)).tolist())) if self.known else {}

    def llr(self, line: str) -> float:
        return self.here.get(line, 0.0)


def _read(body: str, known: dict[str, Line], templates: Templates | None = None) -> tuple[list[int], list[Line]]:
    """Numbers and Lines of a body.  known holds the Lines of short texts, which recur."""
    numbers, lines = [], []
    for i, raw in enumerate(body.split("\n")):
        if not raw.strip():
            continue
        x = known.get(raw)
        if x is None:
            x = Line(raw, templates.llr(raw) if templates else 0.0)
            if not x.count:
                continue
            if x.count < 25:
                known[raw] = x
        numbers.append(i)
        lines.append(x)
    return numbers, lines


def chunks(batches: Iterator[pd.DataFrame], templates: Templates, size: int = 500) -> Iterator[Chunk]:
    """Chunks of slug, body and (if it is there) counts."""
    known: dict[str, Line] = {}
    for pdf in batches:
        for at in range(0, len(pdf), size):
            part = pdf.iloc[at : at + size]
            if len(known) > 100_000:
                known.clear()
            templates.look_up(part["body"], known)
            pages = []
            for slug, body, counts in zip(part["slug"], part["body"], part["counts"] if "counts" in part else [True] * len(part)):
                numbers, lines = _read(body, known, templates)
                if lines:
                    pages.append((slug, bool(counts), numbers, lines, blocks_of(lines)))
            if pages:
                yield Chunk(pages)


class Model:
    """Trees with what they know: templates that recur, with their ratios, and words with their weights."""

    def __init__(self, trees: Trees, templates: Table | None = None, weights: Table | None = None):
        nothing = Table(np.zeros(0, dtype=np.int64), np.zeros(0))
        self.trees, self.templates, self.weights = trees, templates or nothing, weights or nothing

    def gone(self, c: Chunk) -> pd.DataFrame:
        x = c.weighed(self.weights.of(c.vocab)[c.words])
        slugs, nos = c.gone(self.trees.log_odds(x))
        return pd.DataFrame({"slug": pd.Series(slugs, dtype=object), "line_no": nos})


def _pages(articles: DataFrame) -> DataFrame:
    """slug, body."""
    return widen(articles.select("slug", "body").where("slug is not null and body is not null"))


def page_templates(articles: DataFrame) -> DataFrame:
    """slug, site ('' where there is none), t: the hashes of a page's templates, once each; times: how often it was delivered."""
    site = F.coalesce("site", F.lit("")) if "site" in articles.columns else F.lit("")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Templates()
        for pdf in batches:
            t = [list({of.hash(ws) for line in body.split("\n") if (ws := of.words(line))}) for body in pdf["body"]]
            yield pd.DataFrame({"slug": pdf["slug"], "site": pdf["site"], "t": t})

    src = articles.withColumn("_site", site).select("slug", F.col("_site").alias("site"), "body").where("slug is not null and body is not null")
    rows = widen(src).mapInPandas(run, "slug string, site string, t array<bigint>")
    return rows.groupBy("slug").agg(F.min(F.struct("site", "t")).alias("x"), F.count("*").alias("times")).select("slug", "x.site", "x.t", "times")


def selected_pages(articles: DataFrame, provenance: DataFrame) -> DataFrame:
    """page_templates with the selector of each page's last retrieval ('' where there is none)."""
    sel = provenance.where("slug is not null").groupBy("slug").agg(F.max_by("body_selector", F.struct("retrieved_at", "prov_id")).alias("selector"))
    return page_templates(articles).join(sel, "slug", "left").select("slug", "site", F.coalesce("selector", F.lit("")).alias("selector"), "t", "times")


def furniture_templates(pages: DataFrame, least: int = 20) -> DataFrame:
    """template, pages, llr of every template that stands in ``least`` pages or more, over all pages.

    With p the share of a selector's pages, q its share of all that recurs and w = q / p, a page of a site counts log(w) less
    the logarithm of w's mean over the site's pages, so that what one site alone carries is measured by that site's selectors.
    Only hashes and counts are shuffled; counts combine first, so a template on every page is no hot key."""
    n = pages.select("site", "selector", F.explode("t").alias("template")).groupBy("template", "site", "selector").agg(F.count("*").alias("n"))
    total = n.groupBy("template").agg(F.sum("n").alias("pages")).where(F.col("pages") >= least)
    often = cut(n.join(total, "template"), "templates")
    by_site = pages.groupBy("site", "selector").agg(F.count("*").alias("n"))
    shares = lambda df, name: df.groupBy("selector").agg(F.sum("n").alias("n")).select("selector", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name))  # noqa: E731  # one row per selector
    w = shares(by_site, "p").join(shares(often, "q"), "selector").select("selector", (F.col("q") / F.col("p")).alias("w"))
    mean = by_site.join(w, "selector").groupBy("site").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("m"))
    return often.join(w, "selector").join(mean, "site").groupBy("template", "pages").agg(F.sum(F.col("n") * F.ln(F.col("w") / F.col("m"))).alias("llr"))


def _learned(articles: DataFrame, again: bool) -> DataFrame:
    """slug, body, counts: false for all but one delivery of a slug.  Bodies are only shuffled if a slug was delivered again."""
    pages = articles.select("slug", "body").where("slug is not null and body is not null")
    if not again:
        return widen(pages).withColumn("counts", F.lit(True))
    return pages.withColumn("counts", F.row_number().over(Window.partitionBy("slug").orderBy("body")) == 1)


def _tallies(df: DataFrame) -> DataFrame:
    x = df.select(F.explode(F.arrays_zip("w", "c", "n")).alias("x")).select("x.*")
    return x.groupBy("w").agg(*(F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """Columns of numbers on the driver, without rows of objects."""
    return [c.to_numpy() for c in df.toArrow().columns]


def _words_of(tallies: DataFrame, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts by half and label of words in ``least`` lines or more; the numbers of lines."""
    w, *n = _arrays(tallies.where(f"w = {NO_WORD} or n0 + n1 + n2 + n3 >= {least}"))
    n = np.array(n, dtype=np.int64).reshape(4, -1)
    return w[w != NO_WORD], n[:, w != NO_WORD], n[:, w == NO_WORD].sum(1)


class Adder:
    """Adds arrays up over the tasks of a barrier stage, in the tasks' order: the first task takes the others' and returns the
    sum.  (A barrier's own messages take a second each; one is used to tell where the first task listens.)"""

    def __init__(self, task: BarrierTaskContext):
        hosts = [t.address.rsplit(":", 1)[0] for t in task.getTaskInfos()]
        self.others: list[socket.socket] = []
        self.first: socket.socket | None = None
        if len(hosts) == 1:
            return
        rank = task.partitionId()
        server = socket.create_server((hosts[0], 0), backlog=len(hosts)) if rank == 0 else None
        key = secrets.token_hex(16) if server else ""
        where = json.loads(task.allGather(json.dumps([server.getsockname()[1], key] if server else None))[0])
        if server is None:
            self.first = socket.create_connection((hosts[0], where[0]))
            self.first.sendall(where[1].encode() + struct.pack("<i", rank))
        else:
            by_rank: dict[int, socket.socket] = {}
            while len(by_rank) < len(hosts) - 1:
                c, _ = server.accept()
                if secrets.compare_digest(self._take(c, 32), key.encode()):
                    by_rank[struct.unpack("<i", self._take(c, 4))[0]] = c
                else:
                    c.close()
            server.close()
            self.others = [by_rank[k] for k in sorted(by_rank)]
        for c in (*self.others, *([self.first] if self.first else [])):
            c.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _take(c: socket.socket, n: int) -> bytes:
        out = bytearray(n)
        view = memoryview(out)
        while view:
            got = c.recv_into(view)
            if not got:
                raise ConnectionError("a task that adds up with this one is gone")
            view = view[got:]
        return bytes(out)

    def __call__(self, a: np.ndarray) -> np.ndarray:
        a = np.ascontiguousarray(a, dtype=np.float64)
        if self.first:
            self.first.sendall(a.tobytes())
            return np.frombuffer(self._take(self.first, a.nbytes)).reshape(a.shape)
        for c in self.others:
            a = a + np.frombuffer(self._take(c, a.nbytes)).reshape(a.shape)
        for c in self.others:
            c.sendall(a.tobytes())
        return a

    def __enter__(self) -> Adder:
        return self

    def __exit__(self, *_: object) -> None:
        for c in (*self.others, *([self.first] if self.first else [])):
            c.close()


def fit_rows(rows: DataFrame, edges: list[np.ndarray], n: int, positive: int, **how: float) -> Trees:
    """Trees of rows (slug: to order by; x: code_of their features, as bytes; y; salt).  All tasks run at the same time and add
    up their histograms; each keeps its share of the rows in a file of one byte a value."""
    if n == 0:
        return Trees(-20.0, [])
    if positive in (0, n):
        return Trees(20.0 if positive else -20.0, [])
    sc = rows.sparkSession.sparkContext
    side = max(1, min(sc.defaultParallelism, n // 20_000))
    # code -> bin, a table for each feature: as many edges as lie below
    values = value_of(np.arange(1 << 16, dtype=np.uint16))
    shared = sc.broadcast((edges, np.stack([np.searchsorted(e, np.nan_to_num(values), side="left").astype(np.uint8) for e in edges])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, bins_of = shared.value
        own, columns = Rows(edges), np.arange(len(edges))
        for pdf in batches:
            for x, y, salt in zip(pdf["x"], pdf["y"], pdf["salt"]):
                codes = np.frombuffer(x, dtype=np.uint16).reshape(-1, len(edges))
                own.add(bins_of[columns, codes], np.frombuffer(y, dtype=np.bool_), np.frombuffer(salt, dtype=np.uint32))
        task = BarrierTaskContext.get()
        with Adder(task) as gather:
            trees = grow(own, edges, n, positive, gather, **how)
        if task.partitionId() == 0:
            yield pd.DataFrame({"trees": [pickle.dumps((trees.base, trees.trees))]})

    found = rows.repartition(side, "slug").sortWithinPartitions("slug").mapInPandas(run, "trees binary", barrier=True).collect()
    return Trees(*pickle.loads(found[0].trees))


def fit(articles: DataFrame, provenance: DataFrame, least: int = 20, bins: int = 48, **how: float) -> tuple[Model, DataFrame]:
    """A model of all pages, and the pages as they were read (chunk, with rows where it is null)."""
    sc = articles.sparkSession.sparkContext
    own = cut(selected_pages(articles, provenance), "pages")
    templates = Table(*_arrays(furniture_templates(own, least).select("template", F.col("llr").cast("double"))))
    known = sc.broadcast(templates)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks(batches, Templates(known.value)):
            w, k, n = c.tally(np.ones(len(c.own), dtype=bool), c.bad)
            yield pd.DataFrame({"chunk": [c.dumps()], "w": [w], "c": [k], "n": [n]})

    counted = "w array<bigint>, c array<int>, n array<bigint>"
    pages = cut(_learned(articles, not own.where("times > 1").isEmpty()).mapInPandas(read, f"chunk binary, {counted}"), "lines")
    tallies = cut(_tallies(pages), "words")
    w, n, lines = _words_of(tallies)
    first = Table(w, word_weights(n[0] + n[2], n[1] + n[3], (lines[0] + lines[2], lines[1] + lines[3])))
    carried = sc.broadcast(first)

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["chunk"]:
                c = Chunk.loads(b)
                heavy = c.heavy(carried.value)
                for label, sign in ((True, 1), (False, -1)):
                    w, k, n = c.tally(heavy, np.full(len(heavy), label), sign)
                    if not len(w):
                        continue
                    yield pd.DataFrame({"w": [w], "c": [k], "n": [n]})

    w, n, lines = _words_of(tallies.unionByName(_tallies(pages.select("chunk").mapInPandas(carry, counted))).groupBy("w").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in range(4))))
    weights = Table(w, word_weights(n[0] + n[2], n[1] + n[3], (lines[0] + lines[2], lines[1] + lines[3])))
    # A line's own label is not to weigh its words: each half of the pages is weighed by the other half's.
    halves = sc.broadcast(Table(w, np.stack([word_weights(n[2 * k], n[2 * k + 1], (lines[2 * k], lines[2 * k + 1])) for k in (1, 0)], axis=1)))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held = np.zeros((N_FEATURES, 1 << 16), dtype=np.int64), []
        n = positive = 0

        def count() -> None:
            if held:
                codes = np.concatenate(held)
                for f in range(N_FEATURES):
                    seen[f] += np.bincount(codes[:, f], minlength=1 << 16)
                held.clear()

        for pdf in batches:
            for b in pdf["chunk"]:
                c = Chunk.loads(b)
                y = c.bad | c.heavy(carried.value)
                ws = halves.value.of(c.vocab)
                codes = code_of(c.weighed(ws[c.words, np.repeat(c.line(c.half), c.per_line)]))
                own = c.line(c.counts)
                if not own.any():
                    continue
                codes, y = codes[own], y[own]
                hashes = np.array([xxhash.xxh32_intdigest(slug) for slug in c.slugs], dtype=np.uint32)
                salt = (c.line(hashes) + c.nos.astype(np.uint32) * np.uint32(2654435761))[own]
                held.append(codes)
                if sum(map(len, held)) > 100_000:
                    count()
                n, positive = n + len(y), positive + int(y.sum())
                yield pd.DataFrame({"slug": [min(c.slugs)], "x": [codes.tobytes()], "y": [y.tobytes()], "salt": [salt.tobytes()], "k": [None], "n": [None]})
        count()
        if n:
            f, code = np.nonzero(seen)
            yield pd.DataFrame({"slug": [None], "x": [None], "y": [None], "salt": [None], "k": [np.append(f << 16 | code, [-1, -2])], "n": [np.append(seen[f, code], [n, positive])]})

    rows = cut(pages.select("chunk").mapInPandas(weigh, "slug string, x binary, y binary, salt binary, k array<bigint>, n array<bigint>"), "rows")
    k, n = _arrays(rows.where("slug is null").select(F.explode(F.arrays_zip("k", "n")).alias("x")).groupBy("x.k").agg(F.sum("x.n").alias("n")))
    order = np.argsort(k)
    k, n = k[order], n[order]
    total = dict(zip(k[k < 0].tolist(), n[k < 0].tolist()))
    edges = []
    for f in range(N_FEATURES):
        own = k >> 16 == f
        edges.append(edges_of(value_of((k[own] & 0xFFFF).astype(np.uint16)), n[own], bins))
    trees = fit_rows(rows.where("slug is not null").select("slug", "x", "y", "salt"), edges, total.get(-1, 0), total.get(-2, 0), **how)
    return Model(trees, templates, weights), pages.select("chunk")


def boilerplate_lines(articles: DataFrame, provenance: DataFrame, trees: Trees | Model | None = None) -> DataFrame:
    """(slug, line_no) of every line that isn't the page's own content, by the trees that are given or by what all pages tell.
    Texts stay where they are read; what is learned from them is shuffled as counts, and as one byte a feature."""
    sc = articles.sparkSession.sparkContext
    if trees is None:
        model, pages = fit(articles, provenance)
        shared = sc.broadcast(model)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for b in pdf["chunk"]:
                    yield shared.value.gone(Chunk.loads(b))

        return pages.mapInPandas(judge, "slug string, line_no bigint").distinct()
    given = sc.broadcast(Model(trees) if isinstance(trees, Trees) else trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks(batches, Templates(given.value.templates)):
            yield given.value.gone(c)

    return _pages(articles).mapInPandas(run, "slug string, line_no bigint").distinct()


def main_bodies(articles: DataFrame, provenance: DataFrame, trees: Trees | Model | None = None) -> DataFrame:
    """slug, body with its own lines only."""
    gone = boilerplate_lines(articles, provenance, trees).groupBy("slug").agg(F.collect_set(F.col("line_no").cast("int")).alias("nos"))
    one = articles.where("slug is not null").select("slug", "body").dropDuplicates(["slug"])
    kept = F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("nos", i))
    return one.join(gone, "slug", "left").select("slug", F.when(F.col("nos").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("body"))
