"""Text functions as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters that decompose into one ASCII letter and marks, and those letters; by rule, not by table."""
    a, b = [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFKD", chr(cp))
        base = "".join(c for c in d if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(cp) and not base.isspace():
            a.append(chr(cp))
            b.append(base)
    return "".join(a), "".join(b)


_FROM, _TO = _accents()


def fold_ascii(c: Column) -> Column:
    """Compatibility-decomposed text without marks; what isn't ASCII then is dropped (so curly quotes and dashes vanish)."""
    c = F.regexp_replace(F.regexp_replace(c, r"[  -  　]", " "), "…", "...")
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"[^\x00-\x7F]", "")


def normal_text(c: Column) -> Column:
    """Folded, lower-cased words with single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold_ascii(c)), r"[^a-z0-9]+", " "))


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions of the basic plane, by rule: of characters that become one base (with marks or without), and
    of those that become several.  Hangul syllables are left composed; their decomposition tells no two of them apart less."""
    one, many = {}, {}
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0)]:
        d = unicodedata.normalize("NFKD", chr(cp))
        if d != chr(cp):
            base = [c for c in d if not unicodedata.combining(c)]
            (one if len(base) == 1 and d[0] == base[0] else many)[chr(cp)] = d
    return one, many


_ONE, _MANY = _decompositions()
# Characters that are marked or become several go by private-use characters in two ranges, which one short pattern finds.
_MARKED = {c: chr(0xE000 + i) for i, c in enumerate(c for c, d in _ONE.items() if len(d) > 1)}
_SPELLED = {c: chr(0xE000 + len(_MARKED) + i) for i, c in enumerate(_MANY)}
_TO_PRIVATE = {**{c: d[0] for c, d in _ONE.items()}, **_MARKED, **_SPELLED}


def decomposed(c: Column) -> Column:
    """Compatibility decomposition, with one mark for all of a letter's: enough wherever marks are dropped or split words.

    Private-use characters become U+FFFD.  ASCII texts are left as they are."""
    t = F.regexp_replace(c, "[\ue000-\uf8ff]", "\ufffd")
    t = F.translate(t, "".join(_TO_PRIVATE), "".join(_TO_PRIVATE.values()))
    first, last = min(_SPELLED.values()), max(_SPELLED.values())
    spelled = F.array(*[F.lit(d) for d in _MANY.values()])
    whole = F.array_join(F.transform(F.split(t, ""), lambda x: F.when(x.between(first, last), F.get(spelled, F.ascii(x) - ord(first))).otherwise(x)), "")
    t = F.when(t.rlike(f"[{first}-{last}]"), whole).otherwise(t)
    t = F.regexp_replace(t, f"([\ue000-{max(_MARKED.values())}])", "$1\u0301")
    t = F.translate(t, "".join(_MARKED.values()), "".join(_ONE[x][0] for x in _MARKED))
    return F.when(c.rlike(r"[^\x00-\x7F]"), t).otherwise(c)


def fold_compatible(c: Column) -> Column:
    """ASCII of the decomposed text: ligatures and full-width letters are spelled out, what has no ASCII is dropped."""
    return F.regexp_replace(decomposed(c), r"[^\x00-\x7F]", "")


def normal_words(c: Column) -> Column:
    """``normal_text`` by the full decomposition."""
    return F.trim(F.regexp_replace(F.lower(fold_compatible(c)), r"[^a-z0-9]+", " "))


def index_tokens(c: Column) -> Column:
    """Distinct runs of letters or digits of the lower-cased, decomposed text: a mark splits a word."""
    return F.array_distinct(F.regexp_extract_all(F.lower(decomposed(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def plain_prose(c: Column) -> Column:
    """Markdown links as their text, addresses left out."""
    return F.regexp_replace(F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"https?://\S+", " ")


def canon(c: Column) -> Column:
    """For comparing quotations: quotes and dashes unified, other punctuation as space, squeezed, lower-cased."""
    c = F.translate(c, "‘’“”–—", "''\"\"--")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s'-]", " "), r"(?U)\s+", " ")))


def canon_markup(c: Column) -> Column:
    """canon after tags are stripped and the common entities unescaped."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return canon(c)


# What ends a sentence and what a token is.
SENTENCE = r"[.!?;:]+|\n+|\s--\s"
TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z]+)*"


def sentences(c: Column) -> Column:
    """array<array<string>>: case-preserving tokens of each sentence; sentences without tokens are left out."""
    folded = F.replace(fold_ascii(c), F.lit("`"), F.lit("'"))
    chunks = F.transform(F.split(folded, SENTENCE), lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)))
    return F.filter(chunks, lambda x: F.size(x) > 0)


def ngrams(tokens: Column, sizes: tuple[int, ...]) -> Column:
    """All n-grams of a token array, joined by spaces."""

    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def word_count(c: Column) -> Column:
    """Words between white space; 0 for empty text."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def search_tokens(c: Column) -> Column:
    """Distinct runs of letters or digits of the lower-cased text as it is; ``index_tokens`` decomposes it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


# Lines that are an author's or a house's promotion, given the name of the house's section.
def promo_pattern(section: str) -> str:
    return (
        r"(?im)^\s*(?:follow .{0,60}? on twitter.*|the latest (?:edition of )?.{0,4}?" + section + r" podcast.*|find more " + section
        + r" content.*|download the .{0,40}?podcast.*|listen to the episode.*|subscribe on .*)\s*$"
    )


# A line that announces statistics, and the arrows of navigation rows.
STAT_LINE = r"(?im)^\s*\d{4}\s+(?:stats|final ranking)\s*:.*$"
ARROWS = "[▶▷▹◀▸]"


def is_stat_row(line: Column) -> Column:
    """A row with two pipes or more of whose tokens over a quarter are numbers."""
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    tokens = F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0))
    numbers = F.size(F.filter(tokens, lambda t: t.rlike(r"^[\d,.\-]+$")))
    return (pipes >= 2) & (F.size(tokens) > 0) & (numbers > 0.25 * F.size(tokens))


def is_nav_row(line: Column) -> Column:
    s = F.trim(line)
    return s.startswith("- ") & (s.rlike(ARROWS) | (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2))


def strip_furniture(c: Column, section: str) -> Column:
    """Promotions, statistics and navigation rows taken out, every sentence kept."""
    c = F.regexp_replace(c, "(?d)" + promo_pattern(section), "")
    c = F.regexp_replace(c, "(?d)" + STAT_LINE, "")
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_nav_row(x) & ~is_stat_row(x)), "\n")


def drop_repeats(lines: Column) -> Column:
    """Lines without those equal to the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


def last_sentence(c: Column) -> Column:
    """The last sentence of the last paragraph that isn't blank, null if there is none."""
    paras = F.filter(F.split(F.trim(c), "\n"), lambda p: F.trim(p) != "")
    sents = F.filter(F.split(F.trim(F.element_at(paras, -1)), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return F.when(F.size(paras) > 0, F.element_at(sents, -1))
