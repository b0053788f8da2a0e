"""Variant spellings of names (problem 3).

1. Every distinct spelling is read once: role and "by" dropped, "last, first" turned round; joint bylines, placeholders and
   addresses name nobody single.
2. Tokens meet in a prefix-filtered set-similarity join on their q-grams: the q-grams are ordered by rarity, only the rare
   prefix that a similar token must share is joined, lengths and edits are verified.  A token that is a small edit away
   from a commoner one is a misspelling of it: ratios decide, of spellings or of uses, never a number of either.
3. Spellings with one surname are told apart by their first names: nicknames (from the roster and a fixed list), initials
   and misspellings go to the person they fit, if there is just one.  Organisations go by their rare tokens and by acronyms.
4. A spelling stays with its entity if it is similar to the entity's commonest spelling by soft token similarity in which
   tokens weigh by rarity.

Null and empty values, and values that name two, give nothing.  A writer with a third of all rows is no hot spot:
nothing but distinct spellings, with their counts, is shuffled after the first, combining count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Q = 2
# Words that make a byline a role, an organisation or nobody.
ROLES = {"writer", "editor", "reporter", "correspondent", "columnist", "contributor", "analyst", "producer", "intern", "blogger", "author", "freelance", "freelancer"}
ORG_WORDS = {"staff", "press", "wire", "service", "services", "club", "news", "network", "media", "team", "desk", "bureau", "agency", "association", "sports", "group", "magazine", "editors", "crew", "fc", "league", "the", "of"}
GENERIC = {"the", "staff", "service", "services", "football", "club", "team", "desk", "of", "crew", "editors"}
PLACEHOLDERS = {"", "by", "no author name", "no author", "unknown", "n/a", "na", "none", "null", "nil", "admin", "administrator", "anonymous", "author", "tbd", "guest", "webmaster", "editor", "staff", "staff writer", "-", "--"}
ABBREVIATIONS = {"svc": "service", "assoc": "associated", "fc": "football club", "intl": "international", "natl": "national", "dept": "department", "assn": "association"}
NICKNAMES = {
    "alexander": "alex sandy xander", "alexandra": "alex sandra lexi", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny", "charles": "charlie chuck",
    "christopher": "chris topher kit", "daniel": "dan danny", "deborah": "deb debbie", "desmond": "des dez", "edward": "ed eddie ted ned", "elizabeth": "liz beth betsy eliza lizzie betty",
    "frederick": "fred freddie", "gabriel": "gabe", "gregory": "greg", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny",
    "joseph": "joe joey", "katherine": "kate kathy katie kat kit", "lawrence": "larry lars", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge", "mateo": "matt teo",
    "matthew": "matt matty", "michael": "mike mick mickey", "nicholas": "nick nico nik", "ophelia": "phelia", "patricia": "pat patty trish", "rebecca": "becca becky", "richard": "rich rick dick ricky",
    "robert": "rob bob bobby robbie", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie", "theodore": "theo ted teddy", "thomas": "tom tommy", "tobias": "toby tobi",
    "valentina": "val tina", "victoria": "vicky tori vic", "william": "bill will billy willie liam", "yusuf": "joe", "zachary": "zach zack zak",
}

_JOINT = re.compile(r"\s(?:and|und|et|y|with)\s|[&;/+]", re.I)
_ADDRESS = re.compile(r"://|www\.|@|\.(?:com|org|net|example)\b", re.I)


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def parse_byline(raw: str | None) -> tuple[str, str, str, str, list[str]] | None:
    """(kind, first, middle, last, tokens) of a byline that names one person ('person') or organisation ('org'), else None.

    first can be one letter; an acronym has kind 'acronym' and is its only token."""
    if raw is None or _ADDRESS.search(raw):
        return None
    s = " ".join(raw.split())
    if fold(s).strip(" .") in PLACEHOLDERS:
        return None
    s = re.sub(r"^(?:written |posted |story )?by[: ]+", "", s, flags=re.I)
    if fold(s) in PLACEHOLDERS or _JOINT.search(s):
        return None
    s = re.sub(r",(\w)\s", r"\1, ", s)  # a comma that slipped by one letter
    parts = [p.strip() for p in s.split(",") if p.strip()]
    while len(parts) > 1 and any(edits(w, r, 1) <= 1 for w in re.findall(r"[a-z]{5,}", fold(parts[-1])) for r in ROLES):
        parts.pop()
    if len(parts) > 2:
        return None
    if len(parts) == 2:
        if len(parts[0].split()) > 1 and len(parts[1].split()) > 1 and not set(re.findall(r"[a-z]+", fold(s))) & (ORG_WORDS - {"fc"}):
            return None  # two writers
        parts = [f"{parts[1]} {parts[0]}"] if len(parts[0].split()) == 1 else [" ".join(parts)]
    s = parts[0] if parts else ""
    compact = s.replace(".", "").replace(" ", "")
    if re.fullmatch(r"[A-Z]{2,6}", compact) and re.fullmatch(r"[A-Z]{2,6}|(?:[A-Z]\. ?)+[A-Z]?", s):
        return "acronym", "", "", "", [compact.lower()]
    words: list[str] = []
    for w in s.split():
        if re.fullmatch(r"(?:[A-Za-z]\.){2,}", w):  # F.C., J.R.
            words.append(w.replace(".", ""))
        else:
            words.append(w.strip(".,'\"“”’()[]*|-"))
    words = [w for w in words if w]
    low = [t for w in words for t in ABBREVIATIONS.get(fold(w), fold(w)).split()]
    if not low or not any(len(t) > 1 for t in low):
        return None
    slipped = len(words) > 2 and low[0] not in _KNOWN and any(len(t) > 3 and len(o) > 4 and edits(t, o, 1) <= 1 for t in low for o in ORG_WORDS)
    if set(low) & ORG_WORDS or len(words) > 4 or slipped:
        short = [w for w in words if re.fullmatch(r"[A-Z]{2,6}", w)]
        rest = [t for t in low if t not in GENERIC]
        if short and len(rest) == 1 and not s.isupper():
            return "acronym", "", "", "", [rest[0]]
        return "org", "", "", "", low
    if len(words) < 2:
        return "person", "", "", low[-1], low
    first, middle = fold(words[0]), "".join(fold(w)[:1] for w in words[1:-1])
    if len(first) == 2 and words[0].isupper() and (not s.isupper() or not re.search("[aeiouy]", first)) and first not in _KNOWN:
        first, middle = first[0], first[1] + middle
    return "person", first, middle, fold(words[-1]), low


_KNOWN = {x for f, n in NICKNAMES.items() for x in (f, *n.split())}


def edits(a: str, b: str, most: int = 2) -> int:
    """Edits between two tokens (insert, delete, replace, swap neighbours), most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most and min(row) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def allowed(n: int) -> int:
    """Edits that a token of n letters may be off."""
    return 0 if n < 4 else 1 if n < 7 else 2


def similar_tokens(tokens: DataFrame, cut: Callable) -> DataFrame:
    """tokens: token, spellings (count), uses (of all its spellings).  Result: token, canon -- the token it is a misspelling of.

    One edit needs a third more spellings, two need three times as many, or either ten times the uses.  A token goes to the
    nearest, then commonest such token, and with that one on to the end of the chain, however long.

    d edits change at most d * (Q + 1) q-grams (a swap changes Q + 1), so similar tokens share all but that many and thus
    one of the d * (Q + 1) + 1 rarest q-grams of either: only that prefix is joined."""

    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") + 3 - Q), lambda i: F.substring(F.concat(F.lit("^"), "token", F.lit("$")), i, Q)))
    base = tokens.where(F.length("token") >= 4).select("token", "spellings", "uses", F.explode(own).alias("g"))
    rarity = base.groupBy("g").agg(F.count("*").alias("df"))  # at most (letters + 2)^Q rows
    w = Window.partitionBy("token").orderBy("df", "g")
    keep = F.when(F.length("token") < 7, 1).otherwise(2) * (Q + 1) + 1
    prefix = base.join(rarity, "g").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    a, b = (prefix.select("g", F.col("token").alias(t), F.col("spellings").alias(f"n{t}"), F.col("uses").alias(f"u{t}")) for t in "ab")
    # Links go up in spellings, then uses, so they make no circle; which way a pair is linked doesn't matter to the result.
    commoner = F.struct("nb", "ub") > F.struct("na", "ua")
    many = F.greatest("ua", "ub") >= 10 * F.least("ua", "ub")
    near = (F.abs(F.length("a") - F.length("b")) <= 2) & commoner & (many | (3 * F.col("nb") >= 4 * F.col("na")))
    most = F.when(many | (F.col("nb") >= 3 * F.col("na")), 2).otherwise(1)
    pairs = a.join(b, "g").where(near).select("a", "b", "nb", most.alias("most")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, y, n, most in zip(pdf["a"], pdf["b"], pdf["nb"], pdf["most"]):
                m = min(allowed(min(len(x), len(y))), most)
                d = edits(x, y, m)
                if d <= m:
                    rows.append((x, y, d, n))
            yield pd.DataFrame(rows, columns=["token", "canon", "d", "n"])

    ok = pairs.mapInPandas(verify, "token string, canon string, d int, n bigint")
    link = cut(ok.groupBy("token").agg(F.min(F.struct("d", (-F.col("n")).alias("n"), "canon")).alias("best")).select("token", F.col("best.canon").alias("canon")), "links")
    while True:  # each round doubles the steps, so a chain takes as many rounds as its length has binary digits
        on = link.alias("x").join(link.alias("y"), F.col("x.canon") == F.col("y.token"), "left")
        link = cut(on.select("x.token", F.coalesce("y.canon", "x.canon").alias("canon"), F.col("y.canon").isNotNull().alias("moved")), "links")
        if link.where("moved").isEmpty():
            return link.select("token", "canon")
        link = link.select("token", "canon")


def formal_names(roster: DataFrame | None) -> dict[str, set[str]]:
    """Every known first name or nickname with the formal names it can stand for (a fixed list and the roster's pairs)."""
    out: dict[str, set[str]] = {}
    for f, ns in NICKNAMES.items():
        for n in (f, *ns.split()):
            out.setdefault(n, set()).add(f)
    if roster is not None:
        # Distinct pairs of given names: a vocabulary, bounded here by the roster's fixed size.
        for r in roster.select(F.lower("first_name").alias("f"), F.lower("football_name").alias("n")).where("f is not null").distinct().collect():
            out.setdefault(r.f, set()).add(r.f)
            if r.n and r.n != r.f:
                out.setdefault(r.n, set()).add(r.f)
    for f in list(out):
        if f in out[f]:
            out[f] = {f}
    return out


def resolve_firsts(forms: list[tuple[str, str, int]], known: dict[str, set[str]]) -> list[str]:
    """For the (first, middle, spellings) of one surname the formal first name each stands for; '' where that is open."""
    full = {f for f, _, _ in forms if len(f) > 1}
    people = {next(iter(known[f])) for f in full if f in known and len(known[f]) == 1}
    strong: dict[str, int] = {}
    for f, _, n in forms:
        strong[f] = strong.get(f, 0) + n
    got: dict[str, str] = {}
    unknown = []
    for f in sorted(full):
        if f in known:
            fits = known[f] & people or known[f]
            got[f] = next(iter(fits)) if len(fits) == 1 else min(fits) if not known[f] & people else ""
        else:
            unknown.append(f)
    # What this surname's people are called, by any of their names.
    called: dict[str, set[str]] = {}
    for n, fs in known.items():
        for f in fs & people:
            called.setdefault(n, set()).add(f)
    for f, g in got.items():
        if g:
            called.setdefault(f, set()).add(g)
    for f in sorted(unknown, key=lambda f: (-strong[f], f)):
        best, whose = 9, set()
        for n, fs in called.items():
            d = edits(f, n, 2)
            if d <= (1 if max(len(f), len(n)) < 7 else 2) and d <= best:
                whose = fs if d < best else whose | fs
                best = d
        if len(whose) == 1:
            got[f] = next(iter(whose))
        elif not whose:
            got[f] = f
            called.setdefault(f, set()).add(f)
        else:
            got[f] = ""
    everyone = {g for g in got.values() if g}
    middles: dict[str, set[str]] = {}
    for f, m, _ in forms:
        if len(f) > 1 and got[f] and m:
            middles.setdefault(got[f], set()).add(m[:1])
    out = []
    for f, m, _ in forms:
        if len(f) > 1:
            out.append(got[f])
            continue
        fits = {g for g in everyone if g.startswith(f)}
        if len(fits) > 1 and m:
            fits = {g for g in fits if m[:1] in middles.get(g, ())} or fits
        out.append(next(iter(fits)) if len(fits) == 1 else (f if f and not fits else ""))
    return out


def soft_similarity(a: list[str], b: list[str], weight: dict[str, float], known: dict[str, set[str]], called: dict[str, set[str]]) -> float:
    """Weight of the tokens of a and b that have a like one on the other side, as a share of all weight."""

    def aliases(x: str) -> set[str]:
        return {x} | {n for f in known.get(x, ()) for n in called.get(f, ())}

    def like(x: str, y: str) -> float:
        if x == y or known.get(x, {x}) & known.get(y, {y}):
            return 1.0
        ax, ay = aliases(x), aliases(y)
        if len(x) <= 2 or len(y) <= 2:
            return 0.8 if any(p[0] == q[0] for p in ax for q in ay) else 0.0
        best = 0.0
        for p, q in [(x, q) for q in ay] + [(p, y) for p in ax]:
            d = edits(p, q, 2)
            if d <= 2:
                best = max(best, 1 - d / max(len(p), len(q)))
        return best

    total = got = 0.0
    for xs, ys in ((a, b), (b, a)):
        for x in xs:
            w = weight.get(x, 1.0)
            best = max((like(x, y) for y in ys), default=0.0)
            total += w * (0.2 if len(x) == 1 and best == 0 else 1.0)
            got += w * best
    return got / total if total else 0.0


def entities(bylines: DataFrame, roster: DataFrame | None, cut, column: str = "byline_raw", least: float = 0.55) -> DataFrame:
    """value, entity, spelling count of the entity's commonest value: every spelling that names one person or organisation."""
    known = formal_names(roster)
    called: dict[str, set[str]] = {}
    for n, fs in known.items():
        for f in fs:
            called.setdefault(f, set()).add(n)
    values = bylines.select(F.col(column).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, n, *p) for v, n in zip(pdf["value"], pdf["n"]) if (p := parse_byline(v))]
            yield pd.DataFrame(rows, columns=["value", "n", "kind", "first", "middle", "last", "tokens"])

    read = cut(values.mapInPandas(parse, "value string, n bigint, kind string, first string, middle string, last string, tokens array<string>"), "bylines")
    lasts = read.where("kind = 'person'").groupBy(F.col("last").alias("token")).agg(F.count("*").alias("spellings"), F.sum("n").alias("uses"))
    orgs = read.where("kind = 'org'").select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("spellings"), F.sum("n").alias("uses"))
    link = similar_tokens(lasts, cut)
    people = read.where("kind = 'person'").join(link.withColumnRenamed("token", "last"), "last", "left").withColumn("surname", F.coalesce("canon", "last"))
    forms = people.groupBy("surname", "first", "middle").agg(F.count("*").alias("spellings"))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "middle"])
        return pdf.assign(formal=resolve_firsts(list(zip(pdf["first"], pdf["middle"], pdf["spellings"])), known))[["surname", "first", "middle", "formal"]]

    # A group is one surname's distinct first names and initials, not its rows or spellings.
    formal = forms.groupBy("surname").applyInPandas(resolve, "surname string, first string, middle string, formal string").where("formal <> ''")
    named = people.join(formal, ["surname", "first", "middle"]).select("value", "n", "tokens", F.concat_ws("|", F.lit("p"), "surname", "formal").alias("entity"))

    org_link = similar_tokens(orgs, cut)
    generic = F.array(*[F.lit(g) for g in sorted(GENERIC)])
    words = read.where("kind = 'org'").select("value", "n", "tokens", F.posexplode("tokens").alias("at", "token")).join(org_link, "token", "left")
    whole = words.groupBy("value").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canon", "token").alias("t")))), lambda x: x["t"]).alias("canon"))
    core = F.filter("canon", lambda t: ~F.array_contains(generic, t))
    org = whole.withColumn("core", core).where(F.size("core") > 0).withColumn("entity", F.concat_ws("|", F.lit("o"), F.array_join("core", " ")))
    lead = F.when(F.get("canon", F.lit(0)) == "the", F.slice("canon", 2, 99)).otherwise(F.col("canon"))
    letters = lambda a: F.array_join(F.transform(a, lambda t: F.substring(t, 1, 1)), "")
    acronyms = org.select("entity", "n", F.explode(F.array(letters(lead), letters(F.filter(lead, lambda t: t != "staff")), letters("core"))).alias("token")).where(F.length("token") > 1)
    acronyms = acronyms.groupBy("token").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where("entity = other")
    # An organisation whose core is a part of exactly one longer one's, from the start, is that one.
    short = read.where("kind = 'acronym'").select("value", "n", "tokens", F.get("tokens", F.lit(0)).alias("token")).join(acronyms, "token").select("value", "n", "tokens", "entity")
    every = cut(named.unionByName(org.select("value", "n", "tokens", "entity")), "entities")

    rare = read.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    total = read.count()
    head = every.groupBy("entity").agg(F.max(F.struct("n", "tokens")).alias("h")).select("entity", F.col("h.tokens").alias("head"))
    both = every.join(head, "entity")
    need = both.select("value", "entity", F.explode(F.array_distinct(F.concat("tokens", "head"))).alias("t")).join(rare, "t").groupBy("value", "entity").agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("counts"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b, c in zip(pdf["tokens"], pdf["head"], pdf["counts"]):
                weight = {t: math.log(1 + total / n) for t, n in dict(c).items()}
                keep.append(soft_similarity(list(a), list(b), weight, known, called) >= least)
            yield pdf.loc[keep, ["value", "entity"]]

    held = both.join(need, ["value", "entity"]).select("value", "entity", "tokens", "head", "counts").mapInPandas(check, "value string, entity string")
    return held.unionByName(short.select("value", "entity")).distinct()


def same_name_pairs(found: DataFrame) -> DataFrame:
    """(byline_a, byline_b) for all two spellings of one entity, the smaller first."""
    a = found.select("entity", F.col("value").alias("byline_a"))
    b = found.select("entity", F.col("value").alias("byline_b"))
    return a.join(b, "entity").where("byline_a < byline_b").select("byline_a", "byline_b").distinct()
