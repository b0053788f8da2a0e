"""Comparison of two corpora: counts, log-odds, nested and maximal phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.session import spread


def articles(df: DataFrame) -> DataFrame:
    """One row per slug; where deliveries differ the smallest value counts."""
    cols = [c for c in df.columns if c not in ("slug", "entities")]
    return spread(df.where("slug is not null"), "slug").groupBy("slug").agg(*[F.min(c).alias(c) for c in cols])


def sentence_tokens(corpus: DataFrame, key: str, body: str) -> DataFrame:
    """key, s (sentence number), tokens."""
    return corpus.select(key, F.posexplode(text.sentences(F.col(body))).alias("s", "tokens"))


def case_profile(sents: DataFrame, ratio: float = 0.70) -> DataFrame:
    """token, caps, total of tokens that are capitalised in more than ``ratio`` of their uses inside sentences."""
    inner = sents.select(F.explode(F.slice("tokens", 2, 1_000_000)).alias("t"))
    n = inner.groupBy(F.lower("t").alias("token")).agg(F.sum(F.when(F.substring("t", 1, 1).rlike("[A-Z]"), 1).otherwise(0)).alias("caps"), F.count("*").alias("total"))
    return n.where(F.col("caps") > ratio * F.col("total"))


def runs(sents: DataFrame, key: str, proper: DataFrame | None = None) -> DataFrame:
    """key, s, run, tokens: lower-cased stretches of a sentence between dropped tokens (proper nouns and bare years, which
    break the run), or whole sentences without ``proper``."""
    if proper is None:
        return sents.select(key, "s", F.lit(0).alias("run"), F.transform("tokens", lambda t: F.lower(t)).alias("tokens"))
    tok = sents.select(key, "s", F.posexplode("tokens").alias("pos", "t")).withColumn("token", F.lower("t"))
    marked = tok.join(proper.select("token", F.lit(True).alias("is_proper")), "token", "left")
    gone = F.coalesce("is_proper", F.lit(False)) | F.col("token").rlike(r"^(?:19|20)\d{2}$")
    w = Window.partitionBy(key, "s").orderBy("pos")
    islands = marked.withColumn("gone", gone).withColumn("run", F.sum(F.col("gone").cast("int")).over(w)).where("not gone")
    return islands.groupBy(key, "s", F.col("run").cast("int").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def term_counts(run_rows: DataFrame, key: str, side: str, sizes: tuple[int, ...]) -> DataFrame:
    """term, side, tf, df: occurrences and documents per side, in one pass with map-side combining."""
    grams = run_rows.select(side, key, F.explode(text.ngrams(F.col("tokens"), sizes)).alias("term"))
    per_doc = grams.groupBy(side, key, "term").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term", side).agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def document_grams(body: Column, sizes: tuple[int, ...]) -> Column:
    """All n-grams of a text's sentences in one array."""
    lowered = F.transform(text.sentences(body), lambda s: F.transform(s, lambda t: F.lower(t)))
    return F.flatten(F.transform(lowered, lambda s: text.ngrams(s, sizes)))


def whole_term_counts(docs: DataFrame, side: list[str], body: str, sizes: tuple[int, ...]) -> DataFrame:
    """``term_counts`` of one row per document where no token breaks a sentence: term, side, tf, df.

    What a document holds is made distinct inside its row, so occurrences and documents are both counted by one shuffle, that
    of terms already combined; no pair of document and term is ever shuffled."""
    g = docs.where(F.col(body).isNotNull()).select(*side, document_grams(F.col(body), sizes).alias("g"))
    tag = lambda a, once: F.transform(a, lambda t: F.struct(t.alias("term"), F.lit(once).alias("once")))
    rows = g.select(*side, F.inline(F.concat(tag("g", False), tag(F.array_distinct("g"), True))))
    return rows.groupBy("term", *side).agg(F.count_if(~F.col("once")).alias("tf"), F.count_if("once").alias("df"))


def document_counts(docs: DataFrame, body: str, sizes: tuple[int, ...]) -> DataFrame:
    """term, df: in how many documents (one row each) every n-gram stands."""
    g = docs.where(F.col(body).isNotNull()).select(F.explode(F.array_distinct(document_grams(F.col(body), sizes))).alias("term"))
    return g.groupBy("term").agg(F.count("*").alias("df"))


def log_odds(counts: DataFrame, measure: str = "df", least: int = 3) -> DataFrame:
    """counts: term, side ('target' or 'control'), tf, df.  term, n_target, n_control, df, z of terms in ``least`` target
    documents: log-odds with the pooled corpus as prior, over its standard deviation.  A vocabulary of one term has z 0."""
    wide = counts.groupBy("term").agg(
        F.sum(F.when(F.col("side") == "target", F.col(measure)).otherwise(0)).alias("yt"),
        F.sum(F.when(F.col("side") == "control", F.col(measure)).otherwise(0)).alias("yc"),
        F.sum(F.when(F.col("side") == "target", F.col("df")).otherwise(0)).alias("df"),
    )
    vocab = wide.where(F.col("df") >= least)
    totals = vocab.agg(F.sum("yt").alias("nt"), F.sum("yc").alias("nc"))
    x = vocab.crossJoin(F.broadcast(totals))  # one row
    at, ac = 2 * F.col("yt") + F.col("yc"), F.col("yt") + 2 * F.col("yc")
    rest_t, rest_c = 2 * F.col("nt") + F.col("nc") - at, F.col("nt") + 2 * F.col("nc") - ac
    delta = F.ln(at / F.when(rest_t > 0, rest_t)) - F.ln(ac / F.when(rest_c > 0, rest_c))
    z = delta / F.sqrt(1 / at + 1 / ac)
    return x.select("term", F.col("yt").alias("n_target"), F.col("yc").alias("n_control"), "df", F.coalesce(z, F.lit(0.0)).alias("z"))


def collapse_nested(scored: DataFrame, share: float = 0.8, strict: bool = False) -> DataFrame:
    """Terms left after those are dropped that are part of a longer term covering more than ``share`` of their documents
    (documents of the longer are documents of the part, so the overlap is the ratio of counts)."""
    longer = scored.where(F.contains("term", F.lit(" "))).select(F.col("df").alias("wdf"), F.col("z").alias("wz"), F.split("term", " ").alias("w"))
    parts = longer.select("wdf", "wz", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))).alias("term"))
    hit = parts.join(scored.select("term", "df", "z"), "term").where(F.col("wdf") > share * F.col("df"))
    if strict:
        hit = hit.where(F.col("z") < F.col("wz"))
    return scored.join(hit.select("term").distinct(), "term", "left_anti")


def maximal_phrases(terms: DataFrame, run_rows: DataFrame, key: str, cut: Callable, share: float = 0.8, limit: int = 12) -> DataFrame:
    """Each term grown, first to the right, then to the left, by its commonest next token (ties: the smaller) while the grown
    phrase still covers more than ``share`` of the term's documents; up to ``limit`` tokens.

    terms: term, z, df.  Result: phrase, term, z, df -- of the best-scoring term that grows into the phrase.
    Occurrences stay rows and every round is a join and counts that combine; the lineage is cut each round."""
    tokens = cut(run_rows.select(key, "s", "run", F.posexplode("tokens").alias("pos", "token")), "tokens")
    sizes = terms.select(F.size(F.split("term", " ")).alias("n")).distinct()
    lens = sorted(r.n for r in sizes.collect())
    spots = None
    for n in lens:
        own = terms.where(F.size(F.split("term", " ")) == n).select("term")
        at = run_rows.where(F.size("tokens") >= n).select(key, "s", "run", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), lambda i: F.array_join(F.slice("tokens", i, n), " "))).alias("a", "term"))
        part = at.join(own, "term").select("term", key, "s", "run", "a", (F.col("a") + n - 1).alias("b"))
        spots = part if spots is None else spots.unionByName(part)
    base = terms.select("term", F.col("df").alias("base"))
    for left in (False, True):
        stages = [cut(spots, "spots")]
        while True:
            active = stages[-1].where(F.col("b") - F.col("a") + 1 < limit)
            step = active.withColumn("pos", F.col("a") - 1 if left else F.col("b") + 1).join(tokens, [key, "s", "run", "pos"])
            seen = step.groupBy("term", "token").agg(F.count("*").alias("n"))
            best = seen.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("x")).select("term", F.col("x.token").alias("token"))
            kept = step.join(best, ["term", "token"])
            docs = kept.select("term", key).distinct().groupBy("term").agg(F.count("*").alias("docs"))
            grow = docs.join(base, "term").where(F.col("docs") > share * F.col("base")).select("term")
            grown = cut(kept.join(grow, "term").select("term", key, "s", "run", F.col("pos").alias("a") if left else F.col("a"), F.col("b") if left else F.col("pos").alias("b")), "grown")
            if grown.isEmpty():
                break
            stages.append(grown)
        spots = stages[-1]
        for before, after in zip(stages, stages[1:]):
            spots = spots.unionByName(before.join(after.select("term").distinct(), "term", "left_anti"))
    # Any one occurrence spells the phrase.
    one = spots.groupBy("term").agg(F.min(F.struct(key, "s", "run", "a", "b")).alias("x")).select("term", f"x.{key}", "x.s", "x.run", "x.a", "x.b")
    spelled = one.join(run_rows, [key, "s", "run"]).select("term", F.array_join(F.slice("tokens", F.col("a") + 1, F.col("b") - F.col("a") + 1), " ").alias("phrase"))
    best_first = Window.partitionBy("phrase").orderBy(F.desc("z"), "term")
    out = spelled.join(terms.select("term", "z", "df"), "term")
    return out.withColumn("rn", F.row_number().over(best_first)).where("rn = 1").select("phrase", "term", "z", "df")


def ranked_phrases(ranked: DataFrame, run_rows: DataFrame, key: str, cut: Callable, pool: int = 600) -> DataFrame:
    """The whole ranking with the phrases of its head: the ``pool`` best terms are grown, the others stay as they are, less
    those that spell a phrase of the head.  ranked: term, z, df.  Result: phrase, term, z, df."""
    ranked = cut(ranked.select("term", "z", "df"), "ranked")
    head = cut(ranked.orderBy(F.desc("z"), "term").limit(pool), "pool")
    grown = cut(maximal_phrases(head, run_rows, key, cut), "phrases")
    tail = ranked.join(head.select("term"), "term", "left_anti").join(grown.select(F.col("phrase").alias("term")), "term", "left_anti")
    return grown.unionByName(tail.withColumn("phrase", F.col("term")))
