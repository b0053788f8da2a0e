"""Mixing sources to target weights (problem 8): capped water-filling.

Sizes are tokens of a public byte-level BPE.  A source that would need more than its maximum of repetitions is clamped
there, its missing weight goes to the others in proportion to their targets, and so on until nothing exceeds its cap.  A
source's allocation is then epochs: every document is taken the whole number of times, and a seeded choice of documents
once more for the fraction.  The choice goes by a hash of seed and document: hash buckets whose token sums are known fill
the fraction, the bucket in which it ends is filled document by document in hash order, so the share is met within one
document whatever the source's size, and no task ever holds a source.

Documents of a source that is null or has no target are not in the mix; null texts have no tokens and are left out; a
document id that is delivered again counts once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import widen

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Counts tokens; pieces of text recur, so each distinct piece is encoded once while it is held."""

    def __init__(self, path: str = VOCABULARY, held: int = 400_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.find, self.held, self.known = regex.compile(PATTERN).findall, held, {}

    def count(self, text: str) -> int:
        known, n = self.known, 0
        for piece in self.find(text):
            k = known.get(piece)
            if k is None:
                if len(known) >= self.held:
                    known.clear()
                k = known[piece] = len(self.encoding.encode_ordinary(piece))
            n += k
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [counter.count(t) for t in pdf["text"]]})

    src = docs.select("doc_id", "source", "text").where("doc_id is not null and source is not null and text is not null")
    return widen(src).mapInPandas(run, "doc_id bigint, source string, tokens bigint")


def water_fill(targets: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens per source: shares of the budget, clamped at the caps, the excess shared out in proportion."""
    alloc = {s: 0.0 for s in targets}
    free = {s for s, t in targets.items() if t > 0 and caps.get(s, 0) > 0}
    left = budget
    while free:
        weight = sum(targets[s] for s in free)
        full = {s for s in free if targets[s] / weight * left >= caps[s]}
        if not full:
            for s in free:
                alloc[s] = targets[s] / weight * left
            break
        for s in full:
            alloc[s] = caps[s]
        left -= sum(caps[s] for s in full)
        free -= full
    return alloc


def _bucketed(counts: DataFrame, seed: int, buckets: int) -> DataFrame:
    h = F.xxhash64(F.lit(seed), "doc_id")
    return counts.withColumn("h", h).withColumn("bucket", F.pmod(h, F.lit(buckets)).cast("int"))


def plan_mix(counts: DataFrame, targets: DataFrame, budget: float | None, seed: int, buckets: int = 1024) -> list[dict]:
    """One entry per source of targets: available and allotted tokens, whole repetitions, and where the fraction ends.

    Only sums by source and hash bucket come to the driver (sources x buckets numbers)."""
    want = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect() if r.source is not None}
    sums: dict[str, dict[int, int]] = {s: {} for s in want}
    wanted = F.broadcast(targets.select("source").distinct())  # one row per source
    for r in _bucketed(counts, seed, buckets).join(wanted, "source", "left_semi").groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).collect():
        sums[r.source][r.bucket] = int(r.n)
    have = {s: sum(b.values()) for s, b in sums.items()}
    budget = float(sum(have.values())) if budget is None else float(budget)
    alloc = water_fill({s: t for s, (t, _) in want.items()}, {s: have[s] * want[s][1] for s in want}, budget)
    plan = []
    for s in sorted(want):
        whole, rest, cut, room = 0, 0.0, 0, 0.0
        if have[s]:
            whole = int(alloc[s] / have[s] + 1e-12)
            rest = max(0.0, alloc[s] - whole * have[s])
            room = rest
            while cut < buckets and room >= sums[s].get(cut, 0):
                room -= sums[s].get(cut, 0)
                cut += 1
        plan.append({"source": s, "target_share": want[s][0], "max_repeats": want[s][1], "available": have[s], "allotted": float(alloc[s]), "whole": whole, "cut": cut, "room": float(room)})
    return plan


_PLAN = "source string, target_share double, max_repeats int, available bigint, allotted double, whole int, cut int, room double"


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7, buckets: int = 1024, vocabulary: str = VOCABULARY, cut=None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).  mix: doc_id, source, tokens, copies for documents that are in it.  shares: one row per source of
    targets with what it should give and what it really gives.  budget: total tokens; all available tokens if None.
    cut writes the token counts once (they are read three times)."""
    spark = docs.sparkSession
    once = docs.select("doc_id", "source", "text")
    counts = token_counts(once, vocabulary).groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")
    counts = cut(counts, "tokens") if cut else counts
    plan = spark.createDataFrame([tuple(p.values()) for p in plan_mix(counts, targets, budget, seed, buckets)], _PLAN)
    b = _bucketed(counts, seed, buckets).join(F.broadcast(plan), "source")  # one row per source
    # Only the bucket in which a source's fraction ends is put in order: 1/buckets of its documents.
    edge = b.where("bucket = cut")
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", (run <= F.col("room")).cast("int"))
    rest = b.where("bucket <> cut").withColumn("extra", (F.col("bucket") < F.col("cut")).cast("int"))
    taken = edge.unionByName(rest).where("allotted > 0").withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.col("max_repeats"))).where("copies > 0")
    out = taken.select("doc_id", "source", "tokens", "copies")
    got = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.count("*").alias("documents"))
    shares = plan.join(got, "source", "left").fillna(0, ["mixed", "documents"])
    total = F.sum("mixed").over(Window.partitionBy(F.lit(1)))  # one row per source
    shares = shares.select("source", "target_share", "max_repeats", "available", "documents", F.col("mixed").alias("tokens"), F.when(F.col("available") > 0, F.col("mixed") / F.col("available")).alias("epochs"), F.when(total > 0, F.col("mixed") / total).otherwise(0.0).alias("actual_share"))
    return out, shares
