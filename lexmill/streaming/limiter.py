"""Fixed-window rate limiter, in batch and as a stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


def windows(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """client, bucket, attempts, stored: refused attempts don't count up, so the stored counter is the limit at most."""
    g = requests.groupBy("client", bucket(F.col("ts"), seconds).alias("bucket")).agg(F.count("*").alias("attempts"))
    return g.withColumn("stored", F.least("attempts", F.lit(limit)).cast("bigint"))


def decisions(requests: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """key, allowed: the first ``limit`` requests of a client in a window are let through.

    The first ones are found by a ranked limit, which keeps no more than ``limit`` rows of a window in any task before the
    shuffle, so a client with a third of all requests is no hot spot."""
    w = Window.partitionBy("client", "bucket").orderBy("ts", key)
    ranked = requests.select(key, "client", "ts", bucket(F.col("ts"), seconds).alias("bucket")).withColumn("rank", F.row_number().over(w))
    first = ranked.where(F.col("rank") <= limit).select(key, F.lit(True).alias("allowed"))
    return requests.select(key).join(first, key, "left").select(key, F.coalesce("allowed", F.lit(False)).alias("allowed"))


def decide_stream(requests: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """The same decisions on a stream (client, ts): state is one counter per client and window, dropped when the watermark has
    passed the window's end.  Result: client, ts, allowed, stored."""
    keyed = requests.withWatermark("ts", late).withColumn("bucket", bucket(F.col("ts"), seconds))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts")
        allowed, stored = [], []
        for _ in range(len(rows)):
            ok = used < limit
            used += ok
            allowed.append(ok)
            stored.append(used)
        state.update((used,))
        end = (int(key[1]) + 1) * seconds * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "ts": rows["ts"].to_numpy(), "allowed": allowed, "stored": stored})

    return keyed.groupBy("client", "bucket").applyInPandasWithState(step, "client string, ts timestamp, allowed boolean, stored int", "used int", "append", "EventTimeTimeout")
