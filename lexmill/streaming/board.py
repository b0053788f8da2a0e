"""Live status board over an append-only event history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """The history as a stream of files."""
    return spark.readStream.schema(schema).parquet(path)


def counts(events: DataFrame) -> DataFrame:
    """Counts by phase and outcome; complete output mode recomputes the board each time."""
    return events.groupBy("phase", "outcome").agg(F.count("*").alias("n"))


def changed_batches(target: str):
    """foreachBatch writer that skips a redraw when the board's content is the same as the last one's."""
    seen: dict[str, int] = {}

    def write(df: DataFrame, _: int) -> None:
        sign = df.agg(F.bit_xor(F.xxhash64(*df.columns)), F.count("*")).first()
        if seen.get("sign") != sign:
            seen["sign"] = sign
            df.write.mode("overwrite").json(target)

    return write


def run_once(board: DataFrame, target: str, checkpoint: str) -> None:
    """Everything that is there now, then stop; a later call resumes from the checkpoint."""
    q = board.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(changed_batches(target)).start()
    q.awaitTermination()


def audit_log(events: DataFrame, target: str, checkpoint: str):
    """Events appended to a JSON-lines log: time, event, ok, and the rest as a map."""
    rows = events.select(F.col("at").alias("time"), F.col("phase").alias("event"), (F.col("outcome") == "ok").alias("ok"), F.create_map(F.lit("url"), F.col("url")).alias("extra"))
    return rows.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
