"""Sessions and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_CUT: list[str] = []


def get_session(name: str = "lexmill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where it is unset, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    d = getattr(shared_dir, "_own", None)
    if d is None:
        d = shared_dir._own = tempfile.mkdtemp(prefix="lexmill-")  # type: ignore[attr-defined]
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    return "file://" + d


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _CUT.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that were cut so far; to be called when the results that read them are written.  Returns how many."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _CUT:
        path = of(_CUT.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partitioned by columns into as many parts as the session shuffles into (at least one per core).  A number that is
    asked for isn't merged again at run time, so work that costs more than its bytes say keeps all cores busy."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def widen(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than cores, as of one small file, dealt out over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
