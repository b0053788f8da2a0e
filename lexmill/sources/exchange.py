"""JSON, CSV and packed payloads in and out, and the archive's capture index as a data source."""

from __future__ import annotations

import base64
import gzip
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StringType, StructType


def read_json_document(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of an array in one JSON document."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(field))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Names of all seasons' CSV files, each once."""
    cols = "full_name string, player_name string, first_name string, last_name string, football_name string"
    return spark.read.schema(cols).option("header", True).option("enforceSchema", False).csv(path).distinct()


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines.  They are written aside and put in the old ones' place when the job has committed, so a failed job
    leaves the old files; between two renames, and not longer, there is neither."""
    spark = df.sparkSession
    aside, before = (f"{path.rstrip('/')}.{x}-{uuid.uuid4().hex}" for x in ("new", "old"))
    df.write.option("ignoreNullFields", False).json(aside)
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(of(path)):
        fs.rename(of(path), of(before))
    if not fs.rename(of(aside), of(path)):
        raise OSError(f"{aside} can't be moved to {path}")
    fs.delete(of(before), True)


def json_for_page(c: Column) -> Column:
    """JSON text that can stand in a page: '<' escaped."""
    return F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))


def pack(value: object) -> str:
    """A value as JSON, gzipped without a time stamp and in base64: the same bytes for the same value."""
    return base64.b64encode(gzip.compress(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode(), mtime=0)).decode()


def unpack(text: str) -> object:
    return json.loads(gzip.decompress(base64.b64decode(text)))


@F.pandas_udf(StringType())
def packed(s: pd.Series) -> pd.Series:
    """Texts gzipped and in base64, stable."""
    return s.map(lambda x: None if x is None else base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode())


@F.pandas_udf(StringType())
def unpacked(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else gzip.decompress(base64.b64decode(x)).decode())


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CaptureReader(DataSourceReader):
    """Reads JSON arrays of [timestamp, original, statuscode] with a header row; an equality on statuscode is applied here.

    Options as of the archive's own index: match, a pattern that the whole of original fits; collapse, a number of digits of
    the timestamp: of rows of one address that agree in them only the first in its file is given."""

    def __init__(self, options: dict):
        self.paths, self.status = options["path"].split(","), None
        self.match, self.collapse = options.get("match"), int(options.get("collapse", 0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("statuscode",):
                self.status = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path) as f:
            rows = json.load(f)
        head = rows[0] if rows else []
        at = [head.index(c) if c in head else None for c in ("timestamp", "original", "statuscode")]
        fits = re.compile(self.match).fullmatch if self.match else None
        seen: set[tuple] = set()
        for r in rows[1:]:
            out = tuple(r[i] if i is not None and i < len(r) else None for i in at)
            if self.status is not None and out[2] != self.status or fits and not fits(out[1] or ""):
                continue
            if self.collapse:
                if (key := (out[1], (out[0] or "")[: self.collapse])) in seen:
                    continue
                seen.add(key)
            yield out


class CaptureIndex(DataSource):
    """spark.read.format('capture_index').load('a.json,b.json'): saved answers of an archive's capture index."""

    @classmethod
    def name(cls) -> str:
        return "capture_index"

    def schema(self) -> str:
        return "timestamp string, original string, statuscode string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(dict(self.options))
