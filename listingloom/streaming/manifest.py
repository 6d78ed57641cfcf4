"""The stream's source: one manifest line per complete snapshot.

A micro-batch is not a snapshot, so the stream does not read listings. It reads
small manifest files that name a landed snapshot and the moment it stands for.
An empty snapshot has a line too, and is a run like any other.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "run_no bigint, snapshot string, as_of bigint"


@dataclass(frozen=True)
class Entry:
    run_no: int
    snapshot: str
    as_of: int


def append(spark: SparkSession, path: str, entries: Iterable[Entry]) -> None:
    """Adds one manifest file holding the entries."""
    rows = spark.createDataFrame([astuple(e) for e in entries], MANIFEST)
    rows.coalesce(1).write.mode("append").json(path)


def read_snapshot(spark: SparkSession, entry: Entry, schema: str) -> DataFrame:
    """The rows of the snapshot that an entry names; an empty one may have no folder."""
    try:
        rows = spark.read.schema(schema).parquet(entry.snapshot)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MANIFEST)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)
