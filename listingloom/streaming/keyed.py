"""New keys per run from keyed state, without rewriting a seen set.

The stream holds one row per key and run (copies collapse when it is landed), so
no key is hot. Of each key its last run is remembered; a run that does not follow it
directly makes the key new. The new keys then pick the full rows in a join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels with the query: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = "category string, id string, run_no bigint"
# Groups of keys that share a state: a bucket holds this part of what one run has.
BUCKETS = 1024


def land_keys(rows: DataFrame, path: str) -> None:
    """Appends the distinct (category, id, run_no) of a snapshot to the key feed."""
    rows.select("category", "id", "run_no").distinct().write.mode("append").parquet(path)


def read_keys(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The key feed as a stream; ``run_time`` is the run number as event time."""
    reader = spark.readStream.schema(KEYS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("run_time", F.timestamp_seconds("run_no"))


class LastRuns(StatefulProcessor):
    """State of a bucket of keys: the run each was last in. Old keys are dropped by a timer.

    A call to the state store costs far more than a key, so a bucket is read and written whole.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState(
            "held", "categories array<string>, ids array<string>, last_runs array<bigint>"
        )

    def _read(self) -> dict[tuple, int]:
        stored = self._held.get()
        if stored is None:
            return {}
        categories, ids, last_runs = stored
        return dict(zip(zip(categories, ids), last_runs))

    def _write(self, last_runs: dict[tuple, int], watermark: int) -> None:
        """A key absent for a whole run is new when it returns, stored or not."""
        kept = {key: last for key, last in last_runs.items() if (last + 2) * 1000 > watermark}
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if not kept:
            self._held.clear()
            return
        self._held.update(([c for c, _ in kept], [i for _, i in kept], list(kept.values())))
        self._handle.registerTimer((min(kept.values()) + 2) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs: dict[tuple, set[int]] = {}
        for frame in rows:
            texts = frame[["category", "id"]].astype(object)
            texts = texts.where(texts.notna(), None)
            for category, id, run_no in zip(texts["category"], texts["id"], frame["run_no"]):
                runs.setdefault((category, id), set()).add(int(run_no))
        last_runs, fresh = self._read(), []
        for one, numbers in runs.items():
            last = last_runs.get(one)
            for run_no in sorted(numbers):
                if last is None or last < run_no - 1:
                    fresh.append((*one, run_no))
                last = run_no if last is None else max(last, run_no)
            last_runs[one] = last
        self._write(last_runs, timerValues.getCurrentWatermarkInMs())
        if fresh:
            yield pd.DataFrame(fresh, columns=["category", "id", "run_no"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._write(self._read(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def fresh_keys(keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The (category, id, run_no) that are new in their run.

    Keys are dealt to ``buckets`` by their hash; a checkpoint keeps the number it began with.

    Run numbers count executed runs and arrive in order. The watermark trails by one
    run, as the files of one run may be spread over two batches.
    """
    return (
        keys.withWatermark("run_time", "1 second")
        .withColumn("bucket", F.pmod(F.xxhash64("category", "id"), F.lit(buckets)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=LastRuns(),
            outputStructType=KEYS,
            outputMode="append",
            timeMode="EventTime",
        )
    )
