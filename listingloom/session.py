"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates are shown in UTC, whatever zone the driver runs in.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a JSON object: the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Hot keys are split at run time, also where the split costs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Methods above 8000 bytes are never compiled by the JVM's JIT: let such stages use
    # split projections instead of one long interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Keyed streaming state outgrows executor heaps.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the engine's runtime settings; sizing is left to the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run within are removed when it ends.

    Otherwise they stay until the driver's garbage collector finds their frames. For frames that
    are built and run once within.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="listingloom-")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder of the session.

    That is the one named by ``spark.checkpoint.dir``, or else the context's checkpoint folder.
    Where neither is set a folder of this machine is used, but only if all work is done by this
    process: executors elsewhere would each write to a disk of their own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("no shared folder is named: set spark.checkpoint.dir")
        root = _local_root()
    return f"{root.rstrip('/')}/listingloom/{purpose}-{uuid.uuid4().hex}"
