"""Versioned run tables: the seen set, new listings and the outbox of each run.

Nothing is overwritten while it is read: run N writes folders of its own and
becomes visible with its commit: ``read`` looks at committed, executed runs alone. A run
that failed is written again by its retry. One writer per ledger.

    <root>/seen/run=N      (category, id) of run N; replaces that of run N-1
    <root>/new/run=N       new listings in order
    <root>/outbox/run=N    deliveries
    <root>/commits/run=N   one row, written last
    <root>/checkpoints/upto=N  all commits up to run N in one file

A commit is looked for in the newest checkpoint and in the commits after it, so that a run opens at
most ``CHECKPOINT_EVERY`` + 1 files of them, however many runs there were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.operators.diff import all_ids
from listingloom.schema import SEEN
from listingloom.sources import folders

#: Commits that are gathered in one checkpoint.
CHECKPOINT_EVERY = 20

COMMIT = "run_no bigint, executed boolean, seen_run bigint"


@dataclass(frozen=True)
class Commit:
    """``seen_run`` is the run whose seen set counts after this one."""

    run_no: int
    executed: bool
    seen_run: int | None


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._since = 0  # commits since the newest checkpoint
        self._last = self._load_last()

    def path(self, table: str, run_no: int) -> str:
        return f"{self.root}/{table}/run={run_no}"

    def _load_last(self) -> Commit | None:
        self._since = len(self._commit_files()[1])
        row = self.commits().agg(F.max(F.struct("run_no", "executed", "seen_run")).alias("c")).first()
        return Commit(**row["c"].asDict()) if row["c"] else None

    @property
    def last(self) -> Commit | None:
        """The newest committed run."""
        return self._last

    def commits(self) -> DataFrame:
        """All commits, a row per run: the newest checkpoint and what came after it."""
        upto, tail = self._commit_files()
        paths = [self.path("commits", n) for n in tail]
        if upto is not None:
            paths.append(self._checkpoint(upto))
        if not paths:
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(paths)

    def _checkpoint(self, upto: int) -> str:
        return f"{self.root}/checkpoints/upto={upto}"

    def _checkpoints(self) -> list[int]:
        return folders.numbers(self.spark, f"{self.root}/checkpoints", "upto")

    def _commit_files(self) -> tuple[int | None, list[int]]:
        """The run of the newest complete checkpoint, and the runs committed after it."""
        complete = (n for n in reversed(self._checkpoints()) if folders.has_data(self.spark, self._checkpoint(n)))
        upto = next(complete, None)
        runs = folders.numbers(self.spark, f"{self.root}/commits", "run")
        return upto, [n for n in runs if upto is None or n > upto]

    def checkpoint(self) -> None:
        """Gathers all commits so far in one file. Commits stay where they are until a vacuum."""
        if self._last is not None:
            path = self._checkpoint(self._last.run_no)
            self.commits().coalesce(1).write.mode("overwrite").json(path)
            self._since = 0

    def vacuum(self, keep_runs: int = CHECKPOINT_EVERY) -> None:
        """Removes seen sets that no run to come compares with, and commits that a checkpoint holds.

        What the last ``keep_runs`` runs could read stays for readers that have begun: their seen
        sets with the one each of them started from, their commits, the newest checkpoint
        and the newest of those before them. New listings, cards, outboxes and statistics are the
        record of what was done and are never removed. To be called by the ledger's writer between
        runs; a vacuum that is ended half way is completed by the next.
        """
        if keep_runs < 1:
            raise ValueError("the last run is always kept")
        if self._last is None:
            return
        recent = self.commits().orderBy(F.desc("run_no")).limit(keep_runs + 1).collect()
        oldest = min(row["run_no"] for row in recent)
        needed = {row["seen_run"] for row in recent}
        for n in folders.numbers(self.spark, f"{self.root}/seen", "run"):
            # Later ones are of a run that is being written.
            if n not in needed and n < self._last.run_no:
                folders.remove(self.spark, self.path("seen", n))
        complete = [n for n in self._checkpoints() if folders.has_data(self.spark, self._checkpoint(n))]
        held = max((n for n in complete if n < oldest), default=None)
        if held is None:
            return
        for n in folders.numbers(self.spark, f"{self.root}/commits", "run"):
            if n <= held:
                folders.remove(self.spark, self.path("commits", n))
        for n in self._checkpoints():
            if n < held:
                folders.remove(self.spark, self._checkpoint(n))

    def is_done(self, run_no: int) -> bool:
        """Whether a run has a commit of its own.

        A run that comes after a later one was committed can't be fitted in, as the later one
        has been compared with what was there: it raises.
        """
        if self._last is None or run_no > self._last.run_no:
            return False
        if run_no == self._last.run_no or not self.commits().filter(F.col("run_no") == run_no).isEmpty():
            return True
        raise ValueError(f"run {run_no} is late: run {self._last.run_no} is already committed")

    def seen(self) -> DataFrame:
        """The seen set of the previous executed run; empty before the first."""
        if self._last is None or self._last.seen_run is None:
            return self.spark.createDataFrame([], SEEN)
        return self.spark.read.schema(SEEN).parquet(self.path("seen", self._last.seen_run))

    def replace_seen(self, run_no: int, current: DataFrame) -> None:
        """Replaces, never adds to, the seen set: ids that left the feed are forgotten."""
        self.write("seen", run_no, all_ids(current))

    def write(self, table: str, run_no: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.path(table, run_no))

    def write_runs(self, table: str, run_nos: list[int], rows: DataFrame) -> None:
        """The rows of several runs, told apart by ``run_no``, in one job; a folder for every run.

        A folder that an earlier attempt left is replaced, also by none: rows are dealt out by run,
        and a run that has many is shared among tasks.
        """
        if not run_nos:
            return
        stored = rows.withColumnRenamed("run_no", "run")
        empty = stored.drop("run").limit(0)
        held = {row["run"] for row in stored.select("run").distinct().toLocalIterator()}
        if not held <= set(run_nos):
            raise ValueError(f"rows of runs that aren't written: {sorted(held - set(run_nos))}")
        for run_no in sorted(set(run_nos) - held):
            self.write(table, run_no, empty)
        (
            stored.hint("rebalance", "run")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run")
            .parquet(f"{self.root}/{table}")
        )

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of all executed, committed runs of a table, with their run as ``run_no``.

        What a failed or a skipped run has left behind is not read: deliveries are drained
        from here, not from the folders.
        """
        try:
            rows = self.spark.read.schema(f"{schema}, run bigint").parquet(f"{self.root}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], f"{schema}, run_no bigint")
            raise
        executed = self.commits().filter("executed").select(F.col("run_no").alias("run"))
        return rows.join(executed, "run", "left_semi").select(
            *(c for c in rows.columns if c != "run"), F.col("run").alias("run_no")
        )

    def commit(self, run_no: int, executed: bool) -> None:
        """A skipped run carries the seen set forward untouched."""
        carried = self._last.seen_run if self._last else None
        done = Commit(run_no, executed, run_no if executed else carried)
        seen_run = "NULL" if done.seen_run is None else done.seen_run
        row = self.spark.range(0, 1, 1, 1).selectExpr(
            f"CAST({run_no} AS BIGINT) AS run_no",
            f"{str(executed).lower()} AS executed",
            f"CAST({seen_run} AS BIGINT) AS seen_run",
        )
        row.write.mode("overwrite").json(self.path("commits", run_no))
        self._last = done
        self._since += 1
        if self._since >= CHECKPOINT_EVERY:
            self.checkpoint()
