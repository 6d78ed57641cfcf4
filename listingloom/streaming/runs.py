"""Runs driven by a stream of manifest entries, with the seen set as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listingloom.operators import diff, replay
from listingloom.plans.runs import gated_run
from listingloom.sources.ledger import Ledger
from listingloom.sources.params import RunParams, checked_interval
from listingloom.streaming.manifest import Entry

# What a run does with one entry; it commits the run in the ledger.
Run = Callable[[Ledger, Entry], None]
# The same for all entries of a batch, which come in run order.
BatchRun = Callable[[Ledger, list[Entry]], None]


def start_runs(
    manifest: DataFrame,
    ledger: Ledger,
    run: Run,
    checkpoint: str,
    interval_hours: float | None = None,
) -> StreamingQuery:
    """Starts the stream: every ``interval_hours``, or once over what is there.

    Entries of a batch are executed in run order. The few manifest rows are the only
    data the driver sees. A batch that is tried again skips the runs it committed,
    so outbox and seen set are written exactly once per run.
    """

    def each(ledger: Ledger, due: list[Entry]) -> None:
        for entry in due:
            run(ledger, entry)

    return start_catch_up(manifest, ledger, each, checkpoint, interval_hours)


def start_catch_up(
    manifest: DataFrame,
    ledger: Ledger,
    run_batch: BatchRun,
    checkpoint: str,
    interval_hours: float | None = None,
) -> StreamingQuery:
    """As :func:`start_runs`, but the runs of a batch that aren't committed are executed together."""

    def execute(batch: DataFrame, _batch_id: int) -> None:
        # A run that is listed twice counts once.
        rows = batch.dropDuplicates(["run_no"]).orderBy("run_no").toLocalIterator()
        due = [Entry(**row.asDict()) for row in rows if not ledger.is_done(row["run_no"])]
        if due:
            run_batch(ledger, due)

    writer = manifest.writeStream.foreachBatch(execute).option("checkpointLocation", checkpoint)
    if interval_hours is None:
        return writer.trigger(availableNow=True).start()
    seconds = round(checked_interval(interval_hours) * 3600)
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def listing_run(
    read_listings: Callable[[Entry], DataFrame],
    read_subscriptions: Callable[[Entry], DataFrame],
    read_live_channels: Callable[[Entry], DataFrame],
    params: Callable[[Entry], RunParams],
) -> Run:
    """The scheduled run: gate, start date of this run, new listings, outbox, state.

    ``params`` is asked for every run, so that a rolling start moves with ``as_of``.
    Subscriptions and channels are read anew each time. A closed gate skips the run.
    """

    def run(ledger: Ledger, entry: Entry) -> None:
        gated_run(
            ledger,
            entry.run_no,
            read_listings(entry),
            read_subscriptions(entry),
            read_live_channels(entry),
            params(entry),
        )

    return run


def diff_run(read_rows: Callable[[Entry], DataFrame]) -> Run:
    """Only the new rows of each snapshot, without fan-out.

    Rows carry ``category`` and ``id``.
    """

    def run(ledger: Ledger, entry: Entry) -> None:
        rows = read_rows(entry)
        ledger.write("new", entry.run_no, diff.new_listings(rows, ledger.seen()))
        ledger.replace_seen(entry.run_no, rows)
        ledger.commit(entry.run_no, executed=True)

    return run


def diff_batch(read_rows: Callable[[list[Entry]], DataFrame]) -> BatchRun:
    """The new rows of all snapshots of a batch, in one job that starts from the stored seen set.

    ``read_rows`` gives the rows of the entries with ``run_no``, ``category`` and ``id``. Entries
    may skip numbers: a run is compared with the entry before it. New rows and seen sets of all
    runs are written first, then the runs are committed one by one, in order. A batch that fails
    before its last commit is gone on with from the seen set of the last run that was committed.
    """

    def run(ledger: Ledger, entries: list[Entry]) -> None:
        numbers = [entry.run_no for entry in entries]
        steps = ledger.spark.createDataFrame(
            list(zip(numbers, range(1, len(numbers) + 1))), "run_no bigint, _step bigint"
        )
        # A row per manifest entry, and the driver holds them already.
        rows = read_rows(entries).join(F.broadcast(steps), "run_no")
        stretch = rows.withColumnRenamed("run_no", "_run").withColumnRenamed("_step", "run_no")
        new = replay.replay_after(stretch, ledger.seen()).drop("run_no").withColumnRenamed("_run", "run_no")
        ledger.write_runs("new", numbers, new)
        ledger.write_runs("seen", numbers, rows.select("run_no", *diff.KEY).distinct())
        for number in numbers:
            ledger.commit(number, executed=True)

    return run
