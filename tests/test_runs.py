import pytest

from listings_data import listing
from listingloom.plans import runs
from listingloom.schema import SUBSCRIPTION
from listingloom.session import scratch
from listingloom.sources import deliveries, settings
from listingloom.sources.ledger import Ledger
from listingloom.sources.params import DAY, checked_interval, run_params

PARAMS = run_params(2_000_000_000, start=1)


@pytest.fixture
def world(spark, tmp_path):
    subs = spark.createDataFrame([(1, "summer", 11, 0), (1, "offseason", 12, 0)], SUBSCRIPTION)
    live = spark.createDataFrame([(11,), (12,)], "channel_id long")
    return subs, live, str(tmp_path / "ledger")


def outbox(spark, ledger, run_no):
    rows = spark.read.parquet(ledger.path("outbox", run_no)).orderBy("channel_id", "seq")
    return [(r["channel_id"], r["id"]) for r in rows.collect()]


def seen(ledger):
    return sorted((r["category"], r["id"]) for r in ledger.seen().collect())


def test_a_listing_that_left_and_returns_is_new_again(spark, frame, world):
    subs, live, root = world
    ledger = Ledger(spark, root)
    both = frame([listing("a", posted=10), listing("b", posted=20, terms=["Fall 2025"])])
    one = frame([listing("a", posted=10)])
    for run_no, feed in enumerate((both, one, both), 1):
        assert runs.gated_run(ledger, run_no, feed, subs, live, PARAMS)
    assert outbox(spark, ledger, 1) == [(11, "a"), (12, "b")]
    assert outbox(spark, ledger, 2) == []
    assert outbox(spark, ledger, 3) == [(12, "b")]
    assert seen(ledger) == [("offseason", "b"), ("summer", "a")]


def test_changing_category_is_new_again(spark, frame, world):
    subs, live, root = world
    ledger = Ledger(spark, root)
    runs.gated_run(ledger, 1, frame([listing("a", terms=["Fall 2025"])]), subs, live, PARAMS)
    runs.gated_run(ledger, 2, frame([listing("a")]), subs, live, PARAMS)
    assert outbox(spark, ledger, 2) == [(11, "a")]
    assert seen(ledger) == [("summer", "a")]


def test_a_skipped_run_keeps_the_seen_set(spark, frame, world):
    subs, live, root = world
    ledger = Ledger(spark, root)
    feed = frame([listing("a")])
    runs.gated_run(ledger, 1, feed, subs, live, PARAMS)
    half = subs.filter("category = 'summer'")
    assert not runs.gated_run(ledger, 2, frame([listing("z")]), half, live, PARAMS)
    assert seen(ledger) == [("summer", "a")]
    reopened = Ledger(spark, root)
    assert (reopened.last.run_no, reopened.last.executed, reopened.last.seen_run) == (2, False, 1)
    assert runs.gated_run(reopened, 3, feed, half, live, PARAMS, manual=True)
    assert outbox(spark, reopened, 3) == []


def test_a_failed_run_changes_nothing_and_can_be_repeated(spark, frame, world, monkeypatch):
    subs, live, root = world
    ledger = Ledger(spark, root)
    runs.gated_run(ledger, 1, frame([listing("a")]), subs, live, PARAMS)
    feed = frame([listing("a"), listing("b")])
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            runs.gated_run(ledger, 2, feed, subs, live, PARAMS)
    again = Ledger(spark, root)
    assert again.last.run_no == 1 and seen(again) == [("summer", "a")]
    assert runs.gated_run(again, 2, feed, subs, live, PARAMS)
    assert outbox(spark, again, 2) == [(11, "b")]
    assert not runs.gated_run(again, 2, feed, subs, live, PARAMS)


def test_rows_without_a_commit_are_not_read(spark, frame, world, monkeypatch):
    """Run 2 fails before its commit; at its second try the gate is closed, so it never ran."""
    subs, live, root = world
    ledger = Ledger(spark, root)
    runs.gated_run(ledger, 1, frame([listing("a")]), subs, live, PARAMS)
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            runs.gated_run(ledger, 2, frame([listing("b")]), subs, live, PARAMS)
    first = [(1, 11, "a", "C - Intern")]
    columns = ["run_no", "channel_id", "id", "card.title"]
    drained = lambda: [tuple(r) for r in runs.outbox(Ledger(spark, root)).select(columns).collect()]
    assert drained() == first
    assert not runs.gated_run(ledger, 2, frame([listing("b")]), subs.limit(0), live, PARAMS)
    assert drained() == first
    assert runs.gated_run(ledger, 3, frame([listing("b")]), subs, live, PARAMS)
    assert sorted(drained()) == [*first, (3, 11, "b", "C - Intern")]


def test_a_late_run_raises(spark, frame, world):
    subs, live, root = world
    ledger = Ledger(spark, root)
    for run_no in (1, 3):
        runs.gated_run(ledger, run_no, frame([listing("a")]), subs, live, PARAMS)
    assert ledger.is_done(1) and Ledger(spark, root).is_done(3) and not ledger.is_done(4)
    with pytest.raises(ValueError, match="late"):
        runs.gated_run(Ledger(spark, root), 2, frame([listing("a")]), subs, live, PARAMS)


def test_statistics_and_count_cards(spark, frame, world):
    subs, live, root = world
    ledger = Ledger(spark, root)
    runs.gated_run(ledger, 1, frame([listing("a"), listing("b", terms=["Fall 2025"])]), subs, live, PARAMS)
    runs.gated_run(ledger, 2, frame([listing("a"), listing("c")]), subs, live, PARAMS)
    rows = runs.statistics(ledger).orderBy("run_no").collect()
    assert [(r["processed"], r["summer_found"], r["offseason_found"]) for r in rows] == [(2, 1, 1), (2, 2, 0)]
    assert [(r["summer_new"], r["offseason_new"], r["total_new"], r["deliveries"]) for r in rows] == [
        (1, 1, 2, 2), (1, 0, 1, 1)
    ]
    card = runs.count_cards(ledger).filter("run_no = 2").first()["card"]
    assert [(f["name"], f["value"]) for f in card["fields"]] == [("☀️ Summer", "1 new"), ("❄️ Off-Season", "0 new")]
    header = runs.preview_header(frame([listing("a"), listing("c")]), PARAMS).first()["header"]
    assert header.split("\n")[1] == "📊 Total found: 2 summer, 0 off-season"


def test_delivery_log_keeps_the_last_attempt(spark, tmp_path):
    path = str(tmp_path / "log")
    assert deliveries.read_log(spark, path).count() == 0
    for attempt, status in ((1, "failed"), (2, "sent")):
        rows = [(1, 11, 1, attempt, "summer", "a", status), (attempt, 12, 1, 1, "summer", "b", "failed")]
        deliveries.record_attempts(spark.createDataFrame(rows, deliveries.ATTEMPT), path)
    got = sorted((r["run_no"], r["channel_id"], r["status"]) for r in deliveries.read_log(spark, path).collect())
    assert got == [(1, 11, "sent"), (1, 12, "failed"), (2, 12, "failed")]


def test_settings_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "settings")
    assert settings.stored_params(spark, path, 10 * DAY) == run_params(10 * DAY)
    rows = [(1, 12.0, None), (2, None, 500), (3, 0.4, None), (4, None, 0), (5, None, None), (6, 24.0, None)]
    refused = settings.record_settings(spark.createDataFrame(rows, settings.CHANGE), path)
    assert [(r["seq"], r["refusal"]) for r in refused.orderBy("seq").collect()] == [
        (3, "bad_interval"), (4, "bad_start"), (5, "nothing_set")
    ]
    assert settings.stored_params(spark, path, 10 * DAY) == run_params(10 * DAY, start=500, interval_hours=24.0)


def test_a_channel_that_completes_the_settings_starts_a_run(spark, frame, world, tmp_path):
    _, live, root = world
    ledger, path = Ledger(spark, root), str(tmp_path / "changes")
    facts = spark.createDataFrame(
        [(11, 1, True, True), (12, 1, True, True), (13, None, True, True)],
        "channel_id long, owner_guild_id long, can_send boolean, can_embed boolean",
    )
    feed = frame([listing("a")])
    made = lambda *rows: spark.createDataFrame(rows, "seq long, guild_id long, category string, channel_id long")
    refused, ran = runs.channel_set(made((1, 1, "summer", 11), (2, 1, "summer", 13)), facts, path, ledger, 1, feed, live, PARAMS)
    assert [r["refusal"] for r in refused.collect()] == ["other_guild"] and not ran
    refused, ran = runs.channel_set(made((3, 1, "offseason", 12)), facts, path, ledger, 1, feed, live, PARAMS)
    assert refused.count() == 0 and ran and outbox(spark, ledger, 1) == [(11, "a")]


class _Cluster:
    """As much of a session as scratch() looks at."""

    def __init__(self, named=None, folder=None, master="yarn"):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master, self._folder = master, folder

    def getCheckpointDir(self):
        return self._folder


def test_scratch_is_shared_or_refused():
    assert scratch(_Cluster(named="s3://a/"), "x").startswith("s3://a/listingloom/x-")
    assert scratch(_Cluster(folder="hdfs://b"), "x").startswith("hdfs://b/listingloom/x-")
    assert "listingloom" in scratch(_Cluster(master="local[4]"), "x")
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch(_Cluster(master=master), "x")


def test_an_empty_snapshot_empties_the_seen_set(spark, frame, world):
    subs, live, root = world
    ledger = Ledger(spark, root)
    for run_no, rows in enumerate(([listing("a")], [], [listing("a")]), 1):
        runs.gated_run(ledger, run_no, frame(rows), subs, live, PARAMS)
    assert outbox(spark, ledger, 2) == []
    assert outbox(spark, ledger, 3) == [(11, "a")]


def test_preview_touches_no_state(frame):
    rows = [listing(f"s{n}", posted=100 + n) for n in range(7)]
    rows += [listing("f", terms=["Fall 2025"])]
    shown = runs.preview(frame(rows), PARAMS).collect()
    assert [r["id"] for r in shown] == ["s6", "s5", "s4", "s3", "s2", "f"]
    assert shown[-1]["card"]["description"] == "❄️ Fall 2025"


def test_subscription_changes(spark):
    changes = spark.createDataFrame(
        [(1, 10, "summer", 1), (2, 10, "summer", 2), (3, 20, "offseason", 2)],
        "seq long, guild_id long, category string, channel_id long",
    )
    facts = spark.createDataFrame(
        [(1, 10, True, True), (2, 20, True, True)],
        "channel_id long, owner_guild_id long, can_send boolean, can_embed boolean",
    )
    subs, refused = runs.apply_subscription_changes(changes, facts)
    assert sorted((r["guild_id"], r["channel_id"]) for r in subs.collect()) == [(10, 1), (20, 2)]
    assert [(r["seq"], r["refusal"]) for r in refused.collect()] == [(2, "other_guild")]


def test_params():
    assert run_params(1_000_000).start == 1_000_000 - 3 * DAY
    assert run_params(1_000_000, start=5).start == 5
    assert run_params(1_000_000).interval_hours == 6.0
    for bad in ({"start": 0}, {"start": -1}, {"days_back": 0}, {"days_back": 366},
                {"interval_hours": 0.4}, {"interval_hours": 169}):
        with pytest.raises(ValueError):
            run_params(1_000_000, **bad)
    assert checked_interval(0.5) == 0.5
