import pytest

from listingloom.schema import SEEN
from listingloom.sources import folders
from listingloom.sources import ledger as module
from listingloom.sources.ledger import Ledger


@pytest.fixture
def root(monkeypatch, tmp_path):
    monkeypatch.setattr(module, "CHECKPOINT_EVERY", 4)
    return str(tmp_path / "ledger")


def run(ledger, run_no, executed=True):
    if executed:
        rows = ledger.spark.createDataFrame([("summer", f"id{run_no}")], SEEN)
        ledger.write("new", run_no, rows)
        ledger.replace_seen(run_no, rows)
    ledger.commit(run_no, executed)


def committed(ledger):
    return sorted((r["run_no"], r["executed"], r["seen_run"]) for r in ledger.commits().collect())


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


def test_files_of_commits_stay_bounded_and_nothing_is_lost(spark, root):
    ledger = Ledger(spark, root)
    expected, seen_run = [], None
    for n in range(1, 23):
        executed = n % 5 != 0
        run(ledger, n, executed)
        seen_run = n if executed else seen_run
        expected.append((n, executed, seen_run))
        assert len(ledger.commits().inputFiles()) <= 5
        if n in (3, 4, 5, 22):
            reopened = Ledger(spark, root)
            assert committed(reopened) == expected and reopened.last.run_no == n
    assert ids(ledger.read("new", "category string, id string")) == sorted(f"id{n}" for n, ran, _ in expected if ran)
    assert ledger.is_done(2)
    with pytest.raises(ValueError, match="late"):
        ledger.is_done(0)


def test_an_unfinished_checkpoint_counts_for_nothing(spark, root, tmp_path):
    ledger = Ledger(spark, root)
    for n in range(1, 7):
        run(ledger, n, executed=n == 1)
    (tmp_path / "ledger" / "checkpoints" / "upto=6" / "_temporary").mkdir(parents=True)
    reopened = Ledger(spark, root)
    assert [c[0] for c in committed(reopened)] == [1, 2, 3, 4, 5, 6]
    assert reopened.last.seen_run == 1 and ids(reopened.seen()) == ["id1"]


def test_vacuum_leaves_what_can_still_be_read(spark, root):
    ledger = Ledger(spark, root)
    readers = {}
    for n in range(1, 15):
        run(ledger, n)
        readers[n] = Ledger(spark, root).seen()
    before = committed(ledger)
    ledger.vacuum(keep_runs=3)
    assert folders.numbers(spark, f"{root}/seen", "run") == [11, 12, 13, 14]
    assert folders.numbers(spark, f"{root}/commits", "run") == [9, 10, 11, 12, 13, 14]
    assert folders.numbers(spark, f"{root}/checkpoints", "upto") == [8, 12]
    for n in (11, 12, 13, 14):
        assert ids(readers[n]) == [f"id{n}"]
    again = Ledger(spark, root)
    assert committed(again) == before and ids(again.seen()) == ["id14"]
    assert len(ids(again.read("new", "category string, id string"))) == 14
    again.vacuum(keep_runs=3)
    run(again, 15)
    assert committed(Ledger(spark, root))[-1] == (15, True, 15)


def test_vacuum_keeps_the_seen_set_that_skipped_runs_carry(spark, root):
    ledger = Ledger(spark, root)
    ledger.vacuum()
    for n in range(1, 12):
        run(ledger, n, executed=n < 3)
    ledger.vacuum(keep_runs=1)
    assert folders.numbers(spark, f"{root}/seen", "run") == [2]
    assert ids(Ledger(spark, root).seen()) == ["id2"]
    with pytest.raises(ValueError):
        ledger.vacuum(keep_runs=0)


def test_a_seen_set_of_a_run_without_commit_is_not_removed_under_it(spark, root):
    ledger = Ledger(spark, root)
    run(ledger, 1)
    ledger.replace_seen(2, spark.createDataFrame([("summer", "b")], SEEN))
    ledger.vacuum(keep_runs=1)
    assert folders.numbers(spark, f"{root}/seen", "run") == [1, 2]
