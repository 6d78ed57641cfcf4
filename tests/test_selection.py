from pyspark.sql import functions as F

from listings_data import listing
from listingloom.functions import season
from listingloom.operators import diff, select, stats


def ids(rows, category):
    kept = select.newest_first(rows).filter(F.col("category") == category)
    return [r["id"] for r in kept.select("id").collect()]


def seen(spark, *keys):
    return spark.createDataFrame(list(keys), "category string, id string")


def test_current_without_start(five):
    now = select.current(five, None)
    assert ids(now, "summer") == ["summer-1", "summer-2", "old-1"]
    assert ids(now, "offseason") == ["offseason-1"]


def test_current_with_start(five):
    now = select.current(five, 1731850000)
    assert ids(now, "summer") == ["summer-1", "summer-2"]
    assert ids(now, "offseason") == []


def test_start_is_inclusive_and_zero_means_none(frame):
    rows = frame([listing("at", posted=100), listing("before", posted=99)])
    assert ids(select.current(rows, 100), "summer") == ["at"]
    assert ids(select.current(rows, 0), "summer") == ["at", "before"]


def test_new_against_seen(spark, five):
    old = seen(spark, ("summer", "summer-1"), ("offseason", "offseason-1"))
    fresh = diff.new_listings(select.current(five, None), old)
    assert ids(fresh, "summer") == ["summer-2", "old-1"]
    assert ids(fresh, "offseason") == []


def test_new_with_nothing_seen(spark, five):
    fresh = diff.new_listings(select.current(five, 1731850000), seen(spark))
    assert ids(fresh, "summer") == ["summer-1", "summer-2"]
    assert ids(fresh, "offseason") == []


def test_copies_survive_and_seen_is_per_category(spark, frame):
    rows = select.current(
        frame([listing("twice"), listing("twice"), listing("moved", terms=["Summer 2026"])]), None
    )
    old = seen(spark, ("offseason", "moved"))
    for find in (diff.new_listings, diff.new_listings_narrow):
        fresh = sorted(r["id"] for r in find(rows, old).collect())
        assert fresh == ["moved", "twice", "twice"]
    assert diff.all_ids(rows).count() == 2
    assert diff.all_ids(rows, "summer").count() == 2
    assert diff.all_ids(rows, "autumn").count() == 0


def test_seasons(frame):
    cases = {
        "both": (["Summer 2026", "Fall 2026"], "summer"),
        "lower": (["summer 2026"], None),
        "none": ([], None),
        "part": (["Springfield 2026"], "offseason"),
        "winter": (["Winter 2027"], "offseason"),
        "spring": (["Spring 2027"], "offseason"),
        "cut": (["Sum", "mer Fa", "ll"], None),
        "second": (["Q1", "x Fall"], "offseason"),
        "years": (["Summer 2026", "Summer 2027"], "summer"),
    }
    rows = frame(listing(name, terms=terms) for name, (terms, _) in cases.items())
    found = {
        r["id"]: r["category"]
        for r in rows.select("id", season.category(F.col("terms")).alias("category")).collect()
    }
    assert found == {name: category for name, (_, category) in cases.items()}


def test_equal_dates_keep_feed_order(spark, frame):
    rows = frame([listing("b"), listing("a")])
    place = F.when(F.col("id") == "b", 0).otherwise(1)
    current = select.current(rows, None)
    assert ids(current.withColumn("ordinal", place), "summer") == ["b", "a"]
    assert ids(current, "summer") == ["a", "b"]


def test_counters(five):
    row = stats.scrape_counters(five, 1731850000).first().asDict()
    assert row == {
        "processed": 5, "filtered": 2, "summer_found": 2, "offseason_found": 0, "rejected": 0,
    }


def test_new_counts_have_both_categories(five):
    fresh = select.current(five, 1731850000)
    counts = {r["category"]: r["new_count"] for r in stats.new_counts(fresh).collect()}
    assert counts == {"summer": 2, "offseason": 0}


def test_latest_prunes_before_the_shuffle(five):
    top = select.latest_per_category(select.current(five, None), 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r["id"] for r in top.collect()) == ["offseason-1", "summer-1", "summer-2"]
