from listingloom.operators import replay
from listingloom.streaming import keyed


def test_keys_share_the_state_of_their_bucket(spark, tmp_path):
    """400 keys, one of them null, in 4 buckets; some return after a run without them, or after more."""
    rows = [("a", str(n), run) for n in range(400) for run in range(1, 9) if (run + n) % (2 + n % 4)]
    rows += [("a", None, run) for run in (1, 2, 5, 8)]
    table = spark.createDataFrame(rows, keyed.KEYS)
    landed, fresh, checkpoint = (str(tmp_path / name) for name in ("keys", "fresh", "checkpoint"))
    for low in (1, 4, 7):  # stopped twice and gone on with
        keyed.land_keys(table.filter(f"run_no BETWEEN {low} AND {low + 2}").coalesce(1), landed)
        query = (
            keyed.fresh_keys(keyed.read_keys(spark, landed), buckets=4)
            .writeStream.format("parquet").option("path", fresh)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    key = lambda row: tuple(map(str, row))
    got = sorted(map(tuple, spark.read.schema(keyed.KEYS).parquet(fresh).collect()), key=key)
    assert got == sorted(map(tuple, replay.fresh_keys(table).collect()), key=key)
    # A value and the entries of a timer per bucket, not per key.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 4
