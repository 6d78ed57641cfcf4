"""Array documents that are written and read in ranges."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from listingloom.plans import catalog
from listingloom.sources import folders, tables


@pytest.fixture
def lines(spark, tmp_path):
    """Line items of six documents, one of them large and one copied."""
    day = datetime.datetime(2026, 1, 2)
    rows = [
        (doc * tables.DOCUMENT_ORDERS + n, 1, 1, n % 7 + 1, float(n % 51), 1.0, n % 11 / 100, n % 9 / 100, "ANR"[n % 3], "OF"[n % 2], day)
        for doc, many in ((0, 40), (1, 40), (2, 300), (4, 10), (5, 10), (9, 40))
        for n in range(many)
    ]
    frame = spark.createDataFrame(rows + rows[-40:], tables.SCHEMAS["lineitem"])
    frame.write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_ranges_hold_whole_documents(spark, lines):
    assert tables.document_ranges(spark, lines, 100) == [(0, 1), (2, 2), (4, 9)]
    assert tables.document_ranges(spark, lines, 1000) == [(0, 9)]
    whole = tables.listing_documents(spark, lines)
    parts = [tables.listing_documents(spark, lines, *ends) for ends in ((None, 1), (2, 2), (4, None))]
    assert parts[0].unionAll(parts[1]).unionAll(parts[2]).exceptAll(whole).isEmpty()
    assert sum(part.count() for part in parts) == whole.count() == 480 + 12


def test_the_disk_holds_one_range_and_rows_are_the_same(spark, lines, tmp_path, monkeypatch):
    kept, most, remove = tmp_path / "kept", [], folders.remove
    monkeypatch.setattr(catalog, "scratch", lambda _spark, purpose: f"{kept}/{purpose}-{uuid.uuid4().hex}")

    def watched(spark, path):
        most.append(len(list(kept.glob("documents-*/doc=*"))))
        remove(spark, path)

    monkeypatch.setattr(folders, "remove", watched)
    want = catalog.feed_array_split(spark, lines)
    assert want.count() == 480 + 6 and max(most) == 6
    most.clear()
    monkeypatch.setattr(catalog, "LINES_AT_ONCE", 100)
    got = catalog.feed_array_split(spark, lines)
    assert max(most) == 3 and got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert got.filter("place = 0").count() == 6 and got.filter(F.col("id").isNotNull()).count() > 0
    assert not [*kept.glob("documents-*"), *kept.glob("pieces-*")]
