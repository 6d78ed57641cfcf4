"""Mixing sources to target weights by Pareto order sampling.

A source that is to be taken r times gives floor(r) whole copies of every document for
certain. The rest is a sample without replacement: a document's inclusion probability is
proportional to its size (1 at most), documents are ranked by the odds of a hashed random
number over the odds of inclusion, and taken in that order until their words fill the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm.tables import WORD, stored, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most copies of a document, and of a source.
MOST = 3
#: Cells of the rank axis in which words are summed before any document is ordered.
CELLS = 65536
SEED = "mix"


def _size() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` of ``sizes(source, size)``.

    Every source is filled up to the same level times its weight, or to ``MOST`` times its
    size where that is less. In the order of size over weight the full ones come first, so
    running sums find the level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    place = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = by_source.withColumn("weight", weight).select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(onward).alias("weights"),
    )
    full = F.col("left") * F.col("weight") >= MOST * F.col("source_size") * F.col("weights")
    level = F.struct(F.col("left"), F.col("weights"))
    rows = rows.withColumn("full", full).withColumn(
        "level", F.min(F.when(~F.col("full"), F.struct(F.col("weights").alias("_w") * -1, level.alias("l")))).over(whole)["l"]
    )  # the first that isn't full has the most weights left
    share = F.col("weight") * F.col("level")["left"] / F.col("level")["weights"]
    return rows.select(
        "source", "source_size",
        F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(share.cast("double")).alias("target"),
    )


def _uniform() -> Column:
    """A number in (0, 1) from the id alone, so that reruns and retries agree."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)


def _key(u: Column) -> Column:
    """Rank of a document, from 0 (certain) to 1 (size 0, never sampled): x / (1 + x) of the odds ratio x."""
    chance = F.least(F.lit(1.0), F.col("pace") * F.col("size"))
    ratio = (u / (1 - u)) * ((1 - chance) / chance)
    return F.when(chance > 0, F.when(chance < 1, ratio / (1 + ratio)).otherwise(0.0)).otherwise(1.0)


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The measured documents ``(doc_id, source, size)`` and a row of decisions per source.

    A document is sampled when its (key, id, size) isn't above its source's cut. Rows that
    agree in all three share their fate, whatever order they are read in.
    """
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size")), "sizes")
    per = targets(sized).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # pace: chance = pace * size, 1 at most, such that the chances of all words sum to rest.
    # Sizes from the largest down are certain as long as pace * size would be over 1.
    square = F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)") * F.col("n")
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n")).where("size > 0")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    hist = hist.select(
        "source", "size",
        F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("larger"),
        F.sum(square.cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double").alias("squares"),
    )
    paced = hist.join(per.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    paced = paced.withColumn("pace", (F.col("rest") - F.col("larger")) / F.col("squares"))
    paced = paced.where(F.col("pace") * F.col("size") <= 1).groupBy("s").agg(F.max("pace").alias("pace"))
    per = per.join(paced, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *per.columns, F.greatest(F.coalesce("pace", F.lit(0.0)), F.lit(0.0)).alias("pace")
    )
    per = stored(per, "sources")

    ranked = _with_source(sized, per).where("rest > 0 and size > 0").withColumn("key", _key(_uniform()))
    ranked = ranked.withColumn("cell", F.floor(F.col("key") * CELLS))
    cells = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    along = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    last = cells.where("before < rest").groupBy(F.col("source").alias("s")).agg(
        F.max("cell").alias("at"), F.max("before").alias("before")
    )
    # Only the documents of one cell per source are put in order.
    edge = ranked.join(stored(last, "cells"), F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("at")))
    alike = edge.groupBy("source", "rest", "before", "key", "doc_id", "size").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    before = F.col("before") + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = alike.withColumn("taken", before + F.col("words") / 2 < F.col("rest")).where("taken")
    cut = inside.groupBy(F.col("source").alias("s")).agg(
        F.max(F.struct("key", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size")).alias("cut")
    )
    ends = last.select(F.col("s").alias("e"), "at")
    out = per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").join(
        ends, F.col("source").eqNullSafe(F.col("e")), "left"
    )
    # Where nothing of the cell is taken, the cut is at its lower end.
    return sized, stored(out.select(*per.columns, "at", "cut"), "cuts")


def _with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Joins a row per source; the planner broadcasts it if its stored size is small enough."""
    own = per.withColumnRenamed("source", "_source")
    return rows.join(own, rows["source"].cast("string").eqNullSafe(own["_source"])).drop("_source")


def _copies() -> Column:
    """Copies of a document: whole ones, and one more if it is sampled."""
    key = F.struct(
        _key(_uniform()).alias("key"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("size").alias("size"),
    )
    below = F.floor(key["key"] * CELLS) < F.col("at")
    sampled = (F.col("rest") > 0) & (F.col("size") > 0) & (below | (F.col("cut").isNotNull() & (key <= F.col("cut"))))
    return F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every document.

    Null texts have size 0; a null source is a source of its own, the last. Documents of size
    0 are copied as often as their source is taken whole. A table without words has targets of
    0 and no copies; an empty table gives no rows. Only ``doc_id``, ``text`` and ``source`` of
    ``docs`` are read; repeated rows count each.
    """
    sized, cuts = plan(docs)
    return _with_source(sized, cuts).withColumn("copies", _copies()).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, cuts = plan(docs)
    inner = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", _size().alias("size"))
    copies = _with_source(inner, cuts).select("_row", _copies().cast("int").alias("_copies"))
    return copies.where("_copies > 0").select(
        "_row.*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    ).drop("_copy")
