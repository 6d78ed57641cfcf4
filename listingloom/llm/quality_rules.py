"""Quality rules: counts of bad signs, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: one of trusted
documents, one of the whole corpus. A document's sum of log ratios is divided by its number
of n-grams and held against a fixed threshold. Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.tables import SPACE, stored, text_or_empty, words

#: Hash buckets of the two multinomials: the bound of every table that is broadcast here.
BUCKETS = 65536
#: Trusted documents that the target multinomial is fitted on, at most (least hash of id).
TRUSTED_BOUND = 20_000
#: Added to the count of a bucket in trusted text and to the count expected from the corpus, so
#: that n-grams too rare to be expected in trusted text tell little.
SMOOTHING = 16.0
#: Log ratios are kept in units of 2^-20, so that sums don't depend on their order.
UNIT = 1 << 20
#: Mean log ratio below which a document goes.
THRESHOLD = -0.075
MIN_WORDS = 50
#: Percent of the words that repeated windows may hold.
MAX_REPEATED = 50


def _bucket(*hashed: Column) -> Column:
    return F.pmod(F.xxhash64(*hashed), F.lit(BUCKETS)).cast("int")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(h: Column) -> Column:
    """Indices of all words but the last."""
    n = F.size(h)
    return F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(bucket, raw, target)`` for all buckets: n-grams of all documents, of trusted ones.

    ``trusted`` has a column ``doc_id`` and at most ``TRUSTED_BOUND`` rows, so it is broadcast.
    """
    marked = docs.select(F.col("doc_id"), "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("_trusted"))), "doc_id", "left"
    )
    hashed = marked.select(
        F.coalesce("_trusted", F.lit(0)).alias("_trusted"), _hashes(text_or_empty()).alias("_h")
    )
    h = F.col("_h")
    grams = hashed.select(
        "_trusted",
        F.explode_outer(  # the plain form computes the array once more, to see if it is empty
            F.concat(
                F.transform(h, lambda w: _bucket(w)),
                F.transform(_pairs(h), lambda i: _bucket(F.get(h, i), F.get(h, i + 1))),
            )
        ).alias("bucket"),
    )
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_trusted").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return stored(every.join(counted, "bucket", "left").na.fill(0, ["raw", "target"]), "counts")


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row ``weights``: log ratio by bucket in ``UNIT``s; all 0 without trusted text."""
    total = lambda n: counts.agg(F.sum(n)).scalar()
    rows = counts.withColumns({"_r": total("raw"), "_t": total("target")})
    # The document that is being judged isn't part of what it is held against.
    expected = F.greatest(F.col("raw") - 1, F.lit(0)) * F.col("_t") / F.col("_r")
    ratio = (F.col("target") + SMOOTHING) / (expected + SMOOTHING)
    weight = F.when(F.col("_t") > 0, F.round(F.log(ratio) * UNIT)).otherwise(0)
    return rows.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bucket", weight.cast("long").alias("w")))),
            lambda s: s["w"],
        ).alias("weights")
    )


def _repeated_words(h: Column) -> Column:
    """Words in windows of three that are found twice or more, by 64-bit hashes of the windows."""

    def covered(s: Column) -> Column:
        # Sorted by hash, windows that are found twice are neighbours.
        at = lambda k: F.get(s, k)["h"]
        twice = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: at(k).eqNullSafe(at(k + 1)) | ((k > 0) & at(k).eqNullSafe(F.when(k > 0, at(k - 1)))),
        )
        first = F.transform(twice, lambda k: F.get(s, k)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(first, lambda i: F.array(i, i + 1, i + 2)))))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(h) - 3),
        lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)),
    )
    count = _let(
        windows,
        lambda w: F.when(
            F.size(F.array_distinct(w)) < F.size(w),
            _let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered),
        ).otherwise(0),
    )
    return F.when(F.size(h) > 2, count).otherwise(0).cast("long")


def _ratio(h: Column, weights: Column) -> Column:
    """Mean log ratio over a document's n-grams; 0 without words."""
    total = F.aggregate(
        F.sequence(F.lit(0), F.size(h) - 1),
        F.lit(0).cast("long"),
        lambda acc, i: acc
        + F.get(weights, _bucket(F.get(h, i)))
        + F.when(i > 0, F.get(weights, _bucket(F.get(h, i - 1), F.get(h, i)))).otherwise(0),
    )
    return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1) / UNIT).otherwise(0.0)


def verdict(text: Column, weights: Column) -> Column:
    """A struct of all counts, ``base_failed``, ``log_ratio`` and ``kept`` of a text."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))

    def counts(w: Column, h: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(h).alias("n_repeat_words"),
            _ratio(h, weights).alias("log_ratio"),
        )

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(
            *(c[n].alias(n) for n in names),
            failed.alias("base_failed"),
            c["log_ratio"].alias("log_ratio"),
            (~failed & (c["log_ratio"] >= THRESHOLD)).alias("kept"),
        )

    return _let(
        words(text), lambda w: _let(_let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: counts(w, h)), judged)
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of labelled good documents, ``TRUSTED_BOUND`` at most, by hash: any order of rows gives the same."""
    good = labels.where("quality = 1").select("doc_id").where("doc_id is not null").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_BOUND)


def with_verdict(docs: DataFrame, labels: DataFrame, name: str = "verdict") -> DataFrame:
    """Every row of ``docs`` with the struct of ``verdict``.

    The corpus counts take in every document. Repeated rows are judged alike, each on its own;
    an empty table gives an empty result; a null or empty text has no words and fails.
    ``doc_id`` and ``text`` are read, all columns are passed on.
    """
    weights = stored(log_ratios(ngram_counts(docs, trusted_ids(labels))), "ratios")
    rows = docs.withColumn("_weights", weights.scalar())
    return rows.withColumn(name, verdict(text_or_empty(), F.col("_weights"))).drop("_weights")
