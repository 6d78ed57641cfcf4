"""Season flags and the category they lead to."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom.schema import OFFSEASON, OFFSEASON_WORDS, SUMMER, SUMMER_WORDS


def _mentions(terms: Column, words: tuple[str, ...]) -> Column:
    """Does any term contain a word? No word holds a line break, so none can be found
    across two terms; one joined text, unlike a lambda, stays inside generated code."""
    text = F.concat_ws("\n", terms)
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def is_summer(terms: Column) -> Column:
    return _mentions(terms, SUMMER_WORDS)


def is_offseason(terms: Column) -> Column:
    return _mentions(terms, OFFSEASON_WORDS)


def category(terms: Column) -> Column:
    """``summer`` before ``offseason``; null when no term names a season."""
    return F.when(is_summer(terms), F.lit(SUMMER)).when(is_offseason(terms), F.lit(OFFSEASON))


def category_rank(category: Column) -> Column:
    """Summer is shown and delivered first."""
    return F.when(category == SUMMER, F.lit(0)).otherwise(F.lit(1))
