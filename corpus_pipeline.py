"""A training corpus from raw documents: each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm import line_dedup, mixing, quality_rules, sentencepiece_bpe, simhash
from listingloom.llm.queries import piece_model
from listingloom.llm.tables import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; labels of trusted documents come from ``sf_dir``.

    Null, empty and very short texts fail the base rules and go. Rows that repeat share their verdict;
    other columns, null or not, are passed on. An empty table gives no rows.
    """
    judged = quality_rules.with_verdict(docs, table(spark, sf_dir, "labels"), "_verdict")
    return judged.where("_verdict.kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, or nearly repeat, an earlier one.

    The first line by document id (null last) and number stays. No document goes: null texts stay
    null, one that loses all its lines has an empty text. Rows repeated with their id are one
    document, of which each keeps the same. An empty table gives no rows.
    """
    return line_dedup.without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Null and empty texts have fingerprint zero and are one group. Rows without an id are kept, as
    no group can be named after them; where an id repeats, one row of each fingerprint stays.
    An empty table gives no rows.
    """
    return simhash.one_of_each_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them.

    A null source is a source like others, last in order. Null and empty texts have no words and
    aren't taken. Rows that agree in all that orders them share their fate; an empty table gives no rows.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, in place of its text, and the digests of both.

    Null and empty texts have the end id alone. Rows that repeat, as the mix makes them, are each
    coded; an empty table gives no rows.
    """
    coded = sentencepiece_bpe.encoded(docs, piece_model(), ["doc_id", "lang", "source"], decoded=False)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

#: Fitted weights, fingerprints and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
