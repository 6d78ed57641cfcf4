"""The registered queries of the operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm import (
    alignment,
    fingerprints,
    html_extraction,
    line_dedup,
    mixing,
    periodic_runs,
    quality_rules,
    sentencepiece_bpe,
    simhash,
    suffix_dedup,
    superminhash,
    toxicity,
    warc,
)
from listingloom.llm.oracles import ORACLES  # noqa: F401
from listingloom.llm.tables import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(toxicity.held_out(docs), model, ["doc_id", "held_out"])


def piece_model() -> bytes:
    """The merge-type vocabulary, read on the driver and sent with the tasks (half a MB)."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def byte_model() -> str:
    """The byte-level vocabulary as the JSON of its tokenizer, read on the driver and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), piece_model(), ["doc_id"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name: F.col("headers")[name]
    return warc.page_derivatives(table(spark, sf_dir, "pages")).select(
        "page_id",
        field("WARC-Type").alias("warc_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Concurrent-To").alias("concurrent_to"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        field("WARC-Block-Digest").alias("block_digest"),
        field("Content-Length").cast("long").alias("content_length"),
        "record_sha256",
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).drop("th")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.with_verdict(docs.select("doc_id", "text"), labels).select("doc_id", "verdict.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), byte_model(), piece_model())


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def with_planted_period(words: list[bytes], doc_id: object) -> list[bytes]:
    """In a tenth of the documents, by a hash of the id: words from some place on repeat with a period.

    Documents without an id stay as they are.
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs, ["doc_id"], ("doc_id", with_planted_period))
    best = periodic_runs.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.as_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_toxicity, op3_sentencepiece, op4_warc, op5_fingerprints, op6_html_extraction, op7_line_dedup, op8_mixing, op9_quality_rules, op10_simhash,
        op11_alignment, op12_superminhash, op13_periodic_runs,
    )
}