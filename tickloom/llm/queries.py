"""The queries of this subpackage, by name, each over whole tables and with production parameters; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hmm, html, licenses, mixing, packing, parsing, rules, simhash, warc
from .common import cut, delete, shared_dir
from .oracles import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A conversation whose texts hold the template's own control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], rows.schema)
    return chat.read_back(chat.format_trees(chat.conversations_of(rows.unionByName(hard))))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), archive)
    # responses' payloads are read and hashed; of revisits, which have none, the headers alone are parsed
    headers = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes bigint"
    responses = warc.read_archive(spark, archive, f"{headers}, computed_digest string").where("record_type = 'response'")
    revisits = warc.read_archive(spark, archive, headers).where("record_type = 'revisit'").withColumn("computed_digest", F.col("payload_digest"))
    back = responses.unionByName(revisits).select(
        warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.col("computed_digest").alias("payload_digest"), "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"),
    )
    found = cut(back)
    delete(spark, archive)
    return found


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def label_quality(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """docs with a column _label_quality: 2 for documents labelled good, 0.5 for those labelled bad, else 1."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("quality").alias("_q"))
    joined = docs.join(labels, docs["doc_id"] == labels["_label_id"], "left").drop("_label_id")
    return joined.withColumn("_label_quality", F.when(F.col("_q") > 0, 2.0).when(F.col("_q") == 0, 0.5).otherwise(1.0)).drop("_q")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("_size"))
    docs = label_quality(spark, sf_dir, docs)
    mixed = mixing.mix_sources(docs, quality=F.col("_label_quality"), size=F.col("_size"), carry=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first failed rule depends on the measured order, the verdict doesn't
    return rules.judge_documents(table(spark, sf_dir, "documents")).drop("reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_simhash_near_dedup, op3_html_extraction, op4_warc, op5_license_scan, op6_hmm_scoring,
        op7_document_fingerprints, op8_best_fit_packing, op9_mixing, op10_quality_rules,
    )
}
