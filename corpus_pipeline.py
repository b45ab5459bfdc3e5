"""A corpus pipeline of four stages over the table documents: quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
mix repeats a document that it takes twice, and packing packs each of those rows.

Defined cases. Null or empty text: rejected by the quality rules; given to a later stage alone, it is near no other text but
one without words, has size 0 in the mix and is one end id when packed. Null doc_id or source, ties: as the modules say. Very
long texts: read whole. Rows that repeat id and text: near-dedup keeps one. Extra columns, whatever their names, go through
all stages but the last. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, packing, rules, simhash, similar
from tickloom.llm.common import delete, shared_dir
from tickloom.llm.queries import label_quality, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id.

    Near are fingerprints of up to two differing bits, as in the query, and texts whose five-word shingles are similar by 0.8.
    """
    found, links = similar.similar(docs)
    return simhash.one_of_each(docs, found=found, links=links)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights; a document appears as often as the mix takes it.

    Quality is by labels, as in the query. Sizes are counted before labels join, so that texts move once.
    """
    rated = label_quality(spark, sf_dir, docs.withColumn("_size", mixing.word_count(F.col("text"))))
    mixed = mixing.mix_sources(rated, quality=F.col("_label_quality"), size=F.col("_size"))
    return mixing.repeated(mixed, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("best_fit_packing", pack)]

#: SQL has neither XXH64 fingerprints with their links nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written into a folder of this run's own and read again; a stage's rows are deleted once
    the next one's are written."""
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", ""
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{base}/{n}-{name}")
        docs = spark.read.parquet(at)
        if before:
            delete(spark, before)
        before = at
    return docs
