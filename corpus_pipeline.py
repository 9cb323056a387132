"""From raw documents to packed training sequences: five stages, each one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns a table. All but the last return the columns of
documents; each is written as Parquet into the shared folder and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.llm import exact_dedup, ngram_join, packing, quality_rules, substring_dedup
from stackscan.llm.common import fresh_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, judged against the labelled good ones."""
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, trusted, sound=True).where("kept").select("row.*")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near-equal texts, the one with the smallest doc_id."""
    return ngram_join.without_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds already; n_chars follows the text."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    found = substring_dedup.substring_dedup(docs, edges=True)
    return found.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", copies), ("n-gram join", near_copies),
          ("substring dedup", passages), ("packing", packed)]
#: The stages hash n-grams and cut tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
