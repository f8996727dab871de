"""The corpus pipeline: documents to packed training batches in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are run over all that their predecessor
kept, written as Parquet between them. `sf_dir` is there for stages that need further tables; none of these does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import linededup, mixing, packing, quality, simhash_texts
from rivulet.llm.common import ensure_checkpoint_dir, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the lines that passed them. Packing has use for short documents, so
    only those of fewer than five words count as too short."""
    good = quality.assess(docs.select(*COLUMNS), min_words=5).where("kept")
    return _with_length(good.withColumn("text", F.col("clean_text")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more share. Those that lose every line go on as empty
    texts, which are copies of each other to the next stage."""
    return _with_length(linededup.drop_frequent_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 0.8 or more."""
    return simhash_texts.drop_near_duplicates(docs.select(*COLUMNS), width=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources to their target weights takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in token-budget batches of its length bucket."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", clean_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("packing", pack_batches),
]

#: No SQL for run(): neither near-duplicate groups nor dependent rounding can be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared checkpoint folder and read again. What a
    stage wrote goes when the next one is done."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
