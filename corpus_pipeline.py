"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the session, the rows that the stage before kept, and the folder of the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import mixing, packing, pii, quality, simhash
from tallyspark.llm.entries import CAPACITY, MIX_EXPONENT, MIX_SEED, QUALITY_LEAST, table, tokenizer_path
from tallyspark.llm.shared import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What near-duplicates have in common: shingles of so many words, this Jaccard similarity at least.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    model = quality.training_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scored(model, F.col("text")) >= QUALITY_LEAST).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by 0.8 or more of common five-word shingles."""
    return simhash.deduplicated(docs, shingle_words=SHINGLE_WORDS, similarity=SIMILARITY).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked."""
    return pii.redact(docs, pii.train(docs)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come to their target shares."""
    return mixing.mix(docs, seed=MIX_SEED, exponent=MIX_EXPONENT).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("PII", without_personal_data),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Neither the tokenizer, the classifier nor the fingerprints can be said in SQL.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    What a stage has read is removed once its own rows are written, and all of it after a failure; only
    the last stage's rows stay, which the result reads.
    """
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                remove(spark, f"{base}/{k - 1}")
    except BaseException:
        remove(spark, base)
        raise
    return docs
