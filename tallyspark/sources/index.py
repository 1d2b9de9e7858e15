"""A search index on disk: documents and chunks as JSON lines, vectors as Parquet, a line of metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import texts
from tallyspark.sources.sinks import exists


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None
    meta: dict[str, object]


def built(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    """``chunk_id`` and ``chunk`` of all documents with the documents' other columns."""
    cut = texts.chunks(documents, id_col, text_col, size, overlap)
    named = cut.withColumn("chunk_id", F.concat_ws("-", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")))
    return named.join(documents.drop(text_col), id_col)


def write(folder: str, documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, model: str | None = None) -> None:
    """Writes all parts, the metadata last, so that an index without them is one that wasn't finished."""
    folder = folder.rstrip("/")
    documents.write.mode("overwrite").json(f"{folder}/documents.jsonl")
    chunks.write.mode("overwrite").json(f"{folder}/chunks.jsonl")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{folder}/vectors.parquet")
    spark = documents.sparkSession
    stored = spark.read.json(f"{folder}/chunks.jsonl", schema=chunks.schema)
    meta = stored.agg(F.count("*").alias("chunks")).withColumn("model", F.lit(model)).withColumn("has_vectors", F.lit(vectors is not None))
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/index_meta.json")


def read(spark: SparkSession, folder: str, documents_schema: str, chunks_schema: str) -> Index | None:
    """The index of a folder; None if it has no metadata or texts, and no vectors if these are missing."""
    folder = folder.rstrip("/")
    if not all(exists(spark, f"{folder}/{part}") for part in ("index_meta.json", "documents.jsonl", "chunks.jsonl")):
        return None
    (meta,) = spark.read.schema("chunks long, model string, has_vectors boolean").json(f"{folder}/index_meta.json").collect()
    vectors = spark.read.parquet(f"{folder}/vectors.parquet") if meta["has_vectors"] and exists(spark, f"{folder}/vectors.parquet") else None
    documents, chunks = (spark.read.schema(schema).json(f"{folder}/{part}.jsonl") for schema, part in ((documents_schema, "documents"), (chunks_schema, "chunks")))
    return Index(documents, chunks, vectors, meta.asDict())
