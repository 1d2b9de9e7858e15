"""Readers of the engine's file inputs, all through Spark's own sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.catalog import aliases
from tallyspark.functions.scalars import first_parenthesis, normalised_text, stable_id, stock_code, text

BOM = "﻿"


def csv_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header: names without byte-order mark, cells trimmed, nulls empty, all text; multi-line cells are whole."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.select(*[F.trim(text(F.col(f"`{c}`"))).alias(c.lstrip(BOM).strip()) for c in df.columns])


def named(df: DataFrame, prefix: str) -> str:
    """The column whose name begins so."""
    return next(c for c in df.columns if c.startswith(prefix))


def field_registry(spark: SparkSession, paths: dict[str, str], dimensions: tuple[str, ...]) -> DataFrame:
    """Field rows of the metadata files by table: name, label, type, unit, aliases, whether a dimension."""
    out = None
    for table, path in paths.items():
        df = csv_table(spark, path)
        label = F.col("中文名称")
        rows = df.where(F.col("字段名称") != "").select(
            F.lit(table).alias("table_name"),
            F.col("字段名称").alias("field_name"),
            label.alias("chinese_name"),
            F.col(named(df, "字段类型")).alias("data_type"),
            first_parenthesis(label).alias("unit"),
            aliases(F.col("字段名称"), label).alias("aliases"),
            F.col("字段名称").isin(*dimensions).alias("is_dimension"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def company_registry(spark: SparkSession, path: str) -> DataFrame:
    """Companies by normalised code; rows without one are left out, of several rows of a code the last in the file stays."""
    df = csv_table(spark, path).withColumn("_at", F.monotonically_increasing_id())
    rows = df.select(stock_code(F.col("股票代码")).alias("stock_code"), F.col("A股简称").alias("stock_abbr"), F.col("公司名称").alias("company_name"), F.col("上市交易所").alias("exchange"), F.col("所属证监会行业").alias("industry"), "_at").where("stock_code <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("_at")))).where("_n = 1").drop("_n", "_at")


def report_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, stem, text`` of all markdown files below a folder."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    plain = lambda c: F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))  # noqa: E731  names come as parts of an address
    return df.select(plain("_metadata.file_path").alias("path"), F.regexp_extract(plain("_metadata.file_name"), r"^(.*)\.md$", 1).alias("stem"), F.col("value").alias("text"))


def report_metadata(spark: SparkSession, path: str, report_type: str) -> DataFrame:
    """Metadata of research reports by normalised title, the last row of a title staying; absent columns fall back to others."""
    df = csv_table(spark, path).withColumn("_at", F.monotonically_increasing_id())

    def column(*names: str):
        return next((F.col(n) for n in names if n in df.columns), F.lit(""))

    rows = df.select(
        normalised_text(column("title")).alias("title_key"),
        column("title").alias("title"),
        F.lit(report_type).alias("report_type"),
        column("stockName").alias("stock_name"),
        stock_code(column("stockCode")).alias("stock_code"),
        column("orgName", "orgSName").alias("org_name"),
        F.substring(column("publishDate"), 1, 10).alias("publish_date"),
        column("industryName", "indvInduName").alias("industry_name"),
        column("emRatingName", "sRatingName").alias("rating"),
        "_at",
    )
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("title_key").orderBy(F.desc("_at")))).where("_n = 1").drop("_n", "_at")


def research_documents(texts: DataFrame, title: str, stock: DataFrame, industry: DataFrame) -> DataFrame:
    """Reports with the metadata of their title, else of their file's stem; stock metadata go before industry ones."""
    keep = stock.columns[1:]
    both = stock.withColumn("_p", F.lit(0)).unionByName(industry.withColumn("_p", F.lit(1)))
    meta = both.withColumn("_n", F.row_number().over(Window.partitionBy("title_key").orderBy("_p"))).where("_n = 1").select("title_key", F.struct(*keep).alias("meta"))
    by_title = meta.select(F.col("title_key").alias("_t"), F.col("meta").alias("_mt"))
    by_stem = meta.select(F.col("title_key").alias("_s"), F.col("meta").alias("_ms"))
    met = texts.join(by_title, normalised_text(F.col(title)) == F.col("_t"), "left").join(by_stem, normalised_text(F.col("stem")) == F.col("_s"), "left")
    found = F.coalesce("_mt", "_ms")
    return met.select(stable_id(F.col("path"), F.col(title)).alias("doc_id"), "path", F.col(title).alias("doc_title"), "text", *[found[c].alias(c) for c in keep])


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; a missing path is an empty table."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """``id, kind, turn, question``: a row for each question of the JSON array in a cell, counted from 1."""
    return asked_questions(csv_table(spark, path))


def asked_questions(df: DataFrame) -> DataFrame:
    """The rows of a question set with the JSON array of questions taken apart; empty questions are left out."""
    parsed = F.from_json("问题", "array<struct<Q:string>>")
    rows = df.select(F.col("编号").alias("id"), F.col("问题类型").alias("kind"), F.posexplode(parsed).alias("at", "q"))
    return rows.select("id", "kind", (F.col("at") + 1).alias("turn"), F.trim("q.Q").alias("question")).where("question <> ''")


def golden_set(spark: SparkSession, path: str, confirmed_only: bool = False) -> DataFrame:
    """``qid, question, doc_id``: a row for each relevant document of the golden questions."""
    df = json_lines(spark, path, "id string, question string, relevant_docs array<struct<doc_id:string,title:string>>, confirmed boolean")
    df = df.where("confirmed") if confirmed_only else df
    return df.where(F.size("relevant_docs") > 0).select(F.col("id").alias("qid"), "question", F.explode("relevant_docs.doc_id").alias("doc_id"))


def evidence_questions(questions: DataFrame, words: str, excluded: str = "数据校验", many: str = "多意图") -> DataFrame:
    """First questions of each id, without checks of data; those of many intents only if an evidence word occurs."""
    kept = questions.where(~F.col("kind").contains(excluded) & (~F.col("kind").contains(many) | F.col("question").rlike(words)))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("turn"))).where("_n = 1").drop("_n")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, sha256, content`` of files below a folder, found recursively."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def markdown_in_zip(data: bytes) -> str | None:
    """The markdown of a parser's archive: one named full or auto before the first other; None without any."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [n for n in archive.namelist() if n.lower().endswith(".md")]
        if not names:
            return None
        chosen = min(range(len(names)), key=lambda i: (not (names[i].lower().endswith("full.md") or "auto" in names[i].lower()), i))
        return archive.read(names[chosen]).decode("utf-8", "ignore")


def zipped_markdown(files: DataFrame) -> DataFrame:
    """``path, text`` of archives (``path, content``); a broken archive has a null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for data in f["content"]:
                try:
                    texts.append(markdown_in_zip(data))
                except zipfile.BadZipFile:
                    texts.append(None)
            yield pd.DataFrame({"path": f["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def page_ranges(docs: DataFrame, pages: str, most: int = 200) -> DataFrame:
    """``first_page, last_page`` of the parts in which a long document is read."""
    starts = F.sequence(F.lit(1), F.greatest(F.col(pages), F.lit(1)), F.lit(most))
    return docs.select("*", F.explode(starts).alias("first_page")).withColumn("last_page", F.least(F.col("first_page") + most - 1, F.greatest(F.col(pages), F.lit(1))))
