"""Writers: keyed merges and rebuilds on Parquet folders, which never overwrite what they read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.facts import merged
from tallyspark.operators.lineage import numbered


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file of the driver's."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there; one that a broken replacement had put aside is put back first."""
    fs, p = _file_system(spark, path)
    if fs.exists(p):
        return True
    kept = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-*"))
    return bool(kept) and fs.rename(max(kept, key=lambda x: x.getModificationTime()).getPath(), p)


def replace_folder(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes beside the folder and then takes its place, so ``df`` may read the folder itself."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(fresh)
    fs, p = _file_system(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise OSError(f"could not put {path} aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), p):
        if had:
            fs.rename(old, p)
        raise OSError(f"could not put the new rows at {path}")
    if had:
        fs.delete(old, True)


def upsert(fresh: DataFrame, path: str, keys: list[str], keep_nulls: bool = True, partition_by: list[str] | None = None) -> None:
    """Merge by key; ``keep_nulls`` overwrites with nulls too, without it a null keeps what is stored."""
    spark = fresh.sparkSession
    out = merged(spark.read.parquet(path), fresh, keys, keep_nulls) if recovered(spark, path) else fresh
    replace_folder(out, path, partition_by)


def rebuild_runs(fresh: DataFrame, path: str, run: str = "run_id") -> None:
    """Replaces the partitions of the runs in ``fresh`` and leaves the others: running it again changes nothing."""
    writer = fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run)
    writer.parquet(path)


def with_ids(fresh: DataFrame, current: DataFrame | None, id_col: str, order: list[str]) -> DataFrame:
    """Numbers new rows after the highest stored id, in a stated order."""
    top = 0 if current is None else current.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return numbered(fresh, order, id_col).withColumn(id_col, (F.col(id_col) + F.lit(top + 1)).cast("long"))


def mapping_log(facts: DataFrame) -> DataFrame:
    """How each fact came about: by a formula or by a label."""
    method = F.when(F.col("is_derived"), "derived_formula").otherwise("deterministic_alias")
    return facts.select("target_table", "target_field", "source_label", method.alias("method"), "derivation_formula", "confidence")


def with_metadata(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A JSON column with one more key, which replaces an older one."""
    kind = "map<string,string>"
    old = F.coalesce(F.from_json(column, kind), F.from_json(F.lit("{}"), kind))
    return df.withColumn(column, F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))))


def markdown_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a markdown table, header first: ``line_no, line``."""
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + " --- |" * len(columns))], "line_no long, line string")
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    body = df.select(F.monotonically_increasing_id().alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body).orderBy("line_no")


def file_report(df: DataFrame, path: str, columns: list[str], kind: str) -> None:
    """A report as CSV with a header, as JSON lines, or as lines of text (markdown, or plain with a bar for shares)."""
    if kind == "csv":
        df.select(*columns).write.mode("overwrite").csv(path, header=True)
    elif kind == "json":
        df.select(*columns).write.mode("overwrite").json(path)
    elif kind == "markdown":
        markdown_report(df, columns).select("line").write.mode("overwrite").text(path)
    elif kind == "text":
        df.select(F.concat_ws("  ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("line")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind of report: {kind}")


def progress(done: Column, total: Column, width: int = 20) -> Column:
    """A bar of ``width`` signs and the percentage; all of nothing is nothing."""
    share = F.coalesce(F.try_divide(done.cast("double"), total.cast("double")), F.lit(0.0))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    full = F.floor(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full), F.lit("] "), F.format_number(share * 100, 1), F.lit("%"))
