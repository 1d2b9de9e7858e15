"""Cutting long plans: what several later steps read is written once to the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, on one machine (tests) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/") if folder else tempfile.mkdtemp(prefix="tallyspark-")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` from the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, without bringing all rows to one task.

    Rows are sorted into ranges and written; a range counts from the number of rows before it, which
    is known from one row a range. Rows equal in ``order`` share a range and stand in any order.
    """
    ranged = materialised(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_at", within).join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
