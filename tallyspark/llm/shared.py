"""What several training-data operators need: lineage cutting and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset on one machine (tests) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tallyspark-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to go now, not when the driver next happens to collect its garbage."""
    for _ in range(2):  # what the first pass frees can hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by as many underscores as keep it apart from the columns of ``df`` in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src long, dst long")


#: A vertex with more neighbours than this is a hub, and there are not more hubs than that: fewer have so large a share of the edges.
HUB_EDGES, MOST_HUBS = 256, 20_000
#: So many edges (16 bytes each) are settled in one task; rounds over them would be thousands of all but empty tasks.
FEW_EDGES = 1 << 18


def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, component_id`` of the edges of all frames: each label takes the smallest one beside it until no edge has two."""
    edges = np.concatenate([np.empty((0, 2), np.int64), *(f.to_numpy() for f in frames)])
    nodes, ends = np.unique(edges, return_inverse=True)
    src, dst = ends.reshape(-1, 2).T
    low = np.arange(len(nodes))
    while (low[src] != low[dst]).any():
        a, b = low[src], low[dst]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
    yield pd.DataFrame({"node": nodes, "component_id": nodes[low]})


def components(edges: DataFrame, max_rounds: int = 60, few_edges: int = FEW_EDGES) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge: columns ``node, component_id``.

    ``edges`` has ``src`` and ``dst`` (long); direction, loops and repeats don't matter, an edge with a
    null end is ignored. Alternating large-star and small-star rounds: each is one partially
    aggregated minimum per vertex and one join back on the vertex. The minima of hubs are broadcast to
    their edges, so a vertex with very many neighbours never meets them in one task. Rounds are
    checkpointed; only two numbers a round (rows and a checksum) reach the driver. Up to ``few_edges``
    edges are settled in one task instead.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    current = checkpointed(pairs.distinct())
    before, rows = None, current.count()
    if rows <= few_edges:
        return current.coalesce(1).mapInPandas(settled, "node long, component_id long")
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n"))
        least = least.select(F.col("src").alias("hub"), F.least("src", "low").alias("low"), (F.col("n") > max(HUB_EDGES, 2 * rows // MOST_HUBS)).alias("is_hub"))
        hubs = F.broadcast(least.where("is_hub").select(F.col("hub").alias("_hub"), F.col("low").alias("_low")))
        up = both.where("dst > src").join(hubs, F.col("src") == F.col("_hub"), "left")
        few = up.where("_hub is null").join(least.where("not is_hub"), F.col("src") == F.col("hub")).select("dst", "low")
        large = up.where("_hub is not null").select("dst", "_low").union(few).toDF("src", "dst").where("src <> dst").distinct()
        large = checkpointed(large)
        floor = large.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("hub"), "low")
        small = (
            large.join(floor, F.col("src") == F.col("hub"))
            .select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        current = checkpointed(small)
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, rows = state, state[0]
        release(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), "low").select(
        "node", F.col("low").alias("component_id")
    ).union(current.select(F.col("dst").alias("node"), F.col("dst").alias("component_id")).distinct())
