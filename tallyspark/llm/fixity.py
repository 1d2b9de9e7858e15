"""Merkle fixity audit of archived records: compare replicas from the roots down, along mismatches only.

A leaf is a record with its range of bytes in its file. A node hashes the places, ranges and hashes of its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import checkpointed

#: Children of a node.
FANOUT = 16


def warc_record(url: Column, record: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text; null parts count as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def laid_out(records: DataFrame, file: Column, order: list[str], content: Column, id_col: str) -> DataFrame:
    """Leaves of an archive: ``file, ordinal, record_id, offset, length, hash``.

    Records of a file lie one after the other in ``order``; repeated rows are records of their own,
    told apart by their hash. A file must be small enough for one task, as archive files are.
    """
    leaves = records.select(
        file.cast("long").alias("file"),
        F.col(id_col).cast("long").alias("record_id"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.octet_length(content).cast("long").alias("length"),
        F.sha2(content.cast("binary"), 256).alias("hash"),
    )
    along = Window.partitionBy("file").orderBy(*[f"_o{i}" for i in range(len(order))], "hash")
    return leaves.select(
        "file",
        (F.row_number().over(along) - 1).cast("long").alias("ordinal"),
        "record_id",
        (F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        "length",
        "hash",
    )


def parents(nodes: DataFrame, in_file: bool) -> DataFrame:
    """The level above: up to FANOUT neighbours in order, their places, ranges and hashes hashed together."""
    key, ordinal = (F.col("key"), F.floor(F.col("ordinal") / FANOUT)) if in_file else (F.floor(F.col("key") / FANOUT), F.col("ordinal"))
    child = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("key", "ordinal", "start", "length")], "hash").alias("child")
    grouped = nodes.groupBy("side", key.alias("key"), ordinal.alias("ordinal")) if in_file else nodes.groupBy("side", key.alias("key"), F.lit(0).cast("long").alias("ordinal"))
    up = grouped.agg(
        F.array_sort(F.collect_list(F.struct(F.col("key").alias("k"), F.col("ordinal").alias("o"), child))).alias("below"), F.min("start").alias("start"), F.sum("length").alias("length")
    )
    return up.select("side", "key", "ordinal", "start", "length", F.sha2(F.concat_ws("\n", F.col("below.child")), 256).alias("hash"))


def differing(nodes: DataFrame) -> DataFrame:
    """``key, ordinal`` of the nodes that the two sides don't have alike."""
    met = nodes.groupBy("key", "ordinal").agg(F.count("*").alias("n"), F.min("hash").alias("a"), F.max("hash").alias("b"))
    return met.where("n < 2 or a <> b").select(F.col("key").alias("_k"), F.col("ordinal").alias("_o"))


def mismatches(catalogue: DataFrame, replica: DataFrame) -> tuple[DataFrame, list[int]]:
    """Leaves of both sides (``side`` 0 and 1) under lowest branches that differ, and how many branches differ on each level from the root down.

    Both trees are built of their own side's layout alone: first within each file, then over the files
    in order. From the root down only the children of branches that differ are compared; equal roots end
    the audit. A null file is a file of its own before all others.
    """
    both = catalogue.withColumn("side", F.lit(0)).unionByName(replica.withColumn("side", F.lit(1)))
    low = both.agg(F.min("file")).first()[0] or 0
    both = checkpointed(both.withColumn("key", F.coalesce(F.col("file") - F.lit(low) + 1, F.lit(0).cast("long"))))
    longest, last = both.agg(F.max("ordinal"), F.max("key")).first()
    if longest is None:
        return both, []
    inner = outer = 1
    while longest >= FANOUT**inner:
        inner += 1
    while last >= FANOUT**outer:
        outer += 1
    levels = [both.select("side", "key", "ordinal", F.col("offset").alias("start"), "length", "hash")]
    for level in range(inner + outer):
        levels.append(checkpointed(parents(levels[-1], level < inner)))
    counts, branches = [], None
    for level in range(inner + outer, 0, -1):
        nodes = levels[level]
        if branches is not None:
            under = (F.col("key") == F.col("_k")) & (F.floor(F.col("ordinal") / FANOUT) == F.col("_o")) if level < inner else F.floor(F.col("key") / FANOUT) == F.col("_k")
            nodes = nodes.join(branches, under, "left_semi")
        branches = checkpointed(differing(nodes))
        counts.append(branches.count())
        if not counts[-1]:
            return both.limit(0), counts
    return both.join(branches, (F.col("key") == F.col("_k")) & (F.floor(F.col("ordinal") / FANOUT) == F.col("_o")), "left_semi"), counts


def audit(catalogue: DataFrame, replica: DataFrame) -> DataFrame:
    """Damage of a replica: ``file, record_id, offset, length, expected_hash, found_hash, status``.

    Both sides are leaves of ``laid_out``. Only what lies under branches that differ is looked at
    record by record. Records of one id, or of none, pair by equal content first, and of these
    one is moved if it lies in another file or, of the pairs within a file, at another place.
    What is left pairs by id and order and is altered. Then a record without a
    partner is missing, or on the replica's side repeated (its id is in the catalogue) or surplus.
    File and offset are the catalogue's; the last two have none, and an empty expected hash.
    """
    rows, _ = mismatches(catalogue, replica)
    by_content, by_id = (Window.partitionBy("side", *c).orderBy("key", "ordinal") for c in (["record_id", "hash"], ["record_id"]))
    rows = checkpointed(rows.withColumn("copy", F.row_number().over(by_content)))
    ours = rows.where("side = 0").drop("side")
    theirs = rows.where("side = 1").select(F.col("record_id").alias("_id"), F.col("hash").alias("_hash"), F.col("copy").alias("_copy"), F.col("key").alias("_key"), F.col("ordinal").alias("_ordinal"), F.col("length").alias("_length"))
    same = F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & (F.col("copy") == F.col("_copy"))
    pairs = ours.join(theirs, same)
    stays = F.col("key") == F.col("_key")
    ranks = [F.row_number().over(Window.partitionBy("key", "_key").orderBy(c)) for c in ("ordinal", "_ordinal")]
    moved = pairs.withColumn("_a", ranks[0]).withColumn("_b", ranks[1]).where(~stays | (F.col("_a") != F.col("_b")))
    left = ours.join(theirs, same, "left_anti").withColumn("side", F.lit(0)).withColumn("place", F.row_number().over(by_id)).drop("side")
    right = rows.where("side = 1").join(ours.select(F.col("record_id").alias("_id"), F.col("hash").alias("_hash"), F.col("copy").alias("_copy")), same, "left_anti")
    right = right.withColumn("_place", F.row_number().over(by_id)).select(F.col("record_id").alias("_id"), F.col("hash").alias("_hash"), F.col("length").alias("_length"), "_place")
    again = F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place"))
    damaged = left.join(right, again, "left")
    extra = right.join(left.select("record_id", "place"), again, "left_anti")
    listed = catalogue.join(extra.select("_id").distinct(), F.col("record_id").eqNullSafe(F.col("_id")), "left_semi").select("record_id", F.lit(True).alias("_listed")).distinct()
    extra = extra.join(listed, F.col("_id").eqNullSafe(F.col("record_id")), "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    columns = ["file", "record_id", "offset", "length", F.col("hash").alias("expected_hash")]
    nowhere = F.lit(None).cast("long")
    return (
        damaged.select(*columns, F.coalesce("_hash", F.lit("")).alias("found_hash"), F.when(F.col("_hash").isNull(), "missing").otherwise("altered").alias("status"))
        .union(moved.select(*columns, F.col("_hash"), F.lit("moved")))
        .union(extra.select(nowhere, F.col("_id"), nowhere, F.col("_length"), F.lit(""), F.col("_hash"), F.when(F.col("_listed"), "repeated").otherwise("surplus")))
    )
