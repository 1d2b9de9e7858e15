"""Poisson replication: mix sources to target weights by repeating each document a hashed number of times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import checkpointed, unused

#: The distributions of all sources are broadcast if they take so many bytes at most; beyond, Spark chooses the join.
BROADCAST_BYTES = 8 << 20


def uniform(id_col: str, seed: int) -> Column:
    """A number of [0, 1) from the id and the seed alone: the first 32 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def log_factorial(k: Column) -> Column:
    """ln k!: exact up to 20, by Stirling's series beyond."""
    k = k.cast("double")
    tail = (k + 0.5) * F.log(k) - k + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * k) - 1 / (360 * k * k * k)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20.0)).cast("int")).cast("double"))).otherwise(tail)


def steps(rate: Column) -> tuple[Column, Column]:
    """The counts worth a look: what lies outside has a probability far below that of the smallest hashed number."""
    spread = 12 * F.sqrt(rate) + 30
    return F.greatest(F.lit(0), F.floor(rate - spread)).cast("long"), F.ceil(rate + spread).cast("long")


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """``_source, _first, _cdf``: P(X <= k) for k from ``_first`` on, to far beyond the mean; a rate of 0 gives P(X <= 0) = 1.

    One running sum a source, over some 24 times the root of the rate.
    """
    rate, k = F.col("_rate"), F.col("_k")
    first, last = steps(rate)
    mass = rates.select("_source", "_rate", F.explode(F.sequence(first, F.when(rate > 0, last).otherwise(first))).alias("_k"))
    mass = mass.withColumn("_p", F.when(rate > 0, F.exp(k * F.log(rate) - rate - log_factorial(k))).otherwise(F.lit(1.0)))
    along = Window.partitionBy("_source").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    sums = mass.withColumn("_c", F.sum("_p").over(along)).groupBy("_source").agg(F.array_sort(F.collect_list(F.struct("_k", "_c"))).alias("_steps"))
    return sums.select("_source", F.get("_steps", F.lit(0))["_k"].alias("_first"), F.col("_steps._c").alias("_cdf"))


def count_up_to(first: str, cdf: str, u: str) -> Column:
    """Smallest k with P(X <= k) > u: the place of u among the sums, found from the end so that equal ones come before it.

    A lambda that holds u must not stand here: in a new session its variable can get the number of a
    column of the table, and the optimizer then takes it to the wrong side of the join.
    """
    above = F.array_position(F.reverse(F.sort_array(F.array_append(cdf, F.col(u)))), F.col(u)) - 1
    return (F.col(first) + F.size(cdf) - above).cast("int")


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, exponent: float, total: float | None) -> DataFrame:
    """``_source, _rate`` for each source, null being one of them.

    ``weights`` are shares by source (others get 0; they needn't sum to 1); without them a source's
    weight is its row count to the power ``exponent``. ``total`` rows are aimed at, by default as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_n"))
    weight = F.pow(F.col("_n").cast("double"), F.lit(float(exponent)))
    if weights is not None:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("_source") == F.lit(name), F.lit(float(share))).otherwise(weight)
    n, rows, mass = counts.agg(F.count("*"), F.sum("_n"), F.sum(weight)).first()
    if not n or not mass:
        return counts.select("_source", F.lit(0.0).alias("_rate"))
    aim = float(rows if total is None else total)
    return counts.select("_source", (weight / F.lit(float(mass)) * F.lit(aim) / F.col("_n")).alias("_rate"))


def mix(
    docs: DataFrame, seed: int = 42, weights: dict[str, float] | None = None, exponent: float = 0.5, total: float | None = None, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy"
) -> DataFrame:
    """All columns of ``docs`` and ``copy_col`` (from 1), a row for each copy, in an order without sources.

    The number of copies is the inverse Poisson distribution of the source's rate at a number hashed
    from seed and id, so it is the same in every run; repeated ids repeat alike, a null id counts as
    the empty text. Each source's expected rows are its weight's share of the total. An existing
    column of the name ``copy_col`` is replaced.
    """
    rates = checkpointed(source_rates(docs, source_col, weights, exponent, total))
    source, first, cdf, u, times, order = unused(docs, "_source", "_first", "_cdf", "_u", "_times", "_order")
    low, high = steps(F.col("_rate"))
    size = rates.agg(F.sum(8.0 * (high - low) + 100.0)).first()[0] or 0.0
    table = checkpointed(poisson_cdf(rates).select(F.col("_source").alias(source), F.col("_first").alias(first), F.col("_cdf").alias(cdf)))
    table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != copy_col.lower()]
    drawn = docs.join(table, F.col(f"`{source_col}`").eqNullSafe(F.col(source))).withColumn(u, uniform(id_col, seed))
    drawn = drawn.withColumn(times, count_up_to(first, cdf, u)).where(F.col(times) > 0)
    copies = drawn.select(*keep, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy_col))
    place = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy_col))
    return copies.withColumn(order, place).repartition(order).sortWithinPartitions(order).drop(order)
