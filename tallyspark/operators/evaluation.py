"""Metrics of retrieval, parsing and agents, and the upkeep of label sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(found: DataFrame, golden: DataFrame, k: int, q_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """One row: ``questions, hit_rate, recall, mrr`` at k. ``golden`` has a row for each relevant document."""
    wanted = golden.select(q_id, id_col).distinct()
    # rank of a document: the best of its chunks, chunks of one document counting once
    first = found.groupBy(q_id, id_col).agg(F.min("rank").alias("r"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy(q_id).orderBy("r"))).where(F.col("place") <= k)
    hits = wanted.join(place, [q_id, id_col], "left").groupBy(q_id).agg(F.count("*").alias("n"), F.count("place").alias("hit"), F.min("place").alias("best"))
    return hits.agg(
        F.count("*").alias("questions"),
        F.round(F.avg((F.col("hit") > 0).cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
    )


def coarse_recall(channels: dict[str, DataFrame], golden: DataFrame, ks: tuple[int, ...], q_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """``fusion, k, recall``: mean share of the relevant documents among the first k rows of each way of fusing."""
    wanted = golden.select(q_id, id_col).distinct()
    sizes = wanted.groupBy(q_id).agg(F.count("*").alias("n"))
    hits = None
    for name, found in channels.items():
        best = found.groupBy(q_id, id_col).agg(F.min("rank").alias("r")).join(wanted, [q_id, id_col])
        part = best.select(q_id, F.lit(name).alias("fusion"), "r")
        hits = part if hits is None else hits.unionByName(part)
    counted = hits.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).groupBy("fusion", "k", q_id).agg(F.count_if(F.col("r") <= F.col("k")).alias("hit"))
    grid = F.explode(F.array(*[F.struct(F.lit(name).alias("fusion"), F.lit(k).alias("k")) for name in channels for k in ks])).alias("g")
    whole = sizes.select(q_id, "n", grid).select(q_id, "n", "g.fusion", "g.k").join(counted, [q_id, "fusion", "k"], "left")
    return whole.groupBy("fusion", "k").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)) / F.col("n")), 6).alias("recall"))


def judging_batches(pool: DataFrame, size: int = 8, q_id: str = "qid", order: str = "rank") -> DataFrame:
    """Candidates with the ``batch`` of a question in which a judge gets them, counted from 0."""
    place = F.row_number().over(Window.partitionBy(q_id).orderBy(order))
    return pool.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def recall_ceiling(golden: DataFrame, k: int, quota: int, q_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """Highest recall that k rows can reach when each document takes up to ``quota`` of them."""
    room = k // quota if quota > 0 else 1
    n = golden.groupBy(q_id).agg(F.count_distinct(id_col).alias("n"))
    return n.agg(F.round(F.avg(F.least(F.lit(room), F.col("n")) / F.col("n")), 6).alias("ceiling"))


def effective_quota(*quotas: Column) -> Column:
    """Smallest positive quota, 0 if none is."""
    positive = [F.when(q > 0, q) for q in quotas]
    return F.coalesce(F.least(*positive) if len(positive) > 1 else positive[0], F.lit(0))


#: P(X <= k) of a Poisson distribution of mean 1, as far as a number of 32 bits can tell.
POISSON_ONE = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13))


def bootstrap_interval(values: DataFrame, value: str, key: str, rounds: int = 2000, alpha: float = 0.05, seed: int = 20260807) -> DataFrame:
    """Percentile interval of the mean: ``low, high``; nulls without values.

    A Poisson bootstrap: in each round a row counts as often as the inverse distribution of mean 1 says at
    a number hashed from seed, round and key, so it repeats exactly, nothing is joined, and each task
    sums up all rounds before anything is shuffled. Rows of one key are drawn together.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(key).cast("string").alias("_key"))
    drawn = rows.select("v", "_key", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    tag = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.coalesce("_key", F.lit(""))).cast("binary"))
    drawn = drawn.select("round", "v", (F.conv(F.substring(tag, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))).alias("u"))
    times = sum(F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON_ONE)
    means = drawn.select("round", "v", times.alias("n")).groupBy("round").agg((F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("m")).where("m is not null")
    placed = means.withColumn("p", F.row_number().over(Window.orderBy("m", "round")))
    at = lambda q: max(1, min(rounds, int(q * rounds)))
    pick = lambda q, name: F.round(F.max(F.when(F.col("p") == at(q), F.col("m"))), 6).alias(name)
    return placed.agg(pick(alpha / 2, "low"), pick(1 - alpha / 2, "high"))


def crosstab(rows: DataFrame, status: str, kind: str) -> DataFrame:
    """Counts by status and kind with totals, null where a column is summed over."""
    return rows.rollup(status, kind).agg(F.count("*").alias("n"))


def blind_pairs(pairs: DataFrame, key: str, a: str, b: str, seed: int) -> DataFrame:
    """Adds ``swapped`` and what a judge sees first and second: half of the pairs, by a hash of seed and key, are turned around."""
    tag = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    out = pairs.withColumn("swapped", F.conv(F.substring(tag, 1, 1), 16, 10).cast("int") >= 8)
    return out.withColumn("first", F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))).withColumn("second", F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b)))


def whole_judgements(judged: DataFrame, reply: str = "reply", q_id: str = "qid") -> DataFrame:
    """Judgements of the questions of which every batch has a reply: a batch that failed isn't one that found nothing."""
    failed = F.max(F.col(reply).isNull().cast("int")).over(Window.partitionBy(q_id))
    return judged.withColumn("_failed", failed).where("_failed = 0").drop("_failed")


def win_rates(verdicts: DataFrame, by: str | None = None) -> DataFrame:
    """``total, wins, ties, losses, win_rate``; a verdict that can't be read is a tie. ``swapped`` turns A and B around."""
    winner = F.when(F.col("swapped") & (F.col("verdict") == "A"), "B").when(F.col("swapped") & (F.col("verdict") == "B"), "A").otherwise(F.col("verdict"))
    v = verdicts.withColumn("winner", winner)
    grouped = v.groupBy(by) if by else v.groupBy()
    out = grouped.agg(F.count("*").alias("total"), F.count_if(F.col("winner") == "A").alias("wins"), F.count_if(F.col("winner") == "B").alias("losses"))
    return out.withColumn("ties", F.col("total") - F.col("wins") - F.col("losses")).withColumn("win_rate", F.round(F.try_divide("wins", "total"), 6))


def slot_differences(expected: DataFrame, actual: DataFrame, slots: list[str], key: str = "id") -> DataFrame:
    """``id, differs``: names of the slots whose sets of values differ; a missing answer differs in all."""
    same = lambda s: F.array_sort(F.array_distinct(F.coalesce(f"e.{s}", F.array()))) == F.array_sort(F.array_distinct(F.coalesce(f"a.{s}", F.array())))
    met = expected.alias("e").join(actual.alias("a"), F.col(f"e.{key}") == F.col(f"a.{key}"), "left")
    differs = F.filter(F.array(*[F.when(F.col(f"a.{key}").isNull() | ~same(s), F.lit(s)) for s in slots]), lambda x: x.isNotNull())
    return met.select(F.col(f"e.{key}").alias(key), differs.alias("differs"))


def match_rates(compared: DataFrame, variant: str) -> DataFrame:
    """Share without differing slots by variant, and for all (null)."""
    return compared.rollup(variant).agg(F.count("*").alias("total"), F.count_if(F.size("differs") == 0).alias("matched")).withColumn("rate", F.round(F.col("matched") / F.col("total"), 6))


def executability(questions: DataFrame, n_rows: str, error: str, clarification: str, executed: str) -> Column:
    """Status of a question from what came of it."""
    return (
        F.when(F.col(error).isNotNull(), "error")
        .when(F.col(clarification), "clarification")
        .when(~F.col(executed), "sql_built")
        .when(F.col(n_rows) > 0, "ok_nonempty")
        .otherwise("ok_empty")
    )


def merged_labels(old: DataFrame, new: DataFrame, key: str = "qid", labels: str = "relevant") -> DataFrame:
    """New label lists over old ones by question; empty lists drop a question."""
    both = old.select(key, labels, F.lit(0).alias("_p")).unionByName(new.select(key, labels, F.lit(1).alias("_p")))
    top = both.groupBy(key).agg(F.max_by(labels, "_p").alias(labels))
    return top.where(F.size(labels) > 0)


def shortlist(pool: DataFrame, confirmed: DataFrame, n: int, q_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """Confirmed documents of the pool, then its first ``n`` others, then confirmed ones outside it: ``qid, id, part``."""
    own = confirmed.select(q_id, id_col, F.lit(True).alias("_c")).distinct()
    marked = pool.join(own, [q_id, id_col], "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    place = F.row_number().over(Window.partitionBy(q_id, "_c").orderBy("rank", id_col))
    inside = marked.withColumn("_n", place).where(F.col("_c") | (F.col("_n") <= n)).select(q_id, id_col, F.when(F.col("_c"), "confirmed").otherwise("candidate").alias("part"))
    outside = own.join(pool.select(q_id, id_col), [q_id, id_col], "left_anti").select(q_id, id_col, F.lit("outside").alias("part"))
    return inside.unionByName(outside)


def judge_counts(judged: DataFrame, confirmed: DataFrame, pool: DataFrame, q_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """Labels of a judge against confirmed ones: ``hits, extra, missed, not_in_pool`` by question."""
    a, b, p = (x.select(q_id, id_col).distinct() for x in (judged, confirmed, pool))
    met = a.withColumn("j", F.lit(1)).join(b.withColumn("c", F.lit(1)), [q_id, id_col], "full_outer").join(p.withColumn("p", F.lit(1)), [q_id, id_col], "left")
    return met.groupBy(q_id).agg(
        F.count_if(F.col("j").isNotNull() & F.col("c").isNotNull()).alias("hits"),
        F.count_if(F.col("c").isNull()).alias("extra"),
        F.count_if(F.col("j").isNull()).alias("missed"),
        F.count_if(F.col("c").isNotNull() & F.col("p").isNull()).alias("not_in_pool"),
    )


def field_report(catalogue: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Every field of the catalogue, ``covered`` with its value or ``missing``."""
    out = catalogue.join(chosen, keys, "left")
    return out.withColumn("coverage", F.when(F.col("standard_value").isNotNull(), "covered").otherwise("missing"))


def coverage_summary(report: DataFrame, by: str) -> DataFrame:
    out = report.groupBy(by).agg(F.count_if(F.col("coverage") == "covered").alias("covered"), F.count("*").alias("total"))
    return out.withColumn("percent", F.round(F.col("covered") * 100.0 / F.col("total"), 6))
