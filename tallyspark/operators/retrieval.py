"""Retrieval over chunks: BM25, dense vectors, fusion, filters, quotas, reranking; many questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import snippet, text
from tallyspark.operators.lineage import materialised

# Okapi constants, fusion constants and pool sizes.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
BM25_WEIGHT, VECTOR_WEIGHT = 0.45, 0.55
COARSE_POOL = 200
#: Vectors that a task holds while questions stream by.
VECTOR_BLOCK = 16_384


def tokens(c: Column, cjk: bool = True) -> Column:
    """Lower-case ASCII words and, for Chinese, pairs of neighbouring characters (single ones where they stand alone)."""
    low = F.lower(text(c))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0))
    if not cjk:
        return words
    runs = F.when(low.rlike(r"[\x{4e00}-\x{9fff}]"), F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.concat(words, F.flatten(pairs))


def search_text(*parts: Column) -> Column:
    """Fields of a chunk for a channel, empty ones left out, by line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def postings(chunks: DataFrame, id_col: str, text_col: str, cjk: bool = True) -> DataFrame:
    """``id, token, tf, dl``: counts of each token and the length of its chunk."""
    listed = chunks.select(F.col(id_col), tokens(F.col(text_col), cjk).alias("t")).withColumn("dl", F.size("t"))
    return listed.select(id_col, "dl", F.explode("t").alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(chunks: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", q_id: str = "qid", q_text: str = "question", cjk: bool = True, tokeniser: Callable[[Column], Column] | None = None) -> DataFrame:
    """``qid, id, score, rank``: the k best chunks of each question with a positive score, ties by id.

    Only postings of question tokens are counted, shuffled and written, once: the questions' distinct
    tokens cut the tokens down where they are read. A token of the question counts as often as it occurs there.
    """
    cut = tokeniser or (lambda c: tokens(c, cjk))
    asked = questions.select(q_id, F.explode(cut(F.col(q_text))).alias("token")).where("token <> ''").groupBy(q_id, "token").agg(F.count("*").alias("qf"))
    # texts are tokenised once: a row without a token stands for the chunk itself, so that its length counts too
    listed = chunks.select(F.col(id_col), cut(F.col(text_col)).alias("t")).select(id_col, F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("token"))
    wanted = asked.select("token").union(chunks.sparkSession.createDataFrame([("",)], "token string")).distinct()
    counted = materialised(listed.join(wanted, "token", "left_semi").groupBy(id_col, "token", "dl").agg(F.count("*").alias("tf")))
    sizes = counted.where("token = ''").agg(F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("dl")) / F.sum("tf"))
    needed = counted.where("token <> ''")
    frequency = needed.groupBy("token").agg(F.count("*").alias("df"))
    n, avgdl = sizes.first()
    if not n or not avgdl:
        return asked.join(needed, "token").select(q_id, id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl))))
    scored = needed.join(frequency.withColumn("idf", idf), "token").join(asked, "token").groupBy(q_id, id_col).agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scored.where("score > 0"), k, q_id, id_col)


def ranked(scored: DataFrame, k: int | None, q_id: str = "qid", id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """``rank`` from 1 by score, ties by id; the first ``k`` of each question."""
    best = Window.partitionBy(q_id).orderBy(F.col(score).desc(), F.col(id_col))
    out = scored.withColumn("rank", F.row_number().over(best))
    return out if k is None else out.where(F.col("rank") <= k)


def relative(found: DataFrame, q_id: str = "qid") -> DataFrame:
    """Scores as shares of the question's highest."""
    return found.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(q_id)))


def keyword_overlap(chunks: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", q_id: str = "qid", q_text: str = "question") -> DataFrame:
    """The k chunks that share most distinct tokens of more than one character with the question: a fallback for BM25."""
    long = lambda c: F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 1))
    a = chunks.select(id_col, F.explode(long(F.col(text_col))).alias("token"))
    b = questions.select(q_id, F.explode(long(F.col(q_text))).alias("token"))
    return ranked(a.join(b, "token").groupBy(q_id, id_col).agg(F.count("*").cast("double").alias("score")), k, q_id, id_col)


def dense(vectors: DataFrame, questions: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", q_id: str = "qid", q_vector: str = "q", block_rows: int = VECTOR_BLOCK) -> DataFrame:
    """``qid, id, score, rank``: the k best inner products, not below 0, with vectors of another id.

    Vectors are dealt by a hash into blocks, and the questions stream through each block in batches, so
    a task holds one block and one batch, and gives on the k best of each question with all that
    rounding makes equal to them. Null vectors and those of another length than the question's don't compare.
    """
    ids, q_ids = vectors.schema[id_col].dataType.simpleString(), questions.schema[q_id].dataType.simpleString()
    blocks = max(1, -(-vectors.count() // block_rows))
    parts = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n))
    held = vectors.select(F.col(id_col).alias("_id"), F.lit(None).cast(q_ids).alias("_q"), F.col(vector_col).cast("array<double>").alias("_v"), own(id_col, blocks, 1).alias("_block"), every(parts).alias("_part"))
    asks = questions.select(F.lit(None).cast(ids).alias("_id"), F.col(q_id).alias("_q"), F.col(q_vector).cast("array<double>").alias("_v"), every(blocks).alias("_block"), own(q_id, parts, 2).alias("_part"))
    dealt = held.where("_id is not null and _v is not null").union(asks.where("_q is not null and _v is not null")).withColumn("_block", F.col("_block") * parts + F.col("_part")).drop("_part")
    dealt = dealt.repartition("_block").sortWithinPartitions("_block", F.col("_q").asc_nulls_first())

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting, tables = None, [], {}
        for f in frames:
            f["_w"] = f["_v"].map(len)
            for block, g in f.groupby("_block", sort=True):
                if block != now:
                    now, waiting, tables = block, [], {}
                asked = g["_q"].notna()
                if not asked.all():
                    waiting.append(g[~asked])
                if not asked.any():
                    continue
                if waiting:
                    own_rows = pd.concat(waiting)
                    tables = {w: (h["_id"].to_numpy(), np.stack(h["_v"].to_list())) for w, h in own_rows.groupby("_w")}
                    waiting = []
                for w, h in g[asked].groupby("_w"):
                    if w not in tables:
                        continue
                    names, table = tables[w]
                    for at in range(0, len(h), 64):
                        part = h.iloc[at : at + 64]
                        score = np.stack(part["_v"].to_list()) @ table.T
                        score[part["_q"].to_numpy()[:, None] == names[None, :]] = -np.inf
                        if len(names) > k:
                            floor = np.partition(score, -k, axis=1)[:, -k] - 2e-6
                            # at 0 and below all scores are equal and the smaller ids go first
                            low = np.where(floor <= 1e-6, -np.inf, floor)
                        else:
                            low = np.full(len(part), -np.inf)
                        i, j = np.nonzero((score >= low[:, None]) & (score > -np.inf))
                        yield pd.DataFrame({q_id: part["_q"].to_numpy()[i], id_col: names[j], "score": score[i, j]})

    met = dealt.mapInPandas(search, f"`{q_id}` {q_ids}, `{id_col}` {ids}, score double")
    return ranked(met.withColumn("score", F.greatest(F.round("score", 6), F.lit(0.0))), k, q_id, id_col)


def fused(channels: dict[str, DataFrame], how: str = "rrf", q_id: str = "qid", id_col: str = "doc_id", rrf_k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """``qid, id, score, score_detail, rank``: channels (``qid, id, score, rank``) fused by reciprocal rank or by weighted score."""
    weights = weights or {"bm25": BM25_WEIGHT, "vector": VECTOR_WEIGHT}
    rows = None
    for name, found in channels.items():
        share = F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank")) if how == "rrf" else F.lit(float(weights.get(name, 0))) * F.col("score")
        part = found.select(q_id, id_col, F.lit(name).alias("channel"), share.alias("share"), "score")
        rows = part if rows is None else rows.unionByName(part)
    detail = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score"))))
    scored = rows.groupBy(q_id, id_col).agg(F.round(F.sum("share"), 9).alias("score"), detail.alias("score_detail"))
    return ranked(scored, None, q_id, id_col)


def quota(found: DataFrame, most: int, q_id: str = "qid", group: str = "doc_id") -> DataFrame:
    """The first ``most`` rows of each document in rank order, ranked anew; 0 or less keeps all."""
    if most <= 0:
        return found
    within = Window.partitionBy(q_id, group).orderBy("rank")
    kept = found.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(q_id).orderBy("rank")))


def matching(found: DataFrame, codes: list[str] | None = None, industry: str | None = None, report_type: str | None = None) -> DataFrame:
    """Rows that fulfil every given condition; within codes one suffices, an industry may be a part of the name."""
    out = found
    if codes:
        out = out.where(F.col("stock_code").isin(*codes))
    if industry:
        out = out.where(F.col("industry_name").contains(industry))
    if report_type:
        out = out.where(F.col("report_type") == report_type)
    return out


def filtered_else_all(found: DataFrame, condition: Column, q_id: str = "qid") -> DataFrame:
    """Rows of a question that fulfil the condition, or all of them where none does."""
    any_fits = F.max(F.coalesce(condition, F.lit(False)).cast("int")).over(Window.partitionBy(q_id))
    return found.withColumn("_any", any_fits).where((F.col("_any") == 0) | F.coalesce(condition, F.lit(False))).drop("_any")


def reranked(found: DataFrame, score: Callable[[DataFrame], DataFrame] | None, k: int, q_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """The first k by a reranker's score (``qid, id, rerank``); without one the coarse order stays."""
    if score is None:
        return found.where(F.col("rank") <= k)
    scored = found.join(score(found), [q_id, id_col], "left").withColumn("coarse", F.col("rank"))
    best = Window.partitionBy(q_id).orderBy(F.col("rerank").desc_nulls_last(), "coarse")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("coarse")


def pool_sizes(top_k: int, rerank: bool, filtered: bool, coarse: int = COARSE_POOL, candidates: int = 30) -> tuple[int, int]:
    """How many candidates go to the reranker and how many a channel gives."""
    first = max(top_k, candidates) if rerank else top_k
    pool = max(first, coarse)
    return first, pool * 3 if filtered else pool


def interleaved(channels: list[DataFrame], q_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """Channels taken in turns by rank, each row once at its first place: ``qid, id, rank``."""
    rows = None
    for i, found in enumerate(channels):
        part = found.select(q_id, id_col, F.struct("rank", F.lit(i).alias("channel")).alias("turn"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(q_id, id_col).agg(F.min("turn").alias("turn"))
    return first.select(q_id, id_col, F.row_number().over(Window.partitionBy(q_id).orderBy("turn", id_col)).alias("rank"))


def hybrid(chunks: DataFrame, questions: DataFrame, top_k: int = 8, per_document: int = 2, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "text", vector: DataFrame | None = None, how: str = "rrf", condition: Column | None = None) -> DataFrame:
    """Candidates of both channels fused, then filtered, then cut by document quota and ``top_k``."""
    _, pool = pool_sizes(top_k, False, condition is not None)
    channels = {"bm25": bm25(chunks, questions, pool, id_col, text_col)}
    if vector is not None:
        channels["vector"] = vector
    found = fused(channels, how, id_col=id_col).join(chunks.drop(text_col), id_col)
    if condition is not None:
        found = found.where(condition)
    return quota(found, per_document, group=doc_col).where(F.col("rank") <= top_k)


def evidence(found: DataFrame, text_col: str, most: int = 5, size: int = 160, q_id: str = "qid") -> DataFrame:
    """The first ``most`` rows of a question, each text as a snippet of ``size`` characters."""
    return found.where(F.col("rank") <= most).withColumn(text_col, snippet(F.col(text_col), size))
