"""Exact top-k inner products on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an index segment.
SEGMENT_ROWS = 16_384
#: Scores of more bits than this could overflow.
SCORE_BITS = 62


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(scale * x.astype(np.float64))
    if len(out) and np.abs(out).max() >= 2.0**SCORE_BITS:
        raise OverflowError("a quantised component needs more than 62 bits")
    return out.astype(np.int64)


class SlicedSegment:
    """Bit slices of each attribute over rows sorted by id: bit r of slice (d, b) is bit b of row r's attribute d, less the attribute's minimum."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.rows, self.width = values.shape
        self.low = values.min(axis=0)
        shifted = (values - self.low).astype(np.uint64)
        self.bits = max(1, int(shifted.max()).bit_length())
        self.largest = float(np.abs(values).astype(np.float64).max())
        self.words = -(-self.rows // 64)
        packed = np.zeros((self.width, self.bits, self.words * 8), np.uint8)
        for b in range(self.bits):
            plane = ((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
            packed[:, b, : -(-self.rows // 8)] = np.packbits(plane, axis=1, bitorder="little")
        self.slices = packed.view(np.uint64)
        self.all = np.zeros(self.words * 8, np.uint8)
        self.all[: -(-self.rows // 8)] = np.packbits(np.ones(self.rows, np.uint8), bitorder="little")
        self.all = self.all.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the inner product shifted to be nonnegative.

        A slice of weight 2^(b+j) stands for each attribute bit b and query bit j; a negative query
        component takes the attribute's complement, which moves all rows by the same amount. Slices
        of equal weight are added three at a time by full adders, all triples at once.
        """
        size = np.abs(query)
        sign = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(max(1, int(size.max()).bit_length())):
            dims = np.flatnonzero((size >> j) & 1)
            if len(dims):
                for b in range(self.bits):
                    columns.setdefault(b + j, []).append(self.slices[dims, b] ^ sign[dims, None])
        out: list[np.ndarray] = []
        weight = 0
        while columns:
            stack = columns.pop(weight, None)
            if stack is None:
                out.append(np.zeros(self.words, np.uint64))
            else:
                have = np.concatenate(stack) if len(stack) > 1 else stack[0]
                carries = columns.setdefault(weight + 1, [])
                while len(have) > 1:
                    if len(have) == 2:
                        carries.append(have[:1] & have[1:])
                        have = have[:1] ^ have[1:]
                        break
                    n = len(have) // 3
                    a, b, c = have[:n], have[n : 2 * n], have[2 * n : 3 * n]
                    ab = a ^ b
                    carries.append((a & b) | (ab & c))
                    have = np.concatenate([ab ^ c, have[3 * n :]])
                if not carries:
                    del columns[weight + 1]
                out.append(have[0])
            weight += 1
        return out

    def top(self, query: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k highest, equal scores by row; ``without`` is a row left out.

        From the most significant slice down, rows surely in and rows still equal are told apart;
        when the slices end, the equal ones share the boundary score and the first of them fill up.
        """
        if self.width * self.largest * float(np.abs(query).astype(np.float64).max()) >= 2.0**SCORE_BITS:
            raise OverflowError("a score could need more than 62 bits")
        equal = self.all.copy()
        if without >= 0:
            equal[without // 64] &= ~(np.uint64(1) << np.uint64(without % 64))
        sure = np.zeros_like(equal)
        count = 0
        for plane in reversed(self.score_slices(query)):
            high = equal & plane
            n = count + int(np.bitwise_count(high).sum())
            if n > k:
                equal = high
            else:
                sure |= high
                count = n
                equal = equal & ~plane
                if n == k:
                    break
        rows = self.numbers(sure, k)
        if len(rows) < k:
            rows = np.concatenate([rows, self.numbers(equal, k - len(rows))])
        scores = self.values[rows] @ query
        order = np.lexsort((rows, -scores))
        return rows[order], scores[order]

    @staticmethod
    def numbers(bitmap: np.ndarray, most: int) -> np.ndarray:
        """The first set bits of a bitmap."""
        words = np.flatnonzero(bitmap)[:most]
        found = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        where = np.argwhere(found)[:most]
        return words[where[:, 0]] * 64 + where[:, 1]


def finite(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query row's k best other rows, ties to the smaller id.

    Components are quantised to floor(scale * x). Rows are dealt by a hash of their id into segments;
    a segment is indexed once and all queries stream through it in batches, so a task holds one
    segment and one batch. Only where there are fewer segments than the cluster has cores, a segment
    is dealt several times, each with its part of the queries. Vectors that are null, empty or not
    finite, and rows with a null id, take no part; vectors of different lengths don't compare; rows of
    one id are never each other's results. Values so large that a score could overflow 62 bits raise an error.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind, exact = ("<f4", "array<float>") if isinstance(element, T.FloatType) else ("<f8", "array<double>")
    chosen = vectors.withColumn("_q", F.coalesce(is_query, F.lit(False)))
    chosen = chosen.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(exact).alias("v"), "_q").where(finite(F.col("v")) & F.col("vec_id").isNotNull())
    n = chosen.count()
    segments = max(1, -(-n // segment_rows))
    parts = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // segments))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(segments))
    candidates = chosen.select("vec_id", "v", F.lit(False).alias("asks"), own.alias("segment"), every(parts).alias("part"))
    queries = chosen.where("_q").select("vec_id", "v", F.lit(True).alias("asks"), every(segments).alias("segment"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)).alias("part"))
    dealt = candidates.union(queries).select((F.col("segment") * parts + F.col("part")).alias("slot"), "asks", "vec_id", "v")
    dealt = dealt.repartition("slot").sortWithinPartitions("slot", "asks", "vec_id")

    def stacked(rows: list) -> np.ndarray:
        return quantised(np.stack([np.asarray(v, kind) for v in rows]), scale)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, indexes = None, [], {}

        def by_width(f: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
            length = f["v"].map(len)
            for width in sorted(set(length)):
                yield width, f[length == width]

        for f in frames:
            if not len(f):
                continue
            mark = f["slot"].to_numpy() * 2 + f["asks"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1, [len(f)]])
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                g, slot, asks = f.iloc[begin:end], int(mark[begin]) // 2, bool(mark[begin] % 2)
                if slot != now:
                    now, held, indexes = slot, [], {}
                if not asks:
                    held.append(g)
                    continue
                if held:  # all candidates of a slot come before its queries
                    indexes = {w: (h["vec_id"].to_numpy(), SlicedSegment(stacked(h["v"].to_list()))) for w, h in by_width(pd.concat(held))}
                    held = []
                out: list[tuple[int, int, int]] = []
                for width, h in by_width(g):
                    if width not in indexes:
                        continue
                    ids, index = indexes[width]
                    for query_id, query in zip(h["vec_id"].tolist(), stacked(h["v"].to_list()), strict=True):
                        a, b = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
                        rows, scores = index.top(query, k + max(0, int(b - a) - 1), int(a) if b > a else -1)
                        out += [(query_id, int(ids[r]), int(s)) for r, s in zip(rows, scores, strict=True) if ids[r] != query_id][:k]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = dealt.mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
