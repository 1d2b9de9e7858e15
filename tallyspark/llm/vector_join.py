"""Near-duplicate vectors by an exact metric range join: pivots, triangle inequality, independent cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.shared import checkpointed, components, empty_edges

#: Vectors in a block at least and at most; between them a block is half of a core's share.
LEAST_BLOCK_ROWS, BLOCK_ROWS = 2048, 16_384
#: Visitors that are compared with a block at a time.
STRIPE = 256
#: Most pivots; their coordinates go to every task.
MOST_PIVOTS = 512
#: Room for rounding in the bounds; pairs are decided by their cosine alone.
SLACK = 1e-7
#: Pivots closer than this are told apart by rounding only.
LEAST_GAP = 1e-4


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, one of them not zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Block:
    """Vectors of one length at home in a block: how many vectors each links with, and what is connected so far."""

    def __init__(self, rep: np.ndarray, m: np.ndarray, x: np.ndarray, threshold: float) -> None:
        self.rep, self.m, self.x, self.threshold = rep, m, x, threshold
        self.links, self.label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for at in range(0, len(rep), STRIPE):
            i, j = np.nonzero(self.near(x[at : at + STRIPE]))
            other = i + at != j
            i, j = i[other], j[other]
            self.links[at : at + STRIPE] += np.bincount(i, m[j], min(STRIPE, len(rep) - at)).astype(np.int64)
            # a vector is of one label with what it links with
            self.join(np.concatenate([i, np.arange(min(STRIPE, len(rep) - at))]), np.concatenate([j, np.arange(at, min(at + STRIPE, len(rep)))]))

    def near(self, x: np.ndarray) -> np.ndarray:
        return x @ self.x.T >= self.threshold

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows ``j`` with the same ``i`` get one label; returns each i and its label."""
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        each, begins = np.unique(i, return_index=True)
        if not len(each):
            return each, each
        found = self.label[j]
        unlike = np.minimum.reduceat(found, begins) != np.maximum.reduceat(found, begins)
        ends = np.append(begins[1:], len(j))
        for a, b in zip(begins[unlike].tolist(), ends[unlike].tolist(), strict=True):
            labels = np.unique(self.label[j[a:b]])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]
        return each, self.label[j[begins]]

    def visit(self, rep: np.ndarray, m: np.ndarray, x: np.ndarray) -> Iterator[pd.DataFrame]:
        """Links of visitors, each with a vector of the block that it is connected with."""
        for at in range(0, len(rep), STRIPE):
            i, j = np.nonzero(self.near(x[at : at + STRIPE]))
            if len(i):
                self.links += np.bincount(j, m[at + i], len(self.rep)).astype(np.int64)
                n = np.bincount(i, self.m[j], STRIPE).astype(np.int64)
                each, label = self.join(i, j)
                yield pd.DataFrame({"rep": rep[at + each], "links": n[each], "root": self.rep[label]})

    def home(self) -> pd.DataFrame:
        own = self.links > 0
        return pd.DataFrame({"rep": self.rep[own], "links": self.links[own], "root": self.rep[self.label[own]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Equal vectors are joined once and count as links of each other. A vector belongs to the cell of
    its nearest pivot; cells are cut into blocks of bounded size, and a vector visits another
    cell's blocks only if the triangle inequality (distance to the pivot against the cell's radius,
    and to the plane between the two pivots) leaves room for a partner there. Of two blocks only the
    vectors of one visit the other, which of them alternates. A task holds a block while its visitors
    stream by, and returns counts and a spanning forest, never its pairs. Vectors of other
    lengths than most share a cell.

    Vectors that are null, zero or not finite link with nothing and are their own component, as is a
    row with a null id, whose component is null. Repeated ids are rows of their own; ``n_links``
    counts rows.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    exact = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(exact).alias("v"))
    rows = rows.select("vec_id", F.when(usable(F.col("v")) & F.col("vec_id").isNotNull(), F.col("v")).alias("v"))
    # equal vectors once, by their smallest id
    distinct = checkpointed(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    common = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width, n = common
    if block_rows is None:
        block_rows = max(LEAST_BLOCK_ROWS, min(BLOCK_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))
    k = max(1, min(MOST_PIVOTS, n // block_rows))
    picked = distinct.where(F.size("v") == width).orderBy(F.xxhash64("rep"), "rep").limit(k).select("v").collect()
    pivots = unit_rows([np.array(r["v"], kind).tobytes() for r in picked], kind)
    plane = np.sqrt(np.maximum(0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(-1)))

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length = f["v"].map(len).to_numpy()
            raw = [np.asarray(v, kind).tobytes() for v in f["v"]]
            cell, far = np.full(len(f), -1, np.int32), np.zeros(len(f))
            if len(at := np.flatnonzero(length == width)):
                d = distances(unit_rows([raw[i] for i in at], kind))
                cell[at], far[at] = d.argmin(1), d.min(1)
            yield pd.DataFrame({"rep": f["rep"], "m": f["m"], "cell": cell, "far": far, "raw": raw})

    homes = checkpointed(distinct.mapInPandas(home, "rep long, m long, cell int, far double, raw binary"))
    cells = homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()
    # there are not more cells than pivots, and one
    blocks: dict[int, list[int]] = {}
    total = 0
    for r in cells:
        blocks[r["cell"]] = list(range(total, total + -(-r["n"] // block_rows)))
        total += len(blocks[r["cell"]])
    radius = np.array([next((r["radius"] for r in cells if r["cell"] == c), -math.inf) for c in range(len(pivots))])
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            cell, rep, raw = f["cell"].to_numpy(), f["rep"].to_numpy(), f["raw"].to_numpy()
            open_cells = np.zeros((len(f), len(pivots)), bool)
            if len(at := np.flatnonzero(cell >= 0)):
                d = distances(unit_rows(raw[at].tolist(), kind))
                own = d[np.arange(len(at)), cell[at]][:, None]
                gap = plane[cell[at]]
                margin = np.where(gap > LEAST_GAP, (d * d - own * own) / np.maximum(2 * gap, LEAST_GAP), 0)
                open_cells[at] = (margin <= reach) & (d <= radius[None, :] + reach)
                open_cells[at, cell[at]] = True
            spread = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            spread ^= spread >> np.uint64(29)
            first, count = (np.array([g(blocks[c]) for c in cell.tolist()]) for g in (lambda x: x[0], len))
            mine = first + (spread % count.astype(np.uint64)).astype(np.int64)
            yield pd.DataFrame({"block": mine, "visits": False, "rep": rep, "m": f["m"], "raw": raw}).astype({"block": "int32"})
            for c, theirs in blocks.items():
                some = np.flatnonzero(open_cells[:, c] if c >= 0 else cell < 0)
                for b in theirs:
                    go = some[(mine[some] != b) & (((mine[some] + b) % 2 == 0) == (mine[some] < b))]
                    if len(go):
                        yield pd.DataFrame({"block": b, "visits": True, "rep": rep[go], "m": f["m"].to_numpy()[go], "raw": raw[go]}).astype({"block": "int32"})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, homes_of = None, [], {}

        def settled() -> dict[int, Block]:
            f = pd.concat(held)
            length = f["raw"].map(len).to_numpy()
            return {n: Block(f["rep"].to_numpy()[length == n], f["m"].to_numpy()[length == n], unit_rows(f["raw"][length == n].tolist(), kind), threshold) for n in sorted(set(length.tolist()))}

        for f in frames:
            if not len(f):
                continue
            mark = f["block"].to_numpy().astype(np.int64) * 2 + f["visits"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1, [len(f)]])
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                g = f.iloc[begin:end]
                if mark[begin] // 2 != now:
                    homes_of = settled() if held else homes_of
                    yield from (b.home() for b in homes_of.values())
                    now, held, homes_of = mark[begin] // 2, [], {}
                if mark[begin] % 2 == 0:
                    held.append(g)
                    continue
                if held:  # all that is at home comes before the visitors
                    homes_of, held = settled(), []
                length = g["raw"].map(len).to_numpy()
                for n in sorted(set(length.tolist()) & set(homes_of)):
                    h = g[length == n]
                    yield from homes_of[n].visit(h["rep"].to_numpy(), h["m"].to_numpy(), unit_rows(h["raw"].tolist(), kind))
        homes_of = settled() if held else homes_of
        yield from (b.home() for b in homes_of.values())

    dealt = homes.mapInPandas(deal, "block int, visits boolean, rep long, m long, raw binary")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "visits", "rep")
    found = checkpointed(dealt.mapInPandas(join, "rep long, links long, root long"))
    edges = found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    whole = components(edges) if not edges.isEmpty() else empty_edges(spark).toDF("node", "component_id")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = (
        distinct.join(counted, "rep", "left")
        .join(whole.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    full = rows.where("v is not null").join(of_rep, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    rest = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
