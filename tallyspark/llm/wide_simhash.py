"""Near-duplicates by share of common shingles, through wide SimHashes in a byte-position inverted index.

Documents that share 0.8 of their shingles differ in some 15 of 100 SimHash bits, and then a
64-bit fingerprint guarantees no common byte. A wider one has more positional bytes: at 0.8 each
is equal with a probability of 0.27, and a posting list for each of 192 threes of them, no two
threes sharing more than one position, brings a pair together with a probability of 0.97 (0.99
from 0.83, less in a large group). Of what meets the shared positional bytes are counted: pairs that
reach the minimum are compared by bits, and what bits can't tell by the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import checkpointed, components, empty_edges, release
from tallyspark.llm.simhash import posting_edges, shingle_hashes

#: 64-bit words of a fingerprint, and how many of them a posting carries.
WORDS = 12
CARRIED = 2
BITS = 64 * WORDS
#: Threes of positional bytes: i, i + a and i + b for every position i and these a, b, whose differences are all unlike.
STEPS = ((1, 3), (5, 12))
#: Texts whose shingles a task holds at a time.
BATCH_ROWS = 256
#: Shingles, and texts, that a block of texts compared with another block has on average at most.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 18, 512
#: Shared shingles whose texts are multiplied at a time.
MULTIPLIED = 2048
#: Standard deviations of the number of differing bits that are allowed for.
SPREAD = 5.0


def differing_bits(similarity: float, bits: int) -> tuple[float, float]:
    """Expected number, and its standard deviation, of differing bits of two sets of one size with this Jaccard similarity."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return p * bits, math.sqrt(bits * p * (1 - p))


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows have each bit: rows are added three at a time by full adders."""
    ones = np.zeros(rows.shape[1] * 64, np.int64)
    stacks, weight = {0: [rows]}, 0
    while weight in stacks:
        have = np.concatenate(stacks[weight])
        carries: list[np.ndarray] = []
        while len(have) > 1:
            n = max(1, len(have) // 3)
            a, b = have[:n], have[n : 2 * n]
            if len(have) == 2:
                carries.append(a & b)
                have = a ^ b
                continue
            c, ab = have[2 * n : 3 * n], a ^ b
            carries.append((a & b) | (ab & c))
            have = np.concatenate([ab ^ c, have[3 * n :]])
        ones += np.unpackbits(have[0].view(np.uint8), bitorder="little").astype(np.int64) << weight
        weight += 1
        if carries:
            stacks[weight] = carries
    return ones


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of a set of shingle hashes, BITS wide: each hash is mixed anew for each word."""
    ones = np.zeros(BITS, np.int64)
    seeds = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 14):
        z = hashes[at : at + (1 << 14), None] + seeds
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(odd)
        z ^= z >> np.uint64(31)
        ones += bit_counts(z)
    return np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").tobytes()


def index_keys(wide: np.ndarray) -> np.ndarray:
    """Posting keys of rows of positional bytes: which three, and their bytes."""
    b, n = wide.astype(np.int64), wide.shape[1]
    at = np.arange(n)
    keys = [((t * n + at) << 24) | (b << 16) | (b[:, (at + x) % n] << 8) | b[:, (at + y) % n] for t, (x, y) in enumerate(STEPS)]
    return np.concatenate(keys, axis=1)


def tree_links(most: float):
    """Edges of posting lists: of each list the minimum spanning forest by the carried bits, without edges beyond ``most``.

    At every threshold of carried bits such a forest connects what all pairs below it connect, with
    one edge a row. By shingles it need not: an edge that fails there may stand where a similar pair was left out.
    """

    def link(values: np.ndarray, rep: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        two = begins[sizes == 2]
        good = two[np.bitwise_count(values[two] ^ values[two + 1]).sum(axis=1, dtype=np.int64) <= most]
        edges = list(zip(rep[good].tolist(), rep[good + 1].tolist(), strict=True))
        for begin, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            v, r = values[begin : begin + n], rep[begin : begin + n]
            left, best, near = np.arange(1, n), np.full(n - 1, 1 << 30), np.zeros(n - 1, np.int64)
            now = 0
            while len(left):
                d = np.bitwise_count(v[left] ^ v[now]).sum(axis=1, dtype=np.int64)
                closer = d < best
                best, near = np.where(closer, d, best), np.where(closer, now, near)
                k = int(best.argmin())
                now = int(left[k])
                if best[k] <= most and r[now] != r[near[k]]:
                    edges.append((int(r[near[k]]), int(r[now])))
                stay = np.arange(len(left)) != k
                left, best, near = left[stay], best[stay], near[stay]
        return edges

    return link


def common_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``, by products of the columns that both sides have."""
    column = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1]
    cut = sum(map(len, a))
    both = np.zeros(column.max() + 1 if len(column) else 0, bool)
    both[column[:cut]] = True
    shared = np.zeros_like(both)
    shared[column[cut:]] = True
    shared &= both
    number = np.cumsum(shared) - 1
    sides = []
    for sets, columns in ((a, column[:cut]), (b, column[cut:])):
        row, pick = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), shared[columns]
        row, columns = row[pick], number[columns[pick]]
        order = np.argsort(columns, kind="stable")
        sides.append((len(sets), row[order], columns[order]))
    common = np.zeros((len(a), len(b)))
    for at in range(0, int(shared.sum()), MULTIPLIED):
        matrices = []
        for n, row, columns in sides:
            i, j = np.searchsorted(columns, [at, at + MULTIPLIED])
            x = np.zeros((n, MULTIPLIED), np.float32)
            x[row[i:j], columns[i:j] - at] = 1
            matrices.append(x)
        common += matrices[0] @ matrices[1].T
    return common


def label_links(a: pd.DataFrame, b: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect the labels of rows of ``a`` and ``b`` (``label, shingles``) between which there is a similar pair: a forest of them."""
    common = common_shingles(a["shingles"].to_list(), b["shingles"].to_list())
    sizes = [np.array([len(x) for x in f["shingles"]]) for f in (a, b)]
    labels = [f["label"].to_numpy() for f in (a, b)]
    either = sizes[0][:, None] + sizes[1][None, :] - common
    i, j = np.nonzero((common / np.maximum(either, 1) >= similarity) & (labels[0][:, None] != labels[1][None, :]))
    root: dict[int, int] = {}

    def top(n: int) -> int:
        while root.get(n, n) != n:
            root[n] = n = root.get(root[n], root[n])
        return n

    edges = []
    for x, y in np.unique(np.sort(np.stack([labels[0][i], labels[1][j]], axis=1), axis=1), axis=0).tolist():
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((x, y))
    return edges


def left_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges between labels of one cluster that have similar texts: ``src, dst``.

    ``members`` has ``cluster, label, rep, wide``, ``sets`` the shingles of each. All pairs of unlike
    labels of a cluster are tested. Small clusters are dealt many to a task. Of a large one the rows of
    its commonest label and all other rows are cut into blocks of a bounded size, and two blocks meet
    in a task of their own unless both are of that label; no pair leaves a task but as a label's edge.
    """
    rows = members.join(sets, [members["rep"] == sets["doc_id"], members["wide"] == sets["_wide"]]).select("cluster", "label", "rep", "shingles", F.size("shingles").alias("n"))
    rows = checkpointed(rows)
    by_label = rows.groupBy("cluster", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    shape = by_label.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "n", "label")).alias("most"))

    def blocks(rows: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")

    small = (F.col("rows") <= BLOCK_ROWS) & (F.col("n") <= BLOCK_SHINGLES)
    shape = shape.where("rows > 2").select(
        F.col("cluster").alias("_cluster"),
        small.alias("small"),
        F.when(small, F.lit(None)).otherwise(F.col("most.label")).alias("most"),
        F.when(small, F.lit(0)).otherwise(blocks(F.col("most.rows"), F.col("most.n"))).cast("long").alias("own"),
        F.when(small, F.lit(1)).otherwise(blocks(F.col("rows") - F.col("most.rows"), F.col("n") - F.col("most.n"))).cast("long").alias("other"),
    )
    tasks = max(1, math.ceil((rows.agg(F.sum("n")).first()[0] or 0) / BLOCK_SHINGLES))
    dealt = rows.join(shape, F.col("cluster") == F.col("_cluster")).withColumn("place", F.xxhash64("rep", F.size("shingles")))
    common_label = F.coalesce(F.col("label") == F.col("most"), F.lit(False))
    dealt = dealt.withColumn("block", F.when(common_label, F.pmod("place", "own")).otherwise(F.col("own") + F.pmod("place", "other")))
    partners = F.sequence(F.when(common_label, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("other") - 1)
    dealt = dealt.withColumn("partner", F.explode(partners))
    lo, hi = F.least("block", "partner"), F.greatest("block", "partner")
    task = F.when(F.col("small"), F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(F.xxhash64("cluster", lo, hi))
    dealt = dealt.select(task.alias("task"), "cluster", lo.alias("lo"), hi.alias("hi"), "block", "label", "shingles")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for (_, lo, hi), g in f.groupby(["cluster", "lo", "hi"], sort=False):
            a, b = g[g["block"] == lo], g[g["block"] == hi]
            if len(a) and len(b):
                edges += label_links(a, b, similarity)
        return pd.DataFrame(edges, columns=["src", "dst"]).astype("int64")

    return dealt.groupBy("task").applyInPandas(run, "src long, dst long").distinct()


def sketches(docs: DataFrame, shingle_words: int, with_shingles: bool = False) -> DataFrame:
    """``doc_id, wide`` of every row of ``doc_id, text`` and, on request, its distinct ``shingles``."""
    longs = pa.list_(pa.int64())
    out = pa.schema([("doc_id", pa.int64()), ("wide", longs)] + ([("shingles", longs)] if with_shingles else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle_words)) for t in batch.column(1)]
                columns = [batch.column(0), pa.array([np.frombuffer(wide_fingerprint(h), np.int64) for h in sets], longs)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([h.view(np.int64) for h in sets], longs)] if with_shingles else []), schema=out)

    return docs.mapInArrow(run, "doc_id long, wide array<long>" + (", shingles array<long>" if with_shingles else ""))


def bits_apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def shared_bytes(a: str, b: str) -> Column:
    """How many positional bytes two fingerprints have in common: of each differing byte the lowest bit is set, and these are counted."""

    def unlike(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1, 2, 4):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(8 * WORDS) - F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda n, x: n + x)


def least_shared_bytes(similarity: float) -> int:
    """Positional bytes that two sets of this similarity share at least, but for SPREAD deviations."""
    n = BITS // 8
    p = (1 - differing_bits(similarity, 1)[0]) ** 8
    return max(3, math.ceil(n * p - SPREAD * math.sqrt(n * p * (1 - p))))


def similar_documents(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """``doc_id, component_id`` of every row.

    Documents are linked when their sets of shingles have a Jaccard similarity of ``similarity`` at
    least; equal sets, texts without words among them, are one representative, their smallest id.
    Pairs that meet in a posting list are retained if they share enough positional bytes. Those far below or above the expected number of differing bits are decided by it, all others
    by their shingles. First only a forest of each posting list is tested. The groups that this
    leaves beside each other, joined by edges that failed, make a cluster, and then every pair of
    texts of a cluster's unlike groups is tested by its shingles. A row with a null id has no component and
    links with nothing; rows of one id are one document with each of its texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = checkpointed(sketches(texts, shingle_words))
    known = prints.where("doc_id is not null")
    reps = checkpointed(known.groupBy("wide").agg(F.min("doc_id").alias("rep")))
    mean, deviation = differing_bits(similarity, BITS)
    sure, most = mean - SPREAD * deviation, mean + (SPREAD + 2) * deviation  # few shingles vary more
    carried_mean, carried_deviation = differing_bits(similarity, 64 * CARRIED)
    values = tuple(f"v{i}" for i in range(CARRIED))

    met = posting_edges(
        reps.select("wide", "rep", *[F.col("wide")[i].alias(v) for i, v in enumerate(values)]),
        values,
        lambda f: index_keys(np.stack(f["wide"].to_list()).view(np.uint8)),
        tree_links(carried_mean + SPREAD * carried_deviation),
    )
    met = checkpointed(met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    release(docs.sparkSession)
    a, b = (reps.select(F.col("rep").alias(end), F.col("wide").alias(f"wide_{end}")) for end in ("src", "dst"))
    pairs = met.join(a, "src").join(b, "dst").where(shared_bytes("wide_src", "wide_dst") >= least_shared_bytes(similarity))
    pairs = pairs.withColumn("apart", bits_apart("wide_src", "wide_dst")).where(F.col("apart") <= most)
    pairs = checkpointed(pairs)
    open_pairs = pairs.where(F.col("apart") > sure)
    asked = open_pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()
    sets = sketches(texts.join(asked, "doc_id", "left_semi"), shingle_words, True).dropDuplicates(["doc_id", "wide"])
    x, y = (sets.select(F.col("doc_id").alias(end), F.col("wide").alias(f"wide_{end}"), F.col("shingles").alias(f"set_{end}")) for end in ("src", "dst"))
    both = open_pairs.join(x, ["src", "wide_src"]).join(y, ["dst", "wide_dst"])
    common = F.size(F.array_intersect("set_src", "set_dst"))
    alike = both.where(common / (F.size("set_src") + F.size("set_dst") - common) >= similarity)  # divided, so that a share of exactly the limit counts
    # representatives of one id are tied by it; an id that represents nothing ties the representatives of its texts
    several = known.groupBy("doc_id").agg(F.min("wide").alias("a"), F.max("wide").alias("b")).where("a <> b").select("doc_id")
    edges = pairs.where(F.col("apart") <= sure).select("src", "dst").union(alike.select("src", "dst"))
    if not several.isEmpty():
        edges = edges.union(known.join(several, "doc_id").join(reps, "wide").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")))
    edges = checkpointed(edges.distinct())
    release(docs.sparkSession)
    whole = components(edges) if not edges.isEmpty() else empty_edges(docs.sparkSession).toDF("node", "component_id")
    # what a forest left out: a similar pair of unlike labels that meets in a list is joined by edges of its forest, so by edges that failed
    label = checkpointed(reps.join(whole, F.col("rep") == F.col("node"), "left").select("wide", "rep", F.coalesce("component_id", "rep").alias("label")))
    of_rep = label.select("rep", "label").distinct()
    failed = met.join(edges, ["src", "dst"], "left_anti")
    for end in ("src", "dst"):
        failed = failed.join(of_rep.select(F.col("rep").alias(end), F.col("label").alias(f"label_{end}")), end)
    failed = checkpointed(failed.where("label_src <> label_dst").select(F.col("label_src").alias("src"), F.col("label_dst").alias("dst")).distinct())
    if not failed.isEmpty():
        clusters = components(failed).select(F.col("node").alias("_label"), F.col("component_id").alias("cluster"))
        members = checkpointed(label.join(clusters, F.col("label") == F.col("_label")).select("cluster", "label", "rep", "wide"))
        full = members.groupBy("cluster").count().where("count > 2").select("cluster")  # of two the pair is tested
        members = members.join(full, "cluster", "left_semi")
        left = sketches(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle_words, True)
        left = left.dropDuplicates(["doc_id", "wide"]).withColumnRenamed("wide", "_wide")
        more = checkpointed(left_links(members, left, similarity))
        release(docs.sparkSession)
        if not more.isEmpty():
            whole = components(edges.union(more))
    named = reps.join(whole, reps["rep"] == whole["node"], "left").select(F.col("wide").alias("_wide"), F.coalesce("component_id", "rep").alias("component_id"))
    return known.join(named, known["wide"] == named["_wide"]).select("doc_id", "component_id").union(prints.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id")))
