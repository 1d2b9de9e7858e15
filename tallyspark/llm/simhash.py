"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.shared import checkpointed, components, empty_edges, unused

SHINGLE_WORDS = 4
HASH_SEED = 42
MOST_DIFFERING_BITS = 4
#: Fingerprints of eight bytes that differ in so few bits share at least so many bytes by position.
LEAST_SHARED_BYTES = 8 - MOST_DIFFERING_BITS
#: Two that share 4 of 8 positional bytes share 3 of any 7, so a posting list for each value of each
#: three of the first seven positions holds every such pair.
INDEXED = tuple(combinations(range(7), 3))
#: A posting list of more rows than this is cut into blocks that meet in pairs.
LIST_ROWS = 16_384
#: Rows whose postings a task makes at a time.
KEYED_ROWS = 512
#: One fingerprint in so many is counted to find such lists.
PROBE = 16


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of a text's word shingles in their order, repeats included; the whole sequence where it is shorter, nothing without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return np.array([hashed(joined, HASH_SEED)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    return np.array([hashed(joined[a:b], HASH_SEED) for a, b in zip(begins, ends[shingle_words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle_words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every row; a null text counts as empty."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def index_keys(fp: np.ndarray) -> np.ndarray:
    """Posting keys of each fingerprint, a column for each three positions: which three, and their bytes."""
    b = fp.view(np.uint8).reshape(len(fp), 8).astype(np.int64)
    return np.stack([(i << 24) | (b[:, x] << 16) | (b[:, y] << 8) | b[:, z] for i, (x, y, z) in enumerate(INDEXED)], axis=1)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and then differ in few enough bits."""
    mixed = a[:, None] ^ b[None, :]
    shared = (mixed.view(np.uint8).reshape(*mixed.shape, 8) == 0).sum(axis=2)
    out = shared >= LEAST_SHARED_BYTES
    out[out] = np.bitwise_count(mixed[out]) <= MOST_DIFFERING_BITS
    return out


def forest(fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links among these fingerprints connect.

    Breadth first: what a front reaches leaves the rows still open, so rows that are alike are
    compared with a few others and not with each other.
    """
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        seed = int(rep[front[0]])
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                todo = np.flatnonzero(~reached)
                if not len(todo):
                    break
                for part in range(0, len(todo), 4096):
                    some = todo[part : part + 4096]
                    reached[some] = similar(fp[front[at : at + 64]], fp[left[some]]).any(axis=0)
            front, left = left[reached], left[~reached]
            edges += [(int(r), seed) for r in rep[front]]
    return edges


def bit_links(values: np.ndarray, rep: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Edges of posting lists of 64-bit fingerprints: lists of two are tallied all at once, longer ones become forests."""
    fp = values[:, 0]
    two = begins[sizes == 2]
    mixed = fp[two] ^ fp[two + 1]
    tally = (mixed.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    good = two[(tally >= LEAST_SHARED_BYTES) & (np.bitwise_count(mixed) <= MOST_DIFFERING_BITS)]
    edges = list(zip(rep[good].tolist(), rep[good + 1].tolist(), strict=True))
    for a, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        edges += forest(fp[a : a + n], rep[a : a + n])
    return edges


def posting_edges(
    reps: DataFrame,
    values: tuple[str, ...] = ("fp",),
    index: Callable[[pd.DataFrame], np.ndarray] = lambda f: index_keys(f["fp"].to_numpy().view(np.uint64)),
    link: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int]] | Iterator[np.ndarray]] = bit_links,
) -> DataFrame:
    """Edges ``src, dst`` between representatives that meet in a posting list.

    ``reps`` has ``rep``, the longs ``values`` that postings carry, and what ``index`` makes keys of less
    than 34 bits from, a row of them for each representative. ``link`` gets carried values (unsigned),
    representatives, and where the lists begin and how long they are; what it returns may come in pieces.
    With the defaults the edges generate all components.
    """
    ddl = "key long, rep long, " + ", ".join(f"{v} long" for v in values)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), KEYED_ROWS):
                g = f.iloc[at : at + KEYED_ROWS]
                keys = index(g)
                yield pd.DataFrame({"key": keys.ravel()} | {c: np.repeat(g[c].to_numpy(), keys.shape[1]) for c in ("rep", *values)})

    postings = reps.mapInPandas(keyed, ddl)
    # long lists, found in a hashed part of the fingerprints; each list is whole all the same
    probe = reps.where(F.pmod(F.xxhash64(*values), F.lit(PROBE)) == 0).mapInPandas(keyed, ddl)
    long_lists = checkpointed(probe.groupBy("key").count().where(F.col("count") > LIST_ROWS // (2 * PROBE)).select("key", F.ceil(F.col("count") * PROBE / LIST_ROWS).cast("int").alias("cuts")))
    if not long_lists.isEmpty():
        # a list's blocks i and j meet under a key of their own: what is left of 64 bits holds both numbers
        found = postings.join(long_lists, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        found = found.withColumn("mine", F.pmod(F.xxhash64(*values, F.lit(5)), F.col("cuts")))
        found = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - F.lit(1).cast("long"))))
        postings = found.withColumn("key", F.col("key") * (1 << 30) + F.least("mine", "other") * (1 << 15) + F.greatest("mine", "other"))
    sorted_rows = postings.select("key", "rep", *values).repartition("key").sortWithinPartitions("key", *values)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def lists(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            k = f["key"].to_numpy()
            change = np.flatnonzero(k[1:] != k[:-1]) + 1
            begins = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([begins, [len(f)]]))
            edges = link(f[list(values)].to_numpy().view(np.uint64), f["rep"].to_numpy(), begins, sizes)
            for piece in [edges] if isinstance(edges, list) else edges:
                yield pd.DataFrame(piece, columns=["src", "dst"]).drop_duplicates().astype("int64")

        for f in frames:
            if held is not None:
                f = pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            k = f["key"].to_numpy()
            same = k == k[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = f.iloc[cut:]
            if cut:
                yield from lists(f.iloc[:cut])
        if held is not None and len(held):
            yield from lists(held)

    return sorted_rows.mapInPandas(run, "src long, dst long")


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Equal fingerprints are one representative, their smallest id. Links (differing bits within the
    limit) connect components; each is named by its smallest id. Texts without words have
    fingerprint zero and are linked like any other. A row with a null id has a fingerprint but no
    component and links with nothing; rows of one id are one document with each of its texts.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    known = prints.where("doc_id is not null")
    reps = checkpointed(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # an id with several texts ties their fingerprints together
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1 and a <> b").select("doc_id")
    edges = checkpointed(posting_edges(reps).distinct())
    if not several.isEmpty():
        ties = known.join(several, "doc_id").join(reps, "fp").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst"))
        edges = edges.union(ties)
    whole = components(edges) if not edges.isEmpty() else empty_edges(docs.sparkSession).toDF("node", "component_id")
    named = reps.join(whole, reps["rep"] == whole["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return known.join(named, known["fp"] == named["_fp"]).select("doc_id", hexed, "component_id").union(
        prints.where("doc_id is null").select("doc_id", hexed, F.lit(None).cast("long").alias("component_id"))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose id names their component, one for each; rows with a null id all stay.

    With a ``similarity`` documents are linked by that share of common shingles at least, else by
    the differing bits of their fingerprints. Of several rows of an id the smallest stays, by text
    and then by the other columns that have an order.
    """
    if similarity is None:
        found = near_documents(docs, id_col, text_col, shingle_words)
    else:
        from tallyspark.llm.wide_simhash import similar_documents

        found = similar_documents(docs, similarity, id_col, text_col, shingle_words)
    found = checkpointed(found)
    own, place = unused(docs, "_kept", "_place")
    kept = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("n_rows"))
    repeated = not kept.where("n_rows > 1").isEmpty()
    out = docs.join(kept.select(own), docs[id_col].cast("long") == F.col(own), "left_semi")
    if repeated:
        order = [text_col, *(f.name for f in docs.schema if f.name not in (id_col, text_col) and not isinstance(f.dataType, (T.MapType, T.VariantType)))]
        first = F.row_number().over(Window.partitionBy(f"`{id_col}`").orderBy(*[F.col(f"`{c}`") for c in order]))
        out = out.withColumn(place, first).where(F.col(place) == 1).drop(place)
    nameless = docs.where(F.col(id_col).isNull())
    return out if nameless.isEmpty() else out.union(nameless)
