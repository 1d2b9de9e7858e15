"""Compression classifier: text is good when a dictionary of good text shrinks it more than one of bad text.

The score is calibrated on the normalised difference of the compressed sizes and on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows read for each class, half for its dictionary and half for the calibration, and the longest text among them.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 1 << 20
#: Sizes chosen by cross-validation inside the training rows.
DICTIONARY_BYTES = 32_768
TRAIN_BYTES = 512
LEVEL = 3
#: Texts are compressed in blocks of so many bytes, so that the dictionary and not the text's own past decides.
BLOCK_BYTES = 128


@dataclass(frozen=True)
class Model:
    """Dictionaries of both classes and the calibration; without a class there is only a prior."""

    good: bytes
    bad: bytes
    raw: bool
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


FEATURES = 8


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, raw: bool) -> None:
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
        self.packers = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content, dict_type=kind)
            held.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, text: str | None) -> tuple[float, ...]:
        """The size difference of a text, normalised by both sizes and by its length: whole, and over its blocks the median, mean and a low and a high one."""
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            return (0.0,) * FEATURES
        good, bad = self.packers[0].compress, self.packers[1].compress
        parts = [raw[at : at + BLOCK_BYTES] for at in range(0, len(raw), BLOCK_BYTES)]
        g, b = np.array([len(good(x)) for x in parts], float), np.array([len(bad(x)) for x in parts], float)
        n = np.full(len(parts), float(BLOCK_BYTES))
        n[-1] = len(parts[-1])
        gap, both = b - g, b + g
        by_size, by_length = np.sort(gap / both), np.sort(gap / n)
        low, middle, high = (int(q * (len(parts) - 1)) for q in (0.1, 0.5, 0.9))
        total = gap.sum()
        return total / both.sum(), total / len(raw), by_size[middle], by_length[middle], by_size[low], by_length[low], by_size.mean(), by_length[high]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def dictionary(blocks: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or the blocks themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes(), False
    except zstandard.ZstdError:
        return content(blocks), True


def content(blocks: list[bytes]) -> bytes:
    """As many blocks, in hash order, as a dictionary holds."""
    return b"\n".join(blocks)[:DICTIONARY_BYTES].ljust(8, b"\n")


def blocks_of(text: str | None) -> list[bytes]:
    """All of a text in blocks."""
    raw = (text or "").encode("utf-8", "replace")
    return [raw[at : at + TRAIN_BYTES] for at in range(0, len(raw), TRAIN_BYTES)]


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most ``sample_rows`` rows a class of ``labelled`` (id, label 0 or 1), taken in hash order.

    Their texts are used whole; a text of more than ``sample_chars`` isn't learned from. Rows with a null id or another label are left out; of several labels of an id the smallest
    holds. With no labels every text gets 0.5, with one class its smoothed share.
    """
    spark = docs.sparkSession
    known = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    prior = (n_good + 0.5) / (n_good + n_bad + 1)
    nothing = Model(b"", b"", True, (), (), (), prior)
    if not n_good or not n_bad:
        return nothing
    picked = [(r["_id"], y) for y in (0, 1) for r in known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id").collect()]
    chosen = spark.createDataFrame(picked, known.select("_id", "_label").schema)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_label", (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)) == 0).alias("_dict"), "_text").where(F.coalesce(F.char_length("_text") <= sample_chars, F.lit(True)))
    from tallyspark.llm.shared import checkpointed

    sample = checkpointed(sample)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(y, b) for y, t in zip(f["_label"], f["_text"], strict=True) for b in blocks_of(t)], columns=["label", "block"])

    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sample.where("_dict").mapInPandas(cut, "label int, block binary").collect():
        blocks[r["label"]].append(bytes(r["block"]))
    if not blocks[0] or not blocks[1]:
        return nothing
    for y in (0, 1):
        blocks[y].sort(key=lambda x: (xxhash.xxh64_intdigest(x), x))
    (good, raw_good), (bad, raw_bad) = dictionary(blocks[1]), dictionary(blocks[0])
    raw = raw_good or raw_bad
    if raw:
        good, bad = content(blocks[1]), content(blocks[0])
    names = [f"f{i}" for i in range(FEATURES)]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(good, bad, raw)
        for f in frames:
            yield pd.DataFrame([(y, *sizes.features(t)) for y, t in zip(f["_label"], f["_text"], strict=True)], columns=["y", *names])

    seen = np.array([tuple(r) for r in sample.where("not _dict").mapInPandas(measure, "y int, " + ", ".join(f"{c} double" for c in names)).orderBy("y", *names).collect()], float)
    if not len(seen) or len(set(seen[:, 0])) < 2:
        return nothing
    y, x = seen[:, 0], seen[:, 1:]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, n_good / (y == 1).sum(), n_bad / (y == 0).sum())
    beta = logistic((x - mean) / scale, y, weight * len(y) / weight.sum())
    return Model(good, bad, raw, tuple(mean), tuple(scale), tuple(beta), prior)


def scored(model: Model, text: Column) -> Column:
    """Score of 0 to 1 for a text column; a null or empty text gets the prior share of good labels."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(model.good, model.bad, model.raw) if model.weights else None
        mean, scale, beta = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for t in texts:
            out = np.full(len(t), model.prior)
            full = [i for i, x in enumerate(t) if x]
            if sizes and full:
                x = (np.array([sizes.features(t.iloc[i]) for i in full]) - mean) / scale
                out[full] = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield pd.Series(out)

    return score(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows that aren't held out."""
    return fit(docs, labels.where(~held_out()).select("doc_id", "quality"))
