"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import checkpointed

#: Words kept with their ids by each Python worker.
CACHE_WORDS = 400_000
#: Pieces that are packed together: enough that bins fill, few enough for one task.
GROUP_PIECES = 4096

_CORE = re.compile(r"([a-zà-öø-ÿß]+)([.,;:!?|#$%&*]+)")


class WordIds(dict):
    """Little-endian 32-bit ids of lower-cased Latin-1 words, filled by the tokenizer on demand.

    The tokenizer drops white space and splits letters from punctuation before it merges, so a
    text's ids are those of its words in a row, and a word's those of its letters and its tail.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if (m := _CORE.fullmatch(word)) and len(word) < 80:
            ids = self[m[1]] + self[m[2]]
        elif word.isascii() and word.isalpha():
            ids = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) < 80:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text, exactly as the tokenizer gives them."""
        try:
            text.encode("ascii" if text.isascii() else "latin-1")
            plain = "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table of word ids for each worker process and vocabulary file."""
    if path not in _known:
        from tokenizers import Tokenizer

        _known[path] = WordIds(Tokenizer.from_file(path))
    return _known[path]


def tokenised_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids``.

    A null text is an empty one and so becomes the end id alone; null and repeated ids stay as they
    are, row by row. Only documents longer than ``capacity`` are cut; the last piece may be shorter.
    """
    out = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + ([("ids", pa.list_(pa.int64()))] if keep_ids else [])
    )
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.text(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").tolist(),) if keep_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)] if rows else [pa.array([], f.type) for f in out], schema=out)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every length.

    A bin is filled greedily with the longest that still fits. If a gap is left, the bin's shortest
    document gives way to the two unpacked ones that fill its place and the gap best, where they
    fill more; it goes back among the unpacked. Equal lengths are taken in their given order.
    """
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    present = 0
    for n in stacks:
        present |= 1 << n

    def longest(limit: int) -> int:
        return (present & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else -1

    def take(n: int) -> int:
        nonlocal present
        i = stacks[n].pop()
        if not stacks[n]:
            present ^= 1 << n
        return i

    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number = 0
    while present:
        held: list[int] = []
        gap = capacity
        while (n := longest(gap)) > 0:
            held.append(take(n))
            gap -= n
        if gap and len(held) > 1:
            short = int(lengths[held[-1]])
            room, best, pair = gap + short, short, None
            a = longest(room - 1)
            while a > 0 and 2 * a > best:
                b = longest(min(a, room - a))
                if b == a and len(stacks[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(a - 1)
            if pair:
                back = held.pop()
                held += [take(pair[0]), take(pair[1])]
                stacks[short].append(back)
                present |= 1 << short
        at = 0
        for i in held:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        number += 1
    return bins, offsets


def packed(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``doc_id, piece, start, length, ids_crc32``.

    Pieces, copies of one document too, are dealt by a hash into groups of about ``group_pieces`` that are packed apart, so no task
    holds more than its group. What each group leaves half empty at most is packed once more, whole
    sequences as pieces, again in groups. Lengths are 1 to ``capacity``.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    pieces = checkpointed(pieces.select(*columns))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        number, offset = best_two_fit(rows["length"].to_numpy(), capacity)
        fill = np.bincount(number, rows["length"]).astype(np.int64)
        return rows.drop(columns="_group").assign(sequence_id=number + (int(key[0]) << 32), offset=offset, fill=fill[number])

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sequence_id", kind="stable")
        whole = rows.drop_duplicates("sequence_id")
        number, offset = best_two_fit(whole["fill"].to_numpy(), capacity)
        ids, at = whole["sequence_id"].to_numpy(), np.searchsorted(whole["sequence_id"].to_numpy(), rows["sequence_id"].to_numpy())
        name = np.empty(number.max() + 1, np.int64)  # a joint sequence keeps the id of one of its parts
        name[number] = ids
        return rows[[*columns]].assign(sequence_id=name[number[at]], offset=rows["offset"].to_numpy() + offset[at])

    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    first = dealt.groupBy("_group").applyInPandas(run, f"{schema}, fill long")
    if groups == 1:
        return first.drop("fill")
    first = checkpointed(first)
    half = F.col("fill") <= capacity // 2
    parts = max(1, -(-first.where(half & (F.col("offset") == 0)).count() // group_pieces))
    left = first.where(half).withColumn("_group", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)))
    return first.where(~half).drop("fill").union(left.groupBy("_group").applyInPandas(again, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenise and pack all documents; the number of groups follows that of their pieces. No rows give no rows."""
    return packed(tokenised_pieces(docs, tokenizer_path, capacity, 0, id_col, text_col), capacity, group_pieces)
