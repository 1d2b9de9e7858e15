"""Secret scan through a trigram inverted index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre_constants
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, whether letters stand for either case, what a match must fulfil, and a pattern that finds the same without what fails."""

    kind: str
    pattern: str
    any_case: bool = False
    keep: Callable[[re.Match], bool] = lambda m: True
    fast: str | None = None


# The three base kinds, and key formats that their issuers publish.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: m.end(2) - m.start(2) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", False, lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]+", False, lambda m: m.end() - m.start() >= 16, r"[0-9a-f]{16,}"),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + EXTRA

#: A Boolean query over trigrams: True (any text), a trigram, ("and", ...) or ("or", ...).
Query = Any
_EXACT_MOST = 24


def both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return a if a == b else ("and", a, b)


def either(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def of_string(text: str) -> Query:
    """All trigrams of a string that must occur."""
    out: Query = True
    for i in range(len(text) - 2):
        out = both(out, text[i : i + 3])
    return out


def trigram_query(pattern: str) -> Query:
    """What trigrams, in lower case, every text must hold in which the pattern matches.

    Along a concatenation the strings that can end here are kept while they are few; when they
    become many or open, what they require is added and the run starts again.
    """

    def walk(items: Any) -> tuple[set[str] | None, Query]:
        """Exact strings of this part (None: too many) and the requirement beyond them."""
        exact: set[str] = {""}
        need: Query = True

        def close() -> None:
            nonlocal exact, need
            need = both(need, either([of_string(x) for x in sorted(exact)]))
            exact = {""}

        whole = True
        for op, arg in items:
            strings: set[str] | None
            more: Query = True
            if op is sre_constants.LITERAL:
                strings = {chr(arg).lower()}
            elif op is sre_constants.SUBPATTERN:
                strings, more = walk(arg[-1])
            elif op is sre_constants.BRANCH:
                ways = [walk(x) for x in arg[1]]
                strings = set().union(*[w[0] for w in ways]) if all(w[0] is not None and w[1] is True for w in ways) else None
                if strings is None:
                    more = either([both(w[1], True if w[0] is None else either([of_string(x) for x in sorted(w[0])])) for w in ways])
            elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
                inside, _ = walk(arg[2])
                strings = None if inside is None else inside | {""}
            elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0] > 0:
                strings, more = None, walk(arg[2])[1]
            elif op is sre_constants.IN and all(k is sre_constants.LITERAL for k, _ in arg) and len(arg) <= 6:
                strings = {chr(v).lower() for _, v in arg}
            elif op in (sre_constants.ASSERT, sre_constants.ASSERT_NOT, sre_constants.AT):
                strings = {""}
            else:
                strings = None
            need = both(need, more)
            if strings is None:
                close()
                whole = False
            else:
                longer = {a + b for a in exact for b in strings}
                if len(longer) > _EXACT_MOST:
                    close()
                    whole = False
                    longer = strings
                exact = longer
        if whole:
            return exact, need
        close()
        return None, need

    exact, need = walk(sre_parser.parse(pattern))
    return need if exact is None else both(need, either([of_string(x) for x in sorted(exact)]))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


class Segment:
    """Inverted index of a batch of texts: for each trigram of the vocabulary the sorted numbers of the texts that hold it.

    Like the segments of a text search engine it is built and asked where its texts are, so no posting
    list outgrows a batch and none is shuffled.
    """

    def __init__(self, vocabulary: list[str]) -> None:
        self.vocabulary = vocabulary
        self.table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(vocabulary, 1):
            a, b, c = t.encode("latin-1")
            self.table[(a << 16) | (b << 8) | c] = i
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """``data``: UTF-8 bytes of all texts in a row, ``offsets``: where each begins and the last ends."""
        self.size = len(offsets) - 1
        hits: list[np.ndarray] = []
        step = 1 << 22
        for at in range(0, max(0, len(data) - 2), step):
            part = self.lower[data[at : at + step + 2]]
            found = self.table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            where = np.flatnonzero(found)
            doc = np.searchsorted(offsets, where + at, "right") - 1
            inside = where + at + 2 < offsets[doc + 1]
            hits.append(np.unique((found[where].astype(np.int64) << 40 | doc)[inside]))
        keys = np.unique(np.concatenate(hits)) if hits else np.array([], np.int64)
        cut = np.searchsorted(keys, np.arange(1, len(self.vocabulary) + 2, dtype=np.int64) << 40)
        docs = keys & ((1 << 40) - 1)
        self.postings = {t: docs[cut[i] : cut[i + 1]] for i, t in enumerate(self.vocabulary)}

    def ask(self, query: Query) -> np.ndarray:
        """Numbers of the candidate texts."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        parts = [self.ask(q) for q in query[1:]]
        if query[0] == "and":
            out = min(parts, key=len)
            for p in parts:
                out = out[np.isin(out, p, assume_unique=True)] if p is not out else out
            return out
        return np.unique(np.concatenate(parts))


def matches(rule: Rule, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in compiled.finditer(text):
        if rule.keep(m):
            yield m.start(), m.end()


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every text: ``doc_id, spans array<struct<kind,start,end>>``, ends exclusive, in code points.

    A null text is an empty one; null and repeated ids are rows of their own. A rule without
    mandatory trigrams scans every text; all others verify the texts that the index proposes.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    vocabulary = sorted(set().union(*map(trigrams, queries)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("spans", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(vocabulary)
        compiled = [re.compile(r.fast or r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
        for batch in batches:
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
            segment.build(np.frombuffer(b"".join(raw), np.uint8), offsets)
            found: list[list[tuple[int, int, int, str]]] = [[] for _ in raw]
            decoded: dict[int, str] = {}
            for rank, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                for d in segment.ask(query).tolist():
                    if d not in decoded:
                        decoded[d] = raw[d].decode("utf-8", "surrogatepass")
                    found[d] += [(a, rank, b, rule.kind) for a, b in matches(rule, compiled[rank], decoded[d])]
            spans = [[{"kind": k, "start": a, "end": b} for a, _, b, k in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def span_columns(found: DataFrame, base: list[str], counts: list[str]) -> DataFrame:
    """Counts of the base kinds, their digest and the list of all spans, from ``doc_id, spans``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[of_kind(k).alias(c) for k, c in zip(base, counts, strict=True)],
        F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

