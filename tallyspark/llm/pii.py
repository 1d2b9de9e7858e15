"""Personal data by weak supervision: labelers vote on spans, EM learns how far to trust them, a classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base kinds in their order, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("local_phone", "id_number", "iban", "person")
KINDS = BASE_KINDS + EXTRA_KINDS

# Gazetteers. Given names and honorifics are common ones of the four languages.
GIVEN_NAMES = frozenset(
    "anna maria peter thomas michael john james mary robert patricia linda david elizabeth susan jean pierre michel marie sophie luc claire camille hans klaus jürgen wolfgang sabine petra monika juan josé carlos luis carmen isabel ana pedro".split()
)
HONORIFICS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sra", "Sr")
#: Probability from which a span is taken: about that of two labelers who agree and are each right in four of five cases.
ACCEPT = 0.9
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25}
CONTEXT = {
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "appel"),
    "id_number": ("ssn", "social security", "passport", "national id", "ausweis", "dni", "sécurité sociale", "tax id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "person": ("name", "dear", "contact", "sincerely", "regards", "signed", "nom", "nombre", "kontakt"),
}
#: Numbers printed as specimens, and area codes of services that answer for nobody in person.
SPECIMEN_IDS = frozenset("078-05-1120 219-09-9999 457-55-5462".split())
SERVICE_CODES = frozenset("800 822 833 844 855 866 877 888 900".split())
AGAINST = ("version", "isbn", "page", "chapter", "order", "invoice", "article", "total", "price", "$", "€", "%")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{2,4}\)[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9])|(?<![0-9+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PERSON = re.compile(r"\b(?:" + "|".join(HONORIFICS) + r")\b\.?\x20(?=\w)[^\W\d_]{2,}(?:\x20[^\W\d_]{2,})?")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Left of each @ the longest run of local characters since the last match, right of it a dotted domain.

    The same matches as searching the whole pattern from the left, in time linear in the text.
    """
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = last = m.end()
            yield start, end
        else:
            last = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, rank of kind, end) of the base kinds; matches that fail their test are dropped."""
    out = [(a, 0, b) for a, b in emails(text)]
    digits = None
    for m in _CARD.finditer(text):
        digits = m
        if 12 <= m.end() - m.start():
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if digits is not None or "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of the extra kinds that the labelers vote on."""
    if ")" in text or "-" in text:
        for rx, kind in ((_LOCAL_PHONE, "local_phone"), (_ID, "id_number")):
            for m in rx.finditer(text):
                yield m.start(), m.end(), kind
    for m in _IBAN.finditer(text):
        yield m.start(), m.end(), "iban"
    for m in _PERSON.finditer(text):
        yield m.start(), m.end(), "person"


def outside(found: Iterator[tuple[int, int, str]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Candidates that don't lie within a span of a base kind, which marks them already."""
    return [(a, b, k) for a, b, k in found if not any(x <= a and b <= y for x, _, y in base)]


def open_candidates(text: str) -> list[tuple[int, int, str]]:
    found = list(candidates(text))
    return outside(found, base_spans(text)) if found else []


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, int, int]:
    """Votes of the regex, gazetteer and context labelers: 1 for, 0 against, -1 none."""
    span = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    after = text[end : end + 12].lower()
    if kind == "iban":
        shape = 1 if iban_valid(span) else 0
        listed = 1 if IBAN_LENGTHS.get(span[:2]) == len(span.replace(" ", "")) else 0
    elif kind == "person":
        words = span.split()[1:]
        shape = 1 if all(w[0].isupper() and w[1:].islower() for w in words) else 0
        listed = 1 if any(w.lower() in GIVEN_NAMES for w in words) else -1
    elif kind == "id_number":
        area = int(span[:3])
        shape = 1 if area not in (0, 666) and area < 900 and span[4:6] != "00" and span[7:] != "0000" else 0
        listed = 0 if span in SPECIMEN_IDS else -1
    else:
        digits = "".join(c for c in span if c.isdigit())
        shape = 1 if 9 <= len(digits) <= 11 and len(set(digits)) > 2 else 0
        listed = 0 if digits[:3] in SERVICE_CODES else -1
    context = 1 if any(w in before for w in CONTEXT[kind]) else 0 if any(w in before or w in after for w in AGAINST) else -1
    return shape, listed, context


#: Weak, so that patterns which hardly occur are learned all the same.
RIDGE = 1e-6


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier: for each kind an intercept and one weight for each labeler's yes and no."""

    weights: dict[str, tuple[float, ...]]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability that a span with these votes is personal data, for each row of ``patterns``.

    Two classes; a labeler that votes is right with its own rate in each class, starting from 0.8,
    held within 0.05 to 0.95 and drawn to the start by a few made-up votes.
    """
    n = patterns.shape[1]
    right = np.full((n, 2), 0.8)
    prior = 0.5
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.tile([np.log(1 - prior), np.log(prior)], (len(patterns), 1))
        for j in range(n):
            v = patterns[:, j]
            for c in (0, 1):
                log[:, c] += np.where(v == -1, 0, np.where(v == c, np.log(right[j, c]), np.log(1 - right[j, c])))
        fresh = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
        done = np.abs(fresh - post).max() < 1e-9
        post = fresh
        prior = float(np.clip((counts @ post + 2) / (counts.sum() + 4), 0.05, 0.95))
        for j in range(n):
            for c in (0, 1):
                mass = counts * (post if c else 1 - post) * (patterns[:, j] >= 0)
                right[j, c] = np.clip((mass @ (patterns[:, j] == c) + 4) / (mass.sum() + 5), 0.05, 0.95)
        if done:
            break
    return post


def classifier(patterns: np.ndarray, counts: np.ndarray, target: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of EM's probabilities on the votes, weighted by how often they occur."""
    x = np.column_stack([np.ones(len(patterns)), patterns == 1, patterns == 0]).astype(float)
    beta = np.zeros(x.shape[1])
    w = counts / counts.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(x.shape[1]), x.T @ (w * (target - p)) - RIDGE * beta)
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Count vote patterns over all texts (at most 27 a kind reach the driver), estimate reliabilities, fit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for a, b, kind in open_candidates(text or ""):
                    key = (kind, *votes(text, a, b, kind))
                    seen[key] = seen.get(key, 0) + 1
        rows = [(*k, n) for k, n in seen.items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["kind", "a", "b", "c", "n"]).astype({"kind": "str", "a": "int32", "b": "int32", "c": "int32", "n": "int64"}), schema=pa.schema([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("n", pa.int64())]), preserve_index=False)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "kind string, a int, b int, c int, n long").groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
    weights = {}
    for kind in EXTRA_KINDS:
        rows = sorted((r["a"], r["b"], r["c"], r["n"]) for r in counted if r["kind"] == kind)
        if rows:
            table = np.array(rows, float)
            patterns, counts = table[:, :3], table[:, 3]
            weights[kind] = classifier(patterns, counts, expectation_maximisation(patterns, counts))
    return SpanModel(weights)


def accepted(model: SpanModel, kind: str, cast: tuple[int, int, int]) -> bool:
    """Whether the classifier takes a span: a probability of ACCEPT or more."""
    w = model.weights.get(kind)
    if w is None:
        return False
    x = (1.0, *(v == 1 for v in cast), *(v == 0 for v in cast))
    return sum(a * b for a, b in zip(w, x, strict=True)) >= np.log(ACCEPT / (1 - ACCEPT))


def all_spans(text: str, model: SpanModel) -> list[tuple[int, int, int]]:
    """Base spans and accepted extra ones, sorted by start and rank of kind."""
    base = base_spans(text)
    out = list(base)
    for a, b, kind in outside(candidates(text), base):
        if accepted(model, kind, votes(text, a, b, kind)):
            out.append((a, KINDS.index(kind), b))
    return sorted(out)


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind,start,end>>`` of every row; a null text is an empty one."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("spans", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[r], "start": a, "end": b} for a, r, b in all_spans(t or "", model)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: str, model: SpanModel) -> str:
    """The text with every span, overlapping ones as one, replaced by the name of its first kind in brackets."""
    parts, done = [], 0
    spans = all_spans(text, model)
    i = 0
    while i < len(spans):
        a, rank, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][2])
        parts += [text[done:a], f"[{KINDS[rank].upper()}]"]
        done = b
        i += 1
    return "".join(parts) + text[done:] if parts else text


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked; a null text stays null, ``size_col`` follows the text."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else masked(t, model))

    columns = [mask(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*columns)
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        out = out.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(F.char_length(text_col).cast(kind)))
    return out
