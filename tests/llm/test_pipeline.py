"""The corpus pipeline against a plain version of each stage, on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm import pii, quality
from tallyspark.llm.entries import CAPACITY, MIX_SEED, QUALITY_LEAST, table, tokenizer_path
from tallyspark.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def plain_scores(model, texts):
    """Scores from the model's dictionaries and weights, with compressed sizes taken anew."""
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)]
    for text in texts:
        raw = (text or "").encode()
        if not raw:
            yield model.prior
            continue
        blocks = [raw[k : k + 128] for k in range(0, len(raw), 128)]
        sizes = [[len(p.compress(x)) for x in blocks] for p in packers]
        ratio = sorted((y - x) / (y + x) for x, y in zip(*sizes))
        rate = sorted((y - x) / len(z) for x, y, z in zip(*sizes, blocks))
        g, b = map(sum, sizes)
        at = lambda q: int(q * (len(blocks) - 1))
        f = [(b - g) / (b + g), (b - g) / len(raw), ratio[at(0.5)], rate[at(0.5)], ratio[at(0.1)], rate[at(0.1)], sum(ratio) / len(ratio), rate[at(0.9)]]
        z = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, f, model.mean, model.scale)) + model.weights[-1]
        yield 1 / (1 + math.exp(-max(-30, min(30, z))))


def plain_representatives(rows):
    """Ids that are the smallest of what Jaccard links of five-word shingles connect."""
    sets = [(r["doc_id"], set(shingle_hashes(r["text"], 5).tolist())) for r in rows]
    low = {i: i for i, _ in sets}
    changed = True
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a == b or len(a & b) / len(a | b) >= 0.8]
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            if low[i] != m or low[j] != m:
                low[i] = low[j] = m
                changed = True
    return {i for i in low if low[i] == i}


def plain_copies(rows):
    counts = Counter(r["source"] for r in rows)
    mass = sum(math.sqrt(n) for n in counts.values())
    out = {}
    for r in rows:
        n = counts[r["source"]]
        rate = math.sqrt(n) / mass * len(rows) / n
        u = int(hashlib.md5(f"{MIX_SEED}:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        k, term = 0, math.exp(-rate)
        below = term
        while below <= u:
            k += 1
            term *= rate / k
            below += term
        if k:
            out[r["doc_id"]] = k
    return out


def test_every_stage_equals_its_plain_version(spark, tmp_path):
    docs = table(spark, SF, "documents")
    given = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    model = quality.training_model(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = [i for i, s in zip(given, plain_scores(model, [r["text"] for r in given.values()]), strict=True) if s >= QUALITY_LEAST]
    assert sorted(r["doc_id"] for r in kept[0]) == sorted(good)
    assert all(r.asDict() == given[r["doc_id"]].asDict() for r in kept[0])
    assert {r["doc_id"] for r in kept[1]} == plain_representatives(kept[0]) and len(kept[1]) == len({r["doc_id"] for r in kept[1]})
    spans = pii.train(spark.createDataFrame(kept[1], table(spark, SF, "documents").schema))
    assert {r["doc_id"]: r["text"] for r in kept[2]} == {r["doc_id"]: pii.masked(r["text"], spans) for r in kept[1]}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2])
    assert Counter(r["doc_id"] for r in kept[3]) == plain_copies(kept[2])
    tokens = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in kept[3]:
        ids = [*tokens.encode(r["text"], add_special_tokens=False).ids, 0]
        want.update((r["doc_id"], k, at, zlib.crc32(np.array(ids[at : at + CAPACITY], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), CAPACITY)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in kept[4]) == want
    filled = Counter()
    for r in sorted(kept[4], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= CAPACITY
