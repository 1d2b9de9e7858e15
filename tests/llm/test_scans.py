import random
import re

import pytest

from tallyspark.llm import pii, secret_scan


def held(rows):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in rows}


def test_trigram_queries_are_necessary():
    rng = random.Random(0)
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        rx = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))

        def true(q, text):
            if q is True:
                return True
            if isinstance(q, str):
                return q in text
            return (all if q[0] == "and" else any)(true(x, text) for x in q[1:])

        parts = ["password", "api_key", "APIKEY", "Token", "secret", "=", ":", " ", '"', "AKIA", "ABCDEFGH12", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "a" * 36, "eyJ", ".", "xoxb-", "0123456789", "sk_live_", "b" * 24, "é"]
        for _ in range(3000):
            text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
            if rx.search(text):
                assert true(query, text.lower())
    assert secret_scan.trigram_query(r"[0-9a-f]+") is True
    assert secret_scan.trigram_query(r"AKIA[A-Z0-9]+") == ("and", "aki", "kia")


@pytest.mark.parametrize("seed", range(2))
def test_scan_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    parts = ["password", "api_key", "ApiKey", "TOKEN", "toKen", "ſecret", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "xyz+/_.=-", "é日", "\n", "ghp_" + "a" * 36]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(600)] + [None, "", "q" * 200_000 + " token=abcdefghijkl"]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "token=abcdefghijkl", None)], "doc_id long, text string, spans array<int>")
    found = secret_scan.scan(docs)
    got = held(found.collect())
    for i, t in enumerate(texts):
        want = []
        for rank, rule in enumerate(secret_scan.RULES):
            for m in re.finditer(rule.pattern, t or "", re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
                if rule.keep(m):
                    want.append((m.start(), rank, m.end(), rule.kind))
        assert got[i] == [(k, a, b) for a, _, b, k in sorted(want)], t
    out = secret_scan.span_columns(found, ["assign", "access", "hex"], ["a", "b", "c"]).where("doc_id is null").first()
    assert out["a"] == 1 and out["spans"] == "assign:0:18"


def brute_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["a.@- 1", "1.2 3-4+()", "0 1.-25@a.+", "12345. ", "1-. 25٣é"])
def test_base_spans_equal_plain_search(letters):
    rng = random.Random(letters)
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_known_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.iban_valid("DE89 3704 0044 0532 0130 00")


def test_weak_supervision_adds_spans_and_keeps_base(spark):
    good = ["call me, phone (017) 555-7713 today", "my ssn 123-45-6789 is here", "iban DE89 3704 0044 0532 0130 00 please", "dear Mr. John Miller of old"]
    poor = ["version 111-11-1111 of it", "total price 000-00-0000"]
    texts = good * 20 + poor * 30 + [None, "", "plain words", "mail a.b@c.example.org and +1 (017) 555-7713"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    model = pii.train(docs)
    got = held(pii.find(docs, model).collect())
    assert [k for k, _, _ in got[0]] == ["local_phone"] and [k for k, _, _ in got[1]] == ["id_number"]
    assert [k for k, _, _ in got[2]] == ["iban"] and [k for k, _, _ in got[3]] == ["person"]
    assert all(got[i] == [] for i in range(80, len(texts) - 1))
    assert [k for k, _, _ in got[len(texts) - 1]] == ["email", "phone"]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a x.y@z.com b", 13), (2, None, 7), (3, "clean", 5), (4, "+4111111111111111", 17)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(docs, pii.SpanModel({})).collect()}
    assert out[1] == ("a [EMAIL] b", 11) and out[2] == (None, 7) and out[3] == ("clean", 5)
    assert "4111" not in out[4][0]


def test_long_keys_are_found_whole(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + "aB+/9\n" * 900 + "-----END RSA PRIVATE KEY-----"
    jwt = f"eyJ{'a' * 5000}.eyJ{'b' * 9000}.{'c' * 4000}"
    texts = [f"x {key} y", f"t {jwt} z", "xoxb-" + "1" * 300, "sk_live_" + "z" * 500, "-----BEGIN PRIVATE KEY----- and no end", "eyJ" * 40_000, "-----BEGIN PRIVATE KEY-----" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] not in ("hex", "assign")] for r in secret_scan.scan(docs).collect()}
    assert found[0] == [("private_key", 2, 2 + len(key))] and found[1] == [("jwt", 2, 2 + len(jwt))]
    assert found[2] == [("slack", 0, 305)] and found[3] == [("stripe", 0, 508)] and found[4] == [("private_key", 0, 27)]
    assert found[5] == [] and len(found[6]) == 5000


def test_a_rule_of_another_pattern_may_have_a_base_name(spark):
    docs = spark.createDataFrame([(1, "abcd 0123456789abcdef")], "doc_id long, text string")
    (row,) = secret_scan.scan(docs, (secret_scan.Rule("hex", r"abcd "),)).collect()
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(0, 5)]


def test_long_names_and_empty_tables(spark):
    name = "Mr " + "Wolfeschlegelsteinhausenbergerdorff" * 2
    assert [(a, b, k) for a, b, k in pii.candidates(name)] == [(0, len(name), "person")]
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert secret_scan.scan(none).count() == 0
    model = pii.train(none)
    assert pii.find(none, model).count() == 0 and pii.redact(none, model).count() == 0


def test_acceptance_follows_the_labelers():
    assert pii.votes("ssn 078-05-1120", 4, 15, "id_number") == (1, 0, 1)
    assert pii.votes("tel (800) 555-1234", 4, 18, "local_phone") == (1, 0, 1)
    import numpy as np

    patterns = np.array([[1, -1, -1], [1, -1, 1], [1, 0, 0], [0, 0, 0], [1, 1, 1]], float)
    counts = np.array([500.0, 20, 100, 300, 60])
    target = pii.expectation_maximisation(patterns, counts)
    model = pii.SpanModel({"iban": pii.classifier(patterns, counts, target)})
    taken = [pii.accepted(model, "iban", tuple(p)) for p in patterns.astype(int).tolist()]
    assert taken[1] and taken[4] and not taken[2] and not taken[3]
