from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from minewright.llm import pii

#: The base grammar as plain patterns, and what a match has to pass.
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
SCHEMA = "doc_id long, text string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return [True, all(int(x) <= 255 for x in match.split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if passes(k, m.group())]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("12 0.+@a@.(_b)-: é5", "40 -1+5", "a@.b", "25.6.1 "):
        for _ in range(5000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert pii.base_spans(text)[0] == brute(text), text


def test_long_runs_take_no_more_than_a_pass():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + " (" * 150_000, "a@" * 150_000, "a@b" * 100_000):
        pii.candidates(run)


def test_estimation_finds_the_good_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.55, 0.9, 0.6])
    votes = np.where(rng.random((len(truth), 8)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    codes, counts = np.unique(((votes + 1) * 3 ** np.arange(8)).sum(1), return_counts=True)
    prior, reliability = pii.estimate(codes, counts.astype(float))
    assert abs(prior - 0.3) < 0.02
    assert np.allclose(reliability[:, 1, 2] / (reliability[:, 1, 2] + reliability[:, 1, 0]), right, atol=0.03)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(400):
        number = f"4{rng.randrange(10**14):014d}"
        card = next(number + c for c in "0123456789" if luhn(number + c) == (i % 2 == 0))
        pieces = [word(), f"{word()}.{i}@mail{i % 9}.example.com", word(), card, word(), f"+1 ({rng.randint(200, 999)}) 555-{rng.randrange(10**4):04d}", word(), ".".join(str(rng.randint(1, 220)) for _ in range(4)), word()]
        rows.append((i, " ".join(pieces)))
    rows += [(1000, "please write to john.doe [at] example [dot] com, or call (555) 123-4567 today"), (1001, None), (1002, ""), (1003, "nothing here"), (None, "a@b.cd"), (None, "a@b.cd"), (1, "x@y.zz")]
    return spark.createDataFrame(rows, SCHEMA)


def test_rows_base_spans_and_what_is_added(spark, corpus):
    found = pii.personal_data(corpus.withColumnsRenamed({}).selectExpr("*", "1 AS id", "2 AS spans", "3 AS kind")).collect()
    texts = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in corpus.collect())
    assert len(found) == len(texts)
    by_id = {r.doc_id: r for r in found if r.doc_id not in (None, 1)}
    for none, i, text in texts:
        if none or i == 1:
            continue
        base = brute(text)
        r = by_id[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in range(4)]
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(","))
        if i < 400:  # numbers that fail the check are no cards
            assert r.spans == ",".join(said)
    text = dict((i, t) for _, i, t in texts)[1000]
    assert {text[x["start"] : x["end"]] for x in by_id[1000].scored} == {"john.doe [at] example [dot] com", "(555) 123-4567"}
    assert [by_id[i].spans for i in (1001, 1002, 1003)] == ["", "", ""]
    assert sorted(r.spans for r in found if r.doc_id is None) == ["email:0:6"] * 2


def test_redacted_texts_hold_no_base_spans(spark, corpus):
    model = pii.fit(pii.find_candidates(corpus, "doc_id", "text"))
    clean = pii.redact(corpus.selectExpr("text AS t", "doc_id", "'x' AS text2").withColumnRenamed("t", "text"), model)
    rows = clean.collect()
    assert len(rows) == corpus.count() and clean.columns == ["text", "doc_id", "text2"]
    assert not any(brute(r.text) for r in rows if r.text)
    assert {r.text for r in rows if r.doc_id in (1001, 1003)} == {None, "nothing here"}


def test_same_result_for_any_partitioning(spark, corpus):
    a, b = ({(r.doc_id, r.spans, r.base_sha256) for r in pii.personal_data(corpus.repartition(n), sample=300).collect()} for n in (1, 5))
    assert a == b


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
