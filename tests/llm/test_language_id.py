from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minewright.llm import language_id as li
from minewright.llm import textnum as tn

SCHEMA = "doc_id long, text string, lang string, score string"
TEXTS = {"xx": ["the cat sat on the mat", "That THE hat", "then they thaw"], "yy": ["el gato está allí", "la niña y el año", "ella llama"]}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "clash") for lang in TEXTS for i, t in enumerate(TEXTS[lang])]
    return spark.createDataFrame([*rows, (90, "no language", None, ""), (91, None, "xx", "")], SCHEMA).repartition(3)


def test_ngrams_by_hand():
    texts = ["ab c", "", "é1b", "x", "12"]
    want = [["a", "b", "c"], [], ["é", "b"], ["x"], []], [["ab", "b_", "_c"], [], ["é_", "_b"], [], []], [["ab_", "b_c"], [], ["é_b"], [], []]
    for chunk in tn.chunks(pa.array(texts)):
        for n, ((bucket, first), grams) in enumerate(zip(li.ngrams(chunk, (1, 2, 3), 1 << 20), want, strict=True)):
            assert list(np.diff(first)) == [len(g) for g in grams], n
            flat = [g for own in grams for g in own]
            assert len(set(zip(bucket.tolist(), flat))) == len(set(flat)) == len(set(bucket.tolist()))


def test_brute_force(docs):
    model = li.train(docs, buckets=1 << 16)
    assert model.languages == ["xx", "yy"]
    counts = {lang: np.zeros(1 << 16) for lang in TEXTS}
    for lang, texts in TEXTS.items():
        for chunk in tn.chunks(pa.array([t.lower() for t in texts])):
            for bucket, _ in li.ngrams(chunk, (1, 2, 3), 1 << 16):
                counts[lang] += np.bincount(bucket, minlength=1 << 16)
    for k, lang in enumerate(("xx", "yy")):
        p = counts[lang] + 0.5
        np.testing.assert_allclose(model.log_prob[k], np.log(p / p.sum()))
    assert np.exp(model.prior) == pytest.approx([5 / 9, 4 / 9])


def test_predictions(spark, docs):
    model = li.train(docs)
    rows = [(1, "the hat", None, ""), (2, "la gata llama", None, ""), (3, None, "xx", ""), (4, "", None, ""), (5, " 12 !?\n", None, ""), (None, "the " * 40_000, None, ""), (2, "la gata llama", None, "")]
    got = li.identify(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "score"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert got.count() == 7 and by[1][0] == by[None][0] == "xx" and by[2][0] == "yy"
    assert [by[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3 and all(0 <= s <= 1 for _, s in by.values())


def test_empty(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert li.identify(none, li.train(docs)).count() == 0
    assert {(r.lang_pred, r.score) for r in li.identify(docs, li.train(none)).collect()} == {("und", 0.0)}
    with pytest.raises(Exception, match="languages"):
        li.train(docs, max_languages=1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = li.held_out("doc_id", 4, 2)
    found = li.identify(docs.filter(out), li.train(docs.filter(~out)))
    row = found.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert row.n > 150 and row.a > 0.98


def plain_model(rows, buckets, alpha=0.5):
    """Naive Bayes written out, a character at a time: lang -> (log prior, log probability by bucket)."""
    counts, texts = {}, {}
    for text, lang in rows:
        if lang is not None:
            own = counts.setdefault(lang, [0] * buckets)
            texts[lang] = texts.get(lang, 0) + 1
            for b in plain_grams(text or "", buckets):
                own[b] += 1
    total = sum(texts.values())
    return {k: (math.log((texts[k] + 1) / (total + len(texts))), [math.log((c + alpha) / (sum(v) + alpha * buckets)) for c in v]) for k, v in counts.items()}


def plain_grams(text, buckets):
    text = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            if any(text[i : i + n]):
                yield h % buckets


def test_predictions_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda a: "".join(rng.choice(list(a), int(rng.integers(1, 7))))
    alphabets = {"aa": "abcdeé ", "bb": "cdefgß-", "cc": "ABXYZ12"}
    rows = [(" ".join(word(alphabets[k]) for _ in range(int(rng.integers(0, 9)))), k) for k in list(alphabets) * 30]
    rows += [(None, "aa"), ("", "bb"), ("x y", None), ("dd " * 5000, "bb")]
    asked = [" ".join(word("abcdefgßéxyz 1") for _ in range(3)) for _ in range(60)] + ["", None, "123", "é", "cde " * 9000]
    model = li.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), buckets=64)
    got = {r.id: r for r in li.identify(spark.createDataFrame(list(enumerate(asked)), "id int, text string"), model).collect()}
    plain = plain_model(rows, 64)
    for i, text in enumerate(asked):
        grams = list(plain_grams(text or "", 64))
        logs = {k: prior + sum(log[b] for b in grams) for k, (prior, log) in plain.items()}
        best = max(sorted(logs), key=lambda k: logs[k])
        share = 1 / sum(math.exp(max(-700, x - logs[best])) for x in logs.values())
        assert (got[i].lang_pred, got[i].score) == ((best, pytest.approx(share, rel=1e-6)) if grams else ("und", 0.0))


def test_ties_go_to_the_first_language(spark):
    model = li.train(spark.createDataFrame([("abc", "zz"), ("abc", "mm")], "text string, lang string"))
    assert [(r.lang_pred, r.score) for r in li.identify(spark.createDataFrame([("abc",), ("q",)], "text string"), model).collect()] == [("mm", 0.5)] * 2
