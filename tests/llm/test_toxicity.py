from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minewright.llm import toxicity as tx
from minewright.llm.language_id import held_out

SCHEMA = "doc_id long, text string, lang string, score string"


def corpus(n=240):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    texts, labels, langs = [], [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 40))))
        y = int(i % 3 == 0)
        if y:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["nasty", "VILE", "foulness", "foulest", "fouler", "fouled", "fouling"])))
        texts.append(" ".join(words))
        labels.append(y)
        langs.append(["aa", "bb", None][i % 7 % 3])
    return texts, np.array(labels), langs


@pytest.fixture(scope="module")
def net():
    texts, labels, langs = corpus()
    return tx.fit(pa.array(texts), labels, langs)


def test_learns_words_and_their_starts(net):
    score = net.scores(pa.array(["w1 w2 nasty w3", "w1 w2 w3", "vile", "foulish w5 w9", "", None, " !! ", ("w1 " * 60_000) + "nasty"]))
    assert (score[[0, 2, 3, 7]] >= 0.5).all() and (score[[1, 4, 5, 6]] < 0.5).all() and ((score >= 0) & (score <= 1)).all()
    assert score[4] == score[5] == score[6]


def test_scores_match_the_layers(net):
    """The projected form against embedding, convolution, pooling and output written out."""
    for text in ("w1", "w1 nasty", "w1 w2 w3 vile w5 w6"):
        (tokens,) = tx._texts(pa.array([text]), len(net.embedding))
        x = np.concatenate([net.embedding[tokens].sum(1), np.zeros((2, net.embedding.shape[1]))])
        pooled = np.concatenate([np.max([sum(x[t + k] @ bank[k] for k in range(len(bank))) for t in range(len(tokens))], axis=0) for bank in net.banks])
        assert net.logits(tokens, np.array([0, len(tokens)]))[0] == pytest.approx(np.maximum(pooled, 0) @ net.out + net.bias, abs=1e-3)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, (m, 3)).astype(np.int32) for m in (5, 1, 0, 7)]
    net = tx.Network((1, 2, 3), 4, rng.normal(0, 0.5, (50, 6)), [rng.normal(0, 0.5, (w, 6, 4)) for w in (1, 2, 3)], rng.normal(0, 1, 12), 0.1)
    keep, by = rng.random((13, 3)) >= 0.3, rng.normal(0, 1, (4, 12))
    batch = tx.forward(net, texts, keep)
    banks, rows, deltas = tx.backward(net, batch, by * (batch.pooled != 0))
    assert (batch.pooled[2] == 0).all()

    def slope(values, at, e=1e-6):
        old = values[at]
        values[at] = old + e
        up = (tx.forward(net, texts, keep).pooled * by).sum()
        values[at] = old - e
        down = (tx.forward(net, texts, keep).pooled * by).sum()
        values[at] = old
        return (up - down) / (2 * e)

    for j, at in ((0, (0, 1, 2)), (1, (0, 2, 1)), (1, (1, 3, 0)), (2, (2, 5, 3)), (2, (0, 0, 0))):
        assert banks[j][at] == pytest.approx(slope(net.banks[j], at), abs=1e-6)
    for i, r in enumerate(rows):
        assert deltas[i, r % 6] == pytest.approx(slope(net.embedding, (r, r % 6)), abs=1e-6)


def test_training_adds_what_depends_on_words_together():
    """Label 1 if `very` stands right before `bad`; single words say nothing, so the starting point doesn't tell the labels apart."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 30, 12)]
        y = i % 2
        at, other = rng.choice(np.arange(0, 12, 3), 2, replace=False)
        words[at : at + 2] = ["very", "bad"] if y else ["very", "dull"]
        words[other : other + 2] = ["rather", "dull"] if y else ["rather", "bad"]
        texts.append(" ".join(words))
        labels.append(y)
    labels, cut = np.array(labels), 700
    right = lambda net: ((net.scores(pa.array(texts[cut:])) >= 0.5) == labels[cut:]).mean()
    fitted = lambda **o: tx.fit(pa.array(texts[:cut]), labels[:cut], [None] * cut, epochs=40, **o)
    assert right(fitted()) > 0.9 and right(fitted(rate=0.0)) < 0.7


def test_thresholds_by_language():
    """The same toxic words, said lightly in one language: its texts need a higher logit."""
    rng = np.random.default_rng(5)
    texts, labels, langs = [], [], []
    for i in range(800):
        lang, y = "ab"[i % 2], int(i % 4 < 2)
        words = [f"{lang}{x}" for x in rng.integers(0, 40, 15)]
        words[3] = "foul" if y else words[3]
        if lang == "b":
            words[7] = "foul"  # in every text of b
            words[9] = "filth" if y else words[9]
            words[3] = words[4]
        texts.append(" ".join(words))
        labels.append(y)
        langs.append(lang)
    net = tx.fit(pa.array(texts), np.array(labels), langs)
    assert net.languages == ["a", "b"] and net.thresholds[0] != net.thresholds[1]
    tokens = [tx._texts(pa.array([t]), len(net.embedding))[0] for t in texts]
    assert [net.language(t, np.array([0, len(t)]))[0] for t in tokens] == [i % 2 for i in range(800)]
    aside = np.arange(800) % 5 == 4
    z = np.array([net.logits(t, np.array([0, len(t)]))[0] for t in tokens])
    for k in (0, 1):
        own = aside & (np.arange(800) % 2 == k)
        errors = lambda cut: ((z[own] >= cut) != (np.array(labels)[own] == 1)).sum()
        assert errors(net.thresholds[k]) == min(errors(c) for c in np.append(z[own], np.inf))
    score = net.scores(pa.array(texts))
    assert ((score >= 0.5) == (np.array(labels) == 1)).mean() > 0.95


def test_long_texts_are_scored_but_not_learned_from(spark):
    texts, labels, langs = corpus()
    docs = spark.createDataFrame([(i, t, "aa", "") for i, t in enumerate(texts)] + [(10_000, "odd " * 20_000, "aa", "")], SCHEMA)
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(10_000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in tx.score(docs, tx.train(docs, known)).collect()}
    assert got[10_000] == 0 and tx.score(docs, tx.train(docs, known, longest=1 << 20)).filter("doc_id = 10000").first().score > 0.0


def test_batches_do_not_mix_texts(net):
    texts = ["nasty", "w1 w2", "", "vile w4", "w5"]
    together = net.scores(pa.array(texts))
    assert together == pytest.approx([net.scores(pa.array([t]))[0] for t in texts], abs=1e-6)


def test_one_label_or_none():
    for labels in ([0, 0, 0], [1, 1, 1]):
        score = tx.fit(pa.array(["a", "b c", "d"]), np.array(labels), [None] * 3).scores(pa.array(["a", "zz"]))
        assert ((score >= 0.5) == labels[0]).all()
    assert tx.fit(pa.array([], pa.string()), np.zeros(0, int), []).scores(pa.array(["x", None]))[0] < 0.5


def test_cut():
    assert tx._cut(np.array([1.0, 2.0, 4.0, 5.0]), np.array([0, 0, 1, 1])) == 3.0
    assert tx._cut(np.array([-1.0, 2.0]), np.array([0, 1])) == 0.5
    assert tx._cut(np.array([1.0, 2.0]), np.array([1, 1])) == 0.0


def test_tables(spark):
    texts, labels, langs = corpus()
    docs = spark.createDataFrame([(i, t, lang, "clash") for i, (t, lang) in enumerate(zip(texts, langs))] + [(None, "nasty", None, ""), (1, texts[1], None, ""), (999, None, None, "")], SCHEMA)
    known = spark.createDataFrame([(i, int(y), 5) for i, y in enumerate(labels)] + [(None, 1, 5), (3, None, 5), (7, 9, 5), (0, 1, 5)], "doc_id long, toxic int, text int").repartition(3)
    net = tx.train(docs, known, per_class=60)
    got = tx.score(docs.select("doc_id", "text", "score"), net)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == len(texts) + 3
    right = sum(r.predicted == labels[r.doc_id] for r in got.collect() if r.doc_id is not None and r.doc_id < len(texts))
    assert right > 0.97 * len(texts)
    assert tx.score(docs.limit(0), net).count() == 0
    assert tx.score(docs, tx.train(docs, known.limit(0))).filter("predicted = 1").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = held_out("doc_id", 5, 0)
    net = tx.train(docs, labels.filter(~out))
    row = tx.score(docs.join(labels.filter(out), "doc_id"), net).agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 700 and row.a > 0.96
