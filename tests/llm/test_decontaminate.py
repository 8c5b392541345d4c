from __future__ import annotations

import numpy as np
import pytest

from minewright.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, score string, item_id string"
ITEM = "Seven brave tailors quietly carried forty painted lanterns across the frozen harbour before anyone in town had woken up that morning".split()


def noise(n, seed):
    rng = np.random.default_rng(seed)
    return [f"n{x}" for x in rng.integers(0, 5000, n)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], SCHEMA).repartition(3)


def items(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in texts], "item_id long, text string, doc_id string")


def edited(rate, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for w in ITEM:
        r = rng.random()
        out += [] if r < rate / 3 else ["new", w] if r < 2 * rate / 3 else ["other"] if r < rate else [w]
    return out


def test_exact_edited_and_clean(spark):
    texts = [
        (1, " ".join(noise(300, 1) + ITEM + noise(300, 2))),
        (2, " ".join(noise(50, 3) + edited(0.2) + noise(50, 4))),
        (3, ", ".join(ITEM).upper() + "!"),
        (4, " ".join(noise(600, 5))),
        (5, " ".join(ITEM[:6] + noise(100, 6))),  # a quarter of the item
        (6, " ".join(ITEM + noise(100, 7) + edited(0.15, 2))),
        (7, None), (8, ""), (9, "..."), (None, " ".join(ITEM)), (1, " ".join(noise(300, 1) + ITEM + noise(300, 2))),
        (10, " ".join(noise(150_000, 8) + ITEM)),
        (11, " ".join(reversed(ITEM))),
    ]
    got = dc.find_leaks(docs(spark, texts), items(spark, [(77, " ".join(ITEM)), (78, None), (79, ""), (None, "only words of nobody")]))
    assert got.columns == ["doc_id", "item_id", "score", "start_word", "end_word", "n_copies"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == {1, 2, 3, 6, 10, None} and len(by[1]) == 2
    assert [(r.score, r.start_word, r.end_word) for r in by[1]] == [(1.0, 300, 300 + len(ITEM))] * 2
    assert 0.5 <= by[2][0].score < 1 and by[6][0].n_copies == 2 and by[10][0].start_word == 150_000 and by[3][0].score == 1.0


def test_an_item_that_most_documents_hold_is_still_found(spark):
    texts = [(i, " ".join(noise(20, i) + ITEM)) for i in range(200)] + [(500, " ".join(edited(0.2)))]
    got = dc.find_leaks(docs(spark, texts), items(spark, [(1, " ".join(ITEM))]))
    assert {r.doc_id for r in got.collect()} == {*range(200), 500}


@pytest.mark.parametrize("n", [300, 12_000])
def test_a_hot_edited_passage_is_found_at_any_corpus_size(spark, n):
    item = [f"word{i}" for i in range(38)]
    hot = " ".join("changed" if i % 5 == 4 else w for i, w in enumerate(item))
    texts = spark.range(0, n, 1, 4).selectExpr("id AS doc_id", f"concat('n', id, ' m', id, ' ', if(id % 3 = 0, '{hot}', 'nothing of it'), ' o', id) AS text")
    got = dc.find_leaks(texts, items(spark, [(1, " ".join(item))])).collect()
    assert {r.doc_id for r in got} == set(range(0, n, 3)) and len(got) == n // 3
    assert {(r.start_word, r.end_word, r.n_copies) for r in got} == {(2, 40, 1)} and got[0].score == pytest.approx((31 * 2 - 7) / 76)


@pytest.mark.parametrize("seed", range(10))
def test_regions_left_out_hold_no_leak(seed):
    rng = np.random.default_rng(seed)
    items = dc.Items(np.arange(5), list(range(5)), [rng.integers(0, 30, int(rng.integers(1, 20))).astype(np.uint64) for _ in range(5)])
    text = rng.integers(0, 60, 200).astype(np.uint64)
    item, a = rng.integers(0, 5, 50), rng.integers(0, 200, 50)
    b = np.minimum(200, a + rng.integers(1, 60, 50))
    for i, x, y, bound in zip(item, a, b, dc.ceilings(items, text, item, a, b), strict=True):
        assert dc.align(items.words[i], text[x:y])[0] <= max(bound, 0) <= 2 * len(items.words[i])


def test_one_seed_is_enough_and_a_copy_counts_once(spark):
    item = [f"word{i}" for i in range(30)]
    kept = {1, 3, 5, 6, 8, 10, 11, 12, 14, 16, 17, 19, 20, 22, 23, 25, 26, 28, 29, 0}  # only 10, 11, 12 in a row, two words in three
    text = [w if i in kept else "other" for i, w in enumerate(item)]
    stray = item[10:13]  # a run of the item, an item's length behind a whole copy
    got = dc.find_leaks(docs(spark, [(1, " ".join(text)), (2, " ".join([*item, *noise(11, 1), *stray]))]), items(spark, [(1, " ".join(item))]))
    assert {(r.doc_id, r.score, r.n_copies) for r in got.collect()} == {(1, 0.5, 1), (2, 1.0, 1)}


@pytest.mark.parametrize("rate", [0.2, 0.27, 0.33])
def test_recall_over_a_table_against_aligning_everything(spark, rate):
    rng = np.random.default_rng(int(rate * 100))
    words = [f"v{i}" for i in range(400)]
    draw = lambda n: list(rng.choice(words, n, p=1 / np.arange(1, 401) / (1 / np.arange(1, 401)).sum()))  # noqa: E731  # few common words, many rare ones
    wanted = [(i, draw((12, 20, 40)[i % 3])) for i in range(12)]
    texts = []
    for d in range(180):
        copy = []
        for w in wanted[d % 12][1]:
            r = rng.random()
            copy += [] if r < rate / 3 else [draw(1)[0], w] if r < 2 * rate / 3 else draw(1) if r < rate else [w]
        texts.append((d, draw(30) + (copy if d % 5 else draw(20)) + draw(30)))
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs(spark, [(i, " ".join(t)) for i, t in texts]), items(spark, [(i, " ".join(t)) for i, t in wanted])).collect()}
    number = {w: i for i, w in enumerate(words)}
    coded = lambda t: np.array([number[w] for w in t], np.uint64)
    every = {(d, i) for d, t in texts for i, own in wanted if dc.align(coded(own), coded(t))[0] >= 0.5 * dc.MATCH * len(own)}
    assert got <= every and len(got) >= 0.9 * len(every) and len(every) > 100


@pytest.mark.parametrize("seed", range(10))
def test_every_hit_lies_in_a_region_that_a_rarer_or_equal_one_opened(seed):
    rng = np.random.default_rng(seed)
    text, item, begin = np.sort(rng.integers(0, 3, 80)), np.zeros(80, np.int64), rng.integers(-20, 300, 80)
    text_, item_, low, high = dc.regions(text, item, begin, np.array([15]))
    for t in range(3):
        opened = []
        for x in begin[text == t].tolist():  # in the order of rarity
            if all(abs(x - y) > 15 for y in opened):
                opened.append(x)
        spans = list(zip(low[text_ == t], high[text_ == t], strict=True))
        assert len(spans) == len(opened) and all(a <= x <= b for x, (a, b) in zip(sorted(opened), spans, strict=True))
        assert all(any(a <= x <= b for a, b in spans) for x in begin[text == t]) and all(b - a <= 30 for a, b in spans)


@pytest.mark.parametrize("each", [1, 7])
def test_hits_of_a_seed_are_dealt_to_tasks(spark, monkeypatch, each):
    monkeypatch.setattr(dc, "EACH", each)
    monkeypatch.setattr(dc, "TOGETHER", 9)
    texts = [(i, f"n{i} alpha beta gamma delta m{i}") for i in range(60)] + [(100, "alpha beta gamma"), (101, "nothing here at all")]
    found = dc.find_leaks(docs(spark, texts), items(spark, [(1, "alpha beta gamma delta"), (2, "alpha beta gamma epsilon zeta")])).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted([(i, k) for i in [*range(60), 100] for k in (1, 2)])


def test_blocks_of_items_short_and_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 1)
    texts = [(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "omega")]
    found = dc.find_leaks(docs(spark, texts), items(spark, [(1, "alpha beta"), (2, "omega"), (3, "alpha beta gamma delta"), (3, "alpha beta gamma delta")]))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 1), (1, 3), (1, 3), (2, 1), (3, 2)]


def test_empty(spark):
    none = items(spark, [])
    assert dc.find_leaks(docs(spark, [(1, "a")]), none).count() == 0
    assert dc.find_leaks(docs(spark, []), items(spark, [(1, "a b c")])).count() == 0
    kept = dc.drop_leaks(docs(spark, [(1, "x a b c y"), (2, "z"), (None, "q")]), items(spark, [(1, "a b c")]))
    assert {r.doc_id for r in kept.collect()} == {2, None} and kept.columns == ["doc_id", "text", "score", "item_id"]


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return int(h.max())


@pytest.mark.parametrize("seed", range(30))
def test_alignment_against_the_plain_table(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 4, int(rng.integers(1, 25))).astype(np.uint64) for _ in range(2))
    score, x, y = dc.align(a, b)
    assert score == smith_waterman(a, b)
    assert smith_waterman(a, b[x:y]) == score and (score == 0 or y > x)


def test_leaks_of_the_test_data(spark):
    import re

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    wanted = [(r.item_id, norm(r.text)) for r in read("benchmark").collect()]
    exact = {(r.doc_id, i) for r in read("documents").collect() for i, t in wanted if t in norm(r.text)}
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(read("documents"), read("benchmark")).collect()} >= exact and exact
