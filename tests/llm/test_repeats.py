from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from minewright.llm import repeats as rp
from minewright.llm import textnum as tn

SCHEMA = "doc_id long, text string, rid string, sha string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(4)
    text = lambda n, a="abcdé ": "".join(rng.choice(list(a), n))
    passage, line = text(150), text(45)
    out = [None, "", "short", text(39), "a" * 500, "ab" * 300, passage, passage, passage[:60], passage[7:] + text(30)]
    out += [text(int(rng.integers(0, 200))) + passage[int(rng.integers(0, 60)) : int(rng.integers(90, 150))] + text(int(rng.integers(0, 200))) for _ in range(40)]
    out += [text(30) + line + text(30) for _ in range(30)]
    out += [text(20) + line + text(5) + line, text(3000) + passage + text(3000)]
    return out


def run(spark, texts, **options):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = rp.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).orderBy("doc_id").collect()
    assert all(r.n_removed == sum(s["last"] - s["first"] for s in r.spans) and r.n_spans == len(r.spans) for r in got)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_brute_force(spark, hot):
    texts = corpus()
    assert run(spark, texts, length=40, seed=13, hot=hot) == brute(texts, 40)


@pytest.mark.parametrize(("length", "seed"), [(200, 64), (400, 64), (200, 200)])
def test_lengths(spark, length, seed):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcd é"), n))
    passage = text(500)
    texts = [text(100) + passage[int(rng.integers(0, 90)) : int(rng.integers(350, 500))] + text(50) for _ in range(25)] + [passage * 2, text(3000)]
    for hot in (2, 1000):
        assert run(spark, texts, length=length, seed=seed, hot=hot) == brute(texts, length)


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_all_occurrences_of_a_repeat_carry_its_number(spark, hot):
    texts = sorted({t for t in corpus() if t})
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows, _, repeats = rp.find_repeats(df, length=40, seed=13, hot=hot)
    of = {r.rid: texts[r.id].encode() for r in rows.collect()}
    groups = {}
    for r in repeats.collect():
        groups.setdefault(r.repeat, set()).add((r.rid, r.first, r.last))
    assert len(groups) > 30
    for spans in groups.values():
        (found,) = {of[i][a:b] for i, a, b in spans}
        n = len(found)
        assert n >= 40 and {x[:2] for x in spans} == {(i, a) for i, t in of.items() for a in range(len(t) - n + 1) if t[a : a + n] == found}


def test_a_length_that_does_not_fit(spark):
    with pytest.raises(ValueError, match="at most"):
        rp.find_repeats(spark.createDataFrame([], SCHEMA), length=70_000, seed=64)


def test_ids_and_empty(spark):
    long = "x y z " * 50
    rows = [(None, long, "", ""), (None, "only here " * 3, "", ""), (1, long, "", ""), (1, "other", "", "")]
    got = rp.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got), key=repr) == sorted([(None, 300, 300), (None, 30, 0), (1, 300, 300), (1, 5, 0)], key=repr)
    assert rp.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("length", [5, 12])
def test_anchors_depend_on_the_string_alone(length, monkeypatch):
    monkeypatch.setattr(rp, "SLICE", 100)  # texts are worked on in slices
    rng = np.random.default_rng(1)
    seed, seen, texts = 4, {}, ["".join(rng.choice(list("ab"), int(rng.integers(0, 90)))) for _ in range(60)]
    for chunk in tn.chunks(pa.array(texts)):
        place, first, last, _ = rp.anchors(chunk.data, chunk.offsets, length, seed)
        starts = [i for a, b in zip(first, last) for i in range(a, b + 1)]
        want = [i for a, b in zip(chunk.offsets, chunk.offsets[1:]) for i in range(a, b - length + 1)]
        assert sorted(starts) == want
        data = chunk.data.tobytes()
        for p, a, b in zip(place, first, last):
            for i in range(a, b + 1):
                assert 0 <= p - i <= length - seed
                assert seen.setdefault(data[i : i + length], p - i) == p - i


def test_interval_tree():
    words = sorted(["banana", "bandana", "band", "bank", "can", "cane", "dog"])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [common(a, b) for a, b in zip(words, words[1:])]
    got = {(n, tuple(words[i : j + 1])) for n, i, j in rp.intervals(lcp, len(words))}
    assert got == {(0, tuple(words)), (3, ("banana", "band", "bandana", "bank")), (4, ("band", "bandana")), (3, ("can", "cane"))}
    assert list(rp.intervals([], 1)) == []


def test_maximal_repeats_of_a_seed():
    behind = [b"xxA", b"xxB", b"xxB", b"yyy"]
    before = [b"ppq", b"ppq", b"ppr", b"ppq"]  # backwards
    pad = lambda rows: np.array([list(r) for r in rows], np.uint8)
    n = np.full(4, 3)
    got = {(a, b, tuple(sorted(g.tolist()))) for a, b, g in rp.maximal_repeats(pad(behind), n, pad(before), n, 3)}
    assert got == {(2, 3, (1, 2)), (3, 2, (0, 1)), (2, 2, (0, 1, 2)), (3, 0, (0, 1, 3))}
