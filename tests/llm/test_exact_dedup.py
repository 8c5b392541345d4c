from __future__ import annotations

import hashlib
import re

import pytest

from minewright.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, keep_id string, kept string"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\t-\r]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (5, "a  b"), (3, "a\tb"), (4, "a\n\r b"), (1, " a b"), (2, "A b"), (7, None), (6, ""), (8, " "), (9, "\x0b\x0c"), (10, "a b"), (11, "a b"),
    (12, "é" * 50_000), (13, "é" * 50_000), (14, "x"), (14, "x"), (None, "y"), (None, "y"), (None, "x"), (20, "a\x1fb"),
]


@pytest.mark.parametrize("hot", [0, 1, 256])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_brute_force(spark, hot, fan_in):
    rows = [(*r, "clash", None) for r in ROWS]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = ed.exact_dedup(df, runs=5, fan_in=fan_in, hot_groups=hot)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty(spark):
    got = ed.exact_dedup(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and got.count() == 0


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text").repartition(7)
    got = ed.exact_dedup(df, hot_groups=1)
    assert got.filter("keep_id = 0").count() == 1000 and got.filter("kept").count() == 2001


def test_runs_are_sorted_and_merged(spark, capsys):
    """Every level sorts entries by run and digest on both sides of the exchange and merges neighbours."""
    digests = spark.range(500).selectExpr("sha2(string(id % 90), 256) AS _sha", "5L AS _len", "7L AS _check", "500 - id AS _id", "1L AS _n").repartition(9)
    merged = ed.merge_runs(digests, runs=16, fan_in=4)
    merged.explain()
    plan = capsys.readouterr().out
    assert plan.count("SortAggregate") == 6 and "HashAggregate" not in plan and plan.count("Sort [") == 6
    got = {(r._sha, r._id, r._n) for r in merged.collect()}
    assert got == {(hashlib.sha256(str(k).encode()).hexdigest(), 500 - max(range(k, 500, 90)), len(range(k, 500, 90))) for k in range(90)}
