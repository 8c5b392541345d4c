from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from minewright.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, rounds, width):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v, np.int32).tobytes(), v) for i, v in kept if i is not None)[:k]
    centres = [v for *_, v in first]
    square = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            if members := [v for (_, v), o in zip(kept, own) if o == j]:
                centres[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *nearest(v)) for i, v in kept]
    per = [sum(d for _, d, j in last if j == c) for c in range(len(centres))]
    return [(i, j, d, per[j], sum(per), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in last]


def plain(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    blobs = rng.normal(size=(5, 4)) * 3
    rows = [(i, (blobs[i % 5] + rng.normal(size=4) * 0.3).tolist()) for i in range(150)]
    rows += [(i, [0.5, 0.25, -1.0, 0.0]) for i in range(150, 230)] + [(7, rows[3][1]), (7, rows[7][1]), (None, rows[9][1])]
    odd = [(300, None), (301, []), (302, [1.0]), (303, [1.0, 2.0, None, 1.0]), (304, [1.0, math.nan, 1.0, 1.0]), (305, [math.inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS file", "4 AS cluster").repartition(3)
    found, did = centroids.cluster(df, k=8, rounds=10, width=4)
    assert plain(tuple(r) for r in found.collect()) == plain(brute(rows, 8, 10, 4))
    assert did[0]["scanned"] == did[0]["vectors"] == len(rows)
    assert sum(x["scanned"] for x in did[1:]) < 0.5 * 10 * len(rows)  # the bounds leave most vectors alone


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.1])]
    found, _ = centroids.cluster(spark.createDataFrame(rows, SCHEMA), width=2)
    assert plain(tuple(r) for r in found.collect()) == plain(brute(rows, 8, 10, 2))
    assert centroids.cluster(spark.createDataFrame([], SCHEMA), width=2)[0].collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None)], SCHEMA), width=2)[0].collect() == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], SCHEMA), width=2)


def test_tightened_drift_is_a_bound_and_tighter_than_the_drift():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(300):
        dim = int(rng.integers(2, 6))
        centre, old, new = rng.normal(size=dim) * 4, rng.normal(size=dim) * 4, rng.normal(size=dim) * 4
        radius = float(rng.random() * 4)
        bound = centroids.tightened_drift(centre, radius, old, new)
        inside = rng.normal(size=(2000, dim))
        inside = centre + radius * inside / np.linalg.norm(inside, axis=1, keepdims=True) * rng.random((2000, 1)) ** (1 / dim)
        lost = np.linalg.norm(inside - old, axis=1) - np.linalg.norm(inside - new, axis=1)
        drift = np.linalg.norm(new - old)
        assert lost.max() <= bound + 1e-9 and bound <= drift + 1e-12
        less += bound < 0.9 * drift
    assert less > 150
