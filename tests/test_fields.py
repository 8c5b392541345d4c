from __future__ import annotations

import math

import numpy as np
import pytest

from minewright.operators import fields, propagation

SCHEMA = "id long, features array<double>, seed_label int"


def table(n=300, dim=2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * 0.15
    return [(i, v.tolist(), int(i % 3) if i % 9 == 0 else None) for i, v in enumerate(x)]


def brute(rows, gamma, steps):
    x, code = np.array([r[1] for r in rows]), np.array([-1 if r[2] is None else r[2] for r in rows])
    w = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    seeds = np.where(code[:, None] >= 0, np.arange(3)[None, :] == code[:, None], 0).astype(float)
    p = seeds
    for _ in range(steps):
        u = w @ p
        p = np.where(code[:, None] >= 0, seeds, u / u.sum(1, keepdims=True))
    return p


@pytest.mark.parametrize("dim", [1, 2])
def test_a_field_gives_what_all_pairs_give(spark, dim):
    rows = table(dim=dim)
    for steps in (1, 5):
        found = propagation.propagate_labels(spark.createDataFrame(rows, SCHEMA).repartition(3), k=None, max_iter=steps, tol=0.0).collect()
        want = brute(rows, 20.0, steps)
        assert len(found) == len(rows)
        assert all(r.label == want[r.id].argmax() and abs(r.score - want[r.id].max()) < 1e-9 for r in found)


def test_no_pairs_are_formed_where_all_points_are_near(spark, monkeypatch):
    monkeypatch.setattr(propagation, "radius_graph", lambda *a: pytest.fail("pairs"))
    points = spark.createDataFrame(table(), SCHEMA)
    assert propagation.propagate_labels(points, k=None).filter("label IS NULL").count() == 0


def test_what_a_field_does_not_serve_goes_by_the_graph(spark):
    far = [*table(60), (900, [3.0, 0.0], None)]
    wide = [(i, [float(i), 0.0], 1 if i == 0 else None) for i in range(2 * fields.CELLS)]
    three = table(60, dim=3)
    twice = [*table(60), (0, [0.1, 0.1], None)]
    for rows in (far, wide, three, twice, [(1, [0.0, 0.0], None)], [(1, None, 1)], [(1, [math.nan, 0.0], 1)]):
        assert fields.propagate_field(spark.createDataFrame(rows, SCHEMA), "seed_label", 20.0, 5, 0.0, "id", "features") is None
    found = {r.id: r.label for r in propagation.propagate_labels(spark.createDataFrame(far, SCHEMA), k=None).collect()}
    assert len(found) == 61 and found[900] is None
