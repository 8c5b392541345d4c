from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from minewright.operators import propagation

SCHEMA = "id long, features array<double>"


def dense(rows, gamma):
    return {(i, j): math.exp(-gamma * sum((a - b) ** 2 for a, b in zip(v, w, strict=True))) for i, v in rows for j, w in rows}


@pytest.mark.parametrize("dim", [1, 2, 5])
def test_radius_graph_is_the_dense_one_but_for_what_weighs_nothing(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, (rng.normal(size=dim) * 6).tolist()) for i in range(150)] + [(200, [0.0] * dim), (201, [0.0] * dim)]
    df = spark.createDataFrame([*rows, (None, [1.0] * dim), (300, None)], SCHEMA).repartition(3)
    got = {(r.src, r.dst): r.w for r in propagation.radius_graph(df, 20.0).collect()}
    want = dense(rows, 20.0)
    assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    lost = {}
    for (i, _), w in ((p, w) for p, w in want.items() if p not in got):
        lost[i] = lost.get(i, 0.0) + w
    assert max(lost.values()) < 1e-9
    assert len(got) < 0.5 * len(want) and all(got[i, i] == 1.0 for i, _ in rows)


def test_points_in_a_line_have_few_edges_however_many(spark):
    """At a fixed density the edges, and the pairs of a cell with its neighbours, grow with the points."""
    sizes = [propagation.radius_graph(spark.range(n).selectExpr("id", "array(cast(id AS double), 0.5D) AS features"), 1.0).count() / n for n in (500, 6000)]
    assert sizes[1] < 1.3 * sizes[0] < 20


def test_no_points_and_vectors_of_several_lengths(spark):
    assert propagation.radius_graph(spark.createDataFrame([], SCHEMA), 1.0).collect() == []
    with pytest.raises((ValueError, PySparkException), match="1 to 2"):
        propagation.radius_graph(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), 1.0)


def plain(edges, seeds, steps):
    """p by step for the normalised iteration with seeds put back."""
    p = {(i, c): 1.0 for i, c in seeds.items()}
    for _ in range(steps):
        u = {}
        for s, d, w in edges:
            for (i, c), x in p.items():
                if i == d and s not in seeds:
                    u[s, c] = u.get((s, c), 0.0) + w * x
        total = {}
        for (i, _), x in u.items():
            total[i] = total.get(i, 0.0) + x
        p = {k: x / total[k[0]] for k, x in u.items() if x > 0} | {(i, c): 1.0 for i, c in seeds.items()}
    return p


@pytest.mark.parametrize("steps", [1, 5])
def test_changes_sent_give_what_whole_states_give(spark, steps):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 120), rng.integers(0, 30, 120), rng.random(120), strict=True)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    seeds = {0: 1, 5: 2, 9: 1, 14: 3}
    found = propagation.propagate(spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame([*seeds.items(), (20, None), (21, -1)], "id long, label int"), max_iter=steps, tol=0.0)
    want = plain(edges, seeds, steps)
    best = {}
    for (i, c), x in sorted(want.items()):
        if i not in best or round(x, 9) > round(best[i][1], 9):
            best[i] = (c, x)
    assert {r.id: (r.label, round(r.score, 9)) for r in found.collect()} == {i: (c, round(x, 9)) for i, (c, x) in best.items()}


def test_with_a_tolerance_the_harmonic_equations_hold_and_no_table_is_left(spark):
    points = spark.createDataFrame([(i, [i * 0.3, 0.0], 0 if i == 0 else 1 if i == 5 else None) for i in range(6)], "id long, features array<double>, seed_label int")
    edges = propagation.radius_graph(points, 20.0)
    before = {t.name for t in spark.catalog.listTables()}
    found = {r.id: r for r in propagation.propagate(edges, points.selectExpr("id", "seed_label AS label"), tol=1e-4).collect()}
    assert {t.name for t in spark.catalog.listTables()} == before
    assert [found[i].label for i in range(6)] == [0] * 3 + [1] * 3
    p = {i: r.score if r.label == 0 else 1 - r.score for i, r in found.items()}
    w = {(r.src, r.dst): r.w for r in edges.collect()}
    for i in range(1, 5):
        own = [(x, j) for (s, j), x in w.items() if s == i]
        assert abs(p[i] - sum(x * p[j] for x, j in own) / sum(x for x, _ in own)) < 1e-3
