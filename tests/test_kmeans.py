from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from minewright.operators import clustering, images


def plain_nearest(x, centers):
    d = np.stack([((x - c) ** 2).sum(1) for c in centers], 1)
    at = np.round(d, 9).argmin(1)
    return at, d[np.arange(len(x)), at]


@pytest.mark.parametrize(("rows", "k", "dim", "scale"), [(500, 7, 3, 1.0), (300, 5_000, 4, 1.0), (400, 20, 2, 1e4), (0, 3, 2, 1.0)])
def test_nearest_is_that_of_a_loop(rows, k, dim, scale):
    rng = np.random.default_rng(k)
    centers = np.round(rng.normal(size=(k, dim)) * 3) * scale / 2  # many ties, many equal centers
    x = np.round(rng.normal(size=(rows, dim)) * 4) * scale / 2 + (rng.random((rows, 1)) < 0.2) * 0.1
    for got, want in zip(clustering.nearest(x, centers, at_once=4 * k), plain_nearest(x, centers), strict=True):
        assert (got == want).all()


def test_sums_of_all_models_are_those_of_loops_and_only_ties_are_looked_at_twice(monkeypatch):
    """All fits share one product; before (F10, F11) each fit measured the distance of every row to its center again."""
    rng, asked, plain = np.random.default_rng(6), [], clustering.nearest
    monkeypatch.setattr(clustering, "nearest", lambda x, c: asked.append(len(x)) or plain(x, c))
    x = np.concatenate([rng.normal(size=(700, 5)), np.full((50, 5), 3.0)])
    w = rng.integers(1, 4, len(x)).astype(float)
    models = {4: rng.normal(size=(7, 5)), 2: rng.normal(size=(1, 5)), 9: np.array([[2.0] * 5, [4.0] * 5, [2.0] * 5])}
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 5), pa.int32()), pa.array(v.ravel())) for v in (x[:300], x[300:])]
    batches = [pa.RecordBatch.from_arrays([v, pa.array(u)], ["_x", "_w"]) for v, u in zip(lists, (w[:300], w[300:]), strict=True)]
    found = clustering.member_sums(batches, {m: models[m] for m in (4, 2)}, at_once=800)
    assert not asked
    found |= clustering.member_sums(batches, {9: models[9]})
    assert sum(asked) > 0
    for m, c in models.items():
        at, _ = plain_nearest(x, c)
        want = np.stack([(np.column_stack([x, np.ones(len(x))]) * w[:, None])[at == j].sum(0) for j in range(len(c))])
        assert np.allclose(found[m], want, rtol=0, atol=1e-9)


def blobs():
    """Nine groups of uneven distances and sizes, on which a single start often ends in a poor optimum."""
    rng = np.random.default_rng(8)
    spots = [(0, 0), (3, 0), (0, 3), (60, 60), (63, 60), (60, 63), (-80, 40), (-77, 40), (-80, 43)]
    return [(i, (np.array(spots[i % 9]) + rng.normal(size=2) * 0.2).tolist()) for i in range(450)]


def inertia(rows, centers):
    return plain_nearest(np.array([v for _, v in rows]), np.array(centers))[1].sum()


def test_the_best_of_ten_beats_single_starts(spark):
    rows = blobs()
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(3)
    best = clustering.kmeans_best(df, [3, 9], restarts=10).collect()
    own = [r for r in best if r.k == 9]
    assert [r.cluster for r in own] == list(range(9)) and [r.center for r in own] == sorted(r.center for r in own)
    assert abs(own[0].inertia - inertia(rows, [r.center for r in own])) < 1e-6
    groups = np.array([v for _, v in rows])
    ideal = sum(((groups[i::9] - groups[i::9].mean(0)) ** 2).sum() for i in range(9))
    assert abs(own[0].inertia - ideal) < 1e-6  # the groups themselves
    single = [clustering.kmeans_best(df, [9], restarts=1, seed=100 + s).first().inertia for s in range(6)]
    assert max(single) > 1.5 * ideal and min(single) >= ideal - 1e-6


def test_fits_are_fixed_points_and_the_same_for_any_partitioning(spark):
    rows = blobs() + [(1000 + i, [1.0, 1.0]) for i in range(2000)]
    frames = [spark.createDataFrame(rows, "id long, features array<double>").repartition(n) for n in (1, 5)]
    a, b = ([(r.k, r.cluster, [round(x, 6) for x in r.center]) for r in clustering.kmeans_best(f, [2, 5], restarts=3, tol=0.0).collect()] for f in frames)
    assert a == b
    centers = np.array([c for k, _, c in a if k == 5])
    x = np.array([v for _, v in rows])
    at, _ = plain_nearest(x, centers)
    assert np.allclose([x[at == j].mean(0) for j in range(5)], centers, atol=1e-5)


def test_weights_few_vectors_nulls_and_no_rows(spark):
    df = spark.createDataFrame([([1.0], 5.0), ([1.0], 1.0), ([9.0], 2.0), (None, 3.0)], "features array<double>, w double")
    assert [r.center for r in clustering.kmeans(df, 5, weight="w").collect()] == [[1.0], [9.0]]
    one = clustering.kmeans_best(df, [1], weight="w").first()
    assert abs(one.center[0] - 3.0) < 1e-9 and abs(one.inertia - (6 * 4 + 2 * 36)) < 1e-9
    assert clustering.kmeans_best(df.filter("w > 100"), [2]).collect() == []


def test_a_pass_reads_blocks_and_shuffles_nothing(spark):
    """Before (F11), every pass decoded a list per vector and shuffled a row per task, fit, cluster and coordinate."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(5000, 4)).astype(np.float32).astype(float), rng.normal(size=(1000, 4)), np.full((1, 4), 1e300)])
    df = spark.createDataFrame([(v.tolist(),) for v in x[:-1]], "features array<double>").repartition(2)
    rows = clustering.weighted_rows(df)
    assert rows.count() <= 2 * 3
    models = {1: x[:3], 7: x[3:8]}
    spark.sparkContext.setJobGroup("pass", "pass")
    found = clustering._sums(rows, models)
    status = spark.sparkContext.statusTracker()
    jobs = status.getJobIdsForGroup("pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(len(status.getJobInfo(j).stageIds) for j in jobs) == 1
    for m, c in models.items():
        at, d = plain_nearest(x[:-1], c)
        want = np.stack([np.column_stack([x[:-1], np.ones(len(x) - 1)])[at == j].sum(0) for j in range(len(c))])
        assert np.allclose(found[m][0], want, rtol=0, atol=1e-8) and abs(found[m][1] - d.sum()) < 1e-6
    # numbers that four bytes don't hold stay as they are
    parts = list(clustering._parts(clustering._blocks(spark.createDataFrame([(v.tolist(), 1.0) for v in x[-3:]], "_x array<double>, _w double").coalesce(1)).toArrow().to_batches()))
    assert sorted(map(tuple, np.concatenate([v for v, _ in parts]))) == sorted(map(tuple, x[-3:]))


def test_best_palettes(spark):
    pixels = spark.createDataFrame([(i, c, c, c) for i, c in enumerate([10, 10, 12, 200, 202, 202])], "id long, r int, g int, b int")
    found = [(r.k, r.cluster, r.r, r.g, r.b) for r in images.best_palettes(pixels, [1, 2]).collect()]
    assert found == [(1, 0, 106, 106, 106), (2, 0, 10, 10, 10), (2, 1, 201, 201, 201)]
