from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from minewright.operators import metrics, regression, sampling

#: A published table of heights (cm) and weights (kg) with a known line.
HEIGHTS = [147, 150, 153, 158, 163, 165, 168, 170, 173, 175, 178, 180, 183]
WEIGHTS = [49, 50, 51, 54, 58, 59, 60, 62, 63, 64, 66, 67, 68]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(list(zip(HEIGHTS, WEIGHTS)), "h int, w int")


def test_known_line(spark, people):
    row = regression.ols(people, "h", "w").first()
    assert row.slope == pytest.approx(0.5592049619396671, abs=1e-10)
    assert row.intercept == pytest.approx(-33.73541020580768, abs=1e-8)
    assert row.r2 == pytest.approx(0.9944856921763272) and row.n == 13
    new = spark.createDataFrame([(155,), (160,)], "h int")
    got = regression.predict_line(new, regression.ols(people, "h", "w"), "h").orderBy("h").collect()
    assert [round(r.predicted, 2) for r in got] == [52.94, 55.74]
    ends = regression.line_grid(regression.ols(people, "h", "w"), 145, 185).orderBy("x").collect()
    assert [r.x for r in ends] == [145, 185] and ends[0].y == pytest.approx(145 * row.slope + row.intercept)


def test_normal_equations(people):
    got = {r.term: r.weight for r in regression.ols_multi(people, ["h"], "w").collect()}
    assert got["h"] == pytest.approx(0.5592049619396671, abs=1e-8) and got["(intercept)"] == pytest.approx(-33.73541020580768, abs=1e-6)
    cells = {(r.i, r.j): r.value for r in regression.gram_matrix(people, ["h"], "w").collect()}
    assert cells[0, 0] == 13 and cells[0, 1] == sum(HEIGHTS) and cells[1, -1] == sum(a * b for a, b in zip(HEIGHTS, WEIGHTS))


def test_rank_deficient_columns(people):
    twice = people.withColumn("h2", F.col("h") * 2)
    got = {r.term: r.weight for r in regression.ols_multi(twice, ["h", "h2"], "w").collect()}
    assert got["h"] + 2 * got["h2"] == pytest.approx(0.5592049619396671, abs=1e-6)


def test_degenerate_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("d", None, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in regression.ols(df, "x", "y", ["g"]).collect()}
    assert got["a"].slope is None and got["b"].slope is None and got["c"].slope == 0 and got["d"].n == 0


@pytest.mark.parametrize("n", [1, 7, 100])
@pytest.mark.parametrize("size", [0.2, 1, 0.0])
def test_split_is_exact_and_stable(spark, n, size):
    df = spark.range(n)
    got = {r.id: r.is_test for r in sampling.train_test(df, "id", size, 42).collect()}
    assert len(got) == n and sum(got.values()) == (math.ceil(size * n) if isinstance(size, float) else size)
    again = {r.id: r.is_test for r in sampling.train_test(df.repartition(5), "id", size, 42).collect()}
    assert again == got


def test_split_bounds(spark):
    with pytest.raises(ValueError):
        sampling.train_test(spark.range(3), "id", 4)
    assert sampling.train_test(spark.range(0), "id", 0.2).count() == 0


def test_mask(spark):
    df = sampling.bernoulli_mask(spark.range(20_000), "id", 0.1, 42)
    n = df.filter("mask").count()
    assert 1800 < n < 2200
    assert {r.id for r in df.filter("mask").collect()} == {r.id for r in sampling.bernoulli_mask(spark.range(20_000).repartition(7), "id", 0.1, 42).filter("mask").collect()}
    hidden = sampling.hide_labels(df.withColumn("label", F.lit(1)), "label")
    assert hidden.filter("seed_label IS NOT NULL").count() == n


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, True, 1), (2, 1, False, 2), (0, None, True, 3), (None, 2, True, 4)], "prediction int, label int, seed boolean, id int")
    row = metrics.accuracy(df, subset="seed").first()
    assert (row.n, row.n_subset) == (3, 2) and row.accuracy == pytest.approx(1 / 3) and row.subset_accuracy == 0.5
    report = {r.label: (r.n, r.n_classes, r.n_total) for r in metrics.class_report(df).collect()}
    assert report == {1: (2, 2, 4), 2: (1, 2, 4), None: (1, 2, 4)}
    assert metrics.class_head(df, "id", 1).count() == 3


def test_qr_is_right_where_the_gram_matrix_is_not(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=2000)
    b = a + rng.normal(size=2000) * 1e-6
    c = rng.normal(size=2000) * 1e3
    y = 3.0 + 2.0 * a - 5.0 * b + 0.25 * c
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist(), y.tolist(), strict=True)), "a double, b double, c double, y double").repartition(7)
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)], df.schema))
    want = {"(intercept)": 3.0, "a": 2.0, "b": -5.0, "c": 0.25}
    off = lambda df_: max(abs(r.weight - want[r.term]) for r in df_.collect())
    assert off(regression.ols_qr(df, ["a", "b", "c"], "y")) < 1e-7 < 1e-3 < off(regression.ols_multi(df, ["a", "b", "c"], "y"))
    r = regression.triangular_factor(df, ["a", "b", "c"], "y", fan_in=2)
    x = np.column_stack([np.ones(2000), a, b, c, y])
    assert np.allclose(r.T @ r, x.T @ x)


def test_qr_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert sum(r.weight for r in regression.ols_qr(df, ["x"], "y").collect()) == pytest.approx(2.0)
    assert [r.weight for r in regression.ols_qr(df.filter("x > 5"), ["x"], "y").collect()] == [0.0, 0.0]
