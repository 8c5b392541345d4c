from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from minewright.operators import cells, neighbors, sampling, sketches
from minewright.plans import catalog

SCHEMA = "id long, features array<double>, name string"


def brute(queries, base, k, self_join=False):
    out = []
    for i, v in queries:
        near = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9), j) for j, w in base if not (self_join and i == j))
        out += [(i, j, rank + 1) for rank, (_, j) in enumerate(near[:k])]
    return sorted(out)


def plain(df):
    return sorted((r.q_id, r.b_id, r["rank"]) for r in df.collect())


def points(spark, rows):
    return spark.createDataFrame([(i, v, f"n{i}") for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plane():
    rng = np.random.default_rng(7)
    spots = rng.normal(size=(12, 2)) * 20
    rows = [(i, (spots[i % 12] + rng.normal(size=2)).tolist()) for i in range(600)]
    return rows + [(600 + i, rows[i % 3][1]) for i in range(300)]  # a third of all rows on three spots: ties


def test_cells_equal_brute_force_and_leave_most_cells_out(spark, plane):
    df = points(spark, plane)
    asked = df.filter("id % 3 = 0")
    for self_join in (False, True):
        near, reads = neighbors.knn_reads(asked, df, 7, query_block=50, self_join=self_join, cell_rows=16)
        assert plain(near) == brute([x for x in plane if x[0] % 3 == 0], plane, 7, self_join)
        reads = reads.collect()
        assert len(reads) == 300 and all(1 <= r.cells_read <= r.cells for r in reads)
        assert sum(r.cells_read for r in reads) < 0.4 * sum(r.cells for r in reads)


def test_cells_read_hold_all_near_rows(spark, plane):
    """A cell that isn't read has no row that is nearer than the k-th neighbour: bounds() against all distances."""
    base = np.array([v for _, v in plane])
    pivots = np.unique(base[::37], axis=0)
    d = cells.distances(base, pivots)
    own, away = d.argmin(1), d.min(1)
    of = lambda f: np.array([f(away[own == c]) if (own == c).any() else 0.0 for c in range(len(pivots))])
    held = cells.Cells(pivots, np.bincount(own, minlength=len(pivots)), of(np.min), of(np.max))
    queries = np.random.default_rng(1).normal(size=(200, 2)) * 25
    bounds, real = held.bounds(cells.distances(queries, pivots)), cells.distances(queries, base)
    for c in np.flatnonzero(held.count):
        assert (bounds[:, c] <= real[:, own == c].min(1) + 1e-9).all()
    assert (bounds > 0).mean() > 0.7


def test_cells_in_many_dimensions_ids_of_text_and_extra_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(150)]
    df = points(spark, rows).withColumn("id", F.col("id").cast("string"))
    found = neighbors.knn_join(df.filter("id < '3'"), df, 4, extra=("name",), method="cells", query_block=16)
    assert all(r.name == f"n{r.b_id}" for r in found.collect())
    want = brute([(str(i), v) for i, v in rows if str(i) < "3"], [(str(i), v) for i, v in rows], 4)
    assert plain(found) == want


def test_cells_with_few_rows_nulls_and_empty_sides(spark):
    rows = points(spark, [(1, [0.0, 1.0]), (2, [0.0, 3.0])]).unionByName(spark.createDataFrame([(None, [1.0, 1.0], "x"), (5, None, "y")], SCHEMA))
    assert plain(neighbors.knn_join(rows, rows, 5, method="cells")) == brute([(1, [0, 1]), (2, [0, 3])], [(1, [0, 1]), (2, [0, 3])], 5)
    none = rows.filter("id > 100")
    for q, b in ((none, rows), (rows, none), (none, none)):
        for method in ("cells", "lsh", "exact"):
            assert neighbors.knn_join(q, b, 3, method=method).collect() == []


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    sc, none = spark.sparkContext, spark.sparkContext._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_cells_shuffle_no_copies_where_nothing_is_left_out(spark):
    """In 30 dimensions a query reads a large share of the cells; the rows shuffled grow with the rows, not with rows times cells (F7 to F9)."""
    rng, k = np.random.default_rng(4), 3
    rows = [(i, rng.normal(size=30).tolist()) for i in range(640)]
    df = points(spark, rows).cache()
    df.count()
    before = shuffled_rows(spark)
    near, reads = neighbors.knn_reads(df, df, k, self_join=True, cell_rows=10, query_block=100)
    assert shuffled_rows(spark) - before < (k + 8) * len(rows)
    assert reads.agg(F.avg(F.col("cells_read") / F.col("cells")).alias("share")).first().share > 0.3
    assert plain(near) == brute(rows, rows, k, True)


def test_cells_far_from_zero_and_in_one_place(spark):
    """Distances far smaller than the vectors, and cells of more rows than a file or a block holds."""
    rng = np.random.default_rng(5)
    spots = np.array([[1e4, -1e4, 3e3], [1e4, 1e4, 0.0]])
    rows = [(i, (spots[i % 2] + rng.normal(size=3) * 1e-3).tolist()) for i in range(300)] + [(300 + i, spots[0].tolist()) for i in range(200)]
    df = points(spark, rows)
    assert plain(neighbors.knn_join(df, df, 4, method="cells", query_block=40, self_join=True)) == brute(rows, rows, 4, True)


def test_exact_changes_to_cells_beyond_a_block(spark, plane):
    df = points(spark, plane[:400])
    assert plain(neighbors.knn_join(df, df, 5, query_block=64, self_join=True)) == plain(neighbors.knn_join(df, df, 5, query_block=1000, self_join=True))


def test_sign_projections_find_nine_of_ten_among_a_tenth(spark):
    rows = catalog.QUERIES["knn_lsh_recall"](spark, "/root/testdata/sf0.1").collect()
    recall, share = (sum(r[c] for r in rows) / len(rows) for c in ("recall", "proposed_share"))
    print("recall", recall, "proposed", share)
    assert len(rows) == 20 and recall >= 0.9 and share < 0.1


def test_sketch_radius_follows_density():
    rng = np.random.default_rng(3)
    sample = np.concatenate([rng.normal(size=(500, 16)), rng.normal(size=(500, 16)) * 0.01 + 5])
    sketch = sketches.Sketch(sample, 10, 0.05, 0.9)
    own = sketches.codes(sample, sketch.centre, sketch.axes)
    away = sketches.hamming(own, own)
    assert (away == np.array([[bin(int(a) ^ int(b)).count("1") for b in own[:20, 0]] for a in own[:20, 0]]).astype(int)).all() if own.shape[1] == 1 else True
    assert ((away <= sketch.radius(own)[:, None]).mean(1) <= 0.051).all()


def test_first_rows_cuts(spark, plane):
    df = points(spark, plane)
    assert sorted(r.id for r in sampling.first_rows(df, "id", 17).collect()) == list(range(17))
    assert sampling.first_rows(df, "id", 5000).count() == 900
    assert sampling.first_rows(df, "id", 0).count() == 0
