from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from minewright.operators import clustering, images, metrics, neighbors, propagation
from minewright.plans import catalog

BLOBS = [(i, [10.0 * (i % 3) + 0.1 * (i % 5), 5.0 * (i % 3) - 0.1 * (i % 4)], i % 3) for i in range(60)]


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame(BLOBS, "id long, features array<double>, label int").repartition(3)


def test_votes(spark):
    train = spark.createDataFrame([(1, [0.0], 5), (2, [1.0], 5), (3, [2.0], 4), (4, [3.0], 4)], "id long, features array<double>, label int")
    test = spark.createDataFrame([(9, [1.5], 0), (8, [0.0], 0)], "id long, features array<double>, label int")
    got = lambda **o: {r.id: r.prediction for r in neighbors.knn_classify(train, test, **o).collect()}
    assert got(k=4) == {9: 4, 8: 4}  # two votes each: the smaller label
    assert got(k=1) == {9: 5, 8: 5}  # equal distances: the smaller id
    assert got(k=3, weights="distance") == {9: 5, 8: 5}  # 8 lies on a point, which alone votes
    assert got(k=3)[8] == 5


def test_knn_on_blobs(blobs):
    train, test = blobs.filter("id % 4 <> 0"), blobs.filter("id % 4 = 0")
    for options in ({"k": 1}, {"k": 10}, {"k": 10, "weights": "distance"}):
        assert metrics.accuracy(neighbors.knn_classify(train, test, **options)).first().accuracy == 1.0
    one = neighbors.knn_join(test, train, 4, query_block=5)  # several blocks of queries
    assert sorted(one.collect()) == sorted(neighbors.knn_join(test, train, 4).collect()) and one.count() == 60


def test_lsh_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    near = rows.filter("id < 40").unionByName(rows.filter("id < 40").select((F.col("id") + 10_000).alias("id"), F.transform("features", lambda x: x + 0.01).alias("features")))
    exact = {(r.q_id, r.b_id) for r in neighbors.knn_join(rows.filter("id < 40"), near, 2).collect()}
    found = {(r.q_id, r.b_id) for r in neighbors.knn_join(rows.filter("id < 40"), near, 2, method="lsh").collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_searches_query_one_row_in_a_hundred_against_all(spark):
    sf = "/root/testdata/sf0.01"
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    exact, found = (catalog.QUERIES[name](spark, sf).collect() for name in ("knn_search", "knn_lsh"))
    wanted = {i for i in ids if i % 100 == 0}
    for rows in (exact, found):
        assert sorted((r.q_id, r["rank"]) for r in rows) == sorted((i, k) for i in wanted for k in range(1, 11))
    # a row finds itself; recall is that of the others
    real, got = ({(r.q_id, r.b_id) for r in rows if r.q_id != r.b_id} for rows in (exact, found))
    print("recall", len(real & got) / len(real))
    assert len(real & got) >= 0.9 * len(real)


def test_lsh_completes_queries_without_near_rows(spark):
    rows = spark.createDataFrame([(i, [100.0 * i, 0.0]) for i in range(30)], "id long, features array<double>")
    for k in (3, 40):
        exact = neighbors.knn_join(rows.filter("id < 5"), rows, k).collect()
        assert sorted(neighbors.knn_join(rows.filter("id < 5"), rows, k, method="lsh").collect()) == sorted(exact) and len(exact) == 5 * min(k, 30)


def test_lloyd(spark, blobs):
    start = clustering.initial_centroids(blobs, 3)
    costs = []
    for n in range(4):
        fitted = clustering.lloyd(blobs, start, n)
        costs.append(clustering.cost(blobs, fitted).agg(F.sum("cost")).first()[0])
    assert costs == sorted(costs, reverse=True)
    groups = {}
    for r in clustering.assign(blobs, fitted).collect():
        groups.setdefault(r.cluster, set()).add(r.label)
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == 3
    # a centroid without members stays
    far = start.unionByName(spark.createDataFrame([(3, [1e6, 1e6])], clustering.CENTROIDS))
    assert {r.cluster: r.center for r in clustering.lloyd(blobs, far, 3).collect()}[3] == [1e6, 1e6]


def test_kmeans_and_sweep(blobs):
    best = clustering.kmeans(blobs, 3, restarts=3)
    assert {r.n for r in clustering.cost(blobs, best).collect()} == {20}
    swept = clustering.kmeans_sweep(blobs, [1, 3])
    assert [(r.k, r["count"]) for r in swept.groupBy("k").count().orderBy("k").collect()] == [(1, 1), (3, 3)]
    center = swept.filter("k = 1").first().center
    assert center[0] == pytest.approx(sum(f[0] for _, f, _ in BLOBS) / 60)


def test_exemplars_of_small_clusters(blobs):
    centers = clustering.initial_centroids(blobs.filter("id < 3"), 3)
    got = clustering.exemplars(blobs.filter("id < 9"), centers, 20).collect()
    assert sorted((r.cluster, r["rank"]) for r in got) == [(c, k) for c in range(3) for k in (1, 2, 3)]
    first = clustering.exemplars(blobs, centers, 2, "first").orderBy("cluster", "rank").collect()
    assert [r.id for r in first] == [0, 3, 1, 4, 2, 5]


def test_mosaic(spark):
    tiles = spark.createDataFrame([(t, [float(10 * t + j) for j in range(4)]) for t in range(3)], "tile int, features array<double>")
    grid = {(r.gy, r.gx): r.value for r in images.tile_mosaic(tiles, 2, 4).collect()}
    rows = [[grid[y, x] for x in range(4)] for y in range(4)]
    assert rows == [[0, 1, 10, 11], [2, 3, 12, 13], [20, 21, 0, 0], [22, 23, 0, 0]]
    with pytest.raises(ValueError):
        images.tile_mosaic(tiles, 2, 5)
    with pytest.raises(PySparkException):
        images.tile_mosaic(tiles, 2, 9).collect()


def test_minmax(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (3.0,), (None,)], "v double")
    assert [r.scaled for r in images.minmax(df, "v").orderBy("v").collect()] == [None, 0.0, 0.5, 1.0]
    assert [r.scaled for r in images.minmax(df.filter("v = 2"), "v").collect()] == [None]


def test_quantise(spark):
    rows = [("a", y, x, 10 * (x > 1) + x % 2, 0, 200 * (x > 1)) for y in range(2) for x in range(4)]
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, r int, g int, b int")
    recoloured, palette = images.quantise(pixels, 2)
    assert sorted((r.r, r.g, r.b, r.n_pixels, r.n_colours) for r in palette.collect()) == [(0, 0, 0, 4, 2), (10, 0, 200, 4, 2)]  # 0.5 and 10.5 are cut
    lines = images.scanlines(recoloured).collect()
    assert len(lines) == 2 and [tuple(p) for p in lines[0].line] == [(0, 0, 0), (0, 0, 0), (10, 0, 200), (10, 0, 200)]


def test_propagation_chain(spark):
    chain = [(i, [0.1 * i]) for i in range(6)] + [(10 + i, [50 + 0.1 * i]) for i in range(6)] + [(99, [1000.0])]
    points = spark.createDataFrame(chain, "id long, features array<double>")
    seeds = {0: 7, 10: 3, 1: -1}
    points = points.withColumn("seed_label", F.create_map(*[F.lit(x) for p in seeds.items() for x in p])[F.col("id").cast("int")])
    near = propagation.affinity_graph(points, 1.0, 2)
    assert near.filter("src = dst AND w = 1").count() == 13
    edges = near.filter("src = dst OR w > 1e-9")  # cut the isolated point off
    got = {r.id: r.label for r in propagation.propagate(edges, points.select("id", F.col("seed_label").alias("label")), max_iter=40).collect()}
    assert got == {**dict.fromkeys(range(6), 7), **dict.fromkeys(range(10, 16), 3)}
    whole = {r.id: r for r in propagation.propagate_labels(points.filter("id < 20"), gamma=1.0, k=None, max_iter=30).collect()}
    assert whole[0].label == 7 and whole[15].label == 3 and whole[0].score == 1.0


def test_closest_rows_at_their_exact_distances(spark):
    """Far from the origin a matrix product alone would blur small distances and exact matches."""
    rng = np.random.default_rng(2)
    x = 1e4 + rng.normal(0, 1e-3, (400, 8)).round(5)
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(3)
    got = {(r.q_id, r["rank"]): (r.b_id, r.dist) for r in neighbors.knn_join(rows.filter("id < 20"), rows, 5, query_block=8).collect()}
    for i in range(20):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = np.lexsort((np.arange(400), d.round(9)))[:5]
        assert [got[i, k + 1] for k in range(5)] == [(int(j), pytest.approx(d[j], abs=1e-12)) for j in order]
    assert got[7, 1] == (3, 0.0) and got[3, 2] == (7, 0.0)
    own = neighbors.knn_join(rows, rows, 2, self_join=True)
    assert own.filter("q_id = b_id").count() == 0 and own.count() == 800


def test_vectors_of_one_length_only(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>")
    with pytest.raises(PySparkException, match="vectors of 1 to 2"):
        neighbors.knn_join(rows, rows, 1).collect()


def test_assign_keeps_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, [0.0], "a"), (2, None, "b"), (3, [9.0], None)], "id long, features array<double>, cluster string")
    start = spark.createDataFrame([(4, [1.0]), (9, [8.0])], clustering.CENTROIDS)
    got = clustering.assign(rows, start)
    assert got.columns == ["id", "features", "cluster", "distance"]
    assert sorted((r.id, r.cluster, r.distance) for r in got.collect()) == [(1, 4, 1.0), (2, None, None), (3, 9, 1.0)]
    assert {r.cluster for r in clustering.assign(rows, start.limit(0)).collect()} == {None}


def test_propagation_with_a_tolerance_writes_its_state(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(30) for a, b in ((i, i), (i, i + 1), (i + 1, i))], "src long, dst long, w double")
    seeds = spark.createDataFrame([(0, 1), (30, 2)], "id long, label int")
    for tol in (0.0, 1e-9):
        got = {r.id: r.label for r in propagation.propagate(edges, seeds, max_iter=60, tol=tol, check_every=7).collect()}
        assert [got[i] for i in range(31)] == [1] * 16 + [2] * 15
