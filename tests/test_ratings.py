from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException

from minewright.operators import ratings, recommend, similarity

# user 1 target; 2 agrees; 3 opposes; 4 rates everything alike; 5 shares one item with 1; 6 shares none; 7 agrees partly
ROWS = [
    (1, 1, 1), (1, 2, 3), (1, 3, 5), (1, 9, 2),
    (2, 1, 1), (2, 2, 3), (2, 3, 5), (2, 4, 4), (2, 5, 2),
    (3, 1, 5), (3, 2, 3), (3, 3, 1), (3, 4, 1), (3, 6, 5),
    (4, 1, 3), (4, 2, 3), (4, 3, 3), (4, 5, 5),
    (5, 3, 2), (5, 4, 5),
    (6, 7, 4), (6, 8, 1),
    (7, 1, 1), (7, 2, 2), (7, 3, 5), (7, 4, 2), (7, 5, 2),
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(ROWS, "user_id long, item_id long, rating int").repartition(3)


def pearson(x, y):
    n, sx, sy = len(x), sum(x), sum(y)
    den = math.sqrt(n * sum(a * a for a in x) - sx * sx) * math.sqrt(n * sum(b * b for b in y) - sy * sy)
    return (n * sum(a * b for a, b in zip(x, y)) - sx * sy) / den if den else None


def expected():
    of = {}
    for u, i, r in ROWS:
        of.setdefault(u, {})[i] = r
    out = {}
    for u in of:
        for v in of:
            both = sorted(of[u].keys() & of[v].keys())
            if u < v and both:
                out[u, v] = (len(both), pearson([of[u][i] for i in both], [of[v][i] for i in both]))
    return out


def test_profile(spark, cells):
    row = ratings.rating_profile(cells).first()
    assert (row.n_users, row.n_items, row.filled) == (7, 9, len(ROWS))
    assert row.sparsity_pct == pytest.approx(100 - 100 * len(ROWS) / 63)
    assert ratings.rating_profile(cells.limit(0)).first().sparsity_pct is None


def test_slice_and_duplicates(spark, cells):
    wide = {r.user_id: r for r in ratings.rating_slice(cells, 3, 4).collect()}
    assert sorted(wide) == [1, 2, 3] and wide[1].item_4 is None and wide[2].item_4 == 4 and wide[3].item_1 == 5
    assert ratings.assert_unique_cells(cells) is cells
    with pytest.raises(ValueError, match="user 1, item 1"):
        ratings.assert_unique_cells(cells.unionByName(cells.filter("user_id = 1 AND item_id = 1")))


def test_pearson_degenerate_pairs_are_null(cells):
    got = {(r.u, r.v): (r.n_common, r.similarity) for r in similarity.user_similarity(cells).collect()}
    want = expected()
    assert got.keys() == want.keys() and (1, 6) not in got
    for pair, (n, s) in want.items():
        assert got[pair][0] == n
        assert got[pair][1] == (None if s is None else pytest.approx(s, abs=1e-12))
    assert got[1, 4][1] is None and got[1, 5] == (1, None) and got[1, 3][1] == pytest.approx(-1)


def test_target_path_agrees_with_all_pairs(cells):
    every = {(r.u, r.v): r.similarity for r in similarity.both_ways(similarity.user_similarity(cells)).collect()}
    for r in similarity.user_similarity(cells, 1).collect():
        assert every[r.u, r.v] == r.similarity
    corner = {(r.u, r.v): r.similarity for r in similarity.similarity_slice(cells, 4).collect()}
    assert corner[1, 1] == 1.0 and corner[1, 4] is None and corner[2, 1] == corner[1, 2]


def test_min_overlap_and_relabelled_items(spark, cells):
    assert all(r.n_common >= 3 for r in similarity.user_similarity(cells, min_overlap=3).collect())
    moved = cells.selectExpr("user_id", "100 - item_id AS item_id", "rating")
    assert sorted(similarity.user_similarity(moved).collect()) == sorted(similarity.user_similarity(cells).collect())


def test_neighbors_skip_undefined(cells):
    near = similarity.top_neighbors(similarity.user_similarity(cells, 1), 5).orderBy("rank").collect()
    assert [r.v for r in near] == [2, 7, 3] and [r.rank for r in near] == [1, 2, 3]


def test_recommend(spark, cells):
    assert sorted(r.item_id for r in recommend.unseen_items(cells, 1).collect()) == [4, 5, 6, 7, 8]
    items = spark.createDataFrame([(4, "four"), (5, "five")], "item_id long, title string")
    got = recommend.recommend(cells, items, 1, k=5, n=3).orderBy("rank").collect()
    # item 6 is only rated by the negative neighbour: its weight isn't above 0
    s = {v: expected()[1, v][1] for v in (2, 3, 7)}
    four = (s[2] * 4 + s[3] * 1 + s[7] * 2) / (s[2] + s[3] + s[7])
    assert [(r.item_id, r.title) for r in got] == [(4, "four"), (5, "five")]
    assert got[0].predicted_rating == pytest.approx(four) and got[1].predicted_rating == pytest.approx(2.0)
    assert recommend.recommend(cells, items, 6).collect() == []
    every = recommend.recommend(cells, items, None, k=5, n=3).filter("user_id = 1").orderBy("rank").collect()
    assert [(r.item_id, round(r.predicted_rating, 9)) for r in every] == [(r.item_id, round(r.predicted_rating, 9)) for r in got]


def test_equal_predictions_tie_by_item(spark):
    rows = [(1, 1, 1), (1, 2, 2), (1, 3, 4)] + [(u, i, r) for u, s in ((2, 0), (3, 1)) for i, r in ((1, 1), (2, 2 + s), (3, 4), (7, 5), (5, 5), (6, 5))]
    got = recommend.recommend(spark.createDataFrame(rows, "user_id long, item_id long, rating int"), spark.createDataFrame([], "item_id long, title string"), 1)
    assert [(r.item_id, r.title) for r in got.orderBy("rank").collect()] == [(5, None), (6, None), (7, None)]


def test_slice_of_a_matrix_with_a_cell_twice(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 1, 4), (2, 1, 5)], "user_id int, item_id int, rating int")
    with pytest.raises(PySparkException, match="more than one rating for user 1"):
        ratings.rating_slice(rows, 2, 1).collect()
