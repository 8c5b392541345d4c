from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from minewright.llm import graph
from minewright.llm import near_dedup as nd
from minewright.llm.common import Scratch

SCHEMA = "doc_id long, text string, id string, n string"


def brute(rows, k, percent=80):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\t-\r]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and rows[i][0] is not None and rows[j][0] is not None and (100 * len(a & b) >= percent * len(a | b) or rows[i][0] == rows[j][0]):
                root[top(i)] = top(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        c = None if d is None else min(group)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def mutated(words, rate, rng):
    return [w if rng.random() > rate else f"m{rng.integers(0, 10**6)}" for w in words]


def corpus():
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "one", "One", "ONE", "one two", "two one", "É x", "é x", "a b c d", "A  B\nC\td"])]
    base = [f"b{x}" for x in rng.integers(0, 400, 120)]
    rows += [(100 + i, " ".join(mutated(base, rate, rng))) for i, rate in enumerate(np.linspace(0, 0.2, 60))]
    chain = [f"c{x}" for x in range(140)]
    rows += [(200 + i, " ".join(chain[3 * i : 3 * i + 60])) for i in range(20)]  # neighbours are alike, ends aren't
    rows += [(300 + i, " ".join(rng.choice(["x", "y", "z"], 8))) for i in range(40)]
    rows += [(400, "v " * 120_000 + "end"), (401, "v " * 120_000 + "end"), (500, rows[20][1]), (500, rows[20][1]), (None, "one"), (None, None)]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_brute_force(spark, k):
    rows = [(d, t, "clash", "clash") for d, t in corpus()]
    got = nd.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), k=k)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k)


def test_small_blocks_find_the_same(spark):
    rng = np.random.default_rng(9)
    base = [f"b{x}" for x in range(100)]
    rows = [(i, " ".join(mutated(base, 0.07, rng)), "", "") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    members = df.selectExpr("1L AS key", "80L AS c", "doc_id AS id", "doc_id AS component")
    sets = nd._sets(df.selectExpr("doc_id AS id", "text"), 2)
    for block in (8, 512):
        links = nd._bucket_links(members, sets, 80, block=block)
        found = {r.id: r.component for r in graph.connected_components(links).collect()}
        assert [(d, c) for d, _, c, _ in sorted(brute(rows, 2))] == [(d, found.get(d, d)) for d in range(80)]


@pytest.mark.parametrize("block", [8, 30])
def test_large_buckets_are_resolved_around_their_centres(spark, block):
    rows = [(d, t, "clash", "clash") for d, t in corpus()]
    got = nd.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), k=2, block=block, merge=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2)


@pytest.mark.parametrize("merge", [3, 32])
@pytest.mark.parametrize("rate", [0.03, 0.05, 0.065])
def test_a_group_at_the_threshold(spark, rate, merge):
    """Copies of a text that isn't there: linked with few, with some or with hardly any other."""
    rng = np.random.default_rng(4)
    base = [f"b{x}" for x in range(150)]
    rows = [(i, " ".join(mutated(base, rate, rng)), "", "") for i in range(150)]
    got = nd.near_dedup(spark.createDataFrame(rows, SCHEMA), k=2, block=16, merge=merge)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2)


def test_what_large_buckets_make_grows_with_their_members(spark):
    """Rows in the buckets that are left of a large one, for two sizes of a group around the threshold."""
    made = []
    for n in (200, 800):
        rng = np.random.default_rng(8)
        base = [f"b{x}" for x in range(150)]
        df = spark.createDataFrame([(i, " ".join(mutated(base, 0.065, rng)), "", "") for i in range(n)], SCHEMA)
        sets = nd._sets(df.selectExpr("doc_id AS id", "text"), 2)
        rows = df.selectExpr("1L AS key", f"{n}L AS c", "doc_id AS id", "doc_id AS component").join(sets, "id").select("key", "c", "id", "component", "shingles")
        _, rest = nd._centre_links(rows, 80, 64, Scratch(spark, "test"))
        sizes = [r["count"] for r in rest.groupBy("key").count().collect()]
        assert max(sizes) <= n / 2
        made.append(sum(sizes))
    assert made[1] < 6 * made[0]


def test_large_buckets_are_joined_once(spark, monkeypatch):
    """Before, buckets that had been resolved around their centres were joined with their members again."""
    seen, plain = [], nd._spanning

    def spanning(members, scratch):
        seen.append(max((r["count"] for r in members.groupBy("key").count().collect()), default=0))
        return plain(members, scratch)

    monkeypatch.setattr(nd, "_spanning", spanning)
    rng = np.random.default_rng(4)
    base = [f"b{x}" for x in range(150)]
    rows = [(i, " ".join(mutated(base, 0.05, rng)), "", "") for i in range(150)]
    got = nd.near_dedup(spark.createDataFrame(rows, SCHEMA), k=2, block=16, merge=8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2)
    assert seen[0] > 8 >= seen[-1]


def test_leaders_and_members_read_one_exchange_of_sets(spark):
    sets = Scratch(spark, "test").keep(spark.createDataFrame([(i, list(range(i // 2, 40))) for i in range(8)], "id long, shingles array<long>"), "sets")
    pairs = spark.createDataFrame([(a, b) for a in (0, 4) for b in range(a + 1, 8)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = nd._star_links(pairs, sets, 95)
        found = sorted(tuple(r) for r in links.collect())
        plan = links._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [(a, b) for a in (0, 4) for b in range(a + 1, 8) if (40 - b // 2) * 100 >= (40 - a // 2) * 95]
    assert any("ReusedExchange" in line and "shingles" in line for line in plan.splitlines())


def test_the_filter_lets_all_shared_keys_through_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys = [rng.integers(-(1 << 63), 1 << 63, 40).tolist() for _ in range(300)]
    keys[5][:3], keys[7], keys[9] = keys[4][:3], [], [*keys[4][:1], -1, (1 << 63) - 1]
    classes = spark.createDataFrame([(i, 9, k) for i, k in enumerate(keys)], "id long, n long, keys array<long>").repartition(3)
    scratch = Scratch(spark, "test")
    often = classes.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1 OR key = -1")
    nd.write_filter(often, "key", f"{scratch.folder}/filter-0")
    got = [(r.key, r.id, r.n) for r in nd._shared_keys(classes, f"{scratch.folder}/filter-0").collect()]
    wanted = {(k, i, 9) for i in (4, 5) for k in keys[4][:3]} | {(keys[4][0], 9, 9), (-1, 9, 9)}
    assert wanted <= set(got) and len(got) == len(set(got)) <= len(wanted) + 5
    assert set(got) <= {(k, i, 9) for i, own in enumerate(keys) for k in own}


def test_rows_that_repeat_an_id_with_other_texts(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, texts[0], "", ""), (5, texts[0], "", ""), (5, texts[1], "", ""), (6, texts[1], "", ""), (7, texts[2], "", ""), (5, None, "", "")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(spark.createDataFrame(rows, SCHEMA), k=5).collect())
    assert got == [(1, 26, 1, True), (5, 0, 5, True), (5, 26, 1, False), (5, 26, 1, False), (6, 26, 1, False), (7, 26, 7, True)]


def test_empty(spark):
    assert nd.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 50, 300, 3000])
def test_sketch_fills_and_estimates(n):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(30):
        shared = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        part = max(1, n // 2)
        a, b = np.unique(shared), np.unique(np.concatenate([shared[:part], own[: n - part]]))
        x, y = nd.fast_sketch(a, 200), nd.fast_sketch(b, 200)
        assert (x == nd.fast_sketch(a, 200, at_once=1)).all()  # rounds at once change nothing
        errors.append((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


def test_derived_tables_give_what_their_written_copy_gives(spark, tmp_path):
    base = [[f"{i}w{x}" for x in range(60)] for i in range(20)]
    pairs = [(i, " ".join(base[i]), " ".join([*base[i][:-1], "other"])) for i in range(20)]
    spark.createDataFrame(pairs, "doc_id long, a string, b string").write.parquet(f"{tmp_path}/pairs")
    plain = spark.read.parquet(f"{tmp_path}/pairs")
    exploded = plain.select(F.explode(F.array(F.struct("doc_id", F.col("a").alias("text")), F.struct((F.col("doc_id") + 100).alias("doc_id"), F.col("b").alias("text")))).alias("x")).select("x.*")
    tagged = exploded.crossJoin(spark.range(2).withColumnRenamed("id", "tag")).selectExpr("doc_id + 1000 * tag AS doc_id", "text", "tag")
    named = exploded.selectExpr("*", "1 AS _metadata")
    for name, df, dropped in (("exploded", exploded, 20), ("tagged", tagged, 60), ("united", exploded.unionByName(exploded.selectExpr("doc_id + 5000 AS doc_id", "text")), 60), ("named", named, 20), ("cached", exploded.cache(), 20)):
        df.write.parquet(f"{tmp_path}/{name}")
        got, want = (sorted(tuple(r) for r in nd.near_dedup(x).collect()) for x in (df, spark.read.parquet(f"{tmp_path}/{name}")))
        assert got == want and sum(not r[3] for r in got) == dropped, name


@pytest.mark.parametrize("at_once", [1_000_000, 100])
def test_components(spark, at_once):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(1500, 1600)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
