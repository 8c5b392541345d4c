from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from minewright.llm import sharding

SCHEMA = "doc_id long, text string, slot string, Shard int"


@pytest.mark.parametrize("n", [0, 1, 5, 8, 9, 1000])
def test_counts_and_slots(spark, n):
    df = spark.range(n).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text", "'clash' AS slot", "7 AS Shard").repartition(3)
    got = sharding.shard(df, 8, bucket_bytes=200).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (n // 8, n // 8 + (n % 8 > 0))


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, "", 1), (None, None, "", 1), (3, "a", "", 1), (3, "a", "", 1), (4, "é" * 300_000, "", 1), (5, "", "", 1)]
    got = sharding.shard_files(spark.createDataFrame(rows, SCHEMA), shards=4)
    assert got.columns == ["doc_id", "text", "slot", "shard"] or set(got.columns) == {"doc_id", "text", "shard", "slot"}
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in got.collect()) == sorted((r[0] or 0, len(r[1] or "")) for r in rows)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [1, 1, 2, 2]


def test_order_is_random_but_fixed_by_the_seed(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    place = lambda **o: [r.doc_id for r in sharding.shard(df, 4, bucket_bytes=400, **o).orderBy("shard", "slot").collect()]
    one = place()
    assert one == place() and one != place(seed=5) and one != sorted(one)
    # neighbours in the input are no neighbours in the output, and shards draw from all of it
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:])) < 20
    assert all(800 < sum(x < 2000 for x in one[s * 1000 : s * 1000 + 1000]) * 2 < 1200 for s in range(4))


def test_offsets(spark):
    counts = spark.createDataFrame([(b, b % 3 + 1) for b in range(40)], "_bucket long, _n long")
    got = {r["_bucket"]: r["_offset"] for r in sharding.offsets(counts, 7).collect()}
    assert got == {b: sum(x % 3 + 1 for x in range(b)) for b in range(40)}


def test_rows_that_repeat_do_not_fill_a_bucket(spark, monkeypatch):
    sizes = []
    kept = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, name: sizes.append(kept(df, name)) or sizes[-1])
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "CASE WHEN id % 3 > 0 THEN string(id) END AS text")
    got = sharding.shard(rows, 4, bucket_bytes=200).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i if i % 3 else 0 for i in range(6000))
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(1500)]
    most = sizes[-1].selectExpr("max(size(_perm)) AS n").first().n
    assert most < 150


@pytest.mark.parametrize("alike", [2, 1001, 3000])
def test_the_order_is_the_same_however_rows_are_dealt(spark, alike):
    rows = spark.range(600).selectExpr("id AS doc_id", "string(id) AS text").unionByName(spark.range(alike).selectExpr("cast(null AS long) AS doc_id", "'same' AS text"))
    one, two = (sorted((r.shard, r.slot, r.doc_id or -1) for r in sharding.shard(rows.repartition(n), 4, bucket_bytes=200).collect()) for n in (3, 5))
    assert one == two and len(one) == 600 + alike
