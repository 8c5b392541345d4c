from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from minewright.llm.common import Scratch, fresh, join_groups, with_copy_number, with_row_identity


@pytest.mark.parametrize(("hot", "floor"), [(0, 0), (1, 0), (2, 5), (100, 0), (100, 1000)])
def test_join_groups(spark, hot, floor):
    rows = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'big' ELSE concat('k', id % 7) END AS key", "'clash' AS other").repartition(5)
    groups = rows.groupBy("key").count().filter("key <> 'k2'").selectExpr("key", "count", "concat('of ', key) AS name")
    got = join_groups(rows, groups, ["key"], "count", "id", hot, floor)
    assert got.columns == ["key", "id", "other", "count", "name"]
    size = {r.key: r["count"] for r in groups.collect()}
    assert sorted((r.id, r.key, r["count"], r.name) for r in got.collect()) == [
        (i, k, size.get(k), f"of {k}" if k in size else None) for i in range(300) for k in ["big" if i % 3 == 0 else f"k{i % 7}"]
    ]
    kept = join_groups(rows, groups, ["key"], "count", "id", hot, floor, inner=True)
    assert kept.columns == got.columns and sorted(kept.collect()) == sorted(r for r in got.collect() if r.name)


def test_scratch(spark):
    scratch = Scratch(spark, "test")
    a, b = scratch.keep(spark.range(5), "a"), scratch.keep(spark.range(3), "b")
    scratch.drop("a", "none")
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        a.count()


def test_fresh(spark):
    df = spark.range(1).selectExpr("id AS _ROW", "id AS __row")
    assert fresh(df, "_row") == "___row" and fresh(df, "x") == "x"


def test_rows_have_places_of_their_own_however_a_table_is_made(spark, tmp_path):
    spark.range(60).selectExpr("id", "concat('t', id) AS text", "named_struct('a', id) AS _metadata").write.parquet(f"{tmp_path}/t")
    plain = spark.read.parquet(f"{tmp_path}/t")
    other = spark.range(2).withColumnRenamed("id", "tag")
    shapes = {
        "scan": plain,
        "filtered": plain.filter("id > 7").selectExpr("text", "id + 1 AS id", "_metadata"),
        "exploded": plain.select("text", F.explode(F.array("id", F.col("id") + 100)).alias("id")),
        "joined": plain.crossJoin(other),
        "united": plain.unionByName(plain),
        "sampled": plain.sample(0.5, 3),
        "random": plain.withColumn("r", F.rand()),
        "grouped": plain.groupBy("text").agg(F.max("id").alias("id")),
        "in memory": spark.range(9),
        "cached": plain.select("id", "text").cache(),
    }
    for name, df in shapes.items():
        placed = with_row_identity(df, "place")
        assert placed.columns == [*df.columns, "place"], name
        first, again = ({(r.place.file, r.place.row): r.id for r in placed.select("place", "id").collect()} for _ in range(2))
        assert first == again and len(first) == placed.count(), name


@pytest.mark.parametrize("floor", [1, 60])
def test_rows_that_are_alike_are_numbered_without_gaps(spark, floor):
    rows = [(i % 3 if i % 2 else None, "x" if i % 5 else None) for i in range(500)] + [(1000 + i, "one") for i in range(50)]
    got = with_copy_number(spark.createDataFrame(rows, "id long, text string").repartition(4), "copy", F.col("id"), F.col("text"), each=20, floor=floor)
    assert got.columns == ["id", "text", "copy"]
    found = {}
    for r in got.collect():
        found.setdefault((r.id, r.text), []).append(r.copy)
    assert sum(map(len, found.values())) == 550 and all(sorted(x) == (list(range(len(x))) if len(x) > floor else [0] * len(x)) for x in found.values())
