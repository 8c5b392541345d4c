from __future__ import annotations

import corpus_pipeline as cp
from minewright.llm import queries
from minewright.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    toxic = cp.drop_toxic(spark, docs, SF)
    assert toxic.columns == names and 0 < toxic.count() <= docs.count()
    near = cp.drop_near_copies(spark, docs, SF)
    assert near.columns == names and near.select("doc_id").distinct().count() == near.count() < docs.count()
    assert near.select(F.sha2("text", 256)).distinct().count() == near.count() - near.filter("trim(text) = ''").count() + near.filter("trim(text) = ''").select(F.sha2("text", 256)).distinct().count()
    clean = cp.drop_leaked(spark, docs, SF)
    leaks = queries.op1_decontaminate(spark, SF).select("doc_id").distinct()
    assert clean.columns == names and clean.count() == docs.count() - leaks.count()
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == names and dict(mixed.dtypes) == dict(docs.dtypes)
    assert mixed.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0 and mixed.filter("n_chars <> length(text)").count() == 0


def test_repeated_and_null_rows_in_near_dedup_stage(spark):
    """Rows count, not ids: copies without an id go, other texts of a repeated id stay."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, None), (1, text), (None, text + " end"), (None, "other words here"), (3, "  "), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], table(spark, SF, "documents").schema)
    kept = cp.drop_near_copies(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("1", "a b c"), ("1", text), ("3", "  "), ("None", "other words here")]
    assert sorted(str(r.doc_id) for r in kept if not r.text) == ["4", "None"]


def test_leaks_without_an_id_go(spark):
    docs = table(spark, SF, "documents").limit(3)
    item = table(spark, SF, "benchmark").filter("length(text) > 60").first().text
    leaked = docs.limit(1).withColumn("text", F.lit("so " + item)).withColumn("doc_id", F.lit(None).cast("long"))
    assert cp.drop_leaked(spark, leaked, SF).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in cp.STAGES:
        got = stage(spark, docs.limit(0), SF)
        assert got.count() == 0 and set(got.columns) == set(docs.columns) | ({"shard", "slot"} if name == "sharding" else set())
    clash = docs.limit(60).selectExpr("*", "'x' AS _row", "1 AS _score", "2 AS row", "'y' AS _src", "3 AS component_id", "4 AS place", "5 AS draw_id")
    for _, stage in cp.STAGES:
        got = stage(spark, clash, SF)
        assert set(clash.columns) <= set(got.columns) and 0 < got.count()
        assert got.select("_row", "_score", "row", "_src", "component_id", "place", "draw_id").distinct().collect() == [("x", 1, 2, "y", 3, 4, 5)]


def test_run(spark):
    got = cp.run(spark, SF)
    assert set(got.columns) == {*table(spark, SF, "documents").columns, "shard", "slot"}
    n = got.count()
    assert n > 0
    for s in range(8):
        slots = sorted(r.slot for r in got.filter(F.col("shard") == s).select("slot").collect())
        assert slots == list(range(len(slots))) and len(slots) in (n // 8, n // 8 + 1)
