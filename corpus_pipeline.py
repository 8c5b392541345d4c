"""A corpus pipeline over documents, made of operators of minewright.llm.

Every stage takes what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minewright.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from minewright.llm.common import fresh, join_groups, materialize, table, with_row_identity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, fitted on the labelled ones among them, scores below 0.5.

    Rows are judged by their text alone: null and empty texts score as texts without words and stay if those do;
    very long texts are scored whole; repeated rows and ids fare alike; columns of any other name are kept. Without labels nothing
    is dropped, an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, toxic = fresh(docs, "_score"), fresh(docs, "_toxic")
    return toxicity.score(docs, model, names=(score, toxic)).filter(F.col(toxic) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Rows are told apart by their place in the files, so rows that repeat an id, or have none, are judged by their
    texts like all others; of equal ids one row stays, null ids come last. Null, empty and blank texts are copies of
    nothing and stay. Very long texts are compared whole; a set of shingles must fit into a row. Columns of any other name are kept.
    """
    row = fresh(docs, "_row")
    rows = with_row_identity(docs, row)
    ids = rows.select(F.col(row).alias("row"), "doc_id", "text")
    found = near_dedup.near_dedup(ids, id_col="row", k=5).select("row", "component_id")
    groups = found.groupBy("component_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    named = join_groups(found, materialize(groups, "groups"), ["component_id"], "copies", "row", inner=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = named.join(ids.select("row", "doc_id"), "row").groupBy("component_id").agg(first.alias("best")).select("best.row")
    gone = materialize(named.select("row").join(best, "row", "left_anti").withColumnRenamed("row", row), "copies")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none. Rows are judged one by one, whatever their ids,
    very long texts whole; columns of any other name are kept."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row per draw, shard after shard in their shuffled order, n_chars as drawn.

    A draw has the columns of its document; one of part of a text has that part. Documents without words (null, empty or
    blank texts) have nothing to draw and go. A null source is a source; rows that repeat are documents of their own. A text must fit
    into a row, however long it is; columns of any other name are kept.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    mixed = mixing.mix(docs.toDF(*inner.values()), inner["doc_id"], inner["text"], inner["source"])
    mixed = mixing.in_shard_order(mixed, inner["text"]).select(*[F.col(i).alias(c) for c, i in inner.items()])
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order with their shard and slot, written as shards and read back; null, empty, very long
    and repeated ones too. Columns named shard or slot are replaced, all others kept."""
    return sharding.shard_files(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaked),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The learned and the random stages can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
