"""Exact dedup: a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minewright.llm.common import SPACE, join_groups, materialize

KEY = ["_sha", "_len", "_check"]


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space becomes one space; null is the empty text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, " ")


def merge_runs(digests: DataFrame, runs: int = 64, fan_in: int = 4) -> DataFrame:
    """Merge sorted digest runs in rounds until one entry per digest is left.

    digests has KEY, _id and _n. The tasks that read the input are dealt over `runs` runs. In a round, each
    merging node takes the runs of `fan_in` children. As the least identifier is kept with its null flag as a
    struct, Spark aggregates by sorting: every task sorts its entries by run and digest and merges neighbours
    before they are exchanged; behind the exchange, split by digest, the sorted entries of all children
    are merged again, and each digest keeps its smallest identifier and summed count. A digest therefore brings
    at most one entry per task and child to any node, however many copies it has.
    """
    least = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    level = digests.select(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("_run"), *KEY, least.alias("_least"), "_n")
    while True:
        level = level.groupBy("_run", *KEY).agg(F.min("_least").alias("_least"), F.sum("_n").alias("_n"))
        if runs == 1:
            return level.select(*KEY, F.col("_least.id").alias("_id"), "_n")
        runs = -(-runs // fan_in)
        level = level.withColumn("_run", F.expr(f"_run div {fan_in}"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 4, hot_groups: int = 20_000) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of ASCII white space became one space.
    "Same" is verified at every level by SHA-256 together with the length and a second, unrelated
    hash: entries merge only if all three agree. Null and empty texts form one group. Ids are taken
    as unique; rows that repeat an id are counted, and are all kept if theirs is the smallest id.
    Null ids sort last: a group of null ids only has a null keep_id and keeps its rows. Other columns
    of the input are ignored, whatever their names. Very long texts are hashed whole; they are never shuffled.
    An empty table gives no rows.

    The `hot_groups` largest groups are sent to every task (that many rows, no more); see join_groups().
    """
    text = normalised(text_col)
    keyed = materialize(
        docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
            "_id",
            F.sha2("_text", 256).alias("_sha"),
            F.octet_length("_text").cast("long").alias("_len"),
            F.xxhash64("_text").alias("_check"),
            F.lit(1).cast("long").alias("_n"),
        ),
        "digests",
    )
    merged = materialize(merge_runs(keyed, runs, fan_in), "merged")
    groups = merged.filter("_n > 1").select(*KEY, F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"))
    rows = join_groups(keyed.select("_id", *KEY), groups, KEY, "group_size", "_id", hot_groups)
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("_id"))
    return rows.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
