"""Shared helpers: table reading, the shared folder, joins with hot groups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minewright.functions.storage import Scratch, materialize, shared_dir

__all__ = ["ALIKE", "SPACE", "WORD", "Scratch", "fresh", "join_groups", "materialize", "new_path", "table", "with_copy_number", "with_row_identity"]

#: ASCII white space as every contract of this subpackage counts it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_row_identity(docs: DataFrame, name: str) -> DataFrame:
    """docs plus a struct that tells its rows apart and is the same in every scan: file and place in it.

    Rows have a place only in a table that is read from files as it is, with rows filtered and columns computed at most; any other
    (exploded, joined, united, sampled, grouped, made in memory) is written to the shared folder first, where its rows get places
    of their own. Columns that are themselves called _metadata are no hindrance.
    """
    if not _is_scan(docs):
        docs = materialize(docs, "rows")
    meta = fresh(docs, "_place_of_row")
    place = F.struct(F.xxhash64(f"{meta}.file_path").alias("file"), F.col(f"{meta}.row_index").alias("row"))
    return docs.withColumn(meta, docs.metadataColumn("_metadata")).withColumn(name, place).drop(meta)


def _is_scan(docs: DataFrame) -> bool:
    """Whether the plan is filters and projections of one Parquet table, without anything random."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.simpleString(100).endswith(" parquet")


#: Rows alike up to this number may share a bucket or a task.
ALIKE = 1_000


def with_copy_number(docs: DataFrame, name: str, *same: Column, each: int = ALIKE, floor: int = ALIKE) -> DataFrame:
    """docs plus the number of each row among those that are alike in `same`, from 0, if they are more than `floor`; all others have 0.

    The rows of such a group get the numbers 0 .. n - 1 however they are dealt; which of them gets which is open. They are numbered in
    parts of about `each` rows and the parts one after the other, so a group of any size is spread. docs is written to the shared
    folder; only rows of such groups are joined with their numbers.
    """
    keys = ["_k1", "_k2"]
    parts = [*keys, "_part"]
    docs = materialize(docs.withColumns({"_k1": F.xxhash64(*same), "_k2": F.xxhash64(F.lit(1), *same), "_row": F.monotonically_increasing_id()}), "rows")
    groups = materialize(docs.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > floor), "groups")
    few = groups.limit(20_001).count() <= 20_000
    docs = docs.join(F.broadcast(groups) if few else groups, keys, "left")
    rows = docs.filter("_n IS NOT NULL").select(*keys, "_n", "_row")
    rows = materialize(rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.ceil(F.col("_n") / each))), "repeats")
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    start = rows.groupBy(*parts).agg(F.count("*").alias("_size")).withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    number = F.row_number().over(W.partitionBy(*parts).orderBy("_row")) - 1
    numbers = rows.withColumn("_at", number).join(start, parts).select("_row", (F.col("_start") + F.col("_at")).alias(name))
    often = docs.filter("_n IS NOT NULL").drop(*keys, "_n").join(numbers, "_row").drop("_row")
    return docs.filter("_n IS NULL").drop(*keys, "_n", "_row").withColumn(name, F.lit(0).cast("long")).unionByName(often)


def fresh(df: DataFrame, name: str) -> str:
    """name, or one like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, hot: int = 20_000, floor: int = 256, inner: bool = False) -> DataFrame:
    """rows left-joined with groups (unique in keys) on keys, safe for groups that hold most rows.

    The largest groups by column size, at most `hot` of them and of more than `floor` rows each, go to
    every task (that many rows of fixed width, no more). Rows of any other group are joined by shuffling,
    and such a group has at most `floor` or 1/hot of all rows. The rows of hot groups are dealt by column
    spread meanwhile. Key columns must not be null. With inner, rows without a group are left out.
    """
    added = [c for c in groups.columns if c not in keys]
    top = groups.filter(F.col(size) > floor).orderBy(F.desc(size), *keys).limit(hot)
    top = top.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in added], F.lit(True).alias("_is_hot"))
    rest = groups.join(F.broadcast(top.select(*keys)), keys, "left_anti")
    if inner:
        often = rows.join(F.broadcast(top.select(*keys, *[F.col(f"_hot_{c}").alias(c) for c in added])), keys)
        return often.unionByName(rows.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(rest, keys))
    rest = rest.select(*[F.col(c).alias(f"_key_{c}") for c in keys], *[F.col(c).alias(f"_rest_{c}") for c in added])
    rows = rows.join(F.broadcast(top), keys, "left").withColumn("_salt", F.when(F.col("_is_hot"), F.hash(spread)))
    rest = rest.withColumn("_rest_salt", F.lit(None).cast("int"))
    match = F.col("_salt").eqNullSafe(F.col("_rest_salt"))
    for c in keys:
        match &= F.col(c) == F.col(f"_key_{c}")
    named = rows.columns[: len(rows.columns) - len(added) - 2]
    return rows.join(rest, match, "left").select(*named, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in added])
