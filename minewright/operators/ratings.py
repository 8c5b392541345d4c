"""Rating matrices as long tables (user_id, item_id, rating); a missing cell is a missing row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minewright.functions.expressions import ratio


def duplicate_cells(ratings: DataFrame) -> DataFrame:
    """Cells with more than one rating, and how many."""
    return ratings.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique_cells(ratings: DataFrame) -> DataFrame:
    if found := duplicate_cells(ratings).take(1):
        raise ValueError(f"more than one rating for user {found[0].user_id}, item {found[0].item_id}")
    return ratings


def rating_profile(ratings: DataFrame) -> DataFrame:
    """One row: n_users, n_items, filled, sparsity_pct (share of empty cells, null without ratings)."""
    counts = ratings.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.count("rating").alias("filled"))
    cells = F.col("n_users").cast("double") * F.col("n_items")
    return counts.withColumn("sparsity_pct", 100 - ratio(F.col("filled") * 100.0, cells))


def rating_slice(ratings: DataFrame, n_users: int = 5, n_items: int = 10) -> DataFrame:
    """The corner of the matrix with the smallest ids, wide: user_id, item_1 .. item_n by rank of the item.

    Only that corner is pivoted, with its columns given beforehand. More than one rating in a cell is an error.
    """
    users = ratings.select("user_id").distinct().orderBy("user_id").limit(n_users)
    items = ratings.select("item_id").distinct().orderBy("item_id").limit(n_items)
    items = items.withColumn("_rank", F.row_number().over(W.orderBy("item_id")))
    cells = ratings.join(F.broadcast(items), "item_id").groupBy("user_id", "_rank").agg(F.count("*").alias("_n"), F.first("rating").alias("rating"))
    twice = F.raise_error(F.format_string("more than one rating for user %s, item number %s", F.col("user_id").cast("string"), F.col("_rank").cast("string")))
    cells = cells.withColumn("rating", F.when(F.col("_n") == 1, F.col("rating")).otherwise(twice.cast("int")))
    ranks = list(range(1, n_items + 1))
    wide = users.join(cells, "user_id", "left").groupBy("user_id").pivot("_rank", ranks).agg(F.first("rating"))
    return wide.select("user_id", *[F.col(str(r)).alias(f"item_{r}") for r in ranks])
