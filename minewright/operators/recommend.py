"""User-based collaborative filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minewright.functions.storage import materialize
from minewright.operators.ratingblocks import nearest_users
from minewright.operators.ratinglists import RatingLists, scored_items
from minewright.operators.similarity import top_neighbors, user_similarity


def unseen_items(ratings: DataFrame, target: int) -> DataFrame:
    """Items that somebody has rated but not the target."""
    seen = ratings.filter(F.col("user_id") == target).select("item_id")
    return ratings.select("item_id").distinct().join(seen, "item_id", "left_anti")


def score_items(ratings: DataFrame, neighbors: DataFrame, lists: RatingLists | None = None, best: int | None = None) -> DataFrame:
    """user_id, item_id, predicted_rating, weight: means of the neighbours' ratings weighted by similarity.

    Items that the user has rated are left out, and items whose similarities sum to 0 or less. lists: the ratings, stored, for many users with
    neighbours; then best gives only so many items of each, the first by rating to nine decimals and item_id.
    """
    if lists is not None:
        return scored_items(lists, neighbors, best)
    near = neighbors.select(F.col("u").alias("user_id"), F.col("v").alias("_v"), "similarity")
    theirs = ratings.select(F.col("user_id").alias("_v"), "item_id", "rating")
    offered = near.join(theirs, "_v").select("user_id", "item_id", F.expr("similarity * rating").alias("score"), F.col("similarity").alias("weight"), F.lit(False).alias("own"))
    # Own ratings meet the offers in the same aggregate, which leaves out what a join would look up.
    own = ratings.join(near.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("weight"), F.lit(True).alias("own"))
    scored = offered.unionByName(own).groupBy("user_id", "item_id").agg(F.sum("score").alias("score"), F.sum("weight").alias("weight"), F.max("own").alias("own"))
    return scored.filter("weight > 0 AND NOT own").select("user_id", "item_id", (F.col("score") / F.col("weight")).alias("predicted_rating"), "weight")


def recommend(ratings: DataFrame, items: DataFrame, target: int | None = None, k: int = 5, n: int = 3) -> DataFrame:
    """The n best-scored unseen items of the target, or of every user: user_id, rank, item_id, title, predicted_rating.

    items: item_id, title; an item without a title has null. Ratings equal to nine decimals are ties,
    which go to the smaller item_id. A user without defined similarities gets no rows.
    """
    lists = RatingLists(ratings) if target is None else None
    near = materialize(nearest_users(ratings, k, lists=lists) if target is None else top_neighbors(user_similarity(ratings, target), k), "neighbours")
    order = W.partitionBy("user_id").orderBy(F.desc(F.round("predicted_rating", 9)), "item_id")
    best = score_items(ratings, near, lists, n if lists else None).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return best.join(items.select("item_id", "title"), "item_id", "left").select("user_id", "rank", "item_id", "title", "predicted_rating")
