"""k nearest neighbours: exact and approximate joins, and classification by vote."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minewright.functions.expressions import doubles
from minewright.functions.storage import materialize, read_block
from minewright.operators.cells import cell_join
from minewright.operators.matrices import closest, kept_nearest, matrix, nearest_rows
from minewright.operators.sketches import sketch_join


def knn_join(query: DataFrame, base: DataFrame, k: int, key: str = "id", vector: str = "features", extra: tuple[str, ...] = (), method: str = "exact", query_block: int = 4_096, self_join: bool = False) -> DataFrame:
    """q_id, b_id, dist, rank: the k rows of base nearest to each query row (Euclidean), plus base columns extra.

    exact: queries that one block of `query_block` rows holds meet the base in one scan, each task keeping its own k best per query, at
    their exact distances, before anything is shuffled; more are joined by Voronoi cells (see cell_join()), with the same result.
    cells: always that join. lsh: sign projections propose pairs (see sketch_join()), so some of the nearest may be missed; a query with
    fewer than k proposed pairs is searched exactly instead. Distances equal to nine decimals are ties, which go to the smaller b_id. With
    self_join a row isn't its own neighbour. Rows with a null key or vector have none; vectors must have one length.
    """
    q, b = _sides(query, base, key, vector, extra)
    if method == "lsh":
        near, _ = sketch_join(q, b, k, extra, query_block, self_join=self_join)
        full = near.filter(F.col("rank") == k).select("q_id")
        rest = materialize(q.join(full, "q_id", "left_anti"), "rest")
        return near.join(full, "q_id", "left_semi").unionByName(_exact(rest, b, k, extra, query_block, self_join))
    if method == "cells":
        return cell_join(q, b, k, extra, query_block, self_join=self_join)[0]
    return _exact(q, b, k, extra, query_block, self_join)


def knn_reads(query: DataFrame, base: DataFrame, k: int, key: str = "id", vector: str = "features", method: str = "cells", query_block: int = 4_096, self_join: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """knn_join() by cells or lsh as it is found, and what it took for each query: q_id, cells_read and cells, or q_id and proposed (pairs)."""
    q, b = _sides(query, base, key, vector, ())
    return {"cells": cell_join, "lsh": sketch_join}[method](q, b, k, (), query_block, self_join=self_join, **options)


def _sides(query: DataFrame, base: DataFrame, key: str, vector: str, extra: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    q = query.select(F.col(key).alias("q_id"), doubles(F.col(vector)).alias("_q")).dropna()
    return q, base.select(F.col(key).alias("b_id"), doubles(F.col(vector)).alias("_b"), *extra).dropna(subset=["b_id", "_b"])


def _exact(q: DataFrame, b: DataFrame, k: int, extra: tuple[str, ...], query_block: int, self_join: bool) -> DataFrame:
    q = materialize(q, "queries")
    n = q.count()
    if n > query_block:
        return cell_join(q, b, k, extra, query_block, self_join=self_join)[0]
    kinds = {f.name: f.dataType for f in (*q.schema, *b.schema)}
    names = ["q_id", "b_id", "dist", *extra]
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in names])
    if not n:
        return nearest_rows(q.sparkSession.createDataFrame([], schema), k)
    files = tuple(sorted(materialize(q.repartition(1), "block").inputFiles()))

    def search(batches):
        ids, vectors = _queries(files)
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = closest(ids, vectors, part.column(0), matrix(part.column(1)), k, self_join)
                rows = pa.table([*near[:3], *[c.take(near[3]) for c in part.columns[2:]]], names=names)
                best = rows if best is None else pa.concat_tables([best, rows])
                if best.num_rows > 4 * k * len(ids):
                    best = kept_nearest(best, k)
        if best is not None:
            yield from kept_nearest(best, k).to_batches()

    return nearest_rows(b.mapInArrow(search, schema), k)


@lru_cache(maxsize=2)
def _queries(files: tuple[str, ...]) -> tuple[pa.Array, np.ndarray]:
    rows = read_block(files)
    return rows["q_id"].combine_chunks(), matrix(rows["_q"])


def knn_classify(train: DataFrame, test: DataFrame, k: int = 1, weights: str = "uniform", key: str = "id", vector: str = "features", label: str = "label") -> DataFrame:
    """id, label, prediction for each test row, by the votes of its k nearest training rows.

    uniform: one vote each. distance: 1 / distance; if neighbours lie at distance 0, only they vote.
    Ties go to the smaller label. Training rows without a label don't vote.
    """
    near = knn_join(test, train.filter(F.col(label).isNotNull()), k, key, vector, (label,))
    if weights == "distance":
        exact = F.max(F.col("dist") == 0).over(W.partitionBy("q_id"))
        vote = F.when(exact, (F.col("dist") == 0).cast("double")).otherwise(1 / F.when(F.col("dist") > 0, F.col("dist")))
    else:
        vote = F.lit(1.0)
    votes = near.withColumn("_vote", vote).groupBy("q_id", label).agg(F.sum("_vote").alias("_vote"))
    best = votes.groupBy("q_id").agg(F.max_by(label, F.struct(F.round("_vote", 9), -F.col(label))).alias("prediction"))
    return test.select(F.col(key).alias("id"), F.col(label).alias("label")).join(best.withColumnRenamed("q_id", "id"), "id", "left")
