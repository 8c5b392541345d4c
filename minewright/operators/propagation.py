"""Label propagation over an affinity graph."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minewright.functions.expressions import doubles, rbf
from minewright.functions.storage import Scratch
from minewright.operators.fields import propagate_field
from minewright.operators.neighbors import knn_join


def affinity_graph(points: DataFrame, gamma: float = 20.0, k: int | None = 10, key: str = "id", vector: str = "features", method: str = "exact", lost: float = 1e-9) -> DataFrame:
    """src, dst, w = exp(-gamma * squared distance), in both directions, each point tied to itself with 1.

    k: the graph of k nearest neighbours, made symmetric (method: see knn_join()), the default, as it grows with the
    points. None: all pairs whose weight counts, by radius_graph(), from each point's total of which at most `lost` is missing.
    """
    if k is None:
        return radius_graph(points, gamma, key, vector, lost)
    near = knn_join(points, points, k, key, vector, method=method, self_join=True)
    edges = near.select(F.col("q_id").alias("src"), F.col("b_id").alias("dst"), rbf(F.col("dist") * F.col("dist"), gamma).alias("w"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = both.groupBy("src", "dst").agg(F.max("w").alias("w"))
    own = points.filter(F.col(key).isNotNull()).select(F.col(key).alias("src"), F.col(key).alias("dst"), F.lit(1.0).alias("w"))
    return both.unionByName(own)


def radius_graph(points: DataFrame, gamma: float, key: str = "id", vector: str = "features", lost: float = 1e-9, axes: int = 3) -> DataFrame:
    """src, dst, w of all pairs of points, a point with itself too, that are near enough to count.

    With n points, pairs beyond sqrt(ln(n / lost) / gamma) weigh less than lost / n, so a point loses less than `lost`
    in all. Points lie in a grid of cells of that width along the first `axes` features; each meets those of its own and the
    adjacent cells only. At a fixed density the work is in proportion to the points; where all lie within a radius, the graph itself is their
    square. Rows with a null key or vector are left out; vectors must have one length.
    """
    rows = points.select(F.col(key).alias("id"), doubles(F.col(vector)).alias("x")).dropna()
    n, least, most = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} numbers")
    width = int(most or 0)
    radius = math.sqrt(math.log(max(n, 2) / lost) / gamma)
    cell = [F.floor(F.element_at("x", i + 1) / radius) for i in range(min(axes, width))]
    a = rows.select(F.col("id").alias("src"), *[F.element_at("x", i + 1).alias(f"a{i}") for i in range(width)], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    b = rows.select(F.col("id").alias("dst"), *[F.element_at("x", i + 1).alias(f"b{i}") for i in range(width)], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    for i in range(len(cell)):
        b = b.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + step for step in (-1, 0, 1)])))
    squared = sum(((F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in range(width)), F.lit(0.0))
    pairs = a.join(b, [f"c{i}" for i in range(len(cell))]) if cell else a.crossJoin(b.limit(0))
    return pairs.select("src", "dst", squared.alias("d")).filter(F.col("d") <= radius * radius).select("src", "dst", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(rbf(F.col("d"), gamma)).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, max_iter: int = 1000, tol: float = 1e-3, check_every: int = 5) -> DataFrame:
    """id, label, score of every node that labels reach: F <- T F, rows normalised, seeds put back each time.

    edges: src, dst, w; seeds: id, label (null or -1: no seed). Every `check_every` iterations it stops if all p together changed by
    less than tol in the last one, and after max_iter in any case. Nodes out of reach have no row. Ties go to the smaller label.

    State is a row per node and label: u, the weighted sum of its neighbours' p, p itself, and what of it has been sent. Only
    changes are sent along the edges and added to u; those of less than tol / 1000 divided by the number of states wait until they are
    larger, so a part of the graph that has settled sends nothing. The graph is written once to the shared folder, bucketed by dst,
    so an iteration shuffles changes and sums but no edges. The state is written there in each iteration, which bounds the plan
    and survives lost executors; the one before is deleted.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "propagation")
    graph, parts = f"graph_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        seeds = scratch.keep(seeds.filter("label IS NOT NULL AND label <> -1").select("id", "label"), "seeds")
        # What seeds would be sent is never used, so their edges are left out.
        free = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_anti")
        free.repartition(parts, "dst").write.option("path", f"{scratch.folder}/graph-0").bucketBy(parts, "dst").sortBy("dst").saveAsTable(graph)
        edges = spark.table(graph)
        start = seeds.select("id", "label", F.lit(True).alias("seed"), F.lit(0.0).alias("u"), F.lit(1.0).alias("p"), F.lit(0.0).alias("sent"), F.lit(1.0).alias("moved"))
        state, least = scratch.keep(start, "state0"), 0.0
        for i in range(1, max_iter + 1):
            now = F.abs(F.col("p") - F.col("sent")) > least
            sent = state.filter(now).select(F.col("id").alias("dst"), "label", (F.col("p") - F.col("sent")).alias("change"))
            got = edges.join(sent, "dst").select(F.col("src").alias("id"), "label", F.expr("w * change").alias("u"))
            held = state.select("id", "label", "seed", "u", "p", F.when(now, F.col("p")).otherwise(F.col("sent")).alias("sent"))
            both = held.unionByName(got.select("id", "label", F.lit(False).alias("seed"), "u", F.lit(0.0).alias("p"), F.lit(0.0).alias("sent")))
            summed = both.groupBy("id", "label").agg(F.max("seed").alias("seed"), F.sum("u").alias("u"), F.sum("p").alias("old"), F.sum("sent").alias("sent"))
            share = F.greatest("u", F.lit(0.0)) / F.sum(F.greatest("u", F.lit(0.0))).over(W.partitionBy("id"))
            summed = summed.filter("seed OR u > 0 OR old > 0").withColumn("p", F.when(F.col("seed"), 1.0).otherwise(F.coalesce(share, F.lit(0.0))))
            state = scratch.keep(summed.select("id", "label", "seed", "u", "p", "sent", F.abs(F.col("p") - F.col("old")).alias("moved")), f"state{i}")
            scratch.drop(f"state{i - 1}")
            if tol > 0 and i % check_every == 0:
                states, change = state.agg(F.count("*"), F.sum("moved")).first()
                least = tol / 1000 / max(1, states)
                if (change or 0.0) < tol:
                    break
        best = F.struct(F.round("p", 9), -F.col("label"))
        return scratch.done(state.filter("p > 0").groupBy("id").agg(F.max_by("label", best).alias("label"), F.max("p").alias("score")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {graph}")


def propagate_labels(points: DataFrame, label: str = "seed_label", gamma: float = 20.0, k: int | None = 10, max_iter: int = 1000, tol: float = 1e-3, key: str = "id", vector: str = "features", **graph) -> DataFrame:
    """id, label, score for all points; label is null where no seed can be reached.

    k None: over all pairs, without forming them where a field on a grid serves (see propagate_field()), by the graph otherwise.
    """
    found = propagate_field(points, label, gamma, max_iter, tol, key, vector) if k is None and max_iter > 0 and not graph else None
    if found is None:
        found = propagate(affinity_graph(points, gamma, k, key, vector, **graph), points.select(F.col(key).alias("id"), F.col(label).alias("label")), max_iter, tol)
    return points.select(F.col(key).alias("id")).join(found, "id", "left")
