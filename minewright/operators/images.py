"""Images as tables: mosaics, normalisation, colour quantisation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.functions.expressions import ratio
from minewright.functions.storage import materialize
from minewright.operators.clustering import assign, initial_centroids, kmeans_best, kmeans_sweep, lloyd


def tile_mosaic(vectors: DataFrame, per_row: int, size: int, order: str = "tile", vector: str = "features", background: bool = True) -> DataFrame:
    """gy, gx, value: square tiles of `size` values set out on a grid, per_row tiles to a line.

    The tile number is in column `order`, from 0. A size that isn't a square, or a vector of another
    length, is an error. Cells of the last line without a tile hold 0, unless background is off.
    """
    side = math.isqrt(size)
    if side * side != size:
        raise ValueError(f"{size} isn't a square number")
    checked = F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"a vector has not {size} values but "), F.size(vector).cast("string"))).cast("array<double>"))
    cells = vectors.select(F.col(order).cast("long").alias("t"), F.posexplode(checked.cast("array<double>")).alias("j", "value"))
    place = lambda j: (F.expr(f"(t div {per_row}) * {side} + {j} div {side}").alias("gy"), F.expr(f"(t % {per_row}) * {side} + {j} % {side}").alias("gx"))
    filled = cells.select(*place("j"), "value")
    if not background:
        return filled
    count = vectors.agg((F.max(order) + 1).alias("n")).filter("n IS NOT NULL")
    empty = count.select(F.explode(F.expr(f"CASE WHEN n % {per_row} > 0 THEN sequence(cast(n as bigint), cast(n + {per_row} - n % {per_row} - 1 as bigint)) END")).alias("t"))
    empty = empty.select("t", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    return filled.unionByName(empty.select(*place("j"), F.lit(0.0).alias("value")))


def minmax(df: DataFrame, column: str, name: str = "scaled") -> DataFrame:
    """df plus the column scaled so that its least value is 0 and its greatest 1; null if they are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, ratio((F.col(column) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double"))).drop("_lo", "_hi")


def colours(pixels: DataFrame) -> DataFrame:
    """The distinct colours of all pixels with their counts: id (packed colour), features, weight."""
    counted = pixels.groupBy("r", "g", "b").agg(F.count("*").alias("weight"))
    packed = F.col("r").cast("long") * 65536 + F.col("g") * 256 + F.col("b")
    return counted.select(packed.alias("id"), F.array(*[F.col(c).cast("double") for c in "rgb"]).alias("features"), "weight", "r", "g", "b")


def quantise(pixels: DataFrame, k: int, iterations: int = 10, centroids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(recoloured pixels, palette): k-means over colours, each pixel set to its centroid, cut to whole numbers (after rounding to nine decimals).

    Means are taken over distinct colours weighted by their counts, at most 2^24 rows of 8-bit channels
    however many pixels there are. palette: cluster, r, g, b, n_pixels, n_colours.
    """
    distinct = materialize(colours(pixels), "colours")
    start = initial_centroids(distinct, k) if centroids is None else centroids
    fitted = lloyd(distinct, start, iterations, weight="weight")
    whole = fitted.select("cluster", *[F.round(F.element_at("center", i + 1), 9).cast("int").alias(f"new_{c}") for i, c in enumerate("rgb")])
    known = assign(distinct, fitted).select("r", "g", "b", "cluster", "weight")
    used = known.groupBy("cluster").agg(F.sum("weight").alias("n_pixels"), F.count("*").alias("n_colours"))
    palette = whole.join(used, "cluster", "left").select("cluster", *[F.col(f"new_{c}").alias(c) for c in "rgb"], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_pixels", "n_colours")])
    look = known.join(F.broadcast(whole), "cluster").select("r", "g", "b", "cluster", "new_r", "new_g", "new_b")
    rest = [c for c in pixels.columns if c not in ("r", "g", "b")]
    recoloured = pixels.join(look, ["r", "g", "b"]).select(*rest, "cluster", *[F.col(f"new_{c}").alias(c) for c in "rgb"])
    return recoloured, palette


def palettes(pixels: DataFrame, ks: Sequence[int], iterations: int = 10) -> DataFrame:
    """k, cluster, r, g, b: the palettes of quantise() for several k, whose iterations share their passes over the colours."""
    fitted = kmeans_sweep(materialize(colours(pixels), "colours"), ks, weight="weight", iterations=iterations)
    return fitted.select("k", "cluster", *[F.round(F.element_at("center", i + 1), 9).cast("int").alias(c) for i, c in enumerate("rgb")])


def best_palettes(pixels: DataFrame, ks: Sequence[int], restarts: int = 10) -> DataFrame:
    """k, cluster, r, g, b, inertia: the palettes of full fits, the best of `restarts` for each k, all fitted together."""
    fitted = kmeans_best(colours(pixels), ks, restarts, weight="weight")
    return fitted.select("k", "cluster", *[F.round(F.element_at("center", i + 1), 9).cast("int").alias(c) for i, c in enumerate("rgb")], "inertia")


def scanlines(pixels: DataFrame) -> DataFrame:
    """image_id, y, line: the pixels of each line in order of x, the form to write images from."""
    one = F.struct("x", F.struct("r", "g", "b").alias("rgb"))
    return pixels.groupBy("image_id", "y").agg(F.transform(F.sort_array(F.collect_list(one)), lambda p: p.rgb).alias("line"))
