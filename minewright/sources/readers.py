"""Readers for the file kinds that mining data comes in, each with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = "user_id int, item_id int, rating int, timestamp bigint"
#: Column names of the item file, in its order; those after IMDb_URL are genre flags.
ITEM_COLUMNS = [
    "item_id", "movie_title", "release_date", "video_release_date", "IMDb_URL", "unknown", "Action", "Adventure", "Animation", "Childrens", "Comedy", "Crime",
    "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
]


def item_schema() -> T.StructType:
    text = ITEM_COLUMNS[1:5]
    return T.StructType([T.StructField(c, T.StringType() if c in text else T.IntegerType()) for c in ITEM_COLUMNS])


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """A comma-separated table."""
    return spark.read.csv(path, schema=schema, header=header)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated ratings log without header."""
    return spark.read.csv(path, sep="\t", schema=RATINGS)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-separated latin-1 item table without header."""
    return spark.read.csv(path, sep="|", encoding="ISO-8859-1", schema=item_schema())


def read_vectors(spark: SparkSession, path: str, width: int, scale: float = 1.0) -> DataFrame:
    """Headerless lines of a label and `width` numbers to row_id, label, features (divided by scale).

    row_id follows the order of lines: it counts the lines of earlier partitions and those before in the
    same one. The counts per partition are one row each.
    """
    names = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField("label", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    raw = spark.read.csv(path, schema=schema).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = raw.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = raw.withColumn("_part", part).join(counts, "_part")
    row_id = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)
    return rows.select(row_id.cast("long").alias("row_id"), "label", F.array(*[F.col(c) / scale for c in names]).alias("features"))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """All images of a folder as image_id, y, x, r, g, b: one row per pixel, made by the executors.

    Spark decodes to interleaved bytes, blue first; grey images give equal channels, alpha is left out. Each image is cut into
    an array of its lines at once, so a line's row carries its own bytes only, and lines are decoded to columns in Arrow batches.
    """
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").filter("height > 0 AND width > 0")
    cut = F.expr("transform(sequence(0, height - 1), y -> named_struct('y', y, 'bytes', substring(data, y * width * nChannels + 1, width * nChannels)))")
    lines = image.select("origin", "width", "nChannels", F.explode(cut).alias("line")).select("origin", "width", "nChannels", "line.y", "line.bytes")
    return lines.mapInArrow(_pixels, "image_id string, y int, x int, r int, g int, b int")


def _pixels(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Lines (origin, width, nChannels, y, bytes) to pixels; lines of one form are decoded together, about `at_once` pixels a batch."""
    for batch in batches:
        width, channels = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (width[1:] != width[:-1]) | (channels[1:] != channels[:-1])])) if batch.num_rows else []
        for first, behind in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            w, c = int(width[first]), int(channels[first])
            for at in range(int(first), int(behind), max(1, at_once // w)):
                some = batch.slice(at, min(max(1, at_once // w), int(behind) - at))
                data = np.frombuffer(b"".join(some.column(4).to_pylist()), np.uint8).reshape(-1, c)
                n = some.num_rows
                line = pa.array(np.repeat(np.arange(n), w))
                blue, green, red = (data[:, k if c > 1 else 0].astype(np.int32) for k in range(3))
                x = np.tile(np.arange(w, dtype=np.int32), n)
                yield pa.RecordBatch.from_arrays([some.column(0).take(line), some.column(3).take(line), *[pa.array(v) for v in (x, red, green, blue)]], ["image_id", "y", "x", "r", "g", "b"])
