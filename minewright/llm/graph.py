"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm.common import Scratch


def connected_components(edges: DataFrame, at_once: int = 1_000_000, scratch: Scratch | None = None) -> DataFrame:
    """edges (a, b) of long ids to (id, component), the smallest id reachable, for ids with edges.

    Parts of at most `at_once` edges are contracted in a task each: every id of a part gets an edge to the smallest that the part's
    edges reach. If there is one part, that is the answer. Else what is left of all parts goes through large-star
    and small-star steps: each is a grouped minimum and a join, so no node's neighbours are ever gathered in one place; a hub's edges
    meet its one minimum in a join that adaptive execution splits. Rounds grow with the logarithm of a component's size and
    end when every component is a star around its smallest id. Null ids have no edges. The tables that the result reads
    are kept in scratch.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.keep(edges.filter("a <> b").select("a", "b"), "edges")
    parts = max(1, -(-edges.count() // at_once))
    pairs = scratch.keep((edges.coalesce(1) if parts == 1 else edges.repartition(parts)).mapInArrow(_contracted, "u long, v long"), "pairs0")
    rounds = 0
    while parts > 1 and not _stars(pairs):
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        rounds, pairs = rounds + 1, scratch.keep(small.filter("u <> v").distinct(), f"pairs{rounds + 1}")
        scratch.drop(f"pairs{rounds - 1}")
    scratch.drop("edges")
    own = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that edges between a and b reach from each)."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (jumped := label[label] != label).any():
            label[jumped] = label[label[jumped]]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return ids, ids[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        ids, low = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        moved = ids != low
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(low[moved])], ["u", "v"])


def _stars(pairs: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("n")).unionByName(pairs.select(F.col("v").alias("id"), F.lit(0).alias("n")))
    bad = ends.groupBy("id").agg(F.sum("n").alias("k"), F.min("n").alias("root")).filter("k > 1 OR (k = 1 AND root = 0)")
    return bad.isEmpty()
