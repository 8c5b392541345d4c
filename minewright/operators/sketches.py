"""Approximate nearest neighbours: sign projections, compared by Hamming distance, propose the pairs that are looked at."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.functions.storage import Scratch
from minewright.operators.cells import block_search, distances
from minewright.operators.matrices import nearest_rows


def directions(width: int, bits: int, seed: int = 5) -> np.ndarray:
    """width x bits: random directions, orthogonal to each other as far as there is room, which makes signs more even."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-bits // width))]
    return np.concatenate(blocks, 1)[:, :bits]


def codes(x: np.ndarray, centre: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The signs of x - centre along the axes as words of 64 bits."""
    signs = np.packbits((x - centre) @ axes > 0, axis=1)
    wide = np.zeros((len(x), -(-signs.shape[1] // 8) * 8), np.uint8)
    wide[:, : signs.shape[1]] = signs
    return wide.view(np.uint64)


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each row of x differs from each row of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for a, b in zip(x.T, y.T, strict=True):
        out += np.bitwise_count(a[:, None] ^ b[None, :])
    return out


class Sketch:
    """Codes whose length is set from a sample of the base, and for each query a radius within which a share of the sample lies."""

    def __init__(self, sample: np.ndarray, k: int, share: float, recall: float, sizes: tuple[int, ...] = (128, 256, 512, 1024)):
        self.centre, self.share = sample.mean(0), share
        some = sample[:200]
        d = distances(some, sample)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
        for bits in sizes:
            self.axes = directions(sample.shape[1], bits)
            self.sample = codes(sample, self.centre, self.axes)
            away = hamming(self.sample[: len(some)], self.sample)
            if not near.size or (np.take_along_axis(away, near, 1) <= self.radius(self.sample[: len(some)])[:, None]).mean() >= recall:
                break
        self.bits = bits

    def radius(self, own: np.ndarray) -> np.ndarray:
        """For each code the greatest number of bits within which no more than `share` of the sample lies."""
        away = np.sort(hamming(own, self.sample), axis=1)
        rank = min(len(self.sample) - 1, int(self.share * len(self.sample)))
        return away[:, rank].astype(np.int64) - (away[:, rank] == away[:, min(rank + 1, len(self.sample) - 1)])

    def proposer(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def propose(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
            own = codes(queries, self.centre, self.axes)
            return hamming(own, codes(rows, self.centre, self.axes)) <= self.radius(own)[:, None]

        return propose


def sketch_join(query: DataFrame, base: DataFrame, k: int, extra: tuple[str, ...] = (), block: int = 4_096, sample: int = 2_000, share: float = 0.07, recall: float = 0.95, self_join: bool = False) -> tuple[DataFrame, DataFrame]:
    """(near rows of base for each query, k at most; q_id and proposed pairs of each query). query: q_id, _q; base: b_id, _b, extra.

    A vector's code has its signs along random directions; each query looks only at rows whose codes lie within its radius, which is
    multi-probing all buckets of that many flipped bits. The number of bits is the least with which the sample's own
    neighbours lie within such radii in `recall` of all cases; the radius is that within which `share` of the sample (at most
    about `sample` rows, by hash of ids) lies, so about that share of all pairs is compared by distance, in dense places and
    thin ones. Codes are compared in blocks of bounded size, as in block_search(). Neighbours outside the radius are missed.
    """
    spark = query.sparkSession
    scratch = Scratch(spark, "sketch")
    salted = lambda df: df.withColumn("salt", F.monotonically_increasing_id())
    b = scratch.keep(salted(base).withColumn("cell", F.lit(0)), "base")
    rows = b.count()
    h = F.pmod(F.xxhash64(F.lit(13), "b_id"), F.lit(1 << 40))
    taken = [r._b for r in sorted(b.filter(h < int((1 << 40) * min(1.0, sample / max(1, rows)))).select(h.alias("h"), "_b").limit(2 * sample).collect())]
    if len(taken) < 2:
        taken = [r._b for r in b.select("_b").limit(2).collect()]
    if not taken:
        none = query.select("q_id").limit(0).crossJoin(base.select("b_id", F.lit(0.0).alias("dist"), *extra).limit(0))
        return nearest_rows(none, k), query.select("q_id", F.lit(0).cast("long").alias("proposed"))
    sketch = Sketch(np.array(taken, np.float64), k, share, recall)
    q = scratch.keep(salted(query).withColumn("cells", F.array(F.lit(0))), "queries")
    found = scratch.keep(block_search(q, b, {0: max(1, -(-rows // block))}, k, extra, block, self_join, sketch.proposer()), "found")
    near = scratch.keep(nearest_rows(found.filter("b_id IS NOT NULL"), k), "near")
    proposed = scratch.keep(found.filter("b_id IS NULL").groupBy("q_id").agg(F.sum("dist").cast("long").alias("proposed")), "proposed")
    scratch.drop("base", "queries", "found")
    return near, proposed
