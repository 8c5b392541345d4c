"""Label propagation among all pairs of points in one or two features, without their pairs: a smooth field on a grid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.functions.expressions import doubles
from minewright.functions.storage import Scratch

#: Chebyshev nodes per cell and axis: on a cell of width 1 / sqrt(gamma) they give exp(-gamma d^2) to some 1e-13.
NODES = 16
#: Cells and labels that a field may have, and what of the number of points a point's weights must sum up to for nine good digits.
CELLS, LABELS, LEAST = 1_024, 64, 1e-6


class Grid:
    """Cells of width 1 / sqrt(gamma) over a rectangle; a function on it is held as its values at NODES x NODES places of each cell."""

    def __init__(self, low: tuple[float, float], high: tuple[float, float], gamma: float):
        self.low, self.width = np.array(low), 1 / math.sqrt(gamma)
        self.shape = tuple(int((b - a) / self.width) + 1 for a, b in zip(low, high, strict=True))
        self.nodes = np.cos((2 * np.arange(NODES) + 1) * math.pi / (2 * NODES))
        self.turn = np.sin((2 * np.arange(NODES) + 1) * math.pi / (2 * NODES)) * (-1.0) ** np.arange(NODES)
        self.kernels = []
        for n in self.shape:
            at = ((np.arange(n)[:, None] + (self.nodes[None, :] + 1) / 2) * self.width).ravel()
            self.kernels.append(np.exp(-gamma * (at[:, None] - at[None, :]) ** 2))

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, weights of its nodes) of each point; the weights of the two axes multiplied."""
        at = (x - self.low) / self.width
        cell = np.minimum(at.astype(np.int64), np.array(self.shape) - 1)
        d = ((at - cell) * 2 - 1)[:, :, None] - self.nodes
        hit = np.abs(d) < 1e-15
        w = self.turn / np.where(hit, 1, d)
        w = np.where(hit.any(2, keepdims=True), hit, w)
        w /= w.sum(2, keepdims=True)
        return cell[:, 0] * self.shape[1] + cell[:, 1], (w[:, 0, :, None] * w[:, 1, None, :]).reshape(len(x), -1)

    def summed(self, moments: np.ndarray) -> np.ndarray:
        """The field that moments (cell, node, label) make at all nodes."""
        a, b, k = *self.shape, moments.shape[2]
        m = moments.reshape(a, b, NODES, NODES, k).transpose(0, 2, 1, 3, 4).reshape(a * NODES, b * NODES, k)
        m = np.einsum("jk,ikl->ijl", self.kernels[1], np.tensordot(self.kernels[0], m, 1), optimize=True)
        return m.reshape(a, NODES, b, NODES, k).transpose(0, 2, 1, 3, 4).reshape(moments.shape)


def _shares(grid: Grid, field: np.ndarray | None, cells: list[tuple[int, np.ndarray]], w: np.ndarray, code: np.ndarray, labels: int) -> tuple[np.ndarray, float]:
    """(p of each point by label: seeds have their label, others their share of the field; the least sum of an unlabelled point)."""
    u = np.zeros((len(w), labels))
    free = code < 0
    if field is not None:
        for c, rows in cells:
            u[rows] = np.maximum(w[rows] @ field[c], 0)
    total = u.sum(1)
    p = u / np.where(total > 0, total, 1)[:, None]
    p[~free] = 0
    p[np.flatnonzero(~free), code[~free]] = 1
    return p, float(total[free].min(initial=np.inf))


def propagate_field(points: DataFrame, label: str, gamma: float, max_iter: int, tol: float, key: str, vector: str, check_every: int = 5) -> DataFrame | None:
    """id, label, score as propagate() finds them over the graph of all pairs; None where a field doesn't serve.

    It serves for one or two features, unless points are spread over more than CELLS cells (then few lie near each other, and the graph is
    sparse), ids repeat, there are more than LABELS labels, or a point lies so far from all others that its sums would lose digits.

    What a point gets, the weighted sum of all p, is a smooth function of its place, the field. Tasks add up the points' p at the nodes of
    their cells (moments), the driver makes the next field of these, and p follows from the field. So an iteration is a map over the
    points; only moments, the size of a model, are handed on, and no pair is ever formed or written.
    """
    scratch = Scratch(points.sparkSession, "field")
    rows = points.select(F.col(key).alias("id"), doubles(F.col(vector)).alias("x"), F.col(label).alias("label")).dropna(subset=["id", "x"])
    x = [F.element_at("x", 1), F.when(F.size("x") > 1, F.expr("x[1]")).otherwise(0.0)]
    ends = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.count_distinct("id"), *[f(c) for c in x for f in (F.min, F.max)]).first()
    n, least, most, ids, low0, high0, low1, high1 = ends
    if not n or least != most or most not in (1, 2) or ids < n or not all(math.isfinite(v) for v in ends[4:]):
        return None
    if ((high0 - low0) * math.sqrt(gamma) + 1) * ((high1 - low1) * math.sqrt(gamma) + 1) > CELLS:
        return None
    labels = [r.label for r in rows.filter("label IS NOT NULL AND label <> -1").select("label").distinct().orderBy("label").limit(LABELS + 1).collect()]
    if not labels or len(labels) > LABELS:
        return None
    grid, k = Grid((low0, low1), (high0, high1), gamma), len(labels)
    code = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")), F.lit(0)).cast("int") - 1
    parts = max(points.sparkSession.sparkContext.defaultParallelism, n // 100_000)
    held = scratch.keep(rows.select("id", x[0].alias("x0"), x[1].alias("x1"), code.alias("code")).repartition(parts), "points")

    def read(batch):
        at, w = grid.places(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]))
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        return [(int(at[order[a]]), order[a:b]) for a, b in zip(first, [*first[1:], len(order)], strict=True)], w, batch.column(3).to_numpy()

    def step(field, before):
        def work(batches):
            moments, moved, lowest = {}, 0.0, np.inf
            for batch in batches:
                if batch.num_rows:
                    cells, w, code = read(batch)
                    p, total = _shares(grid, field, cells, w, code, k)
                    lowest = min(lowest, total)
                    moved += float(np.abs(p - _shares(grid, before, cells, w, code, k)[0]).sum())
                    for c, some in cells:
                        moments[c] = moments.get(c, 0) + w[some].T @ p[some]
            cells = [-1, *moments]
            values = [np.array([moved, lowest]), *[m.ravel() for m in moments.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], ["cell", "sums"])

        def add(some):
            cell, values = some["cell"][0].as_py(), np.array([np.frombuffer(v) for v in some["sums"].to_pylist()])
            whole = np.array([values[:, 0].sum(), values[:, 1].min()]) if cell < 0 else values.sum(0)
            return pa.table([pa.array([cell], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["cell", "sums"])

        total, moved, lowest = np.zeros((math.prod(grid.shape), NODES * NODES, k)), 0.0, np.inf
        for r in held.mapInArrow(work, "cell int, sums binary").groupBy("cell").applyInArrow(add, "cell int, sums binary").collect():  # the size of the model
            values = np.frombuffer(bytes(r.sums))
            if r.cell < 0:
                moved, lowest = values
            else:
                total[r.cell] += values.reshape(NODES * NODES, k)
        return total, moved, lowest

    moments, field = step(None, None)[0], None
    for i in range(1, max_iter + 1):
        before, field = field, grid.summed(moments)
        moments, moved, lowest = step(field, before)
        if lowest < LEAST * n:
            scratch.drop("points")
            return None
        if tol > 0 and i % check_every == 0 and moved < tol:
            break

    def best(batches):
        for batch in batches:
            if batch.num_rows:
                p = _shares(grid, field, *read(batch), k)[0]
                own = np.argmax(np.round(p, 9), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(p.max(1))], ["id", "own", "score"])

    out = held.mapInArrow(best, held.select("id", F.col("code").alias("own"), F.col("x0").alias("score")).schema)
    return scratch.done(out.select("id", F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("own") + 1).cast(rows.schema["label"].dataType).alias("label"), "score"))
