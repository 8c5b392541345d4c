"""Exact k nearest neighbours of two large sides: Voronoi cells around pivots, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from minewright.functions.storage import Scratch, read_block
from minewright.operators.matrices import chosen, closest, kept_nearest, matrix, nearest_rows

#: Distances are ties if they are equal to nine decimals; a cell is left out only if it is farther than that.
TIE = 2e-9


@dataclass
class Cells:
    """Pivots, their distances to each other, and rows, least and greatest pivot distance of each cell of the base."""

    pivots: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def __post_init__(self):
        self.apart = distances(self.pivots, self.pivots)

    def homes(self, to_pivots: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query its cells in order of their pivots' distance, as many as it takes to hold k rows."""
        order = np.argsort(to_pivots, axis=1, kind="stable")
        rows = np.cumsum(self.count[order], axis=1)
        return [o[: int(np.searchsorted(r, k)) + 1] for o, r in zip(order, rows, strict=True)]

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """For each query and cell, what no row of the cell is nearer than.

        A row lies in a ring around its pivot, and on its pivot's side of the plane half way to the query's own pivot.
        """
        home = to_pivots.argmin(1)
        own = to_pivots[np.arange(len(home)), home]
        apart = self.apart[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (to_pivots**2 - own[:, None] ** 2) / (2 * apart), 0)
        found = np.maximum(np.maximum(to_pivots - self.most[None, :], self.least[None, :] - to_pivots), plane)
        return np.where(self.count[None, :] > 0, np.maximum(found, 0), np.inf)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y, from differences, a few rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.sqrt(((x[at : at + step, None, :] - y[None, :, :]) ** 2).sum(2))
    return out


def choose_pivots(base: DataFrame, rows: int, each: int, most: int) -> np.ndarray:
    """About rows / each of the base's vectors, but `most` at most, chosen by hash of their ids."""
    wanted = min(most, max(1, rows // each))
    h = F.pmod(F.xxhash64(F.lit(11), "b_id"), F.lit(1 << 40))
    found = base.filter(h < int((1 << 40) * min(1.0, 1.5 * wanted / max(1, rows)))).select(h.alias("h"), "_b").limit(4 * wanted).collect()
    found = [r._b for r in sorted(found)[:wanted]] or [r._b for r in base.select("_b").limit(1).collect()]
    return np.unique(np.array(found, np.float64), axis=0) if found else np.zeros((0, 1))


def _celled(rows: DataFrame, pivots: np.ndarray, vector: str) -> DataFrame:
    """rows plus cell, the nearest pivot, and away, the distance to it."""
    names, at = [*rows.columns, "cell", "away"], rows.columns.index(vector)

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                d = distances(matrix(part.column(at)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names)

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))


def block_search(visits: DataFrame, base: DataFrame, parts: dict[int, int], k: int, extra: tuple[str, ...], block: int, self_join: bool, propose: Callable | None = None) -> DataFrame:
    """q_id, b_id, dist, extra: the k nearest of each query (q_id, _q, salt, cells) in every cell that it visits.

    A cell's rows (b_id, _b, salt, cell) are cut into parts and its queries into chunks of about `block`, so a task compares two
    matrices of bounded size, however many rows or queries a cell has; rows are copied per chunk and queries per part. With
    propose (queries and rows to a matrix of booleans), only pairs that it proposes are compared, and each block also gives their
    number for each query as a row without b_id.
    """
    spark = visits.sparkSession
    each = visits.select("q_id", "_q", "salt", F.explode("cells").alias("cell"))
    counts = {r.cell: r.n for r in visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    plan = spark.createDataFrame([(c, parts[c], -(-n // block)) for c, n in counts.items()], "cell int, parts int, chunks int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = each.join(F.broadcast(plan), "cell").withColumn("chunk", F.pmod("salt", F.col("chunks")).cast("int")).select("q_id", "_q", "cell", "chunk", spread("parts").alias("part"))
    b = base.join(F.broadcast(plan), "cell").withColumn("part", F.pmod("salt", F.col("parts")).cast("int")).select("b_id", "_b", *extra, "cell", "part", spread("chunks").alias("chunk"))
    schema = T.StructType([visits.schema["q_id"], T.StructField("b_id", base.schema["b_id"].dataType), T.StructField("dist", T.DoubleType()), *[T.StructField(c, base.schema[c].dataType) for c in extra]])
    arrow, names = to_arrow_schema(schema), schema.names

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        best = arrow.empty_table()
        if not left.num_rows or not right.num_rows:
            return best
        ids, vectors = left["q_id"].combine_chunks(), matrix(left["_q"])
        proposed = np.zeros(len(ids), np.int64)
        for at in range(0, right.num_rows, 1024):
            some = right.slice(at, 1024).combine_chunks()
            other, b_ids = matrix(some["_b"]), some["b_id"].combine_chunks()
            if propose is None:
                near = closest(ids, vectors, b_ids, other, k, self_join)
            else:
                wanted = propose(vectors, other)
                proposed += wanted.sum(1)
                near = chosen(ids, vectors, b_ids, other, *np.nonzero(wanted), self_join)
            rows = pa.table([*near[:3], *[some[c].take(near[3]) for c in extra]], names=names).cast(arrow)
            best = kept_nearest(pa.concat_tables([best, rows]), k)
        if propose is not None:
            count = [ids, pa.nulls(len(ids), arrow.field("b_id").type), pa.array(proposed.astype(float)), *[pa.nulls(len(ids), arrow.field(c).type) for c in extra]]
            best = pa.concat_tables([best, pa.table(count, names=names).cast(arrow)])
        return best

    keys = ["cell", "part", "chunk"]
    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(nearest, schema)


@dataclass
class Stored:
    """The base as tasks read it: files in order of cells, and the cells of each."""

    files: list[str]
    held: list[np.ndarray]

    def read(self, file: int) -> pa.Table:
        return read_block((self.files[file],)).combine_chunks()


def _in_order(celled: DataFrame, rows: int, each: int) -> DataFrame:
    """celled (with salt) in order of cells, in partitions of about `each` rows; a cell of many rows takes several."""
    return celled.repartitionByRange(max(1, -(-rows // each)), "cell", "salt").sortWithinPartitions("cell")


def _stored(base: DataFrame) -> Stored:
    held: dict[str, list[int]] = {}
    for r in base.select(F.col("_metadata.file_name").alias("file"), "cell").distinct().collect():  # a row per file and cell of it
        held.setdefault(r.file, []).append(r.cell)
    files = [f for f in sorted(base.inputFiles()) if f.rsplit("/", 1)[1] in held]
    return Stored(files, [np.array(held[f.rsplit("/", 1)[1]]) for f in files])


class _Search:
    """The k nearest base rows of a block of queries, found by reading the cells that may hold some."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, cells: Cells, k: int, self_join: bool, extra: tuple[str, ...]):
        self.ids, self.q, self.cells, self.k, self.self_join, self.extra = ids, vectors, cells, k, self_join, extra
        self.to_pivots = distances(vectors, cells.pivots)
        self.read = np.zeros(self.to_pivots.shape, bool)
        self.limit, self.places = np.full(len(vectors), np.inf), pa.array(np.arange(len(vectors)))
        self.pending: list[pa.Table] = []

    def run(self, base: Stored) -> pa.Table | None:
        """q_id (the query's place in the block), b_id, dist, extra. Cells that hold the first k rows of a query come first: the k-th
        distance found there, and then any nearer one, bounds what others are worth reading."""
        home = np.zeros(self.to_pivots.shape, bool)
        for row, near in zip(home, self.cells.homes(self.to_pivots, self.k + self.self_join), strict=True):
            row[near] = True
        home &= self.cells.count[None, :] > 0
        self._pass(base, lambda cell: home[:, cell])
        self._settle()
        bounds = np.concatenate([self.cells.bounds(self.to_pivots[i : i + 512]) for i in range(0, len(self.q), 512)])
        bounds[home | (self.cells.count[None, :] == 0)] = np.nan
        self._pass(base, lambda cell: bounds[:, cell] <= self.limit)
        self._settle()
        return self.pending[0] if self.pending else None

    def _pass(self, base: Stored, wanting: Callable[[int], np.ndarray]) -> None:
        near = [self.to_pivots[:, held].min() for held in base.held]
        for file in np.argsort(near, kind="stable"):
            if not any(wanting(c).any() for c in base.held[file]):
                continue
            rows = base.read(file)
            cell = rows["cell"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                asked = np.flatnonzero(wanting(cell[a]))
                self.read[asked, cell[a]] = True
                for at in range(a, b if len(asked) else a, 1024):
                    self._tile(asked, cell[a], rows.slice(at, min(1024, b - at)))

    def _tile(self, asked: np.ndarray, cell: int, rows: pa.Table) -> None:
        """Compare queries with rows of a cell.

        A matrix product finds all rows that may be among the k nearest; their distances are then taken from the differences themselves.
        It is in single precision, but relative to the cell's pivot, so its rounding error shrinks with the distances.
        """
        b, pivot = matrix(rows["_b"]), self.cells.pivots[cell]
        q, own = (self.q if len(asked) == len(self.q) else self.q[asked]) - pivot, b - pivot
        qq, bb = self.to_pivots[asked, cell] ** 2, (own * own).sum(1)
        kind = np.float32 if max(qq.max(), bb.max()) < 1e30 else np.float64
        left, right = np.ones((len(q), q.shape[1] + 1), kind), np.empty((len(b), q.shape[1] + 1), kind)
        left[:, :-1], right[:, :-1], right[:, -1] = q, own, -bb / 2
        s = left @ right.T  # (|q|^2 - d^2) / 2 of each pair
        wide = (q.shape[1] + 8) * 2.0**-22 * (qq + bb.max()) + 2 * TIE * (np.sqrt(qq) + np.sqrt(bb.max())) + 1e-17
        border = (qq - self.limit[asked] ** 2) / 2 - wide
        free = np.flatnonzero(np.isinf(self.limit[asked]))
        if len(free):
            place = max(0, len(b) - self.k - self.self_join)
            border[free] = np.partition(s[free], place, axis=1)[:, place] - wide[free]
        i, j = np.nonzero(s >= border.astype(kind)[:, None])
        near = chosen(self.places, self.q, rows["b_id"].combine_chunks(), b, asked[i], j)
        found = pa.table([*near[:3], *[rows[c].take(near[3]) for c in self.extra]], names=["q_id", "b_id", "dist", *self.extra])
        if self.self_join:
            found = found.filter(pc.not_equal(self.ids.take(found["q_id"].combine_chunks()), found["b_id"]))
        self.pending.append(found)
        if sum(x.num_rows for x in self.pending) > 4 * self.k * len(self.q):
            self._settle()

    def _settle(self) -> None:
        """Keep the k nearest of each query so far; where there are k, the last is the limit of those that are still of interest."""
        if self.pending:
            best = kept_nearest(pa.concat_tables(self.pending), self.k)
            self.pending = [best]
            at, n = np.unique(best["q_id"].to_numpy(), return_counts=True)
            last = best["dist"].to_numpy()[np.cumsum(n) - 1]
            self.limit[at[n == self.k]] = (last * (1 + 1e-12) + TIE)[n == self.k]


def cell_join(query: DataFrame, base: DataFrame, k: int, extra: tuple[str, ...] = (), block: int = 4_096, cell_rows: int = 512, pivots: int = 2_048, self_join: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the k rows of base nearest to each query; q_id, cells_read and cells). query: q_id, _q; base: b_id, _b, extra.

    Base rows belong to the cell of their nearest pivot and are written in order of cells to the shared folder; queries are dealt to
    tasks in the same order, in blocks of `block`. A task reads for its block the cells that each query lies in first (as many near ones
    as hold k rows); the k-th distance found there bounds what other cells are worth reading, by Cells.bounds(). So either side is
    shuffled once, no pair and no copy of a row is, and each query brings k rows out of its task, however many cells it reads. Nothing
    but pivots and a row per cell passes the driver; a task holds a block and a file of the base (2 * block rows). Where the bounds
    leave nothing out (many independent dimensions), all cells are read, which is the work of comparing everything in blocks, and no more.
    """
    spark = query.sparkSession
    scratch = Scratch(spark, "cells")
    rows = base.count()
    points = choose_pivots(base, rows, cell_rows, pivots)
    salted = lambda df: df.withColumn("salt", F.monotonically_increasing_id())
    if not len(points):
        none = query.select("q_id").limit(0).crossJoin(base.select("b_id", F.lit(0.0).alias("dist"), *extra).limit(0))
        return nearest_rows(none, k), query.select("q_id", F.lit(0).cast("long").alias("cells_read"), F.lit(0).cast("long").alias("cells"))
    celled = scratch.keep(salted(_celled(base, points, "_b")), "celled")
    count, least, most = np.zeros(len(points), np.int64), np.zeros(len(points)), np.zeros(len(points))
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most")).collect():  # a row per cell
        count[r.cell], least[r.cell], most[r.cell] = r.n, r.least, r.most
    cells = Cells(points, count, least, most)
    stored = _stored(scratch.keep(_in_order(celled, rows, 2 * block), "base"))
    q = scratch.keep(salted(_celled(query, points, "_q")), "queries")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-q.count() // block))
    schema = T.StructType([T.StructField("q_id", q.schema["q_id"].dataType), T.StructField("b_id", base.schema["b_id"].dataType), T.StructField("dist", T.DoubleType()), *[T.StructField(c, base.schema[c].dataType) for c in extra], T.StructField("cells_read", T.LongType())])
    arrow = to_arrow_schema(schema)

    def search(batches):
        for some in _blocks(batches, block):
            ids = some["q_id"].combine_chunks()
            found = _Search(ids, matrix(some["_q"]), cells, k, self_join, extra)
            if (near := found.run(stored)) is not None:
                near = near.set_column(0, "q_id", ids.take(near["q_id"].combine_chunks())).append_column("cells_read", pa.nulls(near.num_rows, pa.int64()))
                yield from near.cast(arrow).to_batches()
            none = [pa.nulls(len(ids), arrow.field(c).type) for c in arrow.names[1:-1]]
            yield from pa.table([ids, *none, pa.array(found.read.sum(1))], names=arrow.names).cast(arrow).to_batches()

    ordered = q.select("q_id", "_q", "cell", "salt").repartitionByRange(parts, "cell", "salt").sortWithinPartitions("cell")
    found = scratch.keep(ordered.select("q_id", "_q").mapInArrow(search, schema), "found")
    result = scratch.keep(nearest_rows(found.filter("cells_read IS NULL").drop("cells_read"), k), "result")
    reads = scratch.keep(found.filter("cells_read IS NOT NULL").select("q_id", "cells_read", F.lit(len(points)).cast("long").alias("cells")), "reads")
    scratch.drop("celled", "base", "queries", "found")
    return result, reads


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of `rows` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, rows).combine_chunks()
            held = whole.slice(rows).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()
