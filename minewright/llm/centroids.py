"""Centroid clustering: exact k-means on whole numbers that skips vectors by geometric bounds."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm.common import Scratch

#: Components of larger size could let a squared distance leave 64 bits.
LARGEST = 1 << 26
#: Bounds are kept apart by more than what rounding can make of them.
SLACK = 1e-9


def vectors(rows: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """id and v, floor(scale * x) of each component as 32-bit numbers, of the rows whose vector is complete."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), x.alias("x")).filter((F.size("x") == width) & ~bad)

    def work(batches):
        for batch in batches:
            n, column = batch.num_rows, batch.column(1)
            v = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(n, width) * scale)
            if n and np.abs(v).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} / {scale}")
            data = pa.py_buffer(np.ascontiguousarray(v, np.int32))
            ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (4 * width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), n, [None, ends, data])], ["id", "v"])

    return kept.mapInArrow(work, "id long, v binary")


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors() as a matrix of whole numbers."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.int32, len(column) * width, int(offsets[0])).reshape(-1, width).astype(np.int64) if len(column) else np.zeros((0, width), np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; its distance; distance of the next one), from exact squares."""
    d = np.stack([squared(x, c) for c in centroids], 1)
    own = d.argmin(1)
    at = np.arange(len(x))
    best = np.sqrt(d[at, own].astype(np.float64))
    d[at, own] = np.iinfo(np.int64).max
    return own, best, np.sqrt(d.min(1).astype(np.float64)) if len(centroids) > 1 else np.full(len(x), np.inf)


def tightened_drift(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray, steps: int = 8) -> float:
    """The most by which moving a centroid from old to new can lessen its distance to a point of a ball.

    All points of the ball that matter lie, seen from the line of the move, in one half plane, so the question is planar. While
    the centroid moves along the line, its distance to a point shrinks at the rate cos(phi), phi being the
    angle between the move and the point. Seen from s, the ball spans the angles phi(centre) - asin(radius / distance) and up,
    so cos(max(0, that)) bounds the rate for all its points. For a fixed point the rate only falls as the centroid
    moves on, so the rate at the start of a stretch bounds the whole stretch. Never more than the drift
    itself, and negative if the centroid moves away from the ball.
    """
    move = new - old
    drift = float(np.linalg.norm(move))
    if not drift:
        return 0.0
    total = 0.0
    for i in range(steps):
        to = centre - (old + move * (i / steps))
        distance = float(np.linalg.norm(to))
        rate = 1.0
        if distance > radius:
            phi = math.acos(min(1.0, max(-1.0, float(to @ move) / (distance * drift))))
            rate = math.cos(max(0.0, phi - math.asin(min(1.0, radius / distance))))
        total += rate * drift / steps
    return min(total + SLACK * (1 + drift), drift)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what upper bounds grow by, what lower bounds shrink by) for the members of each cluster, as centroids move.

    The members of a cluster lie in the ball around its old centroid with its radius. The lower bound is on the
    distance to all other centroids, so it shrinks by the greatest of their tightened drifts.
    """
    k = len(old)
    before, after = old.astype(np.float64), new.astype(np.float64)
    up = np.linalg.norm(after - before, axis=1)
    down = np.zeros(k)
    for a in range(k):
        down[a] = max((tightened_drift(before[a], float(radius[a]), before[j], after[j]) for j in range(k) if j != a), default=0.0)
    return up, down


@lru_cache(maxsize=4)
def _state(folder: str, file: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cluster, upper, lower) of the vectors of one file, in order of their rows."""
    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(f"{base}/file={file}"))
    parts = [pq.read_table(x.path, filesystem=store, columns=["row", "cluster", "upper", "lower"], partitioning=None) for x in found if x.base_name.endswith(".parquet")]
    table = pa.concat_tables(parts).sort_by("row")
    return tuple(table[c].to_numpy() for c in ("row", "cluster", "upper", "lower"))


def _pass(placed: DataFrame, width: int, centroids: np.ndarray, before: str | None, moved: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """One assignment of all vectors: a row of state per vector, and per task a row of sums per cluster (file null).

    Where the upper bound of a vector is below its lower bound, it stays where it is without a look at its components; where
    it isn't, the distance to its own centroid may settle it, and all others are scanned exactly. Sums are of what joined and
    left a cluster, of all members in the first round.
    """
    k = len(centroids)

    def work(batches):
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        far, scanned = np.zeros(k), 0
        for batch in batches:
            x, file, row = rows_of(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            n = len(x)
            if before is None:
                own, upper, lower = scan(x, centroids)
                new, scanned = np.arange(n), scanned + n
            else:
                own, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                edges = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]])) if n else []
                for a, b in zip(edges, [*edges[1:], n], strict=True):
                    rows, *held = _state(before, int(file[a]))
                    at = np.searchsorted(rows, row[a:b])
                    own[a:b], upper[a:b], lower[a:b] = (h[at] for h in held)
                was = own.copy()
                upper, lower = upper + moved[0][own], lower - moved[1][own]
                open_ = np.flatnonzero(upper + SLACK * (1 + upper) >= lower)
                upper[open_] = np.sqrt(np.einsum("ij,ij->i", x[open_] - centroids[own[open_]], x[open_] - centroids[own[open_]]).astype(np.float64))
                open_ = open_[upper[open_] + SLACK * (1 + upper[open_]) >= lower[open_]]
                own[open_], upper[open_], lower[open_] = scan(x[open_], centroids)
                new, scanned = open_[own[open_] != was[open_]], scanned + len(open_)
                np.subtract.at(total, was[new], x[new])
                np.subtract.at(count, was[new], 1)
            np.add.at(total, own[new], x[new])
            np.add.at(count, own[new], 1)
            np.maximum.at(far, own, upper)
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(row), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        sums = pa.array(total.tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.array(far), pa.nulls(k, pa.float64()), sums, pa.array(count), pa.array([scanned] + [0] * (k - 1), pa.int64())], names)

    names = ["file", "row", "cluster", "upper", "lower", "sums", "n", "scanned"]
    return placed.select("v", "file", "row").mapInArrow(work, "file long, row long, cluster int, upper double, lower double, sums array<long>, n long, scanned long")


def _starts(kept: DataFrame, k: int, width: int) -> np.ndarray:
    """The vectors of the k ids with the smallest hashes; of rows with one id, in order of their bytes."""
    h = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.filter("id IS NOT NULL").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([np.frombuffer(bytes(r.v), np.int32) for r in first], np.int64).reshape(len(first), width)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024) -> tuple[DataFrame, list[dict]]:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 per complete vector; what each pass did).

    Vectors become floor(scale * x) and all sums, means (floored) and squared distances are exact whole numbers, so the
    result doesn't depend on how rows are dealt. Centroids start as the vectors of the k ids with the smallest
    sha256 of `3:<id>`; each of `rounds` rounds assigns every vector to its nearest centroid (ties: the smaller number) and moves
    centroids to the means; an empty one stays. Then vectors are assigned once more.

    Every vector has an upper bound on the distance to its own centroid and a lower bound on that to any other. When centroids
    move, the bounds are loosened by loosening(): by planar geometry on each cluster's ball, less than by the full drift. The
    vectors are written once; a round maps over their files, reads and writes a row of bounds per vector (kept by file,
    so nothing is joined or shuffled but these rows on their way to their files) and hands k sums per task on.
    Only k centroids pass the driver. A cluster that holds most vectors is as any other.

    Null, short and long vectors and those with null, NaN or infinite components are left out. Null ids are clustered but start
    nothing; of repeated ids each row counts, and has a row. Components beyond 2^26 / scale are an error, as squares would
    leave 64 bits. Fewer than k ids give fewer centroids, none gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "centroids")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    kept = scratch.keep(vectors(plain, "id", "x", width, scale), "vectors")
    centroids = _starts(kept, k, width)
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema), []
    k = len(centroids)
    meta = kept.withColumn("_m", kept.metadataColumn("_metadata"))
    placed = meta.select("id", "v", F.xxhash64("_m.file_path").alias("file"), F.col("_m.row_index").alias("row"))
    total, count = np.zeros((k, width), object), np.zeros(k, object)
    folder, moved, did = None, None, []
    for i in range(rounds + 1):
        path = f"{scratch.folder}/state{i}-0"
        _pass(placed, width, centroids, folder, moved).withColumn("sum_row", F.col("file").isNull()).write.partitionBy("sum_row", "file").parquet(path)
        state = spark.read.schema("row long, cluster int, upper double, lower double, sums array<long>, n long, scanned long, sum_row boolean, file long").parquet(path)
        each = [F.sum(F.element_at("sums", j + 1)).alias(f"s{j}") for j in range(width)]
        sums = state.filter("sum_row").groupBy("cluster").agg(F.sum("n").alias("n"), F.max("upper").alias("far"), F.sum("scanned").alias("scanned"), *each).collect()  # k rows
        radius = np.zeros(k)
        for r in sums:
            count[r.cluster] += r.n
            total[r.cluster] += np.array([r[f"s{j}"] for j in range(width)], object)
            radius[r.cluster] = r.far
        did.append({"round": i, "scanned": sum(r.scanned for r in sums), "vectors": int(sum(count))})
        if i:
            scratch.drop(f"state{i - 1}")
        folder = f"{path}/sum_row=false"
        if i < rounds:
            new = np.array([[int(t) // int(n) for t in row] if n else old.tolist() for row, n, old in zip(total, count, centroids, strict=True)], np.int64)
            moved, centroids = loosening(centroids, new, radius), new
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def finish(batches):
        for batch in batches:
            x, file, row = rows_of(batch.column(1), width), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            own = np.zeros(len(x), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]])) if len(x) else []
            for a, b in zip(edges, [*edges[1:], len(x)], strict=True):
                held, cluster_, *_ = _state(folder, int(file[a]))
                own[a:b] = cluster_[np.searchsorted(held, row[a:b])]
            d = x - centroids[own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))], ["id", "cluster", "distance"])

    out = scratch.keep(placed.select("id", "v", "file", "row").mapInArrow(finish, "id long, cluster int, distance long"), "assigned")
    per = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    model = spark.createDataFrame([(c, per.get(c, 0), sum(per.values()), digests[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    scratch.drop(f"state{rounds}", "vectors")
    return out.join(F.broadcast(model), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), did


def _oracle(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024) -> str:
    """The same rounds unrolled: centroids c<i> (cluster, i, v), assignments a<i> (r, cluster, d)."""
    out = [
        f"""f AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor({scale} * x) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"x AS (SELECT r, unnest(range({width})) AS i, unnest(v) AS x FROM f)",
        f"s AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster FROM f WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
        f"c0 AS (SELECT cluster, unnest(range({width})) AS i, unnest(v) AS v FROM s)",
    ]
    for n in range(rounds + 1):
        out.append(f"d{n} AS (SELECT r, cluster, CAST(sum((x - v) * (x - v)) AS BIGINT) AS d FROM x JOIN c{n} USING (i) GROUP BY r, cluster)")
        out.append(f"a{n} AS (SELECT r, cluster, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)")
        if n < rounds:
            out.append(f"m{n} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS k FROM a{n} JOIN x USING (r) GROUP BY 1, 2)")
            out.append(f"c{n + 1} AS (SELECT c.cluster, c.i, coalesce(m.t // m.k - CASE WHEN m.t % m.k < 0 THEN 1 ELSE 0 END, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster AND m.i = c.i)")
    return (
        "WITH " + ",\n".join(f"{x.partition(' AS ')[0]} AS MATERIALIZED {x.partition(' AS ')[2]}" for x in out) + f""",
g AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN f USING (r) JOIN g USING (cluster)"""
    )


ORACLE_SQL = _oracle()
