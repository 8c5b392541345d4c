"""k-means: assignment, Lloyd's iterations with fixed starts, restarts, sweeps, exemplars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minewright.functions.expressions import doubles
from minewright.functions.storage import materialize
from minewright.operators.matrices import matrix

CENTROIDS = "cluster int, center array<double>"


def initial_centroids(points: DataFrame, k: int, key: str = "id", vector: str = "features") -> DataFrame:
    """cluster, center: the first k distinct vectors in order of the key."""
    distinct = points.dropna(subset=[vector]).groupBy(doubles(F.col(vector)).alias("center")).agg(F.min(key).alias("_first"))
    first = distinct.orderBy("_first").limit(k)
    return first.select((F.row_number().over(W.orderBy("_first")) - 1).cast("int").alias("cluster"), "center")


def _model(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cluster numbers, their centers as a matrix): k rows, the size of a model."""
    rows = sorted((r.cluster, list(r.center)) for r in centroids.collect())
    return np.array([c for c, _ in rows], np.int32), np.array([x for _, x in rows], np.float64)


def nearest(x: np.ndarray, centers: np.ndarray, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest center, squared distance) of each row; of centers equally near to nine decimals, the first.

    A matrix product finds for each row the centers that its rounding error or a tie may make the nearest, mostly one; only their
    distances are taken from the differences. Rows go in blocks of about `at_once` products.
    """
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    squares = (centers * centers).sum(1)
    step = max(1, at_once // len(centers))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        own = (part * part).sum(1)
        d = squares[None, :] - 2 * (part @ centers.T)
        border = d.min(1) + 4e-9 + 1e-12 * (own + squares.max())
        row, near = np.nonzero(d <= border[:, None])
        exact = ((part[row] - centers[near]) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(part)))
        tied = np.round(exact, 9)
        least = np.minimum.reduceat(tied, first) if len(part) else tied
        hit = np.flatnonzero(tied == least[row])
        hit = hit[np.searchsorted(row[hit], np.arange(len(part)))]
        at[i : i + step], best[i : i + step] = near[hit], exact[hit]
    return at, best


def _blocks(rows: DataFrame, at_once: int = 2048) -> DataFrame:
    """rows (_x, _w) as blocks of up to `at_once` of them, dealt evenly over the cores: the bytes of their vectors, of their weights, and the vectors' length.

    What goes over the rows again and again hands such bytes on as they are, instead of every number of every vector. Numbers
    that four bytes hold exactly take four.
    """

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                x, w = matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                bytes_ = [(short if np.array_equal(short, x, equal_nan=True) else x).tobytes(), w.tobytes()]
                yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.binary()) for v in bytes_], pa.array([x.shape[1]], pa.int32())], ["_x", "_w", "_d"])

    return rows.mapInArrow(work, "_x binary, _w binary, _d int").repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors as a matrix, their weights) of batches of rows (_x, _w), or of blocks of them (see _blocks())."""
    for batch in batches:
        if not pa.types.is_binary(batch.schema.types[0]):
            if batch.num_rows:
                yield matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            continue
        for x, w, d in zip(*batch.columns, strict=True):
            w, x, d = np.frombuffer(w.as_buffer(), np.float64), x.as_buffer(), d.as_py()
            yield np.frombuffer(x, np.float32 if x.size == 4 * d * len(w) else np.float64).reshape(len(w), d).astype(np.float64, copy=False), w


def member_sums(batches: Iterable[pa.RecordBatch], models: dict[int, np.ndarray], at_once: int = 1 << 20) -> dict[int, np.ndarray]:
    """For each model's centers the weighted sums of the rows (_x, _w) that are nearest to them, with the weight as last column.

    The centers of all models meet a block of rows in one matrix product, and another one adds the rows up; rows go in blocks of
    about `at_once` products. Only rows with several centers within rounding error or a tie are looked at again, by nearest().
    """
    every = np.concatenate(list(models.values()))
    ends = np.cumsum([0, *map(len, models.values())])
    squares, total = (every * every).sum(1), np.zeros((every.shape[0], every.shape[1] + 1))
    step = max(1, at_once // len(every))
    for x, w in _parts(batches):
        wide = np.column_stack([x, np.ones(len(x))]) * w[:, None]
        for i in range(0, len(x), step):
            part = x[i : i + step]
            d = squares[:, None] - 2 * (every @ part.T)
            border = 4e-9 + 1e-12 * ((part * part).sum(1) + squares.max())
            member = np.empty(d.shape)
            for c, a, b in zip(models.values(), ends[:-1], ends[1:], strict=True):
                near = d[a:b] <= d[a:b].min(0) + border
                several = np.flatnonzero(near.sum(0) > 1)
                if len(several):
                    near[:, several] = np.arange(len(c))[:, None] == nearest(part[several], c)[0][None, :]
                member[a:b] = near
            total += member @ wide[i : i + step]
    return dict(zip(models, np.split(total, ends[1:-1]), strict=True))


def assign(points: DataFrame, centroids: DataFrame, vector: str = "features") -> DataFrame:
    """points plus cluster, the nearest centroid (ties to nine decimals: the smaller number), and distance.

    A map over Arrow batches that carries the k centroids; nothing is shuffled. Null vectors have neither.
    Columns of those names are replaced.
    """
    numbers, centers = _model(centroids)
    rows = points.select(*[c for c in points.columns if c not in ("cluster", "distance")], doubles(F.col(vector)).alias("_x"))
    names = [*rows.columns[:-1], "cluster", "distance"]
    at = len(rows.columns) - 1

    def work(batches):
        for batch in batches:
            x, none = batch.column(at), batch.column(at).is_null()
            known = x.drop_null()
            cluster = np.zeros(batch.num_rows, np.int32)
            distance = np.zeros(batch.num_rows)
            if len(known) and len(centers):
                own, d = nearest(matrix(known), centers)
                cluster[~none.to_numpy(False)], distance[~none.to_numpy(False)] = numbers[own], np.sqrt(d)
            none = none if len(centers) else pa.array(np.ones(batch.num_rows, bool))
            mask = none.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(cluster, mask=mask), pa.array(distance, mask=mask)], names)

    kept = T.StructType(rows.schema.fields[:at])
    return rows.mapInArrow(work, kept.add("cluster", T.IntegerType()).add("distance", T.DoubleType()))


def centroid_means(assigned: DataFrame, vector: str = "features", weight: str | None = None) -> DataFrame:
    """cluster, center: (weighted) means of the members' vectors, summed before they are shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    members = assigned.filter(F.col("cluster").isNotNull() & F.col(vector).isNotNull())
    mean = Summarizer.mean(array_to_vector(doubles(F.col(vector))), F.col(weight).cast("double") if weight else F.lit(1.0))
    return members.groupBy("cluster").agg(vector_to_array(mean).alias("center"))


def _moved(rows: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """One Lloyd iteration for several models in one pass over blocks of rows (see _blocks()): their new centers.

    A cluster without members keeps its center.
    """

    total = {m: t for m, (t, _) in _sums(rows, {m: c for m, (_, c) in models.items()}, False).items()}
    return {m: np.where(t[:, -1:] > 0, t[:, :-1] / np.where(t[:, -1:] > 0, t[:, -1:], 1), models[m][1]) for m, t in total.items()}


def _fit(points: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]], iterations: int, tol: float, vector: str, weight: str | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    rows = points.dropna(subset=[vector]).select(doubles(F.col(vector)).alias("_x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    rows = _blocks(rows).persist()
    moving = {m: x for m, x in models.items() if len(x[0])}
    fitted = dict(models)
    for _ in range(iterations if moving else 0):
        for m, centers in _moved(rows, moving).items():
            shift = ((centers - fitted[m][1]) ** 2).sum(1).max()
            fitted[m] = (fitted[m][0], centers)
            if shift <= tol * tol:
                del moving[m]
            else:
                moving[m] = fitted[m]
        if not moving:
            break
    rows.unpersist()
    return fitted


def _rows(model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, list[float]]]:
    return [(int(k), c.tolist()) for k, c in zip(*model, strict=True)]


def lloyd(points: DataFrame, centroids: DataFrame, iterations: int = 10, tol: float = 0.0, vector: str = "features", weight: str | None = None) -> DataFrame:
    """Centroids after so many Lloyd iterations from the given ones, fewer if none moves by more than tol.

    Each iteration maps the points and sums by cluster; only centroids come to the driver. A cluster
    without members keeps its centroid.
    """
    return points.sparkSession.createDataFrame(_rows(_fit(points, {0: _model(centroids)}, iterations, tol, vector, weight)[0]), CENTROIDS)


def weighted_rows(points: DataFrame, vector: str = "features", weight: str | None = None) -> DataFrame:
    """The vectors with their weights in blocks (see _blocks()), written to the shared folder; summed up by vector if they repeat so much that it halves them."""
    rows = points.dropna(subset=[vector]).select(doubles(F.col(vector)).alias("_x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("_x"))).first()
    return materialize(_blocks(rows.groupBy("_x").agg(F.sum("_w").alias("_w")) if 2 * distinct < n else rows), "weighted")


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each row that depends on its values and the salt alone, so it is the same wherever the row is."""
    rng = np.random.default_rng(salt)
    odd = rng.integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((x + 0.0).view(np.uint64) * odd[None, :]).sum(1, dtype=np.uint64) + rng.integers(0, 1 << 63, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17


def _drawn(rows: DataFrame, held: dict[int, np.ndarray | None], wanted: dict[int, int], salt: int) -> dict[int, np.ndarray]:
    """For each model `wanted` rows drawn without replacement, with chances by weight times squared distance to those held (none: by weight).

    A row's key is log(u) / chance and the greatest keys win, so each task hands on as many rows per model as are wanted at most.
    """

    def work(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x, w in _parts(batches):
            for m, c in held.items():
                chance = w * (1.0 if c is None else nearest(x, c)[1])
                some = np.flatnonzero(chance > 0)
                key = np.log(_uniform(x[some], salt * 1_000_003 + m)) / chance[some]
                old = best.get(m, (np.zeros((0, x.shape[1])), np.zeros(0)))
                every, keys = np.concatenate([old[0], x[some]]), np.concatenate([old[1], key])
                top = np.argsort(-keys, kind="stable")[: wanted[m]]
                best[m] = every[top], keys[top]
        for m, (x, keys) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), m, np.int32)), pa.array(keys), pa.array(list(x), pa.list_(pa.float64()))], ["model", "score", "x"])

    found = rows.mapInArrow(work, "model int, score double, x array<double>")
    rank = F.row_number().over(W.partitionBy("model").orderBy(F.desc("score"), "x"))
    out: dict[int, list] = {m: [] for m in held}
    for r in found.withColumn("rank", rank).filter(F.col("rank") <= max(wanted.values(), default=0)).collect():  # the size of the models
        if r["rank"] <= wanted[r.model]:
            out[r.model].append((-r.score, r.x))
    return {m: np.array([x for _, x in sorted(v)], np.float64) for m, v in out.items()}


def _starts(rows: DataFrame, ks: dict[int, int], seed: int, rounds: int = 3) -> dict[int, np.ndarray]:
    """Starting centers of every model (model: k) by k-means||, all models in the same passes: one row, then `rounds` times 2 k more, drawn
    with chances by squared distance; these few are weighted by the rows nearest to them and thinned out to k by k-means++."""
    held = _drawn(rows, {m: None for m in ks}, {m: 1 for m in ks}, seed)
    held = {m: c for m, c in held.items() if len(c)}
    for i in range(1, rounds + 1):
        more = _drawn(rows, held, {m: 2 * ks[m] for m in held}, seed + i)
        held = {m: np.unique(np.concatenate([c, *([more[m]] if len(more[m]) else [])]), axis=0) for m, c in held.items()}
    out = {}
    for m, (sums, _) in _sums(rows, held, False).items():
        c, w, rng = held[m], sums[:, -1], np.random.default_rng((seed, m))
        chosen = [int(rng.choice(len(c), p=w / w.sum()))]
        while len(chosen) < min(ks[m], len(c)):
            d = w * nearest(c, c[chosen])[1]
            if not d.sum():
                break
            chosen.append(int(rng.choice(len(c), p=d / d.sum())))
        out[m] = c[chosen]
    return out


def _sums(rows: DataFrame, models: dict[int, np.ndarray], costs: bool = True) -> dict[int, tuple[np.ndarray, float]]:
    """For each model's centers the weighted sums of their rows' vectors, with the weight as last column, and the cost, if asked for; one pass for all.

    There are as many tasks as cores, whatever the size of the input. A row per task and model, of the size of the model, comes to the
    driver; nothing is shuffled.
    """
    if not models:
        return {}

    def work(batches):
        cost = dict.fromkeys(models, 0.0)

        def costed():
            for batch in batches:
                for x, w in _parts([batch]) if costs else ():
                    for m, c in models.items():
                        cost[m] += float(w @ nearest(x, c)[1])
                yield batch

        sums = member_sums(costed(), models)
        yield pa.RecordBatch.from_arrays([pa.array(list(models), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()), pa.array(list(cost.values()))], ["model", "sums", "cost"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    found = rows.coalesce(tasks).mapInArrow(work, "model int, sums binary, cost double").toArrow()  # the size of the models
    out = {m: (np.zeros((len(c), c.shape[1] + 1)), 0.0) for m, c in models.items()}
    for m, s, own in zip(*(found[c].to_pylist() for c in ("model", "sums", "cost")), strict=True):
        total, cost = out[m]
        out[m] = total + np.frombuffer(s, np.float64).reshape(total.shape), cost + own
    return out


def kmeans_best(points: DataFrame, ks: Sequence[int], restarts: int = 10, seed: int = 1, vector: str = "features", weight: str | None = None, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """k, cluster, center, inertia: for every k the best of `restarts` full fits, the one of least inertia (the summed squared distances).

    All fits of all k start (see _starts()) and move together: an iteration is one pass over the weighted distinct rows, in
    which tasks add up what every fit needs; fits that move by no more than tol drop out. Clusters are numbered in order of
    their centers. Fewer distinct vectors than k give so many clusters; a cluster that loses its members keeps its center.
    """
    rows = weighted_rows(points, vector, weight).persist()
    names = [(k, r) for k in ks for r in range(restarts)]
    fitted = _starts(rows, {m: k for m, (k, _) in enumerate(names)}, seed)
    moving = dict(fitted)
    for _ in range(max_iter):
        if not moving:
            break
        for m, (sums, _) in _sums(rows, moving, False).items():
            w = sums[:, -1:]
            now = np.where(w > 0, sums[:, :-1] / np.where(w > 0, w, 1), moving[m])
            shift = ((now - moving[m]) ** 2).sum(1).max()
            fitted[m] = moving[m] = now
            if shift <= tol * tol:
                del moving[m]
    cost = {m: c for m, (_, c) in _sums(rows, fitted).items()} if fitted else {}
    rows.unpersist()
    out = []
    for k in ks:
        own = [m for m in fitted if names[m][0] == k]
        if own:
            best = min(own, key=lambda m: (round(cost[m], 9), m))
            out += [(k, i, c, cost[best]) for i, c in enumerate(sorted(fitted[best].tolist()))]
    return points.sparkSession.createDataFrame(out, "k int, " + CENTROIDS + ", inertia double")


def kmeans(points: DataFrame, k: int, restarts: int = 10, seed: int = 1, vector: str = "features", weight: str | None = None, max_iter: int = 300) -> DataFrame:
    """cluster, center of the best of `restarts` fits; see kmeans_best()."""
    return kmeans_best(points, [k], restarts, seed, vector, weight, max_iter).select("cluster", "center")


def kmeans_sweep(points: DataFrame, ks: Sequence[int], key: str = "id", vector: str = "features", weight: str | None = None, iterations: int = 10, tol: float = 0.0) -> DataFrame:
    """k, cluster, center for every k, by Lloyd from the first k distinct points.

    All k go through each iteration together: one pass over the cached input per iteration.
    """
    numbers, centers = _model(initial_centroids(points, max(ks, default=0), key, vector))
    fitted = _fit(points, {k: (numbers[:k], centers[:k]) for k in ks}, iterations, tol, vector, weight)
    return points.sparkSession.createDataFrame([(k, *row) for k in ks for row in _rows(fitted[k])], "k int, " + CENTROIDS)


def cost(points: DataFrame, centroids: DataFrame, vector: str = "features") -> DataFrame:
    """cluster, n, cost: members and summed squared distances."""
    found = assign(points, centroids, vector).filter("cluster IS NOT NULL")
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("cost"))


def exemplars(points: DataFrame, centroids: DataFrame, n: int = 20, mode: str = "nearest", key: str = "id", vector: str = "features") -> DataFrame:
    """cluster, rank, key, distance: the n rows of each cluster nearest to its centroid, or first by key.

    Smaller clusters give the rows they have.
    """
    order = W.partitionBy("cluster").orderBy(*([F.round("distance", 9)] if mode == "nearest" else []), key)
    found = assign(points, centroids, vector).filter("cluster IS NOT NULL").withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= n).select("cluster", "rank", key, "distance")
