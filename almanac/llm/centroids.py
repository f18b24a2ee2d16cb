"""Centroid clustering in whole numbers, with PCA-rotated filtering.

Vectors become whole numbers once.  All distances that decide anything are
exact; floating point only says which of them need not be computed:

* the principal axes of all vectors rotate them, and a vector is stored with
  its ``LEADING`` first rotated coordinates and the norm of the rest;
* ``|z - z_c|^2 + (r - r_c)^2``, of leading coordinates z and residual norms r,
  never exceeds the squared distance to a centroid c, as the two residuals are
  at least as far apart as their lengths;
* the centroid of the least bound is measured in whole numbers, and so are
  those whose bound, less an allowance for rounding, does not exceed it.

A task sends one row of sums for each cluster, so a round moves (tasks x
clusters) rows, and only the centroids, ``k`` times ``width`` numbers, reach the
driver and the next round's tasks.  A cluster, or a vector that a third of the
rows share, is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, staged

#: Leading rotated coordinates that are stored.
LEADING = 16
#: Components up to this size have squared distances (of 64) that fit a long;
#: a batch with larger ones is computed in Python's whole numbers.
EXACT = 1 << 27
#: Components beyond this are taken as this.
LARGEST = 1 << 62
LONG = (1 << 63) - 1
#: Of the squared norms: far more than rounding takes from a bound.
ALLOWANCE = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Rotation:
    """Principal axes of a mean and a scatter matrix."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray):
        self.middle = sums / max(n, 1)
        scatter = products / max(n, 1) - np.outer(self.middle, self.middle)
        _, axes = np.linalg.eigh(np.nan_to_num((scatter + scatter.T) / 2))
        self.axes = axes[:, ::-1]  # the widest first

    def __call__(self, points: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates, and the norm of the others (from
        themselves, as a difference of squares would lose digits)."""
        turned = (points.astype(np.float64) - self.middle) @ self.axes
        return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(axis=1))


def bounds(z: np.ndarray, r: np.ndarray, z_c: np.ndarray, r_c: np.ndarray) -> np.ndarray:
    """Lower bounds (points, centroids) of squared distances."""
    least = np.empty((len(z), len(z_c)))
    for c in range(len(z_c)):
        least[:, c] = ((z - z_c[c]) ** 2).sum(axis=1) + (r - r_c[c]) ** 2
    size = (z ** 2).sum(axis=1) + r ** 2
    size_c = (z_c ** 2).sum(axis=1) + r_c ** 2
    return least - ALLOWANCE * (size[:, None] + size_c[None]) - 1


def nearest(points: np.ndarray, z: np.ndarray, r: np.ndarray, centroids: np.ndarray, z_c: np.ndarray,
            r_c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each point, ties to the smaller cluster,
    and how many distances were measured for it."""
    low = bounds(z, r, z_c, r_c)
    kind = np.int64 if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else object
    points, centroids = points.astype(kind), centroids.astype(kind)
    cluster = low.argmin(axis=1)
    best = ((points - centroids[cluster]) ** 2).sum(axis=1)
    measured = len(points)
    first = cluster.copy()
    for c in range(len(centroids)):
        left = np.flatnonzero((first != c) & (low[:, c] <= best.astype(np.float64)))
        if len(left):
            far = ((points[left] - centroids[c]) ** 2).sum(axis=1)
            better = (far < best[left]) | ((far == best[left]) & (c < cluster[left]))
            best[left[better]], cluster[left[better]] = far[better], c
            measured += len(left)
    return cluster, best, measured


def _scatter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((width + 1, width))
        for batch in batches:
            points = _matrix(batch.column(0), width).astype(np.float64)
            n += len(points)
            total[:width] += points.T @ points
            total[width] += points.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width + 1), pa.int32()), pa.array([n] * (width + 1), pa.int64()), *map(pa.array, total.T)],
                names=["line", "n", *(f"s{j}" for j in range(width))])
    return run


def rotation(points: DataFrame, width: int) -> Rotation:
    """The principal axes of the column ``point``, over all rows: every task
    sends its sums, ``width + 1`` lines of ``width`` numbers."""
    names = [f"s{j}" for j in range(width)]
    kind = "line int, n long, " + ", ".join(f"{s} double" for s in names)
    lines = (points.select("point").mapInArrow(_scatter(width), kind).groupBy("line")
                   .agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).orderBy("line").collect())
    if not lines:
        return Rotation(0, np.zeros(width), np.zeros((width, width)))
    total = np.array([[row[s] for s in names] for row in lines])
    return Rotation(lines[0].n, total[width], total[:width])


def _stored(width: int, leading: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = model()
        for batch in batches:
            z, r = turn(_matrix(batch.column(1), width), leading)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * leading), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(r)],
                                             names=["id", "point", "z", "r"])
    return run


def _assigned(width: int, leading: int, model, sums: bool):
    """Rows with cluster and distance, or, with ``sums``, one row a cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centroids = model()
        z_c, r_c = turn(centroids, leading)
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), object)
        for batch in batches:
            points = _matrix(batch.column("point"), width)
            cluster, far, _ = nearest(points, _matrix(batch.column("z"), leading), batch.column("r").to_numpy(),
                                      centroids, z_c, r_c)
            if not sums:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(cluster, pa.int32()), pa.array([d if d <= LONG else None for d in far.tolist()], pa.int64())],
                    names=["id", "cluster", "distance"])
                continue
            wide = np.abs(points).max(initial=0) > EXACT
            for c in np.unique(cluster):
                own = points[cluster == c]
                count[c] += len(own)
                total[c] += own.astype(object).sum(axis=0) if wide else own.sum(axis=0)
        if sums:
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(count[held]),
                 *(pa.array([*map(int, total[held, j])], pa.decimal128(38, 0)) for j in range(width))],
                names=["cluster", "n", *(f"s{j}" for j in range(width))])
    return run


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
             width: int = 64, scale: int = 1024, salt: int = 3, leading: int = LEADING) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid), one row for
    each vector with exactly ``width`` components, none null or non-finite;
    others are left out, null vectors too.

    A component x becomes ``floor(scale * x)``.  Centroids start as the ``k``
    vectors with the smallest lowercase-hex SHA-256 of ``salt:id``, in that
    order (rows that share an id by their components, a null id as an empty
    text), or all vectors if there are fewer.  Each round assigns every vector
    to its nearest centroid, ties to the smaller number, and moves every
    centroid that has vectors to their componentwise ``floor(sum / count)``.
    Rounds that could change nothing are not run.  Then all are assigned once
    more; ``centroid`` is an array of longs.

    Repeated rows each count.  A squared distance, or a sum of them, that does
    not fit a long is null; components are exact to 2^62 and taken as that
    beyond.  An empty table, or none with a usable vector, gives an empty
    result; other columns are not looked at.
    """
    spark, v = vectors.sparkSession, F.col("vector")
    whole = lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(LARGEST - 1024))), F.lit(float(1024 - LARGEST))))
    usable = (vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
                     .filter(F.size(v) == width)
                     .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
                     .select("id", F.transform(v, whole).cast("array<bigint>").alias("point")))
    turn = rotation(usable, width)
    id_type = dict(usable.dtypes)["id"]
    stored = staged(usable.mapInArrow(_stored(width, leading, shipped(spark, turn)),
                                      f"id {id_type}, point array<long>, z array<double>, r double"), "rotated")
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = stored.select(mark.alias("mark"), "point").orderBy("mark", "point").limit(k).collect()
    centroids = np.array([row.point for row in seeds], object).reshape(-1, width)
    names = [f"s{j}" for j in range(width)]
    kind = "cluster int, n long, " + ", ".join(f"{s} decimal(38,0)" for s in names)
    for _ in range(rounds if len(centroids) else 0):
        sums = (stored.select("point", "z", "r")
                      .mapInArrow(_assigned(width, leading, shipped(spark, (turn, centroids)), True), kind)
                      .groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect())
        moved = centroids.copy()
        for row in sums:
            moved[row.cluster] = [int(row[s]) // row.n for s in names]
        if (moved == centroids).all():
            break
        centroids = moved
    rows = staged(stored.mapInArrow(_assigned(width, leading, shipped(spark, (turn, centroids)), False),
                                    f"id {id_type}, cluster int, distance long"), "assigned")
    fits = lambda c: F.when(c <= LONG, c.cast("long"))
    sent = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole_sum = F.when(F.count("*") == F.count("distance"), sent)
    per = rows.groupBy("cluster").agg(whole_sum.alias("own"))
    every = rows.agg(whole_sum.alias("all"))
    final = spark.createDataFrame([(i, [*map(int, c)]) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    facts = per.join(final, "cluster").join(F.broadcast(every)).select(
        "cluster", fits(F.col("own")).alias("cluster_inertia"), fits(F.col("all")).alias("inertia"), "centroid")
    # One row a cluster, so at most k.
    return rows.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
