"""Centroid clustering against a plain version in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from almanac.llm.centroids import Rotation, bounds, clusters, nearest

SCHEMA = "vec_id long, embedding array<float>, point string, cluster int, z int"


def plain(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centers = [list(q) for _, q in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(q, c), j) for j, c in enumerate(centers)) for _, q in kept]
    for _ in range(rounds):
        own = [[q for (_, q), (_, j) in zip(kept, assigned, strict=True) if j == c] for assigned in [assign()]
               for c in range(len(centers))]
        centers = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centers, strict=True)]
    last = assign()
    fits = lambda x: x if x < 2**63 else None
    total = lambda js: fits(sum(d for d, j in last if j in js))
    return sorted(((i, j, fits(d), total({j}), total(set(range(k))), tuple(centers[j])) for (i, _), (d, j) in zip(kept, last, strict=True)), key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", 5, 7) for i, v in rows], SCHEMA)
    out = clusters(table, **options)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out.collect()), key=repr)


def random_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(i % 11, 0.7, 64).astype(np.float32)]) for i in range(n)]


def test_ties_repeats_nulls_and_clashing_columns(spark):
    rows = random_rows(60)
    rows += [(5, rows[5][1])] * 3 + [(None, rows[7][1]), (70, None), (71, []), (72, [1.0] * 63), (73, [None] + [1.0] * 63),
                                     (74, [math.nan] * 64), (75, [math.inf] + [0.0] * 63), (76, [0.0] * 64), (77, [-0.0] * 64)]
    rows += [(100 + i, [float(i % 2)] * 64) for i in range(40)]  # equal vectors: seeds may coincide
    assert found(spark, rows) == plain(rows)


def test_fewer_vectors_than_clusters_and_empty(spark):
    rows = random_rows(3)
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []


def test_numbers_beyond_a_long_distance(spark):
    rows = random_rows(20) + [(50, [3.0e6] * 64), (51, [-2.0e6] * 64), (52, [1.0e9] + [0.0] * 63)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("spread", [0.5, 40.0])
def test_bounds_never_exceed_distances(spread):
    rng = np.random.default_rng(4)
    points = rng.normal(0, spread * 1024, (400, 64)).astype(np.int64) + rng.integers(0, 3, (400, 1)) * 50_000
    centers = points[:8].astype(object)
    turn = Rotation(400, points.sum(axis=0).astype(float), points.T.astype(float) @ points)
    (z, r), (z_c, r_c) = turn(points, 16), turn(centers, 16)
    exact = ((points[:, None] - points[None, :8]) ** 2).sum(axis=2)
    assert (bounds(z, r, z_c, r_c) <= exact).all()
    cluster, best, measured = nearest(points, z, r, centers, z_c, r_c)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < exact.size * 0.9  # the bound spares work
