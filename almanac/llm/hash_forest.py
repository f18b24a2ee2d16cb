"""Nearest neighbours by a hash-prefix forest.

Every vector has a long hash string per tree (the signs of random
projections).  A tree is the sorted array of these strings.  A query descends
in every tree to its longest matching prefix and then ascends in all trees at
once, one bit at a time, until the prefixes in all of them together hold
enough candidates; all of these are measured exactly.

The rows are dealt to shards of about ``SHARD`` rows by a hash of the id, each
with a forest of its own, and the queries visit every shard in blocks; the
work is one group for each (shard, block), of bounded size on both sides.  The
nearest of all shards are merged by a window that keeps ``k`` rows a query.

Equal vectors are one entry of a shard's arrays, which holds their ``k + 1``
smallest ids: no others can be among the ``k`` nearest.  So a vector that a
third of the rows share is one candidate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARD = 8192
BLOCK = 2048
TREES = 160
BITS = 16
#: The ascent goes on until the prefixes hold this many entries, counted with
#: repetition over the trees; a shard of fewer is searched in full sooner.
#: It is a least number: what a prefix holds is taken whole.
ENOUGH = 5000


def _hashes(points: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, points) hash strings as numbers, first bit highest."""
    signs = (points @ planes).reshape(len(points), trees, bits) > 0
    return (signs @ (1 << np.arange(bits - 1, -1, -1))).T.astype(np.int64)


def forest_candidates(entries: np.ndarray, queries: np.ndarray, trees: int, bits: int, enough: int) -> list[np.ndarray]:
    """Entries that each query finds in the forest of ``entries``."""
    rng = np.random.default_rng(7_919)
    planes = rng.standard_normal((entries.shape[1], trees * bits))
    middle = entries.mean(axis=0)
    keys, asked = _hashes(entries - middle, planes, trees, bits), _hashes(queries - middle, planes, trees, bits)
    order = np.argsort(keys, axis=1, kind="stable")
    arrays = np.take_along_axis(keys, order, axis=1)
    # The bounds of every query's prefix at every length, in every tree.
    low = np.empty((bits + 1, trees, len(queries)), np.int32)
    high = np.empty_like(low)
    for length in range(bits + 1):
        first = (asked >> (bits - length)) << (bits - length)
        for t in range(trees):
            low[length, t] = np.searchsorted(arrays[t], first[t], "left")
            high[length, t] = np.searchsorted(arrays[t], first[t] + (1 << (bits - length)), "left")
    held = (high - low).sum(axis=1)  # by length, over the trees
    target = min(enough, trees * len(entries))
    at = bits - np.argmax(held[::-1] >= target, axis=0)  # the longest that holds enough; length 0 holds all
    found = []
    for q, length in enumerate(at):
        mark = np.zeros(len(entries), bool)
        for t in range(trees):
            mark[order[t, low[length, t, q]:high[length, t, q]]] = True
        found.append(np.flatnonzero(mark))
    return found


def _search(k: int, trees: int, bits: int, enough: int):
    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(asked):
            widths = rows.vector.map(len)
            for width in sorted(set(widths)):
                _one_width(rows[widths == width], asked[asked.vector.map(len) == width], k, trees, bits, enough, out)
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def _one_width(rows: pd.DataFrame, asked: pd.DataFrame, k: int, trees: int, bits: int, enough: int, out: dict) -> None:
    if not len(asked):
        return
    rows = rows.sort_values("id", kind="stable")
    points, ids = np.stack(rows.vector.to_numpy()).astype(np.float64), rows.id.to_numpy(np.int64)
    entries, entry_of = np.unique(points + 0.0, axis=0, return_inverse=True)
    entry_of = entry_of.ravel()
    by_entry = np.argsort(entry_of, kind="stable")  # smallest ids first
    starts = np.searchsorted(entry_of[by_entry], np.arange(len(entries) + 1))
    queries = np.stack(asked.vector.to_numpy()).astype(np.float64)
    for q, found in enumerate(forest_candidates(entries, queries, trees, bits, enough)):
        own = asked.id.iloc[q]
        far = np.sqrt(((entries[found] - queries[q]) ** 2).sum(axis=1))
        taken, seen, last = [], set(), np.inf
        for i in np.argsort(far, kind="stable"):
            if len(seen) >= k and far[i] > last:
                break
            members = ids[by_entry[starts[found[i]]:starts[found[i] + 1]][:k + 1]]
            members = members[members != own][:k]
            if len(members):
                taken.append((members, far[i]))
                seen.update(members)
                last = far[i]
        for members, distance in taken:
            out["query_id"].append(np.full(len(members), own, np.int64))
            out["vec_id"].append(members)
            out["score"].append(np.full(len(members), distance))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100,
            trees: int = TREES, bits: int = BITS, enough: int = ENOUGH) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by
    ``every``, its ``k`` nearest other rows found, by Euclidean distance in
    double precision, ties to the smaller id; fewer if there are fewer.

    Rows with a null id, and vectors that are null, empty, zero or hold a null
    or non-finite component, take no part.  Vectors of different lengths are
    not compared.  Rows that share an id are one document: the id appears once
    in a result, by its nearest row, and never in its own.  An empty table
    gives an empty result; other columns are not looked at.
    """
    v = F.col("vector")
    usable = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                             F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
                     .filter(F.col("id").isNotNull() & v.isNotNull())
                     .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
                     .filter(F.exists(v, lambda x: x != 0)).distinct())
    usable = staged(usable, "vectors")
    n_rows, n_queries = usable.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n_rows // SHARD)), max(1, -(-n_queries // BLOCK))
    number = lambda n, salt: F.pmod(F.xxhash64(F.col("id"), v, F.lit(salt)), F.lit(n))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = usable.filter(F.col("id") % every == 0)
    left = usable.select("id", "vector", number(shards, 1).alias("shard")).withColumn("block", every_one(blocks))
    right = queries.select("id", "vector", number(blocks, 2).alias("block")).withColumn("shard", every_one(shards))
    found = (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
                 .applyInPandas(_search(k, trees, bits, enough), "query_id long, vec_id long, score double"))
    found = staged(found, "found").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
