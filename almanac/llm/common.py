"""Helpers shared by the corpus operators.

Every operator cuts its lineage with a table written under the cluster's
shared folder (``spark.checkpoint.dir``); nothing is staged on a machine's own
disk, so a lost executor costs a re-read and never a wrong answer.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Entries after which a worker's word cache is emptied, so that its memory
#: does not grow with the vocabulary.
CACHE_WORDS = 1_000_000
#: Bits of the map of wanted ids for each id, and at most: 8 MB at any number
#: of ids.
ID_BITS, SIFT_BITS = 1024, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the corpus directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread
    table: a cut in the lineage which keeps column pruning and survives any
    executor."""
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _placed(df: DataFrame, wanted: DataFrame, key: str):
    """``df`` with the place of its ``key`` in a map of ``ID_BITS`` bits for each
    row of ``wanted``, ``SIFT_BITS`` at most, the map of ``wanted`` to
    broadcast, and the condition that the bit is set."""
    bits = min(SIFT_BITS, 1 << (ID_BITS * max(1, wanted.count()) - 1).bit_length())
    at = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marks = (wanted.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket"))
                   .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")))
    held = F.expr("getbit(cast(conv(hex(substring(_bits, cast(_pos div 8 as int) + 1, 1)), 16, 10) as int), cast(_pos % 8 as int)) = 1")
    placed = df.withColumn("_in", F.bitmap_bucket_number(at)).withColumn("_pos", F.bitmap_bit_position(at))
    return placed, F.broadcast(marks), (F.col("_in") == F.col("_bucket")) & held


def sifted(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among that of ``wanted``: all of
    those, and a few others where hashes meet.  A map of ``SIFT_BITS`` bits,
    fewer for few ids, is broadcast, so that a join that follows moves hardly
    more rows than it keeps; ids far beyond that number fill the map, and all
    rows pass.  ``wanted`` is read twice, first to count it."""
    placed, marks, held = _placed(df, wanted, key)
    return placed.join(marks, held).select(*df.columns)


def unsifted(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that ``sifted`` leaves out, whose ``key`` is surely not
    among that of ``wanted``, and those without a key."""
    placed, marks, held = _placed(df, wanted, key)
    return placed.join(marks, held & F.col(key).isNotNull(), "left_anti").select(*df.columns)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value``, which must be of bounded size, in any
    task; sent once to each executor, with the code of its class."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that all its bits depend on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h = h ^ (h >> np.uint64(29))
    h = h * MIX2
    return h ^ (h >> np.uint64(32))


def window_hashes(word_hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, by doubling: the hash of a
    run is made from those of two halves which may overlap in one place."""
    total = len(word_hashes) - n + 1
    if total <= 0:
        return np.empty(0, np.uint64)
    h, size = mixed(word_hashes + np.uint64(seed)), 1
    while size < n:
        step = min(size, n - size)
        m = len(h) - step
        h = mixed(h[:m] * MIX + h[step:step + m] + np.uint64(size))
        size += step
    return h[:total]


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def small_batches(batches, rows: int = 512):
    """Arrow batches cut to few rows, so that a worker holds the derived
    arrays of only so many documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
