"""A table with one row per key, upserted a batch at a time.

Rows lie in hash buckets of their key, each in a folder of its own.  A batch
rewrites the buckets that its keys fall in, into new folders, and then commits
a new version of the manifest, which names the folder of every bucket: one small
file, so a reader sees the table before the batch or after it and never half of
it.  The other buckets keep their files.  A batch that was committed before is
left out when it is replayed, and files of a batch that died are never named by
a manifest.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import child_paths, remove_path

BUCKET = "_bucket"
#: Rows of a version: the folder of each bucket, and each writer's last batch.
ENTRY = "bucket int, folder string, writer string, batch long"


class KeyedTable:
    """A keyed table under ``path``.

    ``order`` are the columns that decide between rows of a key: the greatest
    wins, of equal ones the newer; without them the newer always wins.  Null
    keys are a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str] | None = None,
                 buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = (
            spark, path.rstrip("/"), schema, keys, order or [], buckets)

    # ---------------------------------------------------------------- reading

    def _newest(self) -> tuple[int, dict[int, str], dict[str, int]]:
        """(version, folder of each bucket, last batch of each writer)."""
        try:
            found = self.spark.read.schema(f"{ENTRY}, version long").parquet(f"{self.path}/manifest")
        except AnalysisException as e:  # no version yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}, {}
        version = found.agg(F.max("version")).first()[0]
        rows = found.where(F.col("version") == version).collect() if version is not None else []
        return (version or 0, {row.bucket: row.folder for row in rows if row.bucket is not None},
                {row.writer: row.batch for row in rows if row.writer is not None})

    def version(self) -> int:
        return self._newest()[0]

    def committed(self, writer: str) -> int:
        """The last batch of ``writer``, or -1."""
        return self._newest()[2].get(writer, -1)

    def folders(self) -> dict[int, str]:
        """The folder that each bucket's rows are in now."""
        return {b: f"{folder}/{BUCKET}={b}" for b, folder in self._newest()[1].items()}

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The whole table as of now."""
        return self._rows(list(self.folders().values()))

    def lookup(self, *values) -> DataFrame:
        """The row of one key; reads its bucket only."""
        key = [F.lit(v).cast(self.schema[k].dataType).alias(k) for k, v in zip(self.keys, values, strict=True)]
        bucket = self.spark.range(1).select(*key).select(self._bucket()).first()[0]
        rows = self._rows([path for b, path in self.folders().items() if b == bucket])
        for k, v in zip(self.keys, values, strict=True):
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
        return rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    # ---------------------------------------------------------------- writing

    def _latest(self, rows: DataFrame, keys: list[str], age: str) -> DataFrame:
        """One row a key, by order and age: a partial aggregate."""
        others = [f.name for f in self.schema.fields if f.name not in self.keys]
        packed = F.max_by(F.struct(*others) if others else F.lit(0), F.struct(*self.order, age))
        return rows.groupBy(*keys).agg(packed.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])

    def upsert(self, changes: DataFrame, batch: int | None = None, writer: str = "") -> list[int]:
        """Put in ``changes``; gives the buckets that were rewritten.  With a
        ``batch`` number, a batch at or before the last that ``writer`` has
        committed changes nothing.  Of several changes of a key the one last by
        ``order`` holds (any of them, if there is no order)."""
        version, folders, done = self._newest()
        if batch is not None and batch <= done.get(writer, -1):
            return []
        names = [f.name for f in self.schema.fields]
        new = self._latest(changes.select(*names).withColumn("_age", F.lit(1)), self.keys, "_age").withColumn(BUCKET, self._bucket())
        new = new.persist()  # a stream's batch is not to be computed twice
        try:
            touched = sorted(row[0] for row in new.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
            if touched:
                held = self._rows([f"{folder}/{BUCKET}={b}" for b, folder in folders.items() if b in touched])
                both = (new.select(BUCKET, *names).withColumn("_age", F.lit(1))
                           .unionByName(held.select(*names).withColumn(BUCKET, self._bucket()).withColumn("_age", F.lit(0))))
                # Dealt by bucket once: the aggregate by bucket and key, and the write by bucket, need no other shuffle.
                merged = self._latest(both.repartition(len(touched), BUCKET), [BUCKET, *self.keys], "_age")
                folder = f"{self.path}/rows/{version + 1}-{uuid.uuid4().hex}"
                merged.select(BUCKET, *names).write.partitionBy(BUCKET).parquet(folder)
                folders = folders | dict.fromkeys(touched, folder)
        finally:
            new.unpersist()
        if batch is not None:
            done = done | {writer: batch}
        rows = [(b, folder, None, None) for b, folder in folders.items()] + [(None, None, w, n) for w, n in done.items()]
        # One file: the version is there or it is not.
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{self.path}/manifest/version={version + 1}")
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete what none of the newest ``keep`` versions names, files of
        batches that died too; gives the folders.  Not while a batch is being
        written, nor under a reader that began before those versions."""
        manifest = self.spark.read.schema(f"{ENTRY}, version long").parquet(f"{self.path}/manifest")
        newest = [row[0] for row in manifest.select("version").distinct().orderBy(F.desc("version")).limit(keep).collect()]
        kept = manifest.where(F.col("version").isin(newest) & F.col("folder").isNotNull()).select("folder").distinct().collect()
        names = {row.folder.rsplit("/", 1)[-1] for row in kept}
        gone = [p for p in child_paths(self.spark, f"{self.path}/rows") if p.rsplit("/", 1)[-1] not in names]
        gone += [p for p in child_paths(self.spark, f"{self.path}/manifest")
                 if p.rsplit("=", 1)[-1].isdigit() and int(p.rsplit("=", 1)[-1]) not in newest]
        for p in gone:
            remove_path(self.spark, p)
        return gone
