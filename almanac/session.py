"""Session construction and shared-storage helpers.

Operators never build a session themselves; they take the caller's.  This
module only holds the defaults we use in tests/bench and the rule for where
lineage-cutting checkpoints go: the cluster names a shared folder in
``spark.checkpoint.dir``; we create a scratch one only when it is unset
(local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings we rely on for correct and scalable plans.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "almanac", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench.  On a cluster, pass the cluster's
    session to the operators instead and size ``spark.sql.shuffle.partitions``
    to the data (about 128-256 MB of shuffle per partition)."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only when
    the session names none (tests on one machine)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/DBFS) for "
                           "checkpoints and stream state; a machine-local folder does not survive executor loss")
    scratch = tempfile.mkdtemp(prefix="almanac-ckpt-", dir=os.environ.get("ALMANAC_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables, stream
    checkpoints and sinks that must survive executor loss)."""
    root = ensure_checkpoint_dir(spark)
    return "/".join([root.rstrip("/"), *parts])


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def in_shares(df: DataFrame, text: str, most: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` and its text, about ``most`` characters of
    it a task at most: for what makes many rows of a text and sorts them.  A
    text is never cut, so one longer than that is a task of its own size."""
    chars = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return df.repartition(chars // most + 1, F.xxhash64(*keys, text))


def _file_system(spark: SparkSession, path: str):
    """The store of ``path``, as Hadoop's file system, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def child_paths(spark: SparkSession, path: str) -> list[str]:
    """The files and folders directly in ``path``; none if there is no such folder."""
    store, at = _file_system(spark, path)
    return [str(status.getPath()) for status in store.listStatus(at)] if store.exists(at) else []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it."""
    store, at = _file_system(spark, path)
    store.delete(at, True)
