"""S2/JN3/JN4/W6: an append-only record table, bucketed by its key.

The table is an ordinary external Parquet table with Spark's bucketing: each
append deals its rows to ``buckets`` hash buckets, one file a bucket.  A join or
an aggregate on the key then reads the records where they lie: only the other
side is shuffled, into the same number of buckets, so that the check of a run's
candidates costs a shuffle of the candidates and none of the store.  A filter on
the key reads one bucket.

The session's catalog only holds the description; a later session attaches the
same folder again.  The number of buckets and the key are kept beside the data,
as a reader that takes other ones would get wrong rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Enough that a bucket of a large table is some hundred MB.
BUCKETS = 256


class RecordStore:
    """A record table under ``path``, bucketed by ``key``.

    Rows are appended by :meth:`append`; as each key should be stored once, a
    run admits its rows first (:func:`almanac.operators.admit.split_existing`).
    A folder that has a store is attached as it was made, and another key or
    number of buckets is an error.  Rows whose key is null are kept, in one
    bucket, and never match.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path.rstrip("/"), key, buckets, schema
        spec = self._spec()
        if spec is not None and (spec["key"], spec["buckets"]) != (key, buckets):
            raise ValueError(f"{path} is bucketed by {spec['key']} into {spec['buckets']}, not by {key} into {buckets}")
        if spec is None:
            spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.parquet(f"{self.path}/spec")
        self.name = f"records_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS "
                  f"LOCATION '{self.path}/rows'")

    def _spec(self):
        try:
            return self.spark.read.parquet(f"{self.path}/spec").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def append(self, rows: DataFrame) -> None:
        """Add ``rows``, one file a bucket (``rows`` is dealt by the key first,
        so that a task does not open a file for each bucket)."""
        names = [f.name for f in self.schema.fields]
        (rows.select(*names).repartition(self.buckets, self.key).write.format("parquet").mode("append")
             .bucketBy(self.buckets, self.key).option("path", f"{self.path}/rows").saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, value) -> DataFrame:
        """The rows of one key; reads one bucket."""
        return self.read().where(F.col(self.key) == F.lit(value).cast(self.schema[self.key].dataType))

    def bucket_of(self, key: Column) -> Column:
        """The bucket that Spark files a key in."""
        return F.pmod(F.hash(key), F.lit(self.buckets))
