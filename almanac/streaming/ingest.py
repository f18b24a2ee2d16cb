"""The record pipeline's incremental behaviours on Structured Streaming.

R1 resumable position: a file source plus a checkpoint in the shared
   checkpoint folder; ``trigger(availableNow=True)`` processes what is there
   and stops, and a rerun continues after the last committed batch.
R2 first-seen-wins de-duplication: against all history with
   ``foreachBatch`` (first row per key inside the batch, anti-joined with
   the keys already written, then appended; re-running a batch after a
   failure writes nothing twice), or within a bounded delay with
   ``dropDuplicatesWithinWatermark``.
R3 running counters and R4 latest state per key: streaming aggregates in update
   mode, whose changed rows are upserted into a keyed table
   (:class:`almanac.sources.keyed.KeyedTable`), so that a batch rewrites only
   the hash buckets it touches; or, for small results, in complete mode, where
   the result replaces the table each batch.
R5 the current-month cut-off is a plain predicate on the content date
   (not a watermark).

Sinks and checkpoints always live under the shared checkpoint folder, never
a machine-local one.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..session import shared_path
from ..sources.keyed import KeyedTable


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's sink and checkpoint."""
    return shared_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """R1 source: Parquet files arriving in ``directory`` (optionally only
    those matching ``glob``) with a declared schema."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def _run(writer, checkpoint: str, available_now: bool = True):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def _run_batches(writer, write_batch, checkpoint: str, available_now: bool, stop, every: float = 0.1):
    """Run ``write_batch`` on every batch; with ``stop``, until ``stop(query)``
    is true, a stop request inside a run.  A batch that has begun is written to
    its end, and no later one begins, so the run ends between two batches and
    the next run with the same checkpoint goes on after it.  (If the end of a
    batch was not noted in the checkpoint any more, it is done again, which the
    sinks of this module take without a double row.)"""
    if stop is None:
        return _run(writer.foreachBatch(write_batch), checkpoint, available_now)
    writing, closed = threading.Lock(), threading.Event()

    def guarded(batch: DataFrame, batch_id: int):
        with writing:
            if closed.is_set():
                raise RuntimeError("the run was asked to stop")
            write_batch(batch, batch_id)

    w = writer.foreachBatch(guarded).option("checkpointLocation", checkpoint)
    query = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
    while not query.awaitTermination(every):
        if stop(query):
            with writing:
                closed.set()
            query.stop()
            break
    return query


def batches_done(n: int):
    """A stop request once a run has committed ``n`` batches."""
    return lambda query: sum(p["numInputRows"] > 0 for p in query.recentProgress) >= n


def dedup_history(stream: DataFrame, key: str, order: list[str], sink: str, checkpoint: str,
                  columns: list[str] | None = None, available_now: bool = True, buckets: int = 64):
    """R2 against all history: append the first row per key that is not in
    ``sink`` yet.  Inside a batch the first row is the min of a struct led
    by ``order`` (a partial aggregate: hot keys collapse map-side).

    The sink is partitioned by a hash bucket of the key, and a batch reads
    back only the buckets its own keys fall in (the bucket list has at most
    ``buckets`` small integers), so the history scan shrinks with small
    batches instead of growing with the whole sink.  Re-running a batch after
    a failure appends nothing twice: its keys are already in the sink."""
    cols = columns or [c for c in stream.columns if c != key]

    def write_batch(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        packed = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                                *[F.col(c).alias(f"_v_{c}") for c in cols]))
        first = (batch.groupBy(key).agg(packed.alias("_f"))
                 .select(key, *[F.col(f"_f._v_{c}").alias(c) for c in cols])
                 .withColumn("_kb", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")))
        try:
            hist = spark.read.parquet(sink)
        except Exception as e:  # first batch: no sink yet
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            hist = None
        if hist is not None:
            touched = [r[0] for r in first.select("_kb").distinct().collect()]  # <= buckets ints
            seen = hist.where(F.col("_kb").isin(touched)).select(key, "_kb")
            first = first.join(seen, [key, "_kb"], "left_anti")
        first.write.mode("append").partitionBy("_kb").parquet(sink)

    return _run(stream.writeStream.foreachBatch(write_batch), checkpoint, available_now)


def dedup_within_watermark(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """R2 within a bounded delay: state is kept only for ``delay``.  The
    event time must be TIMESTAMP (NTZ columns are cast first)."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp"))
                  .withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]))


def complete_table(agg: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """R3/R4 sink: the complete aggregate result replaces the table at each
    batch (idempotent per batch)."""
    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(sink)

    return _run(agg.writeStream.outputMode("complete").foreachBatch(write_batch), checkpoint, available_now)


def upsert_table(agg: DataFrame, table: KeyedTable, checkpoint: str, available_now: bool = True, stop=None):
    """R3/R4 sink: the rows that a batch changed are upserted into ``table``.
    ``agg`` runs in update mode, so a batch carries the changed keys and not the
    whole result.  A batch that is replayed after a failure changes nothing
    twice: the table knows the last batch of this checkpoint."""
    def write_batch(batch: DataFrame, batch_id: int):
        if table.committed(checkpoint) < batch_id:
            table.upsert(batch, batch_id, writer=checkpoint)
        else:  # the aggregate's own state is still to be brought up to this batch
            batch.write.format("noop").mode("overwrite").save()

    return _run_batches(agg.writeStream.outputMode("update"), write_batch, checkpoint, available_now, stop)


def append_batches(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True, stop=None):
    """R1 sink: every row of the stream once.  A batch overwrites its own
    ``batch_id`` partition, so one that is replayed replaces its first attempt."""
    def write_batch(batch: DataFrame, batch_id: int):
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))

    return _run_batches(stream.writeStream, write_batch, checkpoint, available_now, stop)


def current_month_only(stream: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Keep rows whose content date is in the ``as_of`` month."""
    return stream.where(D.is_current_month(F.col(ts), as_of))


def notices_stream(pages_stream: DataFrame, records_path: str, outcomes_path: str, sites: DataFrame,
                   gazetteer: DataFrame, checkpoint: str, options=None, link_prefix: str | None = None,
                   available_now: bool = True):
    """J10 over the record flow: each micro-batch of fetched pages runs the
    same extract -> match -> admit -> enrich plan as the batch job
    (:func:`almanac.operators.records.process_notices`) against the records
    written by earlier batches, then appends its outcomes and new records.

    Exactly once: both tables are partitioned by ``batch_id`` and a batch
    overwrites only its own partition (dynamic partition overwrite), reading
    history from earlier batch ids only, so a batch replayed after a failure
    produces the same rows and replaces its first attempt."""
    from ..operators.admit import first_seen
    from ..operators.records import process_notices
    from ..sources.tables import RECORD_SCHEMA

    def write_batch(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        try:
            records = spark.read.parquet(records_path).where(F.col("batch_id") < batch_id).drop("batch_id")
        except Exception as e:  # first batch: no history yet
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            records = spark.createDataFrame([], RECORD_SCHEMA)
        from ..sources import fixed
        out, new = process_notices(batch, records, sites, gazetteer, options,
                                   link_prefix=link_prefix or fixed.RECORD_LINK_PREFIX)
        new = first_seen(new, "obituary_url", ["id"]).select(*[f.name for f in RECORD_SCHEMA.fields])
        for df, path in ((out, outcomes_path), (new, records_path)):
            (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
               .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return _run(pages_stream.writeStream.foreachBatch(write_batch), checkpoint, available_now)
