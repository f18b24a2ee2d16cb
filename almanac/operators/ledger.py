"""J6 ledgers: run counters, progress state, run closure and projection.

Plain Parquet has no MERGE, so both ledgers are append-only event tables
and the current view is an aggregate: latest-per-key by ``max_by`` over a
total order (time, then a unique sequence).  All aggregates combine
map-side, so a run or key with a third of all events ships one partial row
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_counters(outcomes: DataFrame, run_key: str, status: str = "status", is_alumni: str = "is_alumni",
                 error: str = "error", order=None) -> DataFrame:
    """A9 + T8: counters per run.  saved: status 'saved' (or no status but
    affiliated); duplicate: 'duplicate'; skipped: 'skipped', 'error', a
    missing outcome and anything else; 'stopped' counts nothing.  The last
    error message (default text when blank) is kept, cut to 4000 chars."""
    s = _col(status)
    alumni = _col(is_alumni) if is_alumni in outcomes.columns else F.lit(False)
    err = _col(error) if error in outcomes.columns else F.lit(None).cast("string")
    saved = (s == fixed.SAVED) | (s.isNull() & F.coalesce(alumni, F.lit(False)))
    dup = s == fixed.DUPLICATE
    stopped = s == fixed.STOPPED
    skipped = ~F.coalesce(saved, F.lit(False)) & ~F.coalesce(dup, F.lit(False)) & ~F.coalesce(stopped, F.lit(False))
    ordering = order if order is not None else F.lit(0)
    msg = F.when(s == fixed.ERROR, F.coalesce(F.nullif(err, F.lit("")), F.lit("Obituary processing error.")))
    return outcomes.groupBy(run_key).agg(
        F.count_if(F.coalesce(saved, F.lit(False))).alias("saved_count"),
        F.count_if(skipped).alias("skipped_count"),
        F.count_if(F.coalesce(dup, F.lit(False))).alias("duplicate_count"),
        T.truncate_message(F.max_by(msg, F.when(msg.isNotNull(), ordering))).alias("error_message"),
    )


def state_from_reason(reason) -> Column:
    """Stop reason -> crawl state: repeated page -> 'pagination_blocked',
    error -> 'error', any other stop -> 'completed'; no stop -> 'running'."""
    r = _col(reason)
    return (F.when(r.isNull(), F.lit(fixed.STATE_RUNNING))
            .when(r == fixed.STOP_REPEATED, F.lit(fixed.STATE_BLOCKED))
            .when(r == fixed.STOP_ERROR, F.lit(fixed.STATE_ERROR))
            .otherwise(F.lit(fixed.STATE_COMPLETED)))


def latest_state(state_events: DataFrame, keys: list[str], order: list[str],
                 fields=("page_number", "last_processed_url", "status", "updated_at")) -> DataFrame:
    """T5: the current progress row per key = the last event by ``order``
    (a total order), via ``max_by`` over a struct (partial aggregate)."""
    ordering = F.struct(*[F.col(c) for c in order])
    packed = F.max_by(F.struct(*[F.col(f) for f in fields]), ordering)
    return state_events.groupBy(*keys).agg(packed.alias("_s")).select(
        *keys, *[F.col(f"_s.{f}").alias(f) for f in fields])


def close_stale_runs(runs: DataFrame, as_of, message: str = fixed.STALE_RUN_MESSAGE) -> DataFrame:
    """Runs still 'running' with no end become 'stopped' ending at
    ``as_of``; their message is set only when blank."""
    stale = (F.col("status") == fixed.RUN_RUNNING) & F.col("finished_at").isNull()
    as_of_c = F.lit(as_of) if isinstance(as_of, str) else as_of
    # all three read the original columns (one projection)
    repl = {
        "error_message": F.when(stale & (F.coalesce(F.col("error_message"), F.lit("")) == ""),
                                F.lit(message)).otherwise(F.col("error_message")),
        "finished_at": F.when(stale, as_of_c.cast(runs.schema["finished_at"].dataType)).otherwise(F.col("finished_at")),
        "status": F.when(stale, F.lit(fixed.RUN_STOPPED)).otherwise(F.col("status")),
    }
    return runs.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in runs.columns])


def final_run_status(failed, stopped) -> Column:
    """T8 end state: failed > stopped > success."""
    return (F.when(_col(failed), F.lit(fixed.RUN_FAILED)).when(_col(stopped), F.lit(fixed.RUN_STOPPED))
            .otherwise(F.lit(fixed.RUN_SUCCESS)))


def keyword_label(c) -> Column:
    """The listing-scan marker shown as 'Listing scan'."""
    c = _col(c)
    return F.when(c == fixed.LISTING_STATE_KEYWORD, F.lit(fixed.LISTING_LABEL)).otherwise(c)


def iso_text(ts) -> Column:
    """ISO-8601 text as Python's ``isoformat()``: seconds, plus six fraction
    digits only when the microseconds are not zero; NULL stays NULL."""
    t = _col(ts)
    frac = F.date_format(t, "SSSSSS")
    return F.when(frac != "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))


def project_run(runs: DataFrame) -> DataFrame:
    """The 12 public fields of a run: ISO timestamps, the keyword shown
    with its display label and kept raw, counters NULL-safe."""
    return runs.select(
        "id", "status",
        iso_text("started_at").alias("started_at"),
        iso_text("finished_at").alias("finished_at"),
        "city",
        keyword_label("search_keyword").alias("search_keyword"),
        F.col("search_keyword").alias("search_keyword_raw"),
        "page_number",
        F.coalesce("saved_count", F.lit(0)).alias("saved_count"),
        F.coalesce("skipped_count", F.lit(0)).alias("skipped_count"),
        F.coalesce("duplicate_count", F.lit(0)).alias("duplicate_count"),
        "error_message")


def latest_run(runs: DataFrame, id_col: str = "id") -> DataFrame:
    """O3: the run with the highest id (a distributed top-1)."""
    return runs.orderBy(F.desc(id_col)).limit(1)


def run_totals(run_id, outcomes: DataFrame | None = None, duplicates: DataFrame | None = None,
               skipped_keys: DataFrame | None = None, failed: bool = False, stopped: bool = False,
               started_at=None, finished_at=None, status: str = "status", error: str = "error",
               order=None) -> DataFrame:
    """T8 + T12: one run row from the run's pieces: processed ``outcomes``
    (A9 rules), URLs found already stored (``duplicates``: +1 duplicate
    each), plan keys skipped as completed (``skipped_keys``: +1 skipped
    each), and the end status failed > stopped > success.  Counts are
    aggregates; nothing is collected."""
    from functools import reduce
    parts = []
    if outcomes is not None:
        parts.append(run_counters(outcomes.withColumn("_run", F.lit(run_id)), "_run", status=status,
                                  error=error, order=order))
    if duplicates is not None:
        parts.append(duplicates.agg(F.lit(run_id).alias("_run"), F.lit(0).cast("long").alias("saved_count"),
                                    F.lit(0).cast("long").alias("skipped_count"),
                                    F.count(F.lit(1)).alias("duplicate_count"),
                                    F.lit(None).cast("string").alias("error_message")))
    if skipped_keys is not None:
        parts.append(skipped_keys.agg(F.lit(run_id).alias("_run"), F.lit(0).cast("long").alias("saved_count"),
                                      F.count(F.lit(1)).alias("skipped_count"),
                                      F.lit(0).cast("long").alias("duplicate_count"),
                                      F.lit(None).cast("string").alias("error_message")))
    if not parts:
        raise ValueError("run_totals needs at least one of outcomes, duplicates, skipped_keys")
    allp = reduce(lambda a, b: a.unionByName(b), parts)
    tot = allp.groupBy("_run").agg(
        F.sum("saved_count").alias("saved_count"), F.sum("skipped_count").alias("skipped_count"),
        F.sum("duplicate_count").alias("duplicate_count"),
        F.max("error_message").alias("error_message"))
    return tot.select(
        F.col("_run").alias("id"),
        final_run_status(F.lit(failed), F.lit(stopped)).alias("status"),
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(finished_at).cast("timestamp").alias("finished_at"),
        "saved_count", "skipped_count", "duplicate_count", "error_message")
