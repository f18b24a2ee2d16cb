"""J4 admission: which candidates become records, and the outcome of each.

Existing-record checks are semi/anti/left joins on the record key; the
record table is large, so these are shuffle joins chosen by Catalyst/AQE
(bucket the record table by key to avoid re-shuffling it on every run).
In-run de-duplication keeps the first row per key through a map-side
partial aggregate over a fixed-size key hash, never a per-key list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import match as M
from ..functions import text as T
from ..sources import fixed
from .enrich import with_coordinates, with_site


def split_existing(candidates: DataFrame, existing: DataFrame, key: str):
    """JN3/JN5: (new, duplicates) = candidates anti / semi joined with the
    existing keys.

    The keys are never broadcast: a store's size is guessed from its files, in
    which keys are packed and most other columns are empty, so that millions of
    them pass for a few MB and would be gathered on the driver."""
    keys = existing.select(key).where(F.col(key).isNotNull()).hint("merge")
    return (candidates.join(keys, key, "left_anti"), candidates.join(keys, key, "left_semi"))


def first_per_value(df: DataFrame, value_col: str, order_col: str) -> DataFrame:
    """U3 by content: the first ``order_col`` per distinct value and the copy
    count.  Groups on a SHA-256 of the value, so only 40 bytes per row cross
    the shuffle, and partial aggregation collapses hot values map-side."""
    return (df.groupBy(F.sha2(F.col(value_col), 256).alias("_h"))
              .agg(F.min(order_col).alias(order_col), F.count(F.lit(1)).alias("n_copies"))
              .drop("_h"))


def first_seen(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """U3 within a run: the first row per key by ``order_cols`` (min of a
    struct led by the order columns: a partial aggregate, skew-safe)."""
    others = [c for c in df.columns if c != key]
    packed = F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c).alias(f"_v_{c}") for c in others]))
    return df.groupBy(key).agg(packed.alias("_first")).select(
        key, *[F.col(f"_first._v_{c}").alias(c) for c in others])


PROCESSING_ERROR = "processing_error"


def outcomes(candidates: DataFrame, existing: DataFrame, sites: DataFrame, gazetteer: DataFrame, *,
             key: str = "url", url_col: str = "url", first_col: str = "first_name",
             last_col: str = "last_name", body_col: str = "body", mode: str = fixed.MATCH_MODE_PROXIMITY,
             institutions=None, statuses=None, keywords=None,
             window: int = fixed.DEFAULT_MATCH_WINDOW, error_col: str | None = None) -> DataFrame:
    """T1 + T2 + W12 + JN1/JN2/JN4: one outcome row per candidate.

    Gate order: processing error (of the page, from ``error_col``) -> missing name -> no affiliation match -> existing record
    (duplicate, carrying the stored name, flag and tags) -> unknown site ->
    saved (with city, province and coordinates).  ``existing`` has the key
    plus ``stored_name``, ``stored_is_alumni``, ``stored_tags``."""
    c = M.with_alumni_match(candidates, body_col, "_match", mode, institutions, statuses, keywords, window)
    ex = existing.select(F.col(key).alias("_ex_key"), "stored_name", "stored_is_alumni", "stored_tags")
    # A key may have been stored twice: one row per key, so one outcome per candidate.
    ex = (ex.where(F.col("_ex_key").isNotNull()).groupBy("_ex_key")
            .agg(F.min(F.struct("stored_name", "stored_is_alumni", "stored_tags")).alias("_ex")).select("_ex_key", "_ex.*"))
    c = c.join(ex, F.col(key) == F.col("_ex_key"), "left")
    c = with_site(c, url_col, sites)
    c = with_coordinates(c, gazetteer)
    failed = F.col(error_col).isNotNull() if error_col else F.lit(False)
    has_name = F.col(first_col).isNotNull() & F.col(last_col).isNotNull()
    matched = F.col("_match").isNotNull()
    dup = F.col("_ex_key").isNotNull()
    known = F.col("city").isNotNull()
    status = (F.when(failed, F.lit(fixed.ERROR)).when(~has_name, F.lit(fixed.SKIPPED)).when(~matched, F.lit(fixed.SKIPPED))
              .when(dup, F.lit(fixed.DUPLICATE)).when(~known, F.lit(fixed.SKIPPED))
              .otherwise(F.lit(fixed.SAVED)))
    reason = (F.when(failed, F.lit(PROCESSING_ERROR)).when(~has_name, F.lit(fixed.MISSING_NAME)).when(~matched, F.lit(fixed.NO_ALUMNI_KEYWORD))
              .when(dup, F.lit(fixed.EXISTING_URL)).when(~known, F.lit(fixed.UNKNOWN_CITY)))
    name = F.when(has_name & matched & dup, F.col("stored_name")) \
        .when(has_name, T.full_name(F.col(first_col), F.col(last_col)))
    is_alumni = (F.when(~has_name | ~matched, F.lit(False))
                 .when(dup, F.col("stored_is_alumni")).otherwise(F.lit(True)))
    saved = has_name & matched & ~dup & known
    return c.select(
        "*",
        status.alias("status"), reason.alias("reason"), name.alias("name"),
        is_alumni.alias("is_alumni"),
        F.col("_match.institution").alias("institution"),
        F.when(has_name & matched & dup, F.col("stored_tags")).when(has_name, F.lit(fixed.DEFAULT_TAG)).alias("tags"),
        F.when(saved, F.col("latitude")).alias("lat"),
        F.when(saved, F.col("longitude")).alias("lon"),
    ).drop("_match", "_ex_key", "stored_name", "stored_is_alumni", "stored_tags", "latitude", "longitude") \
        .withColumnRenamed("lat", "latitude").withColumnRenamed("lon", "longitude")


def saved_records(outcome_rows: DataFrame) -> DataFrame:
    """The rows to append to the record table (status 'saved')."""
    return outcome_rows.where(F.col("status") == fixed.SAVED)


def resolve_attempts(attempts: DataFrame, key: str, attempt_col: str, ok_col: str,
                     outcome_col: str, error_col: str, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Up to ``max_attempts`` tries per key; the first successful try
    gives the outcome, otherwise the key is skipped with the last error.
    Input rows are numbered attempts; only the first ``max_attempts`` count."""
    a = attempts.where(F.col(attempt_col) <= max_attempts)
    ok = F.col(ok_col)
    g = a.groupBy(key).agg(
        F.min(F.when(ok, F.col(attempt_col))).alias("resolved_attempt"),
        F.min_by(F.col(outcome_col), F.when(ok, F.col(attempt_col))).alias("_ok_outcome"),
        F.max_by(F.col(error_col), F.when(~ok, F.col(attempt_col))).alias("_last_error"),
        F.count(F.lit(1)).alias("attempts_used"),
    )
    success = F.col("resolved_attempt").isNotNull()
    return g.select(
        key, "resolved_attempt",
        F.when(success, F.col("resolved_attempt")).otherwise(F.col("attempts_used")).alias("attempts_used"),
        F.when(success, F.lit(fixed.SAVED)).otherwise(F.lit(fixed.SKIPPED)).alias("status"),
        F.when(success, F.col("_ok_outcome")).alias("outcome"),
        F.when(~success, T.truncate_message(F.coalesce(F.col("_last_error"), F.lit("Obituary processing error.")))
               ).alias("message"),
    )


def serving_copy(records: DataFrame, url_col: str = "obituary_url", id_col: str = "id") -> DataFrame:
    """U5 / derived serving table: one row per URL (the lowest id), derived
    from the record table instead of being written twice."""
    return first_seen(records, url_col, [id_col])
