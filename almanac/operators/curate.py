"""J9 curation: tag changes applied to the record table (T11, W10, JN8, S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import fixed


def split_tag_changes(changes: DataFrame, tag: str = "tags"):
    """(valid, rejected) changes; only 'new' and 'updated' are valid."""
    ok = F.col(tag).isin(*fixed.VALID_TAGS)
    return changes.where(ok), changes.where(~F.coalesce(ok, F.lit(False)))


def apply_tag_changes(records: DataFrame, changes: DataFrame, key: str, order: list[str],
                      tag: str = "tags") -> DataFrame:
    """T11 + JN8 + S10: NULL tags become 'new'; then the last valid change per
    key (by ``order``) replaces the tag.  The change set is reduced to one
    row per key with a partial aggregate before the (shuffle) join."""
    valid, _ = split_tag_changes(changes, tag)
    last = valid.groupBy(key).agg(F.max_by(F.col(tag), F.struct(*[F.col(c) for c in order])).alias("_new_tag"))
    out = records.withColumn(tag, F.coalesce(F.col(tag), F.lit(fixed.DEFAULT_TAG)))
    return (out.join(last, key, "left")
               .withColumn(tag, F.coalesce(F.col("_new_tag"), F.col(tag))).drop("_new_tag"))
