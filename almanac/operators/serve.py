"""J7 serving queries over a record table (column-parameterised).

All are declarative DataFrame plans: filters reach the Parquet scan where the
predicate allows, aggregates combine map-side, and nothing is collected to
the driver.  Orderings always name their NULL placement and a unique
tie-break (PostgreSQL order: ascending puts NULLs last, descending first).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_true(c) -> Column:
    """``flag IS TRUE`` (NULL and false both drop).  Used as a WHERE
    predicate, where a NULL already drops the row, so the plain column is
    enough and stays pushable into the Parquet reader (a ``coalesce`` would
    not be)."""
    return _col(c)


def like_literal(q: str) -> str:
    """Search input as an ILIKE fragment.  '%' and '_' stay wildcards, as in
    the original; a backslash escapes the next character as in PostgreSQL,
    so a backslash before an ordinary character is dropped (Spark rejects
    that form)."""
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], q, flags=re.S)


def contains_ci(c, q: str | None) -> Column | None:
    """Case-insensitive contains; blank input -> no predicate."""
    q = (q or "").strip()
    if not q:
        return None
    return _col(c).ilike(f"%{like_literal(q)}%")


def search(records: DataFrame, *, first_name=None, last_name=None, city=None,
           province=None, query=None, flag="is_alumni", first_col="first_name",
           last_col="last_name", city_col="city", province_col="province",
           body_col="family_information", id_col="id") -> DataFrame:
    """W1-W5 + O1: flag filter AND every supplied facet; ordered by last name
    (NULLs last), then id."""
    preds = [is_true(flag),
             contains_ci(first_col, first_name),
             contains_ci(last_col, last_name),
             contains_ci(city_col, city)]
    p = (province or "").strip()
    if p:
        preds.append(_col(province_col) == F.lit(p))
    q = (query or "").strip()
    if q:
        pat = f"%{like_literal(q)}%"
        preds.append(_col(first_col).ilike(pat) | _col(last_col).ilike(pat) | _col(body_col).ilike(pat))
    cond = reduce(lambda a, b: a & b, [x for x in preds if x is not None])
    return records.where(cond).orderBy(F.asc_nulls_last(last_col), F.asc(id_col))


def latest_per_key(records: DataFrame, key="name", ts="publication_date", id_col="id",
                   flag="is_alumni") -> DataFrame:
    """N1 + W1 + O2: the newest row per key (row_number = 1, date desc with
    NULLs first, id as tie-break), *then* the flag filter, newest first.

    Catalyst turns ``row_number() ... = 1`` into a WindowGroupLimit that
    keeps one row per key inside each map task before the shuffle, so a hot
    key ships one row per task, not all of its rows."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_first(ts), F.asc(id_col))
    latest = (records.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1).drop("_rn"))
    if flag is not None:
        latest = latest.where(is_true(flag))
    return latest.orderBy(F.desc_nulls_first(ts), F.asc(id_col))


def dashboard_counts(records: DataFrame, name="name", city="city") -> DataFrame:
    """A1-A3 fused into one aggregate: distinct names (NULL ignored), all rows,
    distinct non-blank cities."""
    c = _col(city)
    return records.agg(
        F.countDistinct(_col(name)).alias("total_names"),
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct(F.when(c.isNotNull() & (c != ""), c)).alias("total_cities"),
    )


def year_bucket(ts, floor: int = fixed.YEAR_BUCKET_FLOOR) -> Column:
    """A4 bucket: the year as text from ``floor`` on, 'Before <floor>' earlier,
    NULL when undated."""
    y = F.year(_col(ts))
    return (F.when(y >= floor, y.cast("string"))
            .when(y.isNotNull(), F.lit(f"Before {floor}")))


def year_buckets(records: DataFrame, as_of_year: int, ts="publication_date", id_col="id",
                 flag="is_alumni", floor: int = fixed.YEAR_BUCKET_FLOOR,
                 fixed_years: list[int] | None = None) -> DataFrame:
    """A4/A5 summary: one row per bucket with its size and date range.

    Buckets ``as_of_year .. floor`` and 'Before <floor>' are always present,
    even when empty (A4); later years appear when seen.  With
    ``fixed_years`` (A5) only the listed years and the 'Before' bucket exist;
    rows of other years vanish.  Rows stay in the table; the bucket is a
    column, so no group is ever collected into one task."""
    dated = records.where(is_true(flag)) if flag is not None else records
    dated = dated.where(_col(ts).isNotNull()).withColumn("bucket", year_bucket(ts, floor))
    if fixed_years is not None:
        keep = [str(y) for y in fixed_years] + [f"Before {floor}"]
        dated = dated.where(F.col("bucket").isin(*keep))
        frame = keep
    else:
        frame = [str(y) for y in range(as_of_year, floor - 1, -1)] + [f"Before {floor}"]
    spark = records.sparkSession
    # the bucket frame is a fixed, tiny list (years since the floor)
    skeleton = spark.createDataFrame([(b, i) for i, b in enumerate(frame)], "bucket string, bucket_order int")
    agg = dated.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.date_format(F.max(ts), "yyyy-MM-dd").alias("newest"),
        F.date_format(F.min(ts), "yyyy-MM-dd").alias("oldest"),
    )
    out = (F.broadcast(skeleton).join(agg, "bucket", "full")
           .select("bucket",
                   F.coalesce("bucket_order", F.lit(-1)).alias("bucket_order"),
                   F.coalesce("n_records", F.lit(0)).alias("n_records"),
                   "newest", "oldest"))
    return out


def year_bucket_rows(records: DataFrame, ts="publication_date", id_col="id", flag="is_alumni",
                     floor: int = fixed.YEAR_BUCKET_FLOOR) -> DataFrame:
    """A4 member rows: every dated flagged row with its bucket, newest first,
    so the years descend and the 'Before' bucket is last (a distributed range sort, not a per-bucket list)."""
    dated = records.where(is_true(flag)) if flag is not None else records
    return (dated.where(_col(ts).isNotNull())
            .withColumn("bucket", year_bucket(ts, floor))
            .orderBy(F.desc(ts), F.asc(id_col)))


def finite(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c)


def location_groups(records: DataFrame, lat="latitude", lon="longitude", name="name",
                    city="city", id_col="id") -> DataFrame:
    """A6 + W9: rows with finite coordinates grouped by (lat, lon): count and
    the first/last member by name.  Partial aggregation runs map-side, so a
    location holding a third of all rows costs one row per task to shuffle."""
    pts = records.where(finite(lat) & finite(lon))
    return pts.groupBy(_col(lat).alias("lat"), _col(lon).alias("lon")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct(_col(city)).alias("n_cities"),
        F.min(_col(name)).alias("first_name_in_group"),
        F.max(_col(name)).alias("last_name_in_group"),
        F.min(_col(id_col)).alias("min_id"),
    )


def location_members(records: DataFrame, lat="latitude", lon="longitude", name="name",
                     id_col="id", columns=("name", "city", "province", "death_date", "id")) -> DataFrame:
    """A6 members: the rows of each location group as a flat table keyed by
    (lat, lon), ordered by group then name and id (a distributed sort, not a
    per-group list, so a crowded location never lands in one row)."""
    pts = records.where(finite(lat) & finite(lon))
    return (pts.select(_col(lat).alias("lat"), _col(lon).alias("lon"), *[_col(c) for c in columns])
               .orderBy("lat", "lon", F.asc_nulls_last(name), F.asc(id_col)))


def location_bounds(groups: DataFrame, default=(42.3149, -83.0364)) -> DataFrame:
    """Extent of the location groups; the default view when there are none."""
    b = groups.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
                   F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
                   F.count(F.lit(1)).alias("n_groups"))
    return b.select(
        F.coalesce("min_lat", F.lit(default[0])).alias("min_lat"),
        F.coalesce("max_lat", F.lit(default[0])).alias("max_lat"),
        F.coalesce("min_lon", F.lit(default[1])).alias("min_lon"),
        F.coalesce("max_lon", F.lit(default[1])).alias("max_lon"),
        "n_groups")


def non_blank(c) -> Column:
    """W7."""
    c = _col(c)
    return c.isNotNull() & (c != "")


def point_lookup(records: DataFrame, key, id_col="id") -> DataFrame:
    """The row with this id (empty when missing)."""
    return records.where(_col(id_col) == F.lit(key))


def detail_view(records: DataFrame, body="family_information", name="name",
                donations="donation_information") -> DataFrame:
    """T16 for the whole table: adds ``paragraphs`` (F12) and
    ``donation_items`` (F13)."""
    out = T.with_paragraphs(records, body, name, "paragraphs")
    return T.with_donation_items(out, donations, "donation_items")


def json_projection(records: DataFrame, columns=None) -> DataFrame:
    """The 14 public columns (body, donations and funeral home dropped),
    dates as ISO text."""
    cols = []
    for c in (columns or fixed.JSON_COLUMNS):
        if c == "publication_date":
            from .ledger import iso_text
            cols.append(iso_text(c).alias(c))
        else:
            cols.append(F.col(c))
    return records.select(*cols)
