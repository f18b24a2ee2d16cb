"""Distinct counts from day sketches against exact ones."""

from pyspark.sql import functions as F

from almanac.operators import sketches as K
from test_plans import plan

SCHEMA = "ts timestamp, name string, city string"


def test_merged_days_are_within_the_bound(spark):
    rows = spark.range(60_000).select(
        F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, int(id % 40))").alias("ts"),
        F.concat(F.lit("n"), F.col("id") % 23_000).alias("name"), F.concat(F.lit("c"), F.col("id") % 7).alias("city"))
    days = K.day_sketches(rows, "ts", {"names": "name", "cities": "city"})
    assert days.count() == 40
    got = {r.month: (r.n_rows, r.names, r.cities) for r in K.merged_counts(days, ["names", "cities"], {"month": F.month("day")}).collect()}
    exact = {r.m: r for r in rows.groupBy(F.month("ts").alias("m")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("d")).collect()}
    assert set(got) == set(exact) == {1, 2}
    for m, (n, names, cities) in got.items():
        assert n == exact[m].n and cities == 7
        assert abs(names - exact[m].d) <= K.error_bound() * exact[m].d
    (total,) = K.merged_counts(days, ["names"]).collect()
    assert total.n_rows == 60_000 and abs(total.names - 23_000) <= K.error_bound() * 23_000


def test_parts_of_a_day_merge_as_the_whole(spark):
    rows = spark.range(5_000).select(F.lit("2026-03-01 10:00:00").cast("timestamp").alias("ts"),
                                     F.concat(F.lit("n"), F.col("id") % 900).alias("name"), F.lit("x").alias("city"))
    parts = K.day_sketches(rows.where("name < 'n5'"), "ts", {"names": "name"}).unionByName(
        K.day_sketches(rows.where("name >= 'n2'"), "ts", {"names": "name"}))
    (got,) = K.merged_counts(parts, ["names"]).collect()
    assert abs(got.names - 900) <= K.error_bound() * 900


def test_nulls_blanks_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a", ""), (None, None, None)], SCHEMA)
    names = {"names": "name", "cities": "city"}
    (got,) = K.merged_counts(K.day_sketches(rows, "ts", names, blank=False), list(names)).collect()
    assert (got.n_rows, got.names, got.cities) == (2, 1, 0)
    (kept,) = K.merged_counts(K.day_sketches(rows, "ts", names), list(names)).collect()
    assert kept.cities == 1
    (none,) = K.merged_counts(K.day_sketches(rows.limit(0), "ts", names), list(names)).collect()
    assert (none.n_rows, none.names, none.cities) == (0, 0, 0)


def test_days_are_aggregated_before_they_move(spark):
    rows = spark.createDataFrame([], SCHEMA)
    p = plan(K.day_sketches(rows, "ts", {"names": "name"}))
    assert p.count("Exchange") == 1 and "partial_hll_sketch_agg" in p
