"""Helpers of the corpus operators."""

from pyspark.sql import functions as F

from almanac.llm import common as C


def test_sifted_keeps_every_wanted_row_and_few_others(spark):
    rows = spark.range(-3000, 100_000).select(F.col("id"), F.lit("x").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(None, "null"), (7, "again")], "id long, text string"))
    wanted = rows.filter("pmod(id, 50) = 7").select("id")
    got = [r.id for r in C.sifted(rows, wanted, "id").collect()]
    want = [r.id for r in wanted.collect()]
    assert sorted(i for i in got if i is not None and i % 50 == 7) == sorted(want)
    assert len(want) <= len(got) < len(want) + 100


def test_sifted_by_a_full_map_passes_all_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "SIFT_BITS", 8)
    rows = spark.range(500)
    assert C.sifted(rows, rows, "id").count() == 500


def test_sifted_by_nothing(spark):
    rows = spark.range(10)
    assert C.sifted(rows, rows.limit(0), "id").count() == 0


def test_unsifted_is_the_rest(spark, monkeypatch):
    rows = spark.range(-300, 5_000).select(F.col("id"), F.lit("x").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(None, "null"), (7, "again")], "id long, text string"))
    wanted = rows.filter("pmod(id, 50) = 7").select("id")
    for bits, least in ((1 << 26, 5_000), (8, 1)):
        monkeypatch.setattr(C, "SIFT_BITS", bits)
        known = sorted(r.id for r in C.sifted(rows, wanted, "id").collect() if r.id is not None)
        rest = [r.id for r in C.unsifted(rows, wanted, "id").collect()]
        assert None in rest and len(rest) >= least
        assert sorted(known + [i for i in rest if i is not None]) == sorted([*range(-300, 5_000), 7])
        assert not any(i % 50 == 7 for i in rest if i is not None)


def test_few_ids_have_a_small_map(spark):
    rows = spark.range(5_000)
    _, marks, _ = C._placed(rows, rows.filter("id % 50 = 7"), "id")
    assert marks.selectExpr("sum(octet_length(_bits))").first()[0] <= 1 << 14
