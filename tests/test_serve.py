"""Serving queries on three seeded records (two affiliated, one not)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import serve
from almanac.operators.export import csv_rows, write_csv
from almanac.sources.tables import RECORD_SCHEMA

ROWS = [
    dict(id=1, tags="new", name="Mia Stone", first_name="Mia", last_name="Stone", birth_date="May 02, 1941",
         death_date="June 01, 2026", publication_date=dt.datetime(2026, 6, 1), obituary_url="https://t/1",
         family_information="Graduated from University of Windsor.", donation_information="", is_alumni=True,
         city="Windsor", province="Ontario", funeral_home="Home A", latitude=42.3, longitude=-83.0),
    dict(id=2, tags="updated", name="Lee Stone", first_name="Lee", last_name="Stone", birth_date=None,
         death_date="May 01, 2024", publication_date=dt.datetime(2024, 5, 1), obituary_url="https://t/2",
         family_information="Proud UWindsor graduate.", donation_information="", is_alumni=True,
         city="Toronto", province="Ontario", funeral_home="Home A", latitude=43.6, longitude=-79.4),
    dict(id=3, tags="new", name="Kai Moss", first_name="Kai", last_name="Moss", birth_date=None,
         death_date="June 02, 2026", publication_date=dt.datetime(2026, 6, 2), obituary_url="https://t/3",
         family_information="No matching school text.", donation_information="", is_alumni=False,
         city="Windsor", province="Ontario", funeral_home="Home A", latitude=42.3, longitude=-83.0),
    # a non-affiliated newer row with the same name as record 1 hides it
    dict(id=4, tags="new", name="Mia Stone", first_name="Mia", last_name="Stone", birth_date=None,
         death_date=None, publication_date=None, obituary_url="https://t/4",
         family_information="Other Mia.", donation_information="", is_alumni=False,
         city="", province="Ontario", funeral_home="Home B", latitude=None, longitude=None),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([tuple(r[f.name] for f in RECORD_SCHEMA.fields) for r in ROWS], RECORD_SCHEMA)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_latest_per_name_filters_after_window(records):
    # record 4 (NULL date sorts first, as in PostgreSQL) is the latest "Mia Stone" and is not affiliated
    assert ids(serve.latest_per_key(records)) == [2]


def test_search(records):
    assert ids(serve.search(records, query="University")) == [1]
    assert ids(serve.search(records, city="Toronto")) == [2]
    assert ids(serve.search(records, last_name="sto", province="Ontario")) == [1, 2]
    assert ids(serve.search(records, first_name="  ")) == [1, 2]
    assert ids(serve.search(records, query="M_a")) == [1]


def test_counts(records):
    r = serve.dashboard_counts(records).first()
    assert (r["total_names"], r["total_records"], r["total_cities"]) == (3, 4, 2)


def test_year_buckets(records):
    got = {r["bucket"]: r["n_records"] for r in serve.year_buckets(records, as_of_year=2026).collect()}
    assert got == {"2026": 1, "2025": 0, "2024": 1, "2023": 0, "2022": 0, "Before 2022": 0}


def test_location_groups_and_bounds(records):
    g = serve.location_groups(records)
    assert sorted((r["lat"], r["n_records"]) for r in g.collect()) == [(42.3, 2), (43.6, 1)]
    b = serve.location_bounds(g).first()
    assert (b["min_lat"], b["max_lat"], b["n_groups"]) == (42.3, 43.6, 2)


def test_detail_view(records):
    r = serve.detail_view(records.where("id = 1")).first()
    assert r["paragraphs"] == ["Graduated from University of Windsor."] and r["donation_items"] == []


def test_csv_export(records, tmp_path):
    rows = csv_rows(records)
    first = rows.first()
    assert (first["name"], first["publication_date"], first["is_alumni"]) == ("Mia Stone", "2026-06-01", "true")
    out = str(tmp_path / "csv")
    write_csv(rows, out)
    import glob
    data = open(glob.glob(out + "/part-*.csv")[0], "rb").read()
    assert data.startswith("﻿id,name".encode("utf-8"))
    assert b"\r\n" in data and data.count(b"\r\n") == 3
    with pytest.raises(ValueError):
        write_csv(rows.where("false"), str(tmp_path / "none"))


def test_point_lookup_and_json(records):
    assert ids(serve.point_lookup(records, 2)) == [2]
    assert ids(serve.point_lookup(records, 99)) == []
    from almanac.operators.export import json_lines
    import json
    j = json.loads(json_lines(records.where("id = 1")).first()["json"])
    assert j["name"] == "Mia Stone" and j["publication_date"] == "2026-06-01T00:00:00" and "family_information" not in j


def test_serving_copy(records, spark):
    from almanac.operators.admit import serving_copy
    dup = records.where("id = 2").withColumn("id", records["id"] + 10)
    out = serving_copy(records.unionByName(dup))
    assert sorted(ids(out)) == [1, 2, 3, 4]


def test_current_month_stream_predicate(spark):
    from almanac.streaming.ingest import current_month_only
    df = spark.createDataFrame([(dt.datetime(2026, 6, 3),), (dt.datetime(2026, 5, 31),), (None,)], "ts timestamp")
    assert current_month_only(df, "ts", "2026-06-15").count() == 1


def test_null_ordering_and_ties(spark, records):
    # O1: NULL last names sort last (PostgreSQL ascending), ties by id
    nulls = records.where("id in (1, 2)").unionByName(
        records.where("id = 2").selectExpr(*[("9 AS id" if c == "id" else ("CAST(NULL AS STRING) AS last_name" if c == "last_name" else c)) for c in records.columns]))
    assert ids(serve.search(nulls)) == [1, 2, 9]
    # O2: NULL publication dates first in newest-first order (CSV export), ties by id
    flagged = records.selectExpr(*[("true AS is_alumni" if c == "is_alumni" else c) for c in records.columns])
    assert [r["id"] for r in csv_rows(flagged).collect()] == ["4", "3", "1", "2"]


def test_csv_quoting_matches_python_csv(spark, tmp_path):
    import csv
    import glob
    import io
    from almanac.operators.export import write_csv
    rows = spark.createDataFrame([("1", 'Mia "Mo" Stone, Jr', ""), ("2", "plain", "a;b")], "id string, name string, note string")
    write_csv(rows.orderBy("id"), str(tmp_path / "q"))
    data = open(glob.glob(str(tmp_path / "q") + "/part-*.csv")[0], "rb").read().decode("utf-8")
    buf = io.StringIO()
    buf.write("﻿")
    w = csv.writer(buf)
    w.writerow(["id", "name", "note"])
    w.writerow(["1", 'Mia "Mo" Stone, Jr', ""])
    w.writerow(["2", "plain", "a;b"])
    assert data == buf.getvalue()


def test_csv_in_parts(spark, tmp_path):
    import csv
    import io
    from almanac.operators.export import write_csv_parts
    data = [(i, f"n{i % 7}", 'a "b", c' if i % 5 == 0 else None if i % 5 == 1 else " x\ny " if i % 5 == 2 else "", i % 3) for i in range(3000)]
    rows = spark.createDataFrame(data, "id long, _line string, note string, _rank int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one part
    try:
        parts = write_csv_parts(rows, str(tmp_path / "p"), [F.desc("_cells._line"), "id"], str(tmp_path / "m"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    held = [open(p.removeprefix("file:"), "rb").read() for p in parts]
    buf = io.StringIO()
    w = csv.writer(buf)
    w.writerow(["id", "_line", "note", "_rank"])
    w.writerows(["" if v is None else v for v in r] for r in sorted(data, key=lambda r: (-int(r[1][1:]), r[0])))
    assert b"".join(held).decode("utf-8") == "\ufeff" + buf.getvalue() and len(parts) > 1
    assert [r.part for r in spark.read.parquet(str(tmp_path / "m")).orderBy("position").collect()] == parts
    with pytest.raises(ValueError):
        write_csv_parts(rows.where("false"), str(tmp_path / "none"), ["id"])
