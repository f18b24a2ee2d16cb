"""Substring search by 3-gram lists against the plain filter."""

import random
import re

import pytest
from pyspark.sql import functions as F

from almanac.operators import search_index as S
from almanac.operators import serve
from test_plans import plan

SCHEMA = ("id long, first_name string, last_name string, city string, province string, family_information string, "
          "is_alumni boolean, gram string, `column` int")
COLUMNS = ["first_name", "last_name", "city", "family_information"]


def rows(n=300):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeÉé%_\\ 🎓İß") for _ in range(rng.randrange(0, 9)))
    maybe = lambda: None if rng.random() < 0.05 else word()
    out = [(i, maybe(), maybe(), maybe(), rng.choice(["ON", "QC"]), " ".join(word() for _ in range(rng.randrange(12))), rng.random() < 0.8, "g", 1)
           for i in range(n)]
    out += [(7, "Anna", "Lee", "Abbécity", "ON", "100% of a_b\\c " + "long " * 30_000, True, "g", 1), (9, "ab", None, "", "QC", None, True, "g", 1)]
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams") / "index")
    df = spark.createDataFrame(rows(), SCHEMA)
    S.build(df, path, "id", COLUMNS)
    return df, S.SearchIndex(spark, path, "id", COLUMNS)


@pytest.mark.parametrize("asked", [
    {"query": "abc"}, {"query": "ABC"}, {"query": "éab"}, {"query": "100%"}, {"query": "100\\% of"}, {"query": "a_b\\\\c"}, {"query": "long long"},
    {"query": "ab"}, {"query": "_"}, {"query": "a%b"}, {"query": "abc%cd_e"}, {"first_name": "ann"}, {"first_name": "ann", "city": "bbéc", "query": "long"},
    {"first_name": "a", "query": "bcd"}, {"query": "nowhere at all"}, {"query": "  "}, {}, {"city": "ééé", "province": "ON"}, {"query": "🎓ab"},
    {"last_name": "lee", "query": "anna"}, {"query": "abc", "first_name": "zzzzz"}], ids=repr)
def test_same_rows_as_the_plain_search(built, asked):
    df, index = built
    got, want = index.search(**asked), serve.search(df, **asked)
    assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]


def test_reads_lists_and_few_buckets(built):
    _, index = built
    p = plan(index.search(first_name="Anna"))
    assert re.search(r"PartitionFilters: \[[^]]*\(_b#\d+ (= \d+|IN \([0-9,]{1,12}\))\)", p), p  # one or a few of 64
    assert "family_information" not in plan(index.candidates([(["first_name"], "Anna")]))


def test_a_split_of_many_texts_is_dealt_out(spark, tmp_path, monkeypatch):
    """What a task sorts follows its characters, not the scan's split."""
    monkeypatch.setattr(S, "TASK_CHARS", 1000)
    some = [(i, f"name {i:03d}", None, "", "QC", "of the same length", True, "g", 1) for i in range(200)]
    df = spark.createDataFrame(some, SCHEMA).coalesce(1)
    S.build(df, str(tmp_path / "i"), "id", COLUMNS)
    index = S.SearchIndex(spark, str(tmp_path / "i"), "id", COLUMNS)
    files = index.postings().where("gram = ' sa'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 200 and max(r["count"] for r in files) <= 100
    assert index.search(first_name="name 07", query="same").count() == 10


def test_runs():
    assert S.literal_runs(" ab%cd_\\%e ") == ["ab", "cd", "%e"] and S.literal_runs("%%") == []
    assert S.literal_runs("a\\b") == ["ab"]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    S.build(df.unionByName(spark.createDataFrame([rows(1)[0]], SCHEMA)), str(tmp_path / "i"), "id", COLUMNS)
    assert S.SearchIndex(spark, str(tmp_path / "i"), "id", COLUMNS).search(query="not there").collect() == []
