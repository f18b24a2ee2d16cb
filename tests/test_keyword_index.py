"""The positional keyword index against the patterns it stands for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from almanac.functions import match as M
from almanac.functions import text as T
from almanac.operators import keyword_index as K
from almanac.sources import fixed
from test_plans import formatted, plan

WORDS = ["the", "The", "of", "university", "University", "straße", "STRASSE", "İzmir", "izmir", "ſee", "see", "a", "b", "a", "John's", "é", "É", "x1", "_", "🎓"]
GAPS = [" ", " ", " ", "  ", " ", ", ", ". ", "-", "'", "\n", "--", " - ", "++"]


def texts(n, seed):
    rng = random.Random(seed)
    out = ["", None, "  ", "++", "a", "a a a a a", "-a-a-a-", "-a--a-", "(a)(a)"]
    out += ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    return [(i, t, i, "w") for i, t in enumerate(out)]


KEYWORDS = ["the university", "university", "a", "a a", "a a a", "a  b", "-a-", "(a)", "straße", "see", "izmir", "é", "John's", "of the",
            "x1", "_", "a-", "-a", "a, b", "a. The", "🎓 a", "university of the", "nowhere", "See"]


@pytest.fixture
def indexed(spark, tmp_path):
    df = spark.createDataFrame(texts(150, 4), "doc_id long, text string, pos long, word string")
    K.build(df, "doc_id", "text", str(tmp_path / "index"))
    return df, K.Index(spark, str(tmp_path / "index"))


def by_pattern(df, keywords):
    d = M.with_occurrences(df, T.collapse_ws("text"), keywords, "occ").select("doc_id", F.posexplode_outer("occ").alias("p", "o"))
    return sorted((r.doc_id, r.o.start, r.o.rank, r.o.end, r.o.keyword) for r in d.where(F.col("o").isNotNull()).collect())


def by_index(found):
    return sorted((r.doc, r.start, r.rank, r.end, r.keyword) for r in found.collect())


def test_same_places_as_the_patterns(indexed):
    df, index = indexed
    want = by_pattern(df, KEYWORDS)
    assert by_index(index.occurrences(KEYWORDS)) == want and len({w[4] for w in want}) > 15


def test_keywords_without_words(indexed):
    df, index = indexed
    keywords = ["++", "--", "a", " "]
    assert by_index(index.occurrences(keywords, df)) == by_pattern(df, keywords)
    with pytest.raises(ValueError, match="words"):
        index.occurrences(keywords)
    assert index.occurrences([]).collect() == []


def test_proximity_is_the_same(indexed):
    df, index = indexed
    for window in (0, 3, 40):
        for inst, stat in ((["university", "the university", "a a"], ["see", "a", "of the"]), (["é"], ["é", "straße"]), (["nowhere"], ["a"])):
            got = K.proximity_match(df, index, "doc_id", "text", "m", inst, stat, window=window)
            want = M.with_proximity_match(df, "text", "m", inst, stat, window=window)
            key = lambda rows: sorted((r.doc_id, r.m and tuple(r.m), r.word) for r in rows.collect())
            assert key(got) == key(want)


def test_a_thousand_keywords_without_a_pass_each(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(200))) for i in range(60)]
    keywords = sorted({" ".join(docs[rng.randrange(60)][1].split()[s:s + rng.randrange(1, 5)]) for s in range(190) for _ in range(6)})[:1000]
    assert len(keywords) > 900
    df = spark.createDataFrame(docs, "doc_id long, text string")
    K.build(df, "doc_id", "text", str(tmp_path / "i"))
    index = K.Index(spark, str(tmp_path / "i"))
    found = index.occurrences(keywords)
    want = []
    for rank, k in enumerate(fixed.longest_first(keywords)):
        for d, t in docs:
            want += [(d, m.start(), rank, m.end(), k) for m in re.finditer(rf"(?<!\w){re.escape(k)}(?!\w)", t)]
    assert by_index(found) == sorted(want)
    # Scans and expressions do not grow with the keywords.
    many = index.occurrences(keywords)
    assert plan(many).count("FileScan parquet") <= 6  # three for keywords that can overlap with themselves
    assert "regexp" not in plan(many).lower() and "rlike" not in plan(many).lower()
    assert not re.search(r"\btext#", formatted(many))  # the texts are not read
    assert not re.search(r"Exchange hashpartitioning\(word", plan(many))  # nor is the index dealt by word


def test_search_reads_the_buckets_of_its_words(indexed):
    _, index = indexed
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|INSET|=)", plan(index.postings(["a"])))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    K.build(df.unionByName(spark.createDataFrame([(1, "word")], df.schema)), "doc_id", "text", str(tmp_path / "i"))
    index = K.Index(spark, str(tmp_path / "i"))
    assert index.occurrences(["nothing here"]).collect() == []
    assert K.proximity_match(df, index, "doc_id", "text", "m", ["word"], ["word"]).collect() == []


def test_a_split_of_many_texts_is_dealt_out(spark, tmp_path, monkeypatch):
    """What a task sorts follows its characters, not the scan's split."""
    monkeypatch.setattr(K, "TASK_CHARS", 1000)
    df = spark.createDataFrame([(i, "the same words " * 5) for i in range(100)], "doc_id long, text string").coalesce(1)
    K.build(df, "doc_id", "text", str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i")).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows) == 1500 and max(r["count"] for r in rows) <= 250
    assert K.Index(spark, str(tmp_path / "i")).occurrences(["same words"]).count() == 500
