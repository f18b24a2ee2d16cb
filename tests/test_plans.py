"""Plan-shape guards for the scale properties the README claims."""

import re

import pytest

from almanac.plans.catalog import QUERIES
from conftest import SMALL

STREAMS = {"stream_dedup", "stream_dedup_watermark", "stream_counters", "stream_state", "stream_notice_outcomes"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_per_key_facts_reduce_before_shuffle(spark):
    q = QUERIES
    assert re.search(r"WindowGroupLimit.*Partial", plan(q["latest_per_key"](spark, SMALL)))
    assert re.search(r"WindowGroupLimit.*Partial", plan(q["attempts"](spark, SMALL)))
    assert re.search(r"WindowGroupLimit.*Partial", plan(q["repeated_pages"](spark, SMALL)))
    for name, fn in [("run_counters", "partial_count("), ("latest_state", "partial_max_by"),
                     ("dedup_by_text", "partial_min"), ("tag_updates", "partial_max_by")]:
        assert fn in plan(q[name](spark, SMALL)), name


def test_document_text_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = formatted(QUERIES["outcomes"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    blocks = [b for b in f.split("\n\n") if ") Exchange" in b]
    assert blocks and not any(re.search(r"Input \[\d+\]: \[[^\]]*\btext#", b) for b in blocks)


def test_crawl_plans_stay_linear(spark):
    for name in ["listing_plan_work", "search_plan_work", "listing_plan_state", "search_plan_state"]:
        assert plan(QUERIES[name](spark, SMALL)).count("Exchange") <= 12, name


def test_scan_prunes_columns(spark):
    p = plan(QUERIES["keyword_hits_simple"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
