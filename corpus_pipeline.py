"""The corpus pipeline: five of the corpus operators, one after another.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; it is written
and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from almanac.llm.common import sifted, staged, table, unsifted

#: The stages cannot be stated in SQL (a trained model, signatures, a sampled
#: fit); their results are tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, scorer, score_col="_toxicity").filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, from a document of nothing else too;
    ``n_chars`` follows the text."""
    cut = line_dedup.drop_boilerplate(docs, host_col="source")
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, that with the smallest id stays; of rows
    that share an id, one.

    Texts are not joined with ids: a row whose id is surely not that of a copy
    or repeated stays where it is.  Of the others, those that stay are looked
    up, and only their rows are moved, one of an id from each task."""
    found = staged(near_dup.near_duplicates(docs, shingle_words=5), "components")
    ids = staged(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("c")), "ids")
    odd = ids.filter("NOT kept OR c > 1").select("doc_id")
    stay = staged(sifted(ids.filter("kept"), odd, "doc_id").select("doc_id"), "stay")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "lang", "source", "n_chars"))
    one = (sifted(docs, stay, "doc_id").withColumn("_row", F.row_number().over(order)).filter("_row = 1")
               .join(stay, "doc_id", "left_semi").select(*docs.columns))
    return unsifted(docs, odd, "doc_id").unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights."""
    return mixing.mixed(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-dedup", drop_copies),
          ("decontamination", drop_contaminated), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
