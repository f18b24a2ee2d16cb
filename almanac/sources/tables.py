"""Table sources (S1-S3) and record/ledger schemas.

Reads are plain Parquet scans so Catalyst can prune columns and push
filters into the reader; nothing here triggers an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of the corpus directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Record table (both the stored and the serving copy).
RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tags", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("first_name", T.StringType(), True),
    T.StructField("last_name", T.StringType(), True),
    T.StructField("birth_date", T.StringType(), True),
    T.StructField("death_date", T.StringType(), True),
    T.StructField("publication_date", T.TimestampType(), True),
    T.StructField("obituary_url", T.StringType(), False),
    T.StructField("family_information", T.StringType(), True),
    T.StructField("donation_information", T.StringType(), True),
    T.StructField("is_alumni", T.BooleanType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("province", T.StringType(), True),
    T.StructField("funeral_home", T.StringType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
])

# Progress state, unique on (subdomain, search_keyword).
CRAWL_STATE_SCHEMA = T.StructType([
    T.StructField("subdomain", T.StringType(), False),
    T.StructField("search_keyword", T.StringType(), False),
    T.StructField("page_number", T.IntegerType(), True),
    T.StructField("last_processed_url", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

# Run ledger.
RUN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), True),
    T.StructField("finished_at", T.TimestampType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("search_keyword", T.StringType(), True),
    T.StructField("page_number", T.IntegerType(), True),
    T.StructField("saved_count", T.LongType(), False),
    T.StructField("skipped_count", T.LongType(), False),
    T.StructField("duplicate_count", T.LongType(), False),
    T.StructField("error_message", T.StringType(), True),
])

PAGE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("html", T.StringType(), True),
])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """S2 scan with the declared schema (no inference)."""
    return spark.read.schema(RECORD_SCHEMA).parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    """S2 append; callers admit rows first (J4) so URLs stay unique."""
    df.select(*[f.name for f in RECORD_SCHEMA.fields]).write.mode("append").parquet(path)


def backfill_tags(df: DataFrame, default: str = "new") -> DataFrame:
    """S10 data effect: tags NULL -> 'new'."""
    return df.withColumn("tags", F.coalesce(F.col("tags"), F.lit(default)))
