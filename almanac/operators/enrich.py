"""J3 enrichment: dimension lookups by left joins.

Both dimensions are small by nature (one row per site, one per place).
Spark broadcasts them from the sizes it knows, in bytes; nothing is counted
here while a query is being built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T



def with_site(df: DataFrame, url_col: str, sites: DataFrame, subdomain_col: str = "subdomain") -> DataFrame:
    """F15 + JN1: add ``subdomain`` (first host label, lower-cased) and the
    site's city and province; at most one match per row, unmatched -> NULL."""
    sites = sites.dropDuplicates([subdomain_col]).withColumnRenamed(subdomain_col, "_site_key")
    keyed = df.withColumn(subdomain_col, T.host_label(url_col))
    return (keyed.join(sites, F.col(subdomain_col) == F.col("_site_key"), "left")
                 .drop("_site_key"))


def with_coordinates(df: DataFrame, gazetteer: DataFrame, city="city", province="province",
                     lat="latitude", lon="longitude") -> DataFrame:
    """JN2: (city, province) -> (latitude, longitude); NULL, NULL on a miss."""
    g = (gazetteer.dropDuplicates([city, province])
         .select(F.col(city).alias("_g_city"), F.col(province).alias("_g_prov"),
                 F.col(lat).alias(lat), F.col(lon).alias(lon)))
    cond = (F.col(city) == F.col("_g_city")) & (F.col(province) == F.col("_g_prov"))
    return df.join(g, cond, "left").drop("_g_city", "_g_prov")


def site_dimension(spark, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """A site table from a caller-supplied mapping subdomain -> (city,
    province)."""
    rows = [(k.lower(), v[0], v[1]) for k, v in mapping.items()]
    return spark.createDataFrame(rows, "subdomain string, city string, province string")
