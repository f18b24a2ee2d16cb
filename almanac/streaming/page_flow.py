"""N3/N5/A12 over a stream of listing pages.

The batch operator (:func:`almanac.operators.frontier.repeated_pages`) numbers
the sightings of a page's link list within its site and finds the page where the
site stops.  On a stream both are remembered across batches:

* how often a (site, link list) was seen is arbitrary state, kept by
  ``transformWithState`` under that pair, so that a site with a third of all
  pages is dealt out by its link lists.  Pages without links, or that could not
  be fetched, need no memory and are dealt out by page;
* the page where a site stops is a row of a keyed table
  (:class:`almanac.sources.keyed.KeyedTable`), upserted with the batch's least
  stopping pages, which are a partial aggregate.

Pages of a site must arrive in the order of their numbers, across batches and in
any order within one, as a crawl fetches them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import fixed
from ..sources.keyed import KeyedTable
from .ingest import _run_batches

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tasks that pages of one site without a link list are dealt to.
SPREAD = 64


class Sightings(StatefulProcessor):
    """Numbers the pages of one (site, link list); remembers how many there
    were, but not beyond ``most``, as all later ones are alike."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        site, signature = key[0], key[1]
        numbered = signature is not None
        n = self.seen.get()[0] if numbered and self.seen.exists() else 0
        # A batch's pages of one link list: numbers only.
        for page, n_links, failed in sorted((r.page, r.n_links, r.failed) for r in rows):
            n = min(n + 1, self.most)
            yield Row(site=site, page=page, n_links=n_links, failed=failed, sighting=n if numbered else None)
        if numbered:
            self.seen.update((n,))

    def close(self) -> None:
        pass


OUTPUT = "site string, page long, n_links int, failed boolean, sighting int"
STOPS = T.StructType([T.StructField("site", T.StringType()), T.StructField("stop_page", T.LongType()),
                      T.StructField("before", T.LongType())])


def stop_table(spark, path: str, buckets: int = 64) -> KeyedTable:
    """Where each site stops: the least page wins (``before`` is its negative)."""
    return KeyedTable(spark, path, STOPS, ["site"], ["before"], buckets)


def repeated_pages_stream(pages: DataFrame, site: str, page: str, links: str, stops: KeyedTable, sink: str, checkpoint: str,
                          threshold: int = fixed.DEFAULT_REPEAT_THRESHOLD, available_now: bool = True, stop=None):
    """Append to ``sink`` what :func:`frontier.repeated_pages` gives for the
    pages of a stream: (site, page, n_links, sighting, is_repeat, stop_reason,
    read, n_yielded), in ``batch_id`` partitions, one row a page.

    A null site is a site like others; a null link list is a page that could not
    be fetched.  A replayed batch replaces its rows, and its stops change
    nothing twice.  The session has to use the RocksDB state store; it is set
    here for the start of the query.
    """
    spark = pages.sparkSession
    failed = F.col(links).isNull()
    n_links = F.when(failed, 0).otherwise(F.size(links))
    p = pages.select(F.col(site).alias("site"), F.col(page).cast("long").alias("page"), n_links.alias("n_links"), failed.alias("failed"),
                     F.when(n_links > 0, F.sha2(F.concat_ws("\n", F.col(links)), 256)).alias("signature"))
    p = p.withColumn("salt", F.when(F.col("signature").isNull(), F.pmod(F.col("page"), F.lit(SPREAD))))
    most = threshold + 2
    counted = p.groupBy("site", "signature", "salt").transformWithState(Sightings(most), OUTPUT, "Append", "None")

    def write_batch(batch: DataFrame, batch_id: int):
        reason = (F.when(F.col("failed"), F.lit(fixed.STOP_ERROR)).when(F.col("n_links") == 0, F.lit(fixed.STOP_NO_LINKS))
                  .when(F.col("sighting") > threshold, F.lit(fixed.STOP_REPEATED)))
        rows = batch.withColumn("stop_reason", reason).persist()  # the state is brought up to the batch once
        try:
            found = rows.where(F.col("stop_reason").isNotNull()).groupBy("site").agg(F.min("page").alias("stop_page"))
            stops.upsert(found.withColumn("before", -F.col("stop_page")), batch_id, writer=checkpoint)
            known = stops.read().select(F.col("site").alias("_site"), "stop_page")
            read = F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page"))
            out = rows.join(known, F.col("site").eqNullSafe(F.col("_site")), "left").select(
                "site", "page", "n_links", "sighting", F.coalesce(F.col("sighting") > 1, F.lit(False)).alias("is_repeat"), "stop_reason",
                read.alias("read"), F.when(read & (F.col("sighting") == 1), F.col("n_links")).otherwise(0).alias("n_yielded"))
            (out.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))
        finally:
            rows.unpersist()

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return _run_batches(counted.writeStream.outputMode("append"), write_batch, checkpoint, available_now, stop)
    finally:
        spark.conf.set(STATE_STORE, before)
