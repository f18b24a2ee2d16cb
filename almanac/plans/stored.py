"""Bindings of the operators that keep tables: record stores bucketed by their
key, keyed tables with upserts, and streams that stop and go on.

As in :mod:`almanac.plans.catalog`, every entry reads whole corpus tables; the
tables that it keeps are written under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import child_paths, shared_path
from ..sources.keyed import KeyedTable
from ..sources.store import RecordStore
from ..sources.tables import table
from . import catalog as C
from . import oracle as O

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def fresh(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------ JN3/JN4/W6 record store --

STORE_BUCKETS = 16


def _document_store(spark: SparkSession, sf: str) -> RecordStore:
    """The labelled documents as records of two earlier runs."""
    records = C._doc_existing(spark, sf)
    store = RecordStore(spark, fresh(spark, "records"), records.schema, "doc_id", STORE_BUCKETS)
    store.append(records.where("stored_is_alumni"))
    store.append(records.where("stored_is_alumni IS DISTINCT FROM true"))
    return store


@register("stored_admit_new", O.ORACLE["admit_new"])
def q_stored_admit_new(spark, sf):
    """JN3 anti join against a bucketed record store."""
    from ..operators.admit import split_existing
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return split_existing(docs, _document_store(spark, sf).read(), "doc_id")[0]


@register("stored_admit_duplicates", O.ORACLE["admit_duplicates"])
def q_stored_admit_duplicates(spark, sf):
    """JN3 semi join against a bucketed record store."""
    from ..operators.admit import split_existing
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return split_existing(docs, _document_store(spark, sf).read(), "doc_id")[1]


@register("stored_outcomes", O.ORACLE["outcomes"])
def q_stored_outcomes(spark, sf):
    """T1 + JN4 against a bucketed record store: outcome rows carry what is
    stored, and the store is joined where it lies."""
    from ..operators.admit import outcomes
    out = outcomes(C._doc_candidates(spark, sf), _document_store(spark, sf).read(), C._doc_sites(spark, sf),
                   C._gazetteer(spark, sf), key="doc_id", url_col="url", body_col="body", mode="simple",
                   keywords=C.DOC_SIMPLE_KEYWORDS)
    return out.select("doc_id", "url", "status", "reason", "name", "is_alumni", "institution", "city", "province",
                      "latitude", "longitude", "tags")


@register("stored_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def q_stored_lookup(spark, sf):
    """One record by id out of a store bucketed by it; one bucket is read."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    store = RecordStore(spark, fresh(spark, "records"), c.schema, "c_custkey", STORE_BUCKETS)
    store.append(c)
    return store.lookup(7)


# ----------------------------------------------- T5/R1/R3/R4/R6 streaming --

#: Batches that a corpus table arrives in, and those that a first run reads.
ARRIVALS, FIRST_RUN = 6, 2


def landed(spark: SparkSession, rows: DataFrame, by: str, batches: int = ARRIVALS) -> DataFrame:
    """``rows`` as a stream of files, an equal share of them a batch, however
    many tasks wrote them."""
    from ..streaming.ingest import file_stream
    path = fresh(spark, "landing")
    rows.repartitionByRange(max(batches, int(spark.conf.get("spark.sql.shuffle.partitions"))), by).write.parquet(path)
    files = sum(p.endswith(".parquet") for p in child_paths(spark, path))
    return file_stream(spark, path, rows.schema, max_files_per_trigger=max(1, -(-files // batches)))


def _state_events(e: DataFrame) -> DataFrame:
    """Progress events: page and URL reached, and why a page stopped."""
    from ..operators.ledger import state_from_reason
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/obituary/"),
                   F.col("event_id").cast("string"))
    reason = (F.when(F.col("event_type") == "error", F.lit("error"))
              .when(F.col("event_type") == "click", F.lit("repeated_page"))
              .when(F.col("event_type") == "purchase", F.lit("no_links")))
    return e.select("user_id", "event_type", "ts", "event_id", F.floor("value").cast("int").alias("page_number"),
                    url.alias("last_processed_url"), state_from_reason(reason).alias("status"), F.col("ts").alias("updated_at"))


def _two_runs(start) -> None:
    """A run that is asked to stop after its first batches, and one that goes
    on from there; ``start(stop)`` begins a run."""
    from ..streaming.ingest import batches_done
    start(batches_done(FIRST_RUN))
    start(None)


@register("upsert_counters", O.ORACLE["run_counters"])
def q_upsert_counters(spark, sf):
    """R3 in update mode over several batches and two runs: the counters of the
    runs that a batch changed are upserted."""
    from ..operators.ledger import run_counters
    from ..streaming.ingest import upsert_table
    e = C._event_outcomes(spark, sf)
    agg = run_counters(landed(spark, e, "event_id"), "user_id", error="props", order=F.struct("ts", "event_id"))
    path = fresh(spark, "counters")
    counters = KeyedTable(spark, f"{path}/table", agg.schema, ["user_id"], buckets=16)
    _two_runs(lambda stop: upsert_table(agg, counters, f"{path}/checkpoint", stop=stop))
    return counters.read()


@register("upsert_state", O.ORACLE["latest_state"])
def q_upsert_state(spark, sf):
    """R4 in update mode over several batches and two runs."""
    from ..operators.ledger import latest_state
    from ..streaming.ingest import upsert_table
    events = landed(spark, table(spark, sf, "events"), "event_id")
    agg = latest_state(_state_events(events), ["user_id", "event_type"], ["ts", "event_id"])
    path = fresh(spark, "state")
    state = KeyedTable(spark, f"{path}/table", agg.schema, ["user_id", "event_type"], buckets=16)
    _two_runs(lambda stop: upsert_table(agg, state, f"{path}/checkpoint", stop=stop))
    return state.read().withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@register("upserted_progress", O.ORACLE["latest_state"])
def q_upserted_progress(spark, sf):
    """T5 in batches: progress events are upserted by key, the latest by time
    wins, whatever the order of the batches."""
    e = _state_events(table(spark, sf, "events"))
    state = KeyedTable(spark, fresh(spark, "progress"), e.schema, ["user_id", "event_type"], ["ts", "event_id"], buckets=16)
    halves = F.col("event_type").isin("error", "purchase")
    late = F.col("page_number") >= 20
    for part in (late & halves, late & ~halves, ~late | late.isNull()):
        state.upsert(e.where(part))
    return state.read().select("user_id", "event_type", "page_number", "last_processed_url", "status",
                               F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@register("resumed_ingest", "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def q_resumed_ingest(spark, sf):
    """A run that is stopped between its batches and one that goes on from
    the checkpoint give every row once."""
    from ..streaming.ingest import append_batches
    events = landed(spark, table(spark, sf, "events"), "event_id")
    path = fresh(spark, "ingest")
    _two_runs(lambda stop: append_batches(events, f"{path}/sink", f"{path}/checkpoint", stop=stop))
    return spark.read.parquet(f"{path}/sink").select("event_id", "user_id", "event_type",
                                                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register("successive_runs", """
SELECT run, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id
FROM (SELECT event_id, dense_rank() OVER (ORDER BY (day(ts) - 1) // 7) - 1 AS run FROM events) GROUP BY run""")
def q_successive_runs(spark, sf):
    """What arrives in a period (here a week) is read by a run of its own
    over one checkpoint; each run takes up what the ones before it left."""
    from ..streaming.ingest import append_batches, file_stream
    e = table(spark, sf, "events").withColumn("period", ((F.dayofmonth("ts") - 1) / 7).cast("int"))
    path = fresh(spark, "periods")
    for run, row in enumerate(e.select("period").distinct().orderBy("period").collect()):  # at most five
        e.where(F.col("period").eqNullSafe(row.period)).write.mode("append").parquet(f"{path}/landing")
        stream = file_stream(spark, f"{path}/landing", e.schema).withColumn("run", F.lit(run))
        append_batches(stream, f"{path}/sink", f"{path}/checkpoint")
    return (spark.read.parquet(f"{path}/sink").groupBy(F.col("run").cast("long").alias("run"))
                 .agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")))


@register("stream_current_month", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders
WHERE strftime(o_orderdate, '%Y-%m') = '2001-07'""")
def q_stream_current_month(spark, sf):
    """Rows of the month of a given day, from a stream."""
    from ..streaming.ingest import append_batches, current_month_only
    orders = landed(spark, table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", batches=3)
    path = fresh(spark, "month")
    append_batches(current_month_only(orders, "o_orderdate", C.STALE_AS_OF), f"{path}/sink", f"{path}/checkpoint")
    sink = spark.read.schema("o_orderkey long, o_orderdate timestamp").parquet(f"{path}/sink")
    return sink.select("o_orderkey", C._day("o_orderdate").alias("order_date"))


# ------------------------------------------------------- T8, JN9 --

@register("run_totals", "WITH " + O._OUTCOMES + """,
done AS (SELECT count(*) AS n FROM (SELECT user_id, event_type, arg_max(event_type, (ts, event_id)) AS last FROM events
                                    GROUP BY user_id, event_type) WHERE last = 'purchase')
SELECT 9 AS id, 'stopped' AS status, '2024-02-01 00:00:00' AS started_at, '2024-02-01 01:00:00' AS finished_at,
       CAST(count(*) FILTER (status = 'saved') AS BIGINT) AS saved_count,
       CAST(count(*) FILTER (status = 'skipped') + (SELECT n FROM done) AS BIGINT) AS skipped_count,
       CAST(count(*) FILTER (status = 'duplicate')
            + (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS BIGINT) AS duplicate_count,
       CAST(NULL AS VARCHAR) AS error_message
FROM oc""")
def q_run_totals(spark, sf):
    """T8 + T12: the row of one run, out of its outcomes, the URLs that were
    found stored, and the plan keys that were skipped as completed."""
    from ..operators.ledger import latest_state, run_totals
    from ..operators.admit import split_existing
    stored = split_existing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")[1]
    state = latest_state(_state_events(table(spark, sf, "events")), ["user_id", "event_type"], ["ts", "event_id"])
    row = run_totals(9, C._outcomes(spark, sf), stored, state.where("status = 'completed'"), stopped=True,
                     started_at="2024-02-01 00:00:00", finished_at="2024-02-01 01:00:00")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return row.select("id", "status", stamp("started_at"), stamp("finished_at"), "saved_count", "skipped_count", "duplicate_count", "error_message")


@register("site_requests", rf"""
WITH s AS (SELECT DISTINCT lower(split_part(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '.', 1)) AS site FROM pages
           WHERE regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) <> ''),
g AS (SELECT site, page FROM s, unnest([1, 2, 3]) AS p(page))
SELECT site, 'notice & co' AS keyword, page,
       'https://' || site || '.remembering.ca/obituaries/obituaries/search?limit=125&search_type=advanced&ap_search_keyword='
       || 'notice+%26+co&sort_by=date&order=desc' || CASE WHEN page > 1 THEN '&p=' || page ELSE '' END AS search_url,
       'https://' || site || '.remembering.ca/obituaries/obituaries/search?limit=125'
       || CASE WHEN page > 1 THEN '&p=' || page ELSE '' END AS listing_url
FROM g""")
def q_site_requests(spark, sf):
    """JN9 + F16 over all sites of the page table."""
    from ..operators.frontier import request_grid
    sites = table(spark, sf, "pages").select(T.host_label("url").alias("site")).where("site IS NOT NULL").distinct()
    return request_grid(sites, "site", ["notice & co"], max_pages=3)


# ----------------------------------------------- M1/JN6 keyword index --

def _document_index(spark, sf):
    from ..operators import keyword_index as K
    path = fresh(spark, "words")
    K.build(table(spark, sf, "documents"), "doc_id", "text", path)
    return K.Index(spark, path)


@register("indexed_occurrences", O.ORACLE["keyword_occurrences"])
def q_indexed_occurrences(spark, sf):
    """M1 by the positional index."""
    from pyspark.sql import Window
    found = _document_index(spark, sf).occurrences(C.DOC_INSTITUTIONS + C.DOC_STATUSES)
    order = Window.partitionBy("doc").orderBy("start", "rank")
    return found.select(F.col("doc").alias("doc_id"), F.row_number().over(order).alias("ordinal"), "start", "end", "keyword")


@register("indexed_proximity", O.ORACLE["proximity_match"])
def q_indexed_proximity(spark, sf):
    """M2 + JN6 by the positional index and binned pairs."""
    from ..operators import keyword_index as K
    d = K.proximity_match(table(spark, sf, "documents"), _document_index(spark, sf), "doc_id", "text", "m",
                          C.DOC_INSTITUTIONS, C.DOC_STATUSES, window=C.DOC_WINDOW)
    m = F.col("m")
    return d.select("doc_id", m.isNotNull().alias("is_match"), m["institution"].alias("institution"), m["status"].alias("status"),
                    m["matched_text"].alias("matched_text"))


@register("indexed_phrases", rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{O._RE2_WS}', ' ', 'g')) AS t FROM documents),
b AS (SELECT trim(regexp_replace(coalesce(text, ''), '{O._RE2_WS}', ' ', 'g')) AS t FROM benchmark),
k AS (SELECT DISTINCT regexp_extract(t, '^\pL+ \pL+ \pL+') AS phrase FROM b),
hits AS (
  SELECT doc_id, phrase, lower(t) AS t, lower(phrase) AS p, unnest(range(1, length(t) - length(phrase) + 2)) AS place
  FROM d, k WHERE phrase <> '' AND contains(lower(t), lower(phrase)))
SELECT phrase AS keyword, count(*) AS n_places, count(DISTINCT doc_id) AS n_docs FROM hits
WHERE substr(t, place, length(p)) = p AND (place = 1 OR NOT regexp_matches(substr(t, place - 1, 1), '^{O._RE2_WORD}$'))
  AND (place + length(p) > length(t) OR NOT regexp_matches(substr(t, place + length(p), 1), '^{O._RE2_WORD}$'))
GROUP BY phrase""")
def q_indexed_phrases(spark, sf):
    """M1 with a keyword for every benchmark item (its first three words)."""
    first = F.regexp_extract(T.collapse_ws("text"), r"^\p{L}+ \p{L}+ \p{L}+", 0)
    phrases = table(spark, sf, "benchmark").select(first.alias("p")).where("p <> ''").distinct()
    words = [r.p for r in phrases.collect()]  # a job's keyword list
    return (_document_index(spark, sf).occurrences(words).groupBy("keyword")
            .agg(F.count("*").alias("n_places"), F.countDistinct("doc").alias("n_docs")))


# ------------------------------------------------ N3/N5/A12 page stream --

@register("stream_repeated_pages", O.ORACLE["repeated_pages"])
def q_stream_repeated_pages(spark, sf):
    """N3 + N5 + A12 over a stream: pages arrive in page order in four parts,
    each read by a run of its own; sightings and stops are kept between them."""
    from ..functions import html as H
    from ..streaming.ingest import file_stream
    from ..streaming.page_flow import repeated_pages_stream, stop_table
    pages = table(spark, sf, "pages").select(
        "page_id", T.host_label("url").alias("site"), H.absolute_links("html", "url", C.LINK_PREFIX).alias("links"))
    path = fresh(spark, "pageflow")
    stops = stop_table(spark, f"{path}/stops", buckets=16)
    first, last = table(spark, sf, "pages").agg(F.min("page_id"), F.max("page_id")).first()
    width = (last - first) // 4 + 1
    for i in range(4):
        part = pages.where(F.col("page_id").between(first + i * width, first + (i + 1) * width - 1))
        part.write.mode("append").parquet(f"{path}/landing")
        repeated_pages_stream(file_stream(spark, f"{path}/landing", pages.schema), "site", "page_id", "links", stops,
                              f"{path}/sink", f"{path}/checkpoint", threshold=C.REPEAT_THRESHOLD)
    return spark.read.parquet(f"{path}/sink").drop("batch_id").withColumnRenamed("page", "page_id")


# --------------------------------------------------- W2/W4 substring index --

@register("indexed_search", O.ORACLE["faceted_search"])
def q_indexed_search(spark, sf):
    """W1-W5 by 3-gram lists: the search of ``faceted_search``."""
    from ..operators import search_index as S
    path, columns = fresh(spark, "grams"), ["c_name", "c_mktsegment", "city", "body"]
    S.build(C.customer_records(spark, sf), path, "c_custkey", columns)
    out = S.SearchIndex(spark, path, "c_custkey", columns).search(
        first_name="customer#0000", city="a", query="build", flag="flag", first_col="c_name", last_col="c_mktsegment",
        city_col="city", province_col="province", body_col="body")
    return out.select("c_custkey", "c_name", "c_mktsegment", "city", "province")


@register("indexed_body_search", """
SELECT doc_id, lang, source FROM documents
WHERE n_chars > 0 AND (lang ILIKE '%apache%lic_nse, version%' OR source ILIKE '%apache%lic_nse, version%'
                       OR text ILIKE '%apache%lic_nse, version%')""")
def q_indexed_body_search(spark, sf):
    """W4 over whole documents by 3-gram lists; wildcards stay wildcards."""
    from ..operators import search_index as S
    path, columns = fresh(spark, "grams"), ["lang", "source", "text"]
    docs = table(spark, sf, "documents").withColumn("flag", F.col("n_chars") > 0).withColumn("city", F.col("source"))
    S.build(docs, path, "doc_id", columns)
    out = S.SearchIndex(spark, path, "doc_id", columns).search(
        query="apache%lic_nse, version", flag="flag", first_col="lang", last_col="source", city_col="city",
        province_col="city", body_col="text")
    return out.select("doc_id", "lang", "source")


# ------------------------------------------------------ A1-A3 by sketches --

@register("sketched_counts", """
SELECT year(o_orderdate) AS year, COUNT(*) AS total_records, COUNT(DISTINCT o_custkey) AS total_names,
       COUNT(DISTINCT nullif(o_orderpriority, '')) AS total_cities, true AS names_within, true AS cities_within
FROM orders GROUP BY 1""")
def q_sketched_counts(spark, sf):
    """A1-A3 a year from sketches of its days, kept as a table that two runs
    append to: exact counts, and whether the merged estimates are within the
    error bound of them."""
    from ..operators import sketches as K
    orders, path = table(spark, sf, "orders"), fresh(spark, "sketches")
    names = {"names": "o_custkey", "cities": "o_orderpriority"}
    for part in (F.col("o_orderstatus") == "F", ~F.col("o_orderstatus").eqNullSafe("F")):
        K.day_sketches(orders.where(part), "o_orderdate", names, blank=False).write.mode("append").parquet(path)
    found = K.merged_counts(spark.read.parquet(path), list(names), {"year": F.year("day")})
    exact = orders.groupBy(F.year("o_orderdate").alias("_year")).agg(
        F.count(F.lit(1)).alias("total_records"), F.countDistinct("o_custkey").alias("total_names"),
        F.countDistinct(F.nullif("o_orderpriority", F.lit(""))).alias("total_cities"))
    both = found.join(exact, F.col("year").eqNullSafe(F.col("_year")), "full_outer").where("n_rows = total_records")
    return both.select("year", "total_records", "total_names", "total_cities",
                       K.within_bound("names", "total_names").alias("names_within"),
                       K.within_bound("cities", "total_cities").alias("cities_within"))


# ----------------------------------------- T1/T2/T12 a run that is stopped --

STOP_AT, SECOND_LATER = 900_000, 50_000


def _customer_pages(c: DataFrame) -> DataFrame:
    """Customers as notice pages at a position of the run, by their balance,
    and every tenth once more, later and with another name.  The
    name stands in one of the three places that the extractor looks in."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("Ines Kolb"), key.cast("string"))
    heading = (F.when(key % 11 == 0, F.lit(""))
               .when(key % 3 == 0, F.concat(F.lit('<h1 class="obit-name">Ines KOLB'), key.cast("string"),
                                            F.lit('</h1><span class="obit-lastname-upper">KOLB'), key.cast("string"), F.lit("</span>")))
               .when(key % 3 == 1, F.concat(F.lit('<p data-testid="desktop-menu-fullname">'), name, F.lit("</p>")))
               .otherwise(F.concat(F.lit("<title>"), name, F.lit(" Obituary | Gazette</title>"))))
    study = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
                   F.lit("Ferry captain and graduate of the University of Windsor.")).otherwise(F.lit("Kept bees &amp; sang."))
    html = F.concat(heading, F.lit('<div class="details-published">Published online May '),
                    (key % 28 + 1).cast("string"), F.lit(', 2025</div><span class="details-copy">'), study, F.lit("</span>"))
    url = F.concat(F.lit("https://src"), F.col("c_nationkey").cast("string"), F.lit(".example.com/obituary/"), key.cast("string"))
    position = F.round(F.col("c_acctbal") * 100).cast("long")
    first = c.select(url.alias("url"), html.alias("html"), position.alias("position"))
    later = c.where(key % 10 == 0).select(url.alias("url"), F.lit("<h1>Other Page</h1>").alias("html"),
                                          (position + SECOND_LATER).alias("position"))
    return first.unionByName(later)


@register("record_run", f"""
WITH p AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, CAST(round(c_acctbal * 100) AS BIGINT) AS pos, 1 AS s FROM customer
           UNION ALL
           SELECT c_custkey, c_nationkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) + {SECOND_LATER}, 2 FROM customer WHERE c_custkey % 10 = 0),
g AS (SELECT p.*, n_name AS place,
             CASE WHEN pos >= {STOP_AT} THEN 'stop_requested' WHEN s = 2 THEN 'already_visited'
                  WHEN k % 11 = 0 THEN 'missing_name' WHEN m NOT IN ('BUILDING', 'MACHINERY') THEN 'no_alumni_keyword'
                  WHEN k % 7 = 0 THEN 'existing_url' WHEN n_name IS NULL THEN 'unknown_city' END AS reason
      FROM p LEFT JOIN nation ON n_nationkey = n AND n_nationkey % 5 <> 0)
SELECT 'https://src' || n || '.example.com/obituary/' || k AS url,
       CASE reason WHEN 'stop_requested' THEN 'stopped' WHEN 'existing_url' THEN 'duplicate' ELSE
            CASE WHEN reason IS NULL THEN 'saved' ELSE 'skipped' END END AS status, reason,
       CASE WHEN reason IN ('stop_requested', 'already_visited', 'missing_name') THEN NULL
            WHEN reason = 'existing_url' THEN 'Stored ' || k ELSE 'Ines Kolb' || k END AS name,
       CASE WHEN reason IN ('stop_requested', 'already_visited') THEN NULL ELSE place END AS city,
       CASE WHEN reason IN ('stop_requested', 'already_visited') THEN NULL
            ELSE 'May ' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || ', 2025' END AS publication_text
FROM g""")
def q_record_run(spark, sf):
    """T1 + T2 + T12 with P2, P3, P7, P8 and P11: a run over notice pages of
    all customers, stopped on its way; the first sighting of a URL counts."""
    from ..operators.records import process_notices
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    stored = c.where(key % 7 == 0).select(
        F.concat(F.lit("https://src"), F.col("c_nationkey").cast("string"), F.lit(".example.com/obituary/"),
                 key.cast("string")).alias("obituary_url"),
        F.concat(F.lit("Stored "), key.cast("string")).alias("name"), F.lit(True).alias("is_alumni"), F.lit("new").alias("tags"))
    sites = (table(spark, sf, "nation").where("n_nationkey % 5 <> 0")
             .select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("subdomain"),
                     F.col("n_name").alias("city"), F.lit("Ontario").alias("province")))
    places = sites.select("city", "province", F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    out, _ = process_notices(_customer_pages(c), stored, sites, places, order_col="position", stop_at=STOP_AT)
    return out.select("url", "status", "reason", "name", "city", "publication_text")


# ------------------------------------------------------ S7 export in parts --

@register("exported_lines", """
SELECT o_orderkey || ',"' || o_orderstatus || ', ""' || o_orderpriority || '""' || '"' AS line, true AS in_order
FROM orders UNION ALL SELECT 'id,note', true""")
def q_exported_lines(spark, sf):
    """S7 over all orders: the lines of the parts, and whether each part keeps
    to its range, titles before all.  Spark's reader leaves out the BOM, which
    is tested on the bytes."""
    from ..operators.export import write_csv_parts
    path = fresh(spark, "export")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"')).alias("note"))
    write_csv_parts(rows, path + "/parts", [F.desc("_cells.id")], path + "/manifest")
    lines = (spark.read.option("lineSep", "\r\n").text(path + "/parts")
                  .select(F.col("value").alias("line"), F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("part"),
                          F.regexp_extract("value", r"^(\d+)", 1).try_cast("long").alias("id")))
    ranges = lines.groupBy("part").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count_if(F.col("id").isNull()).alias("titles"))
    at = spark.read.parquet(path + "/manifest").select("position", F.substring_index("part", "/", -1).alias("part"))
    before = ranges.join(at, "part")  # a row a part
    after = before.select((F.col("position") - 1).alias("position"), F.col("most").alias("next"))
    kept = before.join(after, "position", "left").select(
        "part", (F.coalesce(F.col("least") > F.col("next"), F.lit(True))
                 & (F.col("titles") == F.when(F.col("position") == 0, 1).otherwise(0))).alias("in_order"))
    return lines.join(kept, "part").select("line", "in_order")
