"""W2/W4 by posting lists of 3-grams: substring search without reading every body.

:func:`build` keeps the records in hash buckets of their id, and for each
searched column the records that each 3-gram of its lower-cased text stands in.
A search takes the runs of three and more literal characters of its terms,
intersects the lists of their rarest 3-grams, reads the buckets that the ids left
over lie in, and puts the exact ``ILIKE`` to those records only
(:func:`almanac.operators.serve.search`).  A term without such a run, as ``%a_b%``
or ``ab``, asks nothing of the lists; if no term has one, the records are filtered
as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_shares
from . import serve

GRAM = 3
#: Lists that a term is looked up in: its rarest ones.
LISTS = 4
BUCKETS = 64
#: Characters that a task makes grams of, each a row at most: some 500 MB to sort.
TASK_CHARS = 8_000_000


def literal_runs(term: str) -> list[str]:
    """The runs of literal characters of a search term: what stands between
    the wildcards ``%`` and ``_``, with escapes undone."""
    runs, now, escaped = [], "", False
    for c in serve.like_literal(term.strip()):
        if escaped:
            now, escaped = now + c, False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            runs.append(now)
            now = ""
        else:
            now += c
    return [r for r in (*runs, now) if r]


def with_grams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the distinct 3-grams of a lower-cased text.  They are cut from an
    array of its characters, a column of its own: inside the function it would
    be made anew for each place, and cutting a long text at a place walks all
    of it."""
    chars = F.col("_chars")
    places = F.sequence(F.lit(1), F.greatest(F.size(chars) - (GRAM - 1), F.lit(1)))
    cut = F.transform(places, lambda i: F.concat(*[F.element_at(chars, i + d) for d in range(GRAM)]))
    grams = F.when(F.size(chars) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_chars", F.split(F.lower(F.col(text)), "")).withColumn(out, grams).drop("_chars")


def _bucket(c) -> F.Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def build(records: DataFrame, path: str, id_col: str, columns: list[str]) -> None:
    """Write the index of ``columns`` of ``records``; null texts have no
    grams.  Rows that share an id are found together."""
    records.withColumn("_b", _bucket(id_col)).repartition("_b").write.partitionBy("_b").parquet(f"{path}/records")
    of = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").alias("text")) for i, c in enumerate(columns)]))
    texts = records.select(F.col(id_col).alias("id"), of.alias("c")).select("id", "c.column", "c.text").where("text IS NOT NULL")
    # An outer explode: a plain one lets the optimizer ask for the array's size first, which makes it twice.
    # A scan's split of packed short texts makes rows a hundred times its size: texts are dealt
    # out by their characters, so that what a task sorts does not grow with the table.
    texts = in_shares(texts, "text", TASK_CHARS, "id", "column")
    posts = (with_grams(texts, "text", "grams").select("id", "column", F.explode_outer("grams").alias("gram"))
             .where("gram IS NOT NULL").withColumn("_g", _bucket("gram")))
    # Each task writes its own part of every list: the lists are too much to shuffle.
    posts.sortWithinPartitions("_g", "gram").write.partitionBy("_g").parquet(f"{path}/postings")
    sizes = SearchIndex(records.sparkSession, path, id_col, columns).postings().groupBy("_g", "column", "gram").agg(F.count("*").alias("n"))
    sizes.repartition("_g").write.partitionBy("_g").parquet(f"{path}/sizes")


class SearchIndex:
    """An index that :func:`build` wrote, of the same columns."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, columns: list[str]):
        self.spark, self.path, self.id_col, self.columns = spark, path, id_col, list(columns)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    def _of(self, table: DataFrame, grams: list[str]) -> DataFrame:
        """The rows of ``grams``, out of their buckets only."""
        listed = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        buckets = [r[0] for r in listed.select(_bucket("gram")).distinct().collect()]
        return table.where(F.col("_g").isin(buckets) & F.col("gram").isin(grams))

    def candidates(self, facets: list[tuple[list[str], str]]) -> DataFrame | None:
        """(id): records that can hold, for each facet (columns, term), the
        term in one of the columns; None if the lists can't tell."""
        asked = {}
        for columns, term in facets:
            # Lower-cased by Spark, as the texts were.
            runs = [r for r in literal_runs(term) if len(r) >= GRAM]
            if runs:
                low = with_grams(self.spark.createDataFrame([(r,) for r in runs], "r string"), "r", "g").collect()
                grams = sorted({g for row in low for g in row.g})
                if grams:
                    asked[tuple(self.columns.index(c) for c in columns), term] = grams
        if not asked:
            return None
        every = sorted({g for grams in asked.values() for g in grams})
        sizes = {(r.column, r.gram): r.n for r in self._of(self.spark.read.parquet(f"{self.path}/sizes"), every).collect()}
        conditions, wanted, counts = [], set(), []
        for (columns, _), grams in asked.items():
            either = []
            for c in columns:
                if all((c, g) in sizes for g in grams):  # else no record has it there
                    rarest = sorted(grams, key=lambda g: (sizes[c, g], g))[:LISTS]
                    wanted |= {(c, g) for g in rarest}
                    name = f"n{len(counts)}"
                    counts.append(F.count_if((F.col("column") == c) & F.col("gram").isin(rarest)).alias(name))
                    # At least: rows that share an id have a row each in a list.
                    either.append(F.col(name) >= len(rarest))
            conditions.append(reduce(lambda a, b: a | b, either, F.lit(False)))
        if not wanted:
            return self.postings().limit(0).select("id")
        pairs = reduce(lambda a, b: a | b, [(F.col("column") == c) & (F.col("gram") == g) for c, g in sorted(wanted)])
        found = self._of(self.postings(), sorted({g for _, g in wanted})).where(pairs).groupBy("id")
        return found.agg(*counts).where(reduce(lambda a, b: a & b, conditions)).select("id")

    def search(self, *, first_name=None, last_name=None, city=None, province=None, query=None, flag="is_alumni", first_col="first_name",
               last_col="last_name", city_col="city", province_col="province", body_col="family_information") -> DataFrame:
        """W1-W5 + O1 with the rows and order of :func:`serve.search`."""
        facets = [([c], term) for c, term in ((first_col, first_name), (last_col, last_name), (city_col, city)) if (term or "").strip()]
        if (query or "").strip():
            facets.append(([first_col, last_col, body_col], query))
        rows, ids = self.records(), self.candidates(facets)
        if ids is not None:
            ids = ids.withColumn("_b", _bucket("id")).persist()
            buckets = [r[0] for r in ids.select("_b").distinct().collect()]  # at most BUCKETS
            rows = rows.where(F.col("_b").isin(buckets)).join(ids.select(F.col("id").alias(self.id_col)), self.id_col, "left_semi")
        return serve.search(rows.drop("_b"), first_name=first_name, last_name=last_name, city=city, province=province, query=query,
                            flag=flag, first_col=first_col, last_col=last_col, city_col=city_col, province_col=province_col,
                            body_col=body_col, id_col=self.id_col)
