"""M1/JN6 over a positional index: any number of keywords without a pass each.

:func:`build` writes one row per word of every text: its place among the words,
its span, and what stands between it and its neighbours.  A keyword is then a
run of words and of what stands between them.  Its rarest word is looked up, the
other words are looked up at the places where they would have to be, and the run
is verified word by word; the text itself is not read.  Pairs of occurrences
within a window are a join on (document, bin of the position), where a row meets
only what its window can reach.

The rows are the same as those of :mod:`almanac.functions.match`, whose patterns
ask the same: the keyword's own words, whole, in any case, with white space
between them.

The index is partitioned by a hash of the word, so that a search reads the
buckets of its words.  It is written without a shuffle of its rows, a file of a bucket
for each task, so that a word with a third of all rows is no single task's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import match as M
from ..functions import text as T
from ..session import in_shares
from ..sources import fixed

WORD = r"(?U)\w+"
BUCKETS = 64
#: Characters that a task cuts into words, a row each: some 500 MB to sort.
TASK_CHARS = 16_000_000
#: Rows of a keyword list that is sent to every task (some MB); a longer list
#: is joined by a shuffle.
SENT_ROWS = 100_000


def fold(word) -> Column:
    """The word as a case-insensitive pattern sees it: each character by
    itself to upper and then to lower case (so a sharp s is no double s)."""
    c = F.col(word) if isinstance(word, str) else word

    def one(x: Column) -> Column:
        upper = F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
        return F.substring(F.lower(upper), 1, 1)
    slow = F.array_join(F.transform(F.split(c, ""), one), "")
    return F.when(F.octet_length(c) > F.length(c), slow).otherwise(F.lower(c))


def words_of(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words`` (as written), ``gaps`` (what stands before each word, and
    after the last)."""
    return (df.withColumn("words", F.regexp_extract_all(F.col(text), F.lit(WORD), 0))
              .withColumn("gaps", F.split(F.col(text), WORD, -1)))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, word, start, end, before, after, last): the words of the
    white-space-normalised texts.  Texts without a word, and null texts, have
    no rows."""
    df = docs.select(F.col(id_col).alias("doc"), T.collapse_ws(text_col).alias("_t"))
    df = words_of(df, "_t").drop("_t").where(F.size("words") > 0)
    df = df.withColumn("_steps", F.zip_with(F.slice("gaps", F.lit(1), F.size("words")), F.col("words"),
                                            lambda g, w: F.length(g) + F.length(w)))
    df = M._with_running_ends(df, "_steps", "_ends").drop("_steps")
    n = F.size("words")
    rows = F.transform("words", lambda w, i: F.struct(
        w.alias("raw"), F.element_at("_ends", i + 1).alias("end"), F.element_at("gaps", i + 1).alias("before"),
        F.element_at("gaps", i + 2).alias("after"), (i == n - 1).alias("last")))
    df = df.select("doc", F.posexplode(rows).alias("pos", "w"))
    return df.select("doc", "pos", fold("w.raw").alias("word"), (F.col("w.end") - F.length("w.raw")).alias("start"),
                     F.col("w.end").alias("end"), F.col("w.before").alias("before"), F.col("w.after").alias("after"),
                     F.col("w.last").alias("last"))


def _bucket(word) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Write the index of ``docs`` to ``path``.  The id must be unique: rows
    that share one would be one text."""
    # Texts are dealt out by their characters: the rows of a scan's split are
    # many times its size and would be sorted on disk.
    shares = in_shares(docs.select(id_col, text_col), text_col, TASK_CHARS, id_col)
    rows = positions(shares, id_col, text_col).withColumn("bucket", _bucket("word"))
    # Each task writes the buckets of its own texts: a row for every word is
    # too much to shuffle.
    rows.sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class Keyword:
    """A keyword as words and gaps; ``gaps`` has one more."""

    rank: int
    keyword: str
    words: tuple[str, ...]
    gaps: tuple[str, ...]

    def may_overlap(self) -> bool:
        """Two places of it in a text can share characters; a pattern then
        takes the first of them only."""
        n = len(self.words)
        shifted = any(self.words[s:] == self.words[:n - s] and self.gaps[s + 1:n] == self.gaps[1:n - s] for s in range(1, n))
        return shifted or bool(self.gaps[0] and self.gaps[-1])


class Index:
    """An index that :func:`build` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _keywords(self, keywords) -> tuple[list[Keyword], list[str]]:
        """The keywords, cut by the same expressions as the texts; and those
        without a word, which no index can find."""
        listed = [(i, k) for i, k in enumerate(fixed.longest_first(keywords))]
        if not listed:
            return [], []
        df = self.spark.createDataFrame(listed, "rank int, keyword string").withColumn("_t", T.collapse_ws("keyword"))
        cut = words_of(df, "_t").select("rank", "keyword", F.transform("words", fold).alias("words"), "gaps").collect()
        with_words = [Keyword(r.rank, r.keyword, tuple(r.words), tuple(r.gaps)) for r in cut if r.words]
        return with_words, [r.keyword for r in cut if not r.words]

    def _list(self, rows: list[tuple], schema: str) -> DataFrame:
        df = self.spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= SENT_ROWS else df

    def postings(self, words: list[str]) -> DataFrame:
        """The index rows of ``words``; reads their buckets only."""
        wanted = self._list([(w,) for w in sorted(set(words))], "word string")
        buckets = [r[0] for r in wanted.select(_bucket("word")).distinct().collect()]  # at most BUCKETS
        rows = self.spark.read.parquet(self.path).where(F.col("bucket").isin(buckets)).drop("bucket")
        return rows.join(wanted, "word", "left_semi")

    def counts(self, words: list[str]) -> dict[str, int]:
        """How often each word stands in the texts."""
        return {r.word: r["count"] for r in self.postings(words).groupBy("word").count().collect()}

    def occurrences(self, keywords, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """M1: (doc, start, end, rank, keyword): the places of every keyword,
        code points, end exclusive; places of one keyword that overlap count
        once, the first.  ``rank`` is that of :func:`fixed.longest_first`.
        Keywords without a word character are matched by pattern over ``docs``,
        which has to be given if there are such."""
        known, wordless = self._keywords(keywords)
        parts = []
        once, twice = [k for k in known if not k.may_overlap()], [k for k in known if k.may_overlap()]
        if once:
            parts.append(self._found(once))
        if twice:
            parts.append(self._found(twice, _apart))
        if wordless:
            if docs is None:
                raise ValueError(f"not to be found by their words: {wordless}")
            rank = {k: i for i, k in enumerate(fixed.longest_first(keywords))}
            d = M.with_occurrences(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_x")), T.collapse_ws("_x"), wordless, "o")
            d = d.select("doc", F.posexplode_outer("o").alias("p", "o")).where(F.col("o").isNotNull())
            ranks = F.create_map(*[F.lit(x) for k in wordless for x in (k, rank[k])])
            parts.append(d.select("doc", "o.start", "o.end", ranks[F.col("o.keyword")].alias("rank"), F.col("o.keyword").alias("keyword")))
        if not parts:
            return self.spark.read.parquet(self.path).limit(0).select("doc", "start", "end", F.lit(0).alias("rank"), F.lit("").alias("keyword"))
        return reduce(DataFrame.unionByName, parts)

    def _found(self, known: list[Keyword], chosen=lambda found: found) -> DataFrame:
        vocabulary = sorted({w for k in known for w in k.words})
        counts = self.counts(vocabulary)
        anchor = {k.rank: min(range(len(k.words)), key=lambda j: (counts.get(k.words[j], 0), j)) for k in known}
        # Every word of every keyword: what it must be, and what must stand around it.
        asked = [(k.rank, len(k.words), j, w, k.gaps[j], k.gaps[j + 1], j == 0, j == len(k.words) - 1, j == anchor[k.rank])
                 for k in known for j, w in enumerate(k.words)]
        kind = "rank int, n int, j int, word string, gap string, gap_after string, is_first boolean, is_last boolean"
        anchors, others = ([a[:8] for a in asked if a[8] is one] for one in (True, False))
        rows = self.postings(vocabulary)

        def fits(p: str = "") -> Column:
            """The words around agree; at the keyword's own ends, what stands
            there may be more than the keyword's, or end with the text."""
            c = lambda x: F.col(p + x)
            head = c("before").endswith(F.col("gap")) & ((F.col("gap") == "") | (F.length(c("before")) > F.length("gap")) | (c("pos") == 0))
            tail = c("after").startswith(F.col("gap_after")) & (
                (F.col("gap_after") == "") | (F.length(c("after")) > F.length("gap_after")) | c("last"))
            return F.when(F.col("is_first"), head).otherwise(c("before") == F.col("gap")) & F.when(F.col("is_last"), tail).otherwise(F.lit(True))

        begin = F.when(F.col("is_first"), F.col("start") - F.length("gap"))
        finish = F.when(F.col("is_last"), F.col("end") + F.length("gap_after"))
        at = rows.join(self._list(anchors, kind), "word").where(fits())
        at = at.select("doc", "rank", "n", (F.col("pos") - F.col("j")).alias("p0"), begin.alias("start"), finish.alias("end")).where("p0 >= 0")
        alone = at.where("n = 1").select("doc", "rank", "start", "end")
        if not others:
            return self._named(chosen(alone), known)
        due = (at.where("n > 1").select("doc", "rank", "n", "p0", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
                 .join(self._list(others, kind).drop("n"), "rank").withColumn("pos", F.col("p0") + F.col("j")))
        # The place is part of the key, so a frequent word or a long text is dealt out.
        seen = due.join(rows, ["doc", "pos", "word"]).where(fits())
        whole = (seen.groupBy("doc", "rank", "p0", "n", "a_start", "a_end")
                     .agg(F.count("*").alias("c"), F.max(begin).alias("start"), F.max(finish).alias("end")).where("c = n - 1")
                     .select("doc", "rank", F.coalesce("a_start", "start").alias("start"), F.coalesce("a_end", "end").alias("end")))
        return self._named(chosen(alone.unionByName(whole)), known)

    def _named(self, found: DataFrame, known: list[Keyword]) -> DataFrame:
        names = self._list([(k.rank, k.keyword) for k in known], "rank int, keyword string")
        return found.join(names, "rank").select("doc", "start", "end", "rank", "keyword")


def _apart(found: DataFrame) -> DataFrame:
    """Of places of a keyword in a document that overlap, the first, and from
    its end on again."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    kind = "array<struct<start:int,end:int>>"
    kept = F.aggregate(spans, F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= x["start"]), F.array_append(acc, x.cast("struct<start:int,end:int>"))).otherwise(acc))
    return found.groupBy("doc", "rank").agg(kept.alias("k")).select("doc", "rank", F.explode("k").alias("s")).select("doc", "rank", "s.start", "s.end")


def first_pairs(institutions: DataFrame, statuses: DataFrame, window: int) -> DataFrame:
    """JN6: (doc, i, s): per document the first institution, and for it the
    first status, in order of start and rank, whose gap ``max(0, max(starts) -
    min(ends))`` is at most ``window``.

    A status is filed under the bin of its start, an institution under every
    bin that its window reaches, and both meet in a join on (document, bin): the
    pairs made are those within reach.  Bins are as wide as a reach of the
    median status, so an institution stands in few; the longest status is found
    first, as the reach to the left depends on it."""
    window = max(1, int(window))
    longest = statuses.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    width = 2 * window + longest
    place = lambda: F.struct("start", "rank", "end", "keyword")
    bin_of = lambda c: F.floor(c / width)
    left = institutions.select("doc", place().alias("i")).select(
        "doc", "i", F.explode(F.sequence(bin_of(F.greatest(F.col("i.start") - window - longest, F.lit(0))),
                                         bin_of(F.col("i.end") + window))).alias("bin"))
    right = statuses.select("doc", place().alias("s"), bin_of(F.col("start")).alias("bin"))
    gap = F.greatest(F.col("i.start"), F.col("s.start")) - F.least(F.col("i.end"), F.col("s.end"))
    return (left.join(right, ["doc", "bin"]).where(gap <= window).groupBy("doc")
                .agg(F.min(F.struct("i", "s")).alias("p")).select("doc", "p.i", "p.s"))


def proximity_match(docs: DataFrame, index: Index, id_col: str, text_col: str, out: str = "match", institutions=None,
                    statuses=None, window: int = fixed.DEFAULT_MATCH_WINDOW, padding: int = fixed.EXCERPT_PADDING) -> DataFrame:
    """M1 + M2 + M3 by the index of ``docs``: adds ``out`` as
    :func:`almanac.functions.match.with_proximity_match` does.  Only the texts of
    documents with a pair are read, for the excerpt."""
    institutions = list(fixed.DEFAULT_INSTITUTION_KEYWORDS if institutions is None else institutions)
    statuses = list(fixed.DEFAULT_STATUS_KEYWORDS if statuses is None else statuses)
    pairs = first_pairs(index.occurrences(institutions, docs, id_col, text_col), index.occurrences(statuses, docs, id_col, text_col), window)
    lo = F.least("i.start", "s.start")
    hi = F.greatest("i.end", "s.end")
    first = F.greatest(F.lit(0), lo - padding)
    pairs = pairs.select(F.col("doc").alias(id_col), F.col("i.keyword").alias("_i"), F.col("s.keyword").alias("_s"), first.alias("_first"),
                         (hi + padding).alias("_last"))
    joined = docs.join(pairs, id_col, "left")
    text = F.when(F.col("_i").isNotNull(), T.collapse_ws(text_col))
    length = F.least(F.length(text), F.col("_last")) - F.col("_first")
    match = F.when(F.col("_i").isNotNull(), F.struct(F.col("_i").alias("institution"), F.col("_s").alias("status"),
                                                     F.trim(F.substring(text, F.col("_first") + 1, length)).alias("matched_text")))
    return joined.withColumn(out, match.cast(M.MATCH_TYPE)).drop("_i", "_s", "_first", "_last")
