"""Substring dedup by level-wise doubling.

A word is removed if it lies in a window of ``words`` consecutive words whose
sequence also starts in a document with a smaller id.  The windows are found
from shorter ones:

* level one, half the length: a window that is not repeated at half the
  length cannot be repeated at the whole.  Half windows are compared at
  anchors only.  The anchor of a window is its least half window (by hash,
  the leftmost of equals), which depends on nothing but the window's words,
  so two occurrences of a window have the same anchor at the same place;
* level two, twice that: windows whose anchor is repeated in two documents
  are extended to the full length and compared as a whole.

There is one step per length until no candidate survives or the length asked
for is reached; longer repeats consist of windows of that length, so further
doubling would mark the same words.  Documents with equal word sequences are
represented by the smallest id from the start: every window of the others
also starts in that one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_long, list_array, small_batches, staged, window_hashes


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, unchanged."""
    return (text or "").encode().split()


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors(half: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` half windows, the place of its least, the
    leftmost of equals; by doubling, so that length does not matter."""
    total = len(half) - span + 1
    if total <= 0:
        return np.empty(0, np.int64)
    at, size = np.arange(len(half)), 1
    while size < span:
        step = min(size, span - size)
        left, right = at[:len(at) - step], at[step:]
        at, size = np.where(half[left] <= half[right], left, right), size + step
    return at[:total]


def _profile(words: int):
    half = words // 2
    span = words - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in small_batches(batches):
            sizes, digests, places, marks = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = words_of(text)
                h = window_hashes(cache.array(own), half) if len(own) >= words else np.empty(0, np.uint64)
                at = np.unique(anchors(h, span))
                sizes.append(len(own))
                digests.append(kept_digest(own))
                places.append(at)
                marks.append(as_long(h[at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 list_array(places, pa.int64()), list_array(marks, pa.int64())],
                names=["id", "n", "digest", "places", "marks"])
    return run


def _extend(words: int):
    """(id, digest, start, h1, h2) of each window whose anchor is repeated."""
    half = words // 2
    span = words - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in small_batches(batches, 128):
            ids, digests, found = [], [], [[], [], []]
            for key, digest, text, repeated in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = words_of(text)
                if kept_digest(own) != digest:
                    continue  # another row with the same id
                base = cache.array(own)
                at = anchors(window_hashes(base, half), span)
                start = np.flatnonzero(np.isin(at, np.array(repeated, np.int64)))
                ids.append(np.full(len(start), key, np.int64))
                digests.extend([digest] * len(start))
                for into, what in zip(found, (start, as_long(window_hashes(base, words, 1)[start]),
                                              as_long(window_hashes(base, words, 2)[start])), strict=True):
                    into.append(what)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(digests, pa.string()),
                     *(pa.array(np.concatenate(x)) for x in found)], names=["id", "digest", "start", "h1", "h2"])
    return run


def _cut(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            ids, digests, removed, kept = [], [], [], []
            for key, digest, text, starts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = words_of(text)
                if kept_digest(own) != digest:
                    continue
                gone = np.zeros(len(own) + 1, np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, np.array(starts) + words, -1)
                gone = np.cumsum(gone)[:-1] > 0
                ids.append(key)
                digests.append(digest)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, x in zip(own, gone, strict=True) if not x).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["id", "digest", "n_removed", "kept_text"])
    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     words: int = 50) -> tuple[DataFrame, DataFrame]:
    """The rows' profiles (id, n, digest, copy) and, of rows that lose some
    but not all words, (id, digest, n_removed, kept_text)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = staged(texts.mapInArrow(_profile(words), "id long, n long, digest string, places array<long>, marks array<long>"),
                  "profiles")
    long_enough = rows.filter(F.col("id").isNotNull() & (F.col("n") >= words))
    first = long_enough.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    several = first.filter("c > 1")
    profile = rows.select("id", "n", "digest").join(several.select("digest", "first"), "digest", "left")
    profile = profile.withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("first")

    # Level one: anchors that stand in two documents.
    single = long_enough.join(several.withColumnRenamed("first", "id"), ["digest", "id"], "left_semi")
    alone = long_enough.join(several, "digest", "left_anti")
    kept_rows = single.unionByName(alone).select("id", "digest", F.explode(F.arrays_zip("marks", "places")).alias("a"))
    spots = kept_rows.select("id", "digest", F.col("a.marks").alias("mark"), F.col("a.places").alias("place"))
    # The repeated anchors (below: windows) are written before they are joined:
    # as a table they let Spark split the rows of a hot one.
    twice = staged(spots.groupBy("mark").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("mark"), "marks")
    candidates = staged(spots.join(twice, "mark").groupBy("id", "digest")
                        .agg(F.collect_set("place").alias("places")), "candidates")

    # Level two: the whole windows around them.
    own_texts = staged(texts.join(candidates, "id").select("id", "digest", "text", "places"), "candidate-texts")
    windows = staged(own_texts.mapInArrow(_extend(words), "id long, digest string, start long, h1 long, h2 long"), "windows")
    origin = staged(windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
                           .select("h1", "h2", "lo"), "origins")
    starts = (windows.join(origin, ["h1", "h2"]).filter("id > lo")
                     .groupBy("id", "digest").agg(F.collect_set("start").alias("starts")))
    cut = own_texts.select("id", "digest", "text").join(starts, ["id", "digest"]).select("id", "digest", "text", "starts")
    cut = cut.mapInArrow(_cut(words), "id long, digest string, n_removed long, kept_text string")
    return profile, cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), one row for each row of ``docs``.

    Null and blank texts have no words and lose none.  Rows without an id
    neither lose words nor make others lose any.  Rows that share an id do not
    remove words from each other.  An empty table gives an empty result;
    other columns of ``docs`` are not looked at.
    """
    profile, cut = repeated_windows(docs, id_col, text_col, words)
    changed = cut.select("id", "digest", "n_removed", F.sha2("kept_text", 256).alias("kept_sha")).distinct()
    none_left = F.sha2(F.lit("").cast("binary"), 256)
    return (profile.join(changed, ["id", "digest"], "left")
                   .select(F.col("id").alias(id_col), F.col("n").alias("n_words"),
                           F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                           F.when(F.col("copy"), none_left).otherwise(F.coalesce("kept_sha", "digest")).alias("kept_sha256")))
