"""Benchmark decontamination: a BM25 index of the test items, asked by every
passage of the training texts.

The index holds, per term, the items with their impact: the BM25 weight over
the weight of the whole item, so that a score is the share of the item that a
passage covers, and one threshold fits all items.  Items are filed in blocks
with the largest impact of each term in each block.  A passage first adds up
these block maxima; only the blocks whose sum reaches the threshold are opened
and their items scored (block-max WAND with a threshold that is known
beforehand: what it skips cannot reach the threshold, so all items above it
are retrieved).

A retrieved item is verified on its words in order: enough of the five-word
shingles of its question and of its answer must stand in the text.  The answer
is the item's last line, or its last sentence if it has one line; an item of
one sentence is all question.

Passages are twice as long as the longest item and overlap by half, so a copy
of an item lies within one.  The index is sent to the executors in parts of at
most ``PART_BYTES`` of item text; a larger set of items makes further passes.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped, small_batches, staged

K1, B = 1.2, 0.75
#: Least share of an item's weight in a passage, and least share of the
#: question's and of the answer's shingles in the text.
SCORE, OVERLAP = 0.6, 0.8
SHINGLE = 5
ITEMS_A_BLOCK = 8
PART_BYTES = 8 << 20

_SPACED = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased."""
    return (text or "").encode().lower().translate(_SPACED).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    lines = [x for x in text.splitlines() if terms_of(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", text) if terms_of(x)]
    if len(lines) < 2:
        return terms_of(text), []
    return terms_of(" ".join(lines[:-1])), terms_of(lines[-1])


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    size = min(SHINGLE, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def overlap(part: list[bytes], held: set, words: list[bytes]) -> float:
    own = shingles(part)
    if not own:
        return 1.0
    if len(part) < SHINGLE:  # a short part is a single shingle of its own length
        return float(bool(own & {tuple(words[i:i + len(part)]) for i in range(len(words) - len(part) + 1)}))
    return len(own & held) / len(own)


def _csr(rows: dict[int, dict[int, float]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.zeros(n + 1, np.int64)
    for t, row in rows.items():
        starts[t + 1] = len(row)
    starts = np.cumsum(starts)
    columns = np.fromiter((c for t in range(n) for c in rows.get(t, ())), np.int64, starts[-1])
    values = np.fromiter((v for t in range(n) for v in rows.get(t, {}).values()), np.float64, starts[-1])
    return starts, columns, values


class Index:
    """Impacts by term of a bounded part of the items."""

    def __init__(self, items: list[tuple[int, str]], stats: dict):
        own = [(i, t, Counter(terms_of(t))) for i, t in items]
        self.items = [(i, *question_and_answer(t)) for i, t, c in own if c]
        own = [c for _, _, c in own if c]
        self.terms: dict[bytes, int] = {}
        impacts: dict[int, dict[int, float]] = {}
        blocks: dict[int, dict[int, float]] = {}
        for at, counts in enumerate(own):
            size = sum(counts.values())
            weight = {t: stats["idf"][t] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / stats["mean"])) for t, n in counts.items()}
            whole = sum(weight.values())
            for term, w in weight.items():
                t = self.terms.setdefault(term, len(self.terms))
                impacts.setdefault(t, {})[at] = w / whole
                best = blocks.setdefault(t, {})
                best[at // ITEMS_A_BLOCK] = max(best.get(at // ITEMS_A_BLOCK, 0), w / whole)
        n = len(self.terms)
        self.impacts, self.blocks = _csr(impacts, n), _csr(blocks, n)
        self.n_blocks = -(-len(own) // ITEMS_A_BLOCK)
        self.known = pa.array(list(self.terms), pa.binary())
        self.stride = max(1, stats["longest"])

    @staticmethod
    def _rows(csr, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``terms``, column, value) of every entry of their rows."""
        starts, columns, values = csr
        n = starts[terms + 1] - starts[terms]
        of = np.repeat(np.arange(len(terms)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[terms], n)
        return of, columns[at], values[at]

    def retrieve(self, texts: list[list[bytes]], least: float) -> list[dict[int, float]]:
        """For each text, item number -> best score over its passages, of all
        items that reach ``least`` in one."""
        found: list[dict[int, float]] = [{} for _ in texts]
        # Passage p consists of the halves p and p + 1; after the halves of a
        # text an empty one is counted, so that no passage spans two texts.
        halves = np.array([-(-len(words) // self.stride) + 1 for words in texts], np.int64)
        first = np.cumsum(halves) - halves
        n = len(self.terms)
        if not texts or not n:
            return found
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        words = pa.array(itertools.chain.from_iterable(texts), pa.binary(), size=int(sizes.sum()))
        ids = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        half = (place // self.stride + np.repeat(first, sizes))[ids >= 0]
        pairs = np.unique(half * n + ids[ids >= 0])
        half, term = pairs // n, pairs % n
        of, block, best = self._rows(self.blocks, term)
        bound = np.bincount(half[of] * self.n_blocks + block, best, halves.sum() * self.n_blocks).reshape(-1, self.n_blocks)
        # A term in both halves counts twice here, so this is not too small.
        opened = np.zeros_like(bound, bool)
        opened[:-1] = bound[:-1] + bound[1:] >= least
        opened[-1] = bound[-1] >= least
        rows = np.flatnonzero(opened.any(axis=1))
        if not len(rows):
            return found
        low, high = np.searchsorted(half, rows), np.searchsorted(half, rows + 2)
        size = high - low
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        pairs = np.unique(np.repeat(np.arange(len(rows)), size) * n + term[at])
        row, term = pairs // n, pairs % n
        of, item, impact = self._rows(self.impacts, term)
        row = row[of]
        inside = opened[rows[row], item // ITEMS_A_BLOCK]
        keys, at = np.unique(row[inside] * len(self.items) + item[inside], return_inverse=True)
        scores = np.bincount(at, impact[inside])
        good = scores >= least
        for key, s in zip(keys[good], scores[good], strict=True):
            of_text = found[int(np.searchsorted(first, rows[key // len(self.items)], "right")) - 1]
            item = int(key % len(self.items))
            of_text[item] = max(of_text.get(item, 0.0), float(s))
        return found

    def verified(self, texts: list[str | None], least: float, least_overlap: float) -> list[list[tuple[int, float, float, float]]]:
        """For each text, (item id, score, question and answer overlap) of the
        items it contains."""
        words = [terms_of(t) for t in texts]
        out = []
        for own, found in zip(words, self.retrieve(words, least - 1e-9), strict=True):
            held, kept = shingles(own) if found else set(), []
            for at, score in sorted(found.items()):
                item, question, answer = self.items[at]
                q, a = overlap(question, held, own), overlap(answer, held, own)
                if q >= least_overlap and a >= least_overlap:
                    kept.append((item, round(score, 9), q, a))
            out.append(kept)
        return out


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The index in parts of bounded size.  Document frequencies and lengths
    are those of all items; a part brings those of its own terms only."""
    rows = staged(items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
                  .filter("id IS NOT NULL AND text IS NOT NULL").distinct(), "items")
    counted = staged(rows.mapInArrow(_counted, "id long, term binary, n long, size long"), "item-terms")
    total, mean, longest, size = (counted.select("id", "size").distinct()
                                  .agg(F.count("*"), F.avg("size"), F.max("size"), F.sum("size")).first())
    if not total:
        return
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = -(-n_bytes // PART_BYTES)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    df = counted.select("id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    for p in range(parts):
        own = rows.filter(part("id") == p).orderBy("id", "text").collect()
        frequent = counted.filter(part("id") == p).select("term").distinct().join(df, "term").collect()
        idf = {bytes(r.term): float(np.log(1 + (total - r.df + 0.5) / (r.df + 0.5))) for r in frequent}
        yield Index([(r.id, r.text) for r in own], {"idf": idf, "mean": mean, "longest": longest})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = [(i, w, n, sum(c.values())) for i, t in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)
                for c in [Counter(terms_of(t))] for w, n in c.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                                          pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                                         names=["id", "term", "n", "size"])


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", score: float = SCORE,
                   least_overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every item
    that a text of ``docs`` contains.

    Null and blank texts contain nothing, and null or blank items are
    contained in nothing.  Rows of ``docs`` are worked on one by one, so
    repeated rows, and rows without an id, give the same pairs each; equal
    items with different ids are all reported.  With either table empty the
    result is empty; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], kind)
    for index in _indexes(items, item_id, item_text):
        def search(batches: Iterator[pa.RecordBatch], get=shipped(docs.sparkSession, index)) -> Iterator[pa.RecordBatch]:
            known = get()
            for batch in small_batches(batches, 128):
                held = known.verified(batch.column(1).to_pylist(), score, least_overlap)
                found = [(i, *x) for i, own in zip(batch.column(0).to_pylist(), held, strict=True) for x in own]
                if found:
                    ids, own, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(own, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(rows.mapInArrow(search, kind))
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", score: float = SCORE, least_overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with all columns;
    nothing is shuffled.  The cases are those of :func:`contaminations`."""
    schema: T.StructType = docs.schema
    for index in _indexes(items, item_id, item_text):
        def clean(batches: Iterator[pa.RecordBatch], get=shipped(docs.sparkSession, index)) -> Iterator[pa.RecordBatch]:
            known = get()
            for batch in small_batches(batches, 128):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not x for x in known.verified(texts, score, least_overlap)], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs
