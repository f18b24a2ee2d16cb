"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel compares two words by their common subsequences of three
characters, which may have gaps; a subsequence that spans ``s`` characters
weighs ``DECAY ** s``, and spans of more than ``SPAN`` characters weigh
nothing.  So ``i.d.i.o.t`` and ``idxiot`` stay close to ``idiot``.  Words of
single characters ("i d i o t") are read as one.

Nyström: the kernel is approximated from landmark words, and a sentence's
vector is the sum of the maps of its words.  A linear support vector machine
(squared hinge) is fitted to the sentence vectors with the label of their
document; a document scores as its most toxic sentence.  A label says only
that some sentence of the document is toxic, so of toxic documents the
sentences with a telling stem are taken at first (a beginning of words, shared
by more sentences of toxic documents than chance explains; also the source of
the landmarks); the machine is refitted with the best sentence of toxic
documents without one and with the sentences of clean documents that it holds
for toxic (multi-instance rounds).  Because the fitted function is linear in
the kernel, a word adds one weight for each subsequence, and scoring is one
pass without a shuffle.  The probability is fitted on a fifth of the sample,
which the machine does not see.

The fit takes at most ``DOCS`` labelled documents of each label, chosen by a
hash of the id among those of up to ``DOC_CHARS`` characters, with all their
sentences; this bound is the only sample here, and scores are of whole texts.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, as_long, list_array, shipped, small_batches, staged

SPAN, DECAY = 5, 0.6
DOCS, DOC_CHARS = 1000, 12_000
BIAS = -1.0
#: Least share of a toxic word's sentences that are of toxic documents.
PURE = 0.8
TOXIC_MARKS, CLEAN_MARKS, LEAST_DIFFERENT, CLEAN_BAGS, ROUNDS = 120, 50, 0.9, 4_000, 5
#: Scores from here on mean toxic.
THRESHOLD = 0.3
PIECE = 32
#: Words of a sentence that add up, and lengths of stems.
WINDOW, STEMS = 32, range(5, 9)
#: Clean sentences from which on a stem is known to be clean.
LEAST_SEEN = 3
HARD_BAGS = 1_500
#: Words compared at once when landmarks are chosen, and rows of a product.
POOL_PART, ROW_PART = 128, 2_048
#: Documents of each label to set aside for the probability, or none are.
LEAST_ASIDE = 5

_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_ENDS = re.compile(r"[.!?…]+(?=\s|$)|\n+")


def sentences(text: str | None) -> list[str]:
    return [s for s in _ENDS.split(text or "") if s and not s.isspace()]


def words_of(sentence: str) -> list[str]:
    """Lower-cased words without punctuation around them; a run of words of
    one character is one word."""
    out: list[str] = []
    run: list[str] = []
    for raw in sentence.lower().split():
        word = raw.strip("\"'.,;:!?()[]{}<>…«»“”*#&%$-_")
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
        if word:
            out.append(word)
    if len(run) > 2:
        out.append("".join(run))
    return out


def windows(words: list[str]) -> list[list[str]]:
    """The words in runs of ``WINDOW``, so that a text without ends of
    sentences does not add up as one."""
    return [words[i:i + WINDOW] for i in range(0, len(words), WINDOW)]


def stems(word: str) -> list[str]:
    """The word's beginnings of ``STEMS`` characters, then itself."""
    return [*(word[:n] for n in STEMS if n < len(word)), word]


def _pieces(word: str) -> list[str]:
    """A very long word as overlapping parts that together have all its
    subsequences."""
    return [word[i:i + PIECE] for i in range(0, max(1, len(word) - SPAN + 1), PIECE - SPAN + 1)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the weighted subsequences of each word, scaled
    so that a word's kernel with itself is one."""
    rows, codes, weights = [], [], []
    by_size = defaultdict(list)
    words = [f"\x02{w}\x03" for w in words]  # so that a word's start and end count
    for at, word in enumerate(words):
        by_size[len(word)].append(at)
    for size, where in by_size.items():
        letters = np.frombuffer("".join(words[i] for i in where).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
        for a, b in _OFFSETS:
            if b < size:
                code = (letters[:, :size - b] << np.uint64(42)) | (letters[:, a:size - b + a] << np.uint64(21)) | letters[:, b:]
                rows.append(np.repeat(np.array(where), size - b))
                codes.append(code.ravel())
                weights.append(np.full(code.size, DECAY ** (b + 1)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    row, code, weight = np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)
    order = np.lexsort((code, row))
    row, code, weight = row[order], code[order], weight[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    row, code, weight = row[new], code[new], np.add.reduceat(weight, new)
    norm = np.sqrt(np.bincount(row, weight * weight, len(words)))
    return row, code, weight / norm[row]


def _beyond(decision: np.ndarray) -> np.ndarray:
    """Beyond the margin the decision grows by a hundredth at most, in order,
    so that ties are of equal values only."""
    size = np.abs(decision)
    return np.where(size > 1, np.sign(decision) * (1 + 0.01 * (1 - 1 / np.maximum(size, 1))), decision)


class Scorer:
    """A weight for each subsequence: word -> its part of a sentence's decision
    value."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(codes)
        self.codes, self.weights, self.bias = codes[order], weights[order], bias
        self.scale, self.shift = 1.0, 0.0

    def values(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self._values(words[at:at + 4000]) for at in range(0, len(words), 4000)] or [np.empty(0)])

    def _values(self, words: list[str]) -> np.ndarray:
        pieces = [(i, p) for i, w in enumerate(words) for p in _pieces(w)]
        row, code, weight = subsequences([p for _, p in pieces])
        found = np.zeros(len(pieces))
        if len(self.codes) and len(code):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            found = np.bincount(row[hit], weight[hit] * self.weights[at[hit]], len(pieces))
        best = np.full(len(words), -np.inf)
        np.maximum.at(best, np.array([i for i, _ in pieces], np.int64), found)
        return best

    def decisions(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """Decision value of each text; ``bias`` for one without words."""
        held = [[set(words) for s in sentences(t) for words in windows(words_of(s))] for t in texts]
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list(set().union(*(words for ws in held for words in ws)) - known.keys())
        known.update(zip(new, self.values(new).tolist(), strict=True))
        top = [max((sum(map(known.__getitem__, words)) for words in ws), default=0.0) + self.bias for ws in held]
        return np.array(top, float)

    def documents(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """The decision values, those beyond the margin as equal: to these the
        probability is fitted."""
        return np.clip(self.decisions(texts, known), -1, 1)

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * decision + self.shift, -30, 30)))


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Dense kernel of words and landmarks, by the landmarks' subsequences."""
    return _bag_kernel([[w] for w in words], landmarks)


def _bag_kernel(bags: list[list[str]], landmarks: list[str]) -> np.ndarray:
    """The kernel with each landmark, summed over the words of each bag."""
    l_row, l_code, l_weight = subsequences(landmarks)
    known, at = np.unique(l_code, return_inverse=True)
    table = np.zeros((len(known), len(landmarks)))
    table[at, l_row] = l_weight
    out = np.zeros((len(bags), len(landmarks)))
    for start in range(0, len(bags), 100):
        part = bags[start:start + 100]
        of = np.repeat(np.arange(len(part)), [len(b) for b in part])
        row, code, weight = subsequences([w for b in part for w in b])
        if not len(known) or not len(code):
            continue
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = np.flatnonzero(known[at] == code)
        bag = of[row[hit]]
        # One entry for each bag and subsequence.
        key, which = np.unique(bag * len(known) + at[hit], return_inverse=True)
        if not len(key):
            continue
        total = np.bincount(which, weight[hit])
        bag, code = key // len(known), key % len(known)
        ends = np.searchsorted(bag, np.arange(len(part) + 1))
        for i, (a, b) in enumerate(zip(ends, ends[1:])):  # bag by bag: its rows of the table only
            out[start + i] = total[a:b] @ table[code[a:b]]
    return out


def _margin(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps
    on the rows inside the margin.  The bias is fixed at ``BIAS``: a word like
    no landmark is clean."""
    w, keep, size = np.zeros(x.shape[1]), np.full(x.shape[1], penalty), 1.0

    def loss(w: np.ndarray) -> float:
        return float(keep @ (w * w) + weight @ np.maximum(0, 1 - y * (x @ w + BIAS)) ** 2)

    now = loss(w)
    for _ in range(60):
        slack = 1 - y * (x @ w + BIAS)
        on = slack > 0
        grad = keep * w - x.T @ np.where(on, weight * y * slack, 0.0)
        hess, inside = np.diag(keep), np.flatnonzero(on)
        for start in range(0, len(inside), ROW_PART):  # never a second copy of x
            at = inside[start:start + ROW_PART]
            hess = hess + (x[at] * weight[at, None]).T @ x[at]
        step, size = np.linalg.solve(hess, grad), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if then >= now - 1e-10:
            break
        w, now = w - size * step, then
    return w


def _fit(rows: Iterable[tuple[int, int, str]]) -> Scorer | None:
    """``rows``: (document, label, sentence)."""
    # Stems are counted by the different sentences that hold them, so that
    # copies of a document do not count again.
    bags: dict[int, dict[int, list[frozenset[str]]]] = {0: defaultdict(list), 1: defaultdict(list)}
    for doc, label, sentence in rows:
        for words in windows(words_of(sentence)):
            bag = frozenset(sys.intern(p) for w in words for p in _pieces(w) if len(p) >= 3)
            if bag:
                bags[label][doc].append(bag)
    if not bags[0] or not bags[1]:
        return None
    different = [set().union(*bags[k].values()) for k in (0, 1)]
    n_clean, n_toxic = map(len, different)
    share = n_toxic / (n_toxic + n_clean)
    count: list[Counter] = [Counter(), Counter()]
    for bag in different[1]:
        count[1].update({x for w in bag for x in stems(w)})
    for bag in different[0]:
        count[0].update({x for w in bag for x in stems(w) if x in count[1]})

    def surprise(stem: str) -> float:
        """Log likelihood ratio of the stem's sentences, if most are toxic."""
        t, c = count[1][stem], count[0][stem]
        if t < PURE * (t + c):
            return 0.0
        return t * math.log(t / (share * (t + c))) + (c * math.log(c / ((1 - share) * (t + c))) if c else 0.0)

    limit = math.log(1 + len(count[1]))  # more than the number of different stems makes likely
    telling = {x: v for x in count[1] if (v := surprise(x)) > limit}

    def evidence(word: str) -> float:
        """Of the longest stem that says anything; one that is often in clean
        sentences speaks against its word."""
        for x in reversed(stems(word)):
            if x in telling:
                return telling[x]
            if count[0][x] >= LEAST_SEEN and count[1][x] < PURE * (count[0][x] + count[1][x]):
                return 0.0
        return 0.0

    of_word = {w: evidence(w) for bag in different[1] for w in bag}
    strong = sorted((w for w, v in of_word.items() if v), key=lambda w: (-of_word[w], -count[1][w], w))
    if not strong:
        strong = sorted(of_word, key=lambda w: (-surprise(w), w))[:20]
    clean_words = sorted({w for bag in different[0] for w in bag}, key=lambda w: (_mixed(w), w))[:500]

    # A toxic document's telling sentences; of one that has none, the label
    # says only that some sentence is toxic, and the rounds find which.
    chosen = set(strong)
    positive = {bag for bag in different[1] if bag & chosen}
    negative = Counter({bag: 1 for bag in sorted(different[0], key=lambda b: (_mixed(min(b)), sorted(b)))[:CLEAN_BAGS]})
    landmarks = _different(strong[:1500], TOXIC_MARKS)
    hard = clean_words
    scorer = None
    for _ in range(ROUNDS):
        landmarks = landmarks + _different(hard, CLEAN_MARKS, landmarks)
        spread, vectors = np.linalg.eigh(_kernel(landmarks, landmarks))
        root = vectors / np.sqrt(np.maximum(spread, 1e-6)) @ vectors.T
        plus = sorted(positive, key=sorted)
        x = _bag_kernel([*map(sorted, plus), *map(sorted, negative)], landmarks)
        for start in range(0, len(x), ROW_PART):
            x[start:start + ROW_PART] = x[start:start + ROW_PART] @ root
        y = np.r_[np.ones(len(plus)), -np.ones(len(negative))]
        weight = np.array([1.0] * len(plus) + [float(n) for n in negative.values()])
        for side in (y > 0, y < 0):
            weight[side] /= max(weight[side].sum(), 1e-9)
        w = _margin(x, y, weight)
        row, code, part = subsequences(landmarks)
        known, at = np.unique(code, return_inverse=True)
        scorer = Scorer(known, np.bincount(at, part * (root @ w)[row], len(known)), BIAS)
        words = sorted(set().union(*different[0], *different[1]))
        value = dict(zip(words, scorer.values(words).tolist(), strict=True))
        total = lambda bag: sum(map(value.__getitem__, bag))  # noqa: E731, B023
        # The sentence that looks most toxic in each clean document is not;
        # that in each toxic one is, if the machine holds it for so.
        tops = Counter(max(own, key=lambda b: (total(b), sorted(b))) for own in bags[0].values())
        # So are the clean sentences most inside the margin not.
        inside = [(v, b) for b in different[0] if (v := total(b) + BIAS) > -0.5]
        negative.update(b for _, b in heapq.nlargest(HARD_BAGS, inside, key=lambda x: (x[0], sorted(x[1]))))
        negative.update(tops)
        for own in bags[1].values():
            if not any(bag & chosen for bag in own):
                best = max(own, key=lambda b: (total(b), sorted(b)))
                if total(best) + BIAS > 0:
                    positive.add(best)
        worst = Counter()
        for bag, n in tops.items():
            word = max(bag, key=lambda w: (value[w], w))
            if value[word] > 0.3:
                worst[word] += n
        hard = [w for w, _ in sorted(worst.items(), key=lambda x: (-x[1] * value[x[0]], x[0]))][:500]
    return scorer


def _different(pool: list[str], most: int, beside: list[str] = []) -> list[str]:  # noqa: B006
    """The first words of ``pool`` none of which is too close to another or to
    one of ``beside``.  The pool is compared in parts, with the words taken so
    far and within the part, so no table of all its subsequences is made."""
    taken: list[str] = []
    for start in range(0, len(pool), POOL_PART):
        if len(taken) >= most:
            break
        part = pool[start:start + POOL_PART]
        known = [*beside, *taken]
        free = _kernel(part, known).max(axis=1) < LEAST_DIFFERENT if known else np.ones(len(part), bool)
        between = _kernel(part, part)
        own: list[int] = []
        for i in np.flatnonzero(free):
            if len(taken) + len(own) < most and (not own or between[i, own].max() < LEAST_DIFFERENT):
                own.append(i)
        taken += [part[i] for i in own]
    return taken


def _mixed(word: str) -> int:
    return int.from_bytes(word.encode()[:8].ljust(8), "little") * 0x9E3779B97F4A7C15 % 2**64


def _calibrate(scorer: Scorer, decisions: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Logistic regression of the label on the decision value."""
    x = np.c_[decisions, np.ones(len(decisions))]
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weights * (labels - p)) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    scorer.scale, scorer.shift = float(max(w[0], 1e-6)), float(w[1])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Scorer | None:
    """Fit on the labelled rows that are not held out; None if they do not
    show both labels.  Of contradicting labels the larger counts, of several
    texts of an id the least."""
    marks = (labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
                   .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
                   .filter(~held_out(F.col("id"))))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    present = texts.filter(F.length("text") <= DOC_CHARS).select("id").distinct().join(marks, "id")
    chosen = staged(present.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(DOCS)
                    .unionByName(present.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(DOCS)), "sample")
    sample = staged(texts.filter(F.length("text") <= DOC_CHARS).join(F.broadcast(chosen), "id")  # at most 2 * DOCS rows
                         .groupBy("id", "label").agg(F.min("text").alias("text")), "sample-texts")
    # One task fits, so that the driver never holds the sample: it gets the
    # weights and the ids that were set aside.
    fitted = (sample.mapInArrow(_sentence_rows, "id long, label int, sentence string").repartition(1)
                    .sortWithinPartitions("label", "id", "sentence")
                    .mapInArrow(_fitted, "codes array<long>, weights array<double>, unseen array<long>").toArrow())
    if not fitted.num_rows:
        return None
    codes, weights, unseen = (fitted.column(c)[0].values.to_numpy() for c in ("codes", "weights", "unseen"))
    scorer = Scorer(codes.view(np.uint64), weights, BIAS)
    get = shipped(docs.sparkSession, scorer)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = get(), {}
        for batch in small_batches(batches, 128):
            yield pa.RecordBatch.from_arrays([pa.array(own.documents(batch.column(0).to_pylist(), known)), batch.column(1)],
                                             names=["decision", "label"])

    judged = sample.filter(F.col("id").isin(unseen.tolist())) if len(unseen) else sample
    seen = judged.select("text", "label").mapInArrow(decide, "decision double, label int").toArrow().to_pandas()
    shares = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    y = seen.label.to_numpy(int)
    taken = np.bincount(y, minlength=2)
    _calibrate(scorer, seen.decision.to_numpy(), y.astype(float), np.array([shares[k] / taken[k] for k in y]))
    return scorer


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 128):
        names = batch.schema.names
        rows = [(i, label, s) for i, label, text in zip(*(batch.column(names.index(c)).to_pylist() for c in ("id", "label", "text")), strict=True)
                for s in sentences(text)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                                          pa.array(columns[2], pa.string())], names=["id", "label", "sentence"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all sentences of the sample in order: the scorer's codes and
    weights, and the ids of the documents that the fit did not see; none if
    the sample does not show both labels."""
    rows = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
    aside = {label: {i for i, own, _ in rows if own == label and _mixed(str(i)) // 7 % 5 == 0} for label in (0, 1)}
    if min(map(len, aside.values())) < LEAST_ASIDE:
        aside = {}
    unseen = set().union(*aside.values())
    scorer = _fit(r for r in rows if r[0] not in unseen)
    if scorer is not None:
        yield pa.RecordBatch.from_arrays([list_array([as_long(scorer.codes)], pa.int64()), list_array([scorer.weights], pa.float64()),
                                          list_array([np.array(sorted(unseen), np.int64)], pa.int64())],
                                         names=["codes", "weights", "unseen"])


def scored(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` added (a column of that name is replaced):
    0 to 1, higher if a label 1 is likelier.  Null and blank texts score as one without any
    telling word does; without a scorer all score 0.  Rows are scored one by
    one, so repeated rows and rows without an id score the same."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == score_col.lower()])
    if scorer is None:
        return docs.withColumn(score_col, F.lit(0.0))
    get = shipped(docs.sparkSession, scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = get(), {}
        for batch in small_batches(batches, 128):
            found = _beyond(own.decisions(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), known))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.probability(found), pa.float64())],
                                             names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, docs.withColumn(score_col, F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of ``docs``;
    for the cases see :func:`train` and :func:`scored`.  A row without an id
    is not held out.  An empty table gives an empty result."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = scored(rows, train(docs, labels, id_col, text_col))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
