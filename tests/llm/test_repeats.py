"""Removed words against a scan of all windows."""

import hashlib
import random

from almanac.llm import repeats as R

SCHEMA = "doc_id long, text string, n long, digest string"


def brute(rows, width):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - width + 1):
            key = tuple(words[s:s + width])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            if first[tuple(words[s:s + width])] < i:
                gone[s:s + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, width):
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in R.remove_repeats(df, words=width).collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(rnd.randint(8, 40))] for k in range(5)]
    rows = [(1, None), (2, ""), (3, "é " * 40), (4, "same " * 60), (5, "same " * 30)]
    for i in range(40):
        words = [rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice(passages)
        rows.append((10 + rnd.randint(0, 30), " ".join(words)))  # ids repeat
        if rnd.random() < 0.3:
            rows.append((90 + i, "\t".join(words)))
    for width in (10, 7):
        assert run(spark, rows, width) == brute(rows, width)


def test_nulls_and_empty(spark):
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, text, 0, ""), (2, text, 0, ""), (3, text, 0, "")], SCHEMA)
    got = {r.doc_id: r.n_removed for r in R.remove_repeats(df, words=10).collect()}
    assert got == {None: 0, 2: 0, 3: 20}
    assert R.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
