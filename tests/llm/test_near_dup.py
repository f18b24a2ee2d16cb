"""Components against brute force over all pairs."""

import random

from almanac.llm import near_dup as N

SCHEMA = "doc_id long, text string, n long, mark string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    size = min(width, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(rows, width):
    """doc_id -> smallest reachable id, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in label}


def run(spark, rows, width):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    out = N.near_duplicates(df, shingle_words=width).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}, len(out)


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.randint(1, 120))]
        rows.append(" ".join(text))
        for _ in range(rnd.randint(0, 6)):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(copy) // 12))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append("  ".join(copy).upper() if rnd.random() < 0.3 else "\n".join(copy))
    rnd.shuffle(rows)
    return [(100 + i * 3, t) for i, t in enumerate(rows)]


def check(spark, width, seed):
    rows = corpus(seed) + [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b c d e"), (7, "a b c d e f")]
    got, n = run(spark, rows, width)
    want = brute(rows, width)
    assert n == len(rows)
    assert got == {i: (len(shingles(t, width)), want[i], want[i] == i) for i, t in rows}


def test_two_word_shingles(spark):
    check(spark, 2, 5)


def test_five_word_shingles_in_blocks(spark, monkeypatch):
    """The same with all crowded lists compared in small blocks."""
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "BLOCK", 4)
    check(spark, 2, 11)


def test_crowd_around_shared_passages(spark, monkeypatch):
    """Texts that share a passage but are no copies, among them copies that the
    list's smallest member does not reach; signatures and sets in small blocks."""
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SIGNATURES", 8)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage, rows = [rnd.choice(words) for _ in range(40)], []
    for _ in range(40):
        own = [rnd.choice(words) for _ in range(40)]
        for _ in range(rnd.choice((1, 1, 3))):
            text = own + passage
            text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append(" ".join(text))
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    got, _ = run(spark, rows, 5)
    assert {i: g[1] for i, g in got.items()} == brute(rows, 5)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, 0, ""), (9, text, 0, ""), (9, "other words " + "x y z " * 9, 0, ""), (4, text, 0, ""),
                                (4, text, 0, "")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df, shingle_words=2).collect()), key=str)
    assert got == sorted([(None, None, True), (9, 4, False), (9, 4, False), (4, 4, True), (4, 4, True)], key=str)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
