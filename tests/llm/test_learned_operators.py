"""Decontamination, mixing, toxicity, nearest neighbours and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark import TaskContext

from almanac.llm import decontaminate as D
from almanac.llm import hash_forest as H
from almanac.llm import mixing as X
from almanac.llm import toxicity as T
from conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id int"


def test_contaminations_against_a_scan(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, f"{say(20)}?\n{say(8)}.") for i in range(30)] + [(40, None), (41, ""), (42, "single sentence of seven words here")]
    rows = []
    for i in range(60):
        text = say(rnd.randint(0, 400))
        if i % 3 == 0:
            item = rnd.choice(items[:30])[1]
            at = rnd.randint(0, len(text))
            text = text[:at] + " " + " ".join(item.upper().split()) + " " + text[at:]
        if i % 7 == 1:
            text += " " + items[i % 30][1].split("\n")[0]  # the question alone
        rows.append((i, text, "en", "s", 0, 1))
    rows += [(90, None, "en", "s", 0, 1), (91, "", "en", "s", 0, 1), (92, "single sentence, of seven words here!", "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def held(text, item):
        part = [D.terms_of(x) for x in item.splitlines()]
        own = b" ".join(D.terms_of(text))
        return all(b" " + b" ".join(p) + b" " in b" " + own + b" " for p in part)

    want = {(i, k) for i, t, *_ in rows for k, item in items if item and t and held(t, item)}
    got = {(r.doc_id, r.item_id) for r in D.contaminations(docs, bench).collect()}
    assert got == want and len(want) >= 20
    left = D.uncontaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert D.contaminations(docs.limit(0), bench).collect() == []
    assert D.uncontaminated(docs, bench.limit(0)).count() == len(rows)


def test_index_in_parts_finds_the_same(spark, monkeypatch):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(D.contaminations(docs, bench))
    monkeypatch.setattr(D, "PART_BYTES", 2000)
    assert key(D.contaminations(docs, bench)) == whole and whole


def test_mixing_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(i, "word " * rnd.randint(1, 80), rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["a", "a", "a", "b", None]), 0, 1)
            for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    topic = (F.col("doc_id") % 2).cast("string")
    cells = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic.alias("topic"),
                        X.tokens_of(F.col("text")).alias("tokens")).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    targets = X.default_targets(cells)
    raked = X.rake(cells, targets).collect()
    assert math.isclose(sum(r.weight for r in raked), 1, rel_tol=1e-3)
    for m in X.MARGINS:
        for r in targets[m].collect():
            assert math.isclose(sum(c.weight for c in raked if c[m] == r[0]), r.target, rel_tol=2e-3)
    out = X.mixed(docs, topic=topic, budget=0.3).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(sum(r.tokens for r in out) / total - 0.3) < 0.03
    tokens = sum(r.tokens for r in out)
    for r in targets["source"].collect():
        assert abs(sum(c.tokens for c in out if (c.source or "") == r[0]) / tokens - r.target) < 0.03
    odd = spark.createDataFrame([(None, None, None, None, 0, 1), (1, "", "en", "a", 0, 1)], DOCS)
    assert {c.tokens for c in X.mixed(odd, budget=1.0).collect()} == {1}
    assert X.mixed(odd.limit(0)).collect() == []


def test_kernel_is_the_gap_weighted_one():
    def plain(a, b):
        def phi(word):
            word, out = f"\x02{word}\x03", {}
            for i in range(len(word)):
                for j in range(i + 1, len(word)):
                    for k in range(j + 1, min(len(word), i + T.SPAN)):
                        u = word[i] + word[j] + word[k]
                        out[u] = out.get(u, 0) + T.DECAY ** (k - i + 1)
            return out
        x, y = phi(a), phi(b)
        dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    words = ["idiot", "idxiot", "i.d.i.o.t", "aaaa", "é", "trash"]
    got = T._kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert math.isclose(got[i, j], plain(a, b), rel_tol=1e-9, abs_tol=1e-12)
    assert got[0, 1] > 0.3 > got[0, 5]


def test_held_out_toxicity(spark):
    rnd = random.Random(8)
    clean = ["".join(rnd.choice("abdefgilmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    rude = ["blockhead", "nincompoop", "dunderpate"]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 120))]
        if toxic:
            for _ in range(2):
                words.insert(rnd.randint(0, len(words)), rnd.choice(rude) + rnd.choice(["", "s", "."]))
        rows.append((i, " ".join(w + rnd.choice(["", "", "", "."]) for w in words), "en", "s", 0, 1))
        marks.append((i, int(toxic)))
    rows += [(None, None, None, None, 0, 1), (5000, "", "en", "s", 0, 1), (5001, "you blockhxead", "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = T.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    want = dict(marks)
    held = [r for r in out if r.held_out]
    assert all((r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in out)
    right = np.mean([r.predicted == want[r.doc_id] for r in held if r.doc_id in want])
    assert right > 0.95
    by_id = {r.doc_id: r for r in out}
    assert by_id[None].predicted == 0 and by_id[5000].predicted == 0 and 0 <= by_id[5000].score <= 1
    assert by_id[5001].score > by_id[5000].score
    assert T.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_landmarks_in_parts_and_ordered_scores():
    words = [f"{a}{b}{c}" for a in ("bor", "tal", "quin", "mes") for b in ("en", "ok", "ust", "ra") for c in ("ta", "lo", "mund", "", "x")]
    words = (words + [w + "e" for w in words])[:T.POOL_PART + 20]
    full = T._kernel(words, words)
    plain: list[int] = []
    for i in range(len(words)):
        if len(plain) < 60 and all(full[i, j] < T.LEAST_DIFFERENT for j in plain):
            plain.append(i)
    assert T._different(words, 60) == [words[i] for i in plain] and len(plain) > 10
    assert words[plain[0]] not in T._different(words, 60, beside=[words[plain[0]]])
    bags = [words[:3], [], words[5:40], words[40:41]]
    assert np.allclose(T._bag_kernel(bags, words[:9]), [full[[words.index(w) for w in b], :9].sum(axis=0) for b in bags])
    line = np.array([-9.0, -1.5, -1, -0.2, 0, 0.7, 1, 1.0001, 3, 300])
    assert (np.diff(T._beyond(line)) > 0).all() and np.abs(T._beyond(line)).max() < 1.01
    assert T._beyond(line)[2:7].tolist() == line[2:7].tolist()


def test_one_text_of_a_repeated_id(spark):
    rows = [(i, "plain words here.", 0) for i in range(40)] + [(100 + i, "you blorfing fool.", 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, "zebra crossing."), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    one = sorted(map(tuple, T.toxicity(docs, labels).collect()), key=str)
    assert one == sorted(map(tuple, T.toxicity(docs.repartition(7), labels).collect()), key=str) and len(one) == 82


def test_the_fit_is_a_task(spark, monkeypatch):
    fit = T._fit

    def in_a_task(rows):
        if TaskContext.get() is None:
            raise RuntimeError("the sample came to the driver")
        return fit(rows)

    monkeypatch.setattr(T, "_fit", in_a_task)
    rows = [(i, "plain words here.", 0) for i in range(40)] + [(100 + i, "you blorfing fool.", 1) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = T.train(table, table)
    toxic, clean = scorer.documents(["you blorfing fool.", "plain words here."], {})
    assert toxic > clean
    assert T.train(table, table.filter("toxic = 0")) is None and T.train(table.limit(0), table) is None


def test_rare_words_of_a_toxic_stem_and_sums_over_a_sentence():
    rnd = random.Random(3)
    make = lambda n: "".join(rnd.choice("abdefgilmnoprstu") for _ in range(n))
    clean = [make(rnd.randint(3, 9)) for _ in range(600)]
    say = lambda *more: " ".join([rnd.choice(clean) for _ in range(10)] + list(more))
    # Each toxic word is there once; only their stem is shared.
    rows = [(i, int(i < 60), s) for i in range(400) for s in [say(), say(*["zwonkk" + make(4)] * (i < 60)), say()]]
    scorer = T._fit(rows)
    new = [say("zwonkk" + make(4)) for _ in range(50)]
    top = scorer.documents([*new, *(say() for _ in range(50))], {})
    assert (top[:50] > 0).mean() > 0.9 and (top[50:] > 0).mean() < 0.1
    # A sentence adds up; two sentences do not.
    word = "zwonkkabcd"
    value = scorer.values([word, clean[0]])
    one = scorer.documents([f"{word} {clean[0]}", f"{word}. {clean[0]}"], {})
    assert np.allclose(one, np.clip([value.sum() + T.BIAS, max(value) + T.BIAS], -1, 1))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((700, 16)).astype(np.float32)
    points[300:420] = points[0]  # a third of them equal, more than are asked for
    rows = [(i, [float(x) for x in p], "l") for i, p in enumerate(points)]
    rows += [(900, None, "l"), (901, [], "l"), (902, [0.0] * 16, "l"), (903, [float("nan")] + [1.0] * 15, "l"),
             (None, [1.0] * 16, "l"), (1000, [None] + [1.0] * 15, "l"), (100, [float(x) for x in points[100]], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {}
    for r in H.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 100))
    x, hits = points.astype(np.float64), 0
    for q, found in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(700), far))[:10]
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(math.isclose(s, far[v], rel_tol=1e-12, abs_tol=1e-12) for _, v, s in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / 70 >= 0.9
    assert [v for _, v, _ in got[0]] == list(range(300, 310))
    assert H.nearest(df.limit(0)).collect() == []


def test_shards_and_blocks_agree(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    key = lambda: sorted(tuple(r) for r in H.nearest(df, every=10).collect())
    whole = key()
    monkeypatch.setattr(H, "SHARD", 100)
    monkeypatch.setattr(H, "BLOCK", 7)
    assert key() == whole and whole


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_return_documents(spark, stage):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    name, f = P.STAGES[stage]
    out = f(spark, docs, SMALL)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept <= every
    if name == "line dedup":
        assert kept == every
    if name == "near-dedup":
        from test_near_dup import brute
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert kept == set(brute(rows, 5).values())
    if name == "decontamination":
        bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
        assert every - kept == {r.doc_id for r in D.contaminations(docs, bench).collect()}
    if name == "toxicity":
        toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
        assert len(kept) > 0.8 * len(every) and toxic & (every - kept)


def texts_moved(df):
    """Rows with a text that exchanges of a collected ``df`` wrote."""
    def of(node):
        own = 0
        if node.nodeName() == "Exchange" and "text#" in node.output().toString():
            own = node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        return own + sum(of(children.apply(i)) for i in range(children.size()))
    return of(df._jdf.queryExecution().executedPlan())


def test_copies_go_without_moving_the_texts_that_stay(spark):
    """Where ids are too many to broadcast; among them null and repeated ids."""
    import corpus_pipeline as P
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60)), "en", "s", 119, 1) for i in range(300)]
    copies = [(1000 + i, rows[i][1] + " tail", *rows[i][2:]) for i in range(80)]
    repeated = [rows[200]] * 3 + [(201, "another text", "en", "s", 12, 1)] + [copies[0]] * 2
    without = [(None, rows[0][1], "en", "s", 119, 1), (None, None, "en", "s", None, 1)]
    docs = spark.createDataFrame(rows + copies + repeated + without, DOCS)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = P.drop_copies(spark, docs, SMALL)
        got = out.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert kept.pop(201) in (rows[201][1], "another text")
    assert kept == {r[0]: r[1] for r in rows if r[0] != 201} and len(got) == 302
    assert sorted(str(r.text) for r in got if r.doc_id is None) == sorted(["None", rows[0][1]])
    assert texts_moved(out) < 20


def test_line_stage_empties_documents_of_boilerplate_only(spark):
    import corpus_pipeline as P
    rows = [(i, f"menu\nown {i}", "en", "s", 9, 1) for i in range(20)] + [(50, "menu", "en", "s", 4, 1), (51, None, "en", "s", 7, 1)]
    got = {r.doc_id: (r.text, r.n_chars) for r in P.drop_lines(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()}
    assert got[3] == ("own 3", 5) and got[50] == ("", 0) and got[51] == (None, 7)


def test_run_is_the_stages_in_order(spark):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "mixing"]
    got = sorted(r.doc_id for r in P.run(spark, SMALL).collect())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from almanac.llm.common import staged
    for _, f in P.STAGES:
        docs = staged(f(spark, docs, SMALL), "again")
    assert got == sorted(r.doc_id for r in docs.collect()) and got
