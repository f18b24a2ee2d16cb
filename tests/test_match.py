"""Keyword matching: cases of our own plus a randomised check
against a plain Python ``re`` model of the same rules."""

import random
import re

from almanac.functions import match as M
from almanac.sources import fixed


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = M.with_alumni_match(df, "text", "m", **kw).orderBy("id").collect()
    return [r["m"].asDict() if r["m"] is not None else None for r in out]


def test_case_and_near_misses(spark):
    got = run(spark, ["In 1971 they were a GRADUATE OF the UNIVERSITY OF WINDSOR, and glad of it.",
                      "Forty years on, still an UWindsor alumnus at heart.",
                      "Born, raised and buried near Windsor.",
                      "Swept the halls of UWindsor each night."])
    assert got[0]["institution"] == "University of Windsor"
    assert (got[1]["institution"], got[1]["status"]) == ("UWindsor", "alumnus")
    assert got[2:] == [None, None]


def test_dotted_status_and_order(spark):
    a, b = run(spark, ["Called to the bar with an LL.B. of Windsor Law.",
                       "Some graduating classes forget; the one at the University of Windsor did not."])
    assert (a["institution"], a["status"]) == ("Windsor Law", "LL.B.") and "Windsor Law" in a["matched_text"]
    assert (b["institution"], b["status"]) == ("University of Windsor", "graduating")


def test_simple_mode_own_phrase(spark):
    (m,) = run(spark, ["Every spring the Tall Ships Choir sang."], mode="simple", keywords=["tall ships choir"])
    assert m["status"] == "simple_keyword" and m["institution"] == "tall ships choir"


def test_window_edge(spark):
    inst, stat = "Essex College", "alumna"
    at = f"{inst} " + "x" * 158 + f" {stat}"       # gap = 160 (two spaces + filler)
    past = f"{inst} " + "x" * 159 + f" {stat}"     # gap = 161
    got = run(spark, [at, past])
    assert got[0] is not None and got[1] is None


def test_emoji_nbsp_offsets(spark):
    text = "😀😀 Class of 1990, a graduate of Assumption College."
    (m,) = run(spark, [text])
    assert m["institution"] == "Assumption College"
    # excerpt is cut on code points of the normalised text
    norm = " ".join(text.split())
    assert m["matched_text"] == norm[max(0, norm.index("Class") - 45):].strip()


# ---- randomised agreement with a sequential model ---------------------------

def model(text, institutions, statuses, window):
    t = " ".join((text or "").split())

    def occ(keys):
        out = []
        for k in fixed.longest_first(keys):
            pat = re.compile(r"(?<!\w)" + r"\s+".join(re.escape(p) for p in k.split()) + r"(?!\w)", re.I)
            out += [(m.start(), k, m.end()) for m in pat.finditer(t)]
        order = {k: i for i, k in enumerate(fixed.longest_first(keys))}
        return sorted(out, key=lambda o: (o[0], order[o[1]]))

    for i in occ(institutions):
        for s in occ(statuses):
            if max(0, max(i[0], s[0]) - min(i[2], s[2])) <= window:
                lo, hi = min(i[0], s[0]), max(i[2], s[2])
                return {"institution": i[1], "status": s[1],
                        "matched_text": t[max(0, lo - 45):min(len(t), hi + 45)].strip()}
    return None


WORDS = ["the", "of", "Windsor", "University", "graduate", "B.A.", "alumni", "x", "é", "😀", "class",
         "Assumption", "College", "degree", "grad", "studied", "Law", "UWindsor", " ", "  ", "\n", "\u00a0", "\u2003", "graduated", "LL.B.", "J.D.", "Class of"]


def test_randomised_against_model(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(400):
        n = rnd.randint(0, 60)
        texts.append("".join(rnd.choice(WORDS) + rnd.choice([" ", "", ".", ", "]) for _ in range(n)))
    got = run(spark, texts, window=40)
    want = [model(t, fixed.DEFAULT_INSTITUTION_KEYWORDS, fixed.DEFAULT_STATUS_KEYWORDS, 40) for t in texts]
    assert got == want


def test_empty_keyword_sets_match_nothing(spark):
    assert run(spark, ["graduate of University of Windsor"], institutions=[]) == [None]
    assert run(spark, ["graduate of University of Windsor"], mode="simple", keywords=[]) == [None]


def test_running_ends_block_boundaries(spark):
    from itertools import accumulate
    rnd = random.Random(23)
    lengths = [0, 1, 2, 63, 64, 65, 127, 128, 129, 200, 4095, 4097, 5000]
    rows = [(n, [rnd.randint(1, 9) for _ in range(n)]) for n in lengths]
    df = spark.createDataFrame(rows, "n int, steps array<int>")
    got = {r["n"]: r["ends"] for r in M._with_running_ends(df, "steps", "ends").collect()}
    for n, steps in rows:
        assert got[n] == list(accumulate(steps)), n
