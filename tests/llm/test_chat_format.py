"""Chat formatting: spans of black-box templates, exact round trips."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import chat_format as C

TEXT = st.lists(st.sampled_from([*"\\[]<>/ aé😀\n\ue000", "[INST] ", "</s>", " [/INST]", "[ROLE x] ", "\\["]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=6))
def test_round_trip(turns):
    text, spans = C.render(C.marked_turns, turns)
    assert [C.read_turn(text[s.start:s.end]) for s in spans] == turns
    assert [C.unescape(text[s.text_start:s.text_end]) for s in spans] == [t for _, t in turns]
    assert [s.learned for s in spans] == [r == "assistant" for r, _ in turns]
    assert text == C.marked_turns(turns) and all(a.end == b.start for a, b in zip(spans, spans[1:], strict=False))
    assert not any(m in C.escape(t) for _, t in turns for m in ("[INST]", "[/INST]", "</s>", "[SYS]", "[ROLE"))


def lines(turns):
    return "<s>" + "".join(f"{r}: {t.strip()}\n" for r, t in turns)


def forgetful(turns):  # drops what earlier assistants thought
    last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
    return "".join(f"<{r}>{t if r == 'user' or i > last else '...'}" for i, (r, t) in enumerate(turns))


def open_end(turns):  # ends with an invitation, which the next turn replaces
    return "".join(f"<{r}>{t}" for r, t in turns) + "<bot?>"


def silent(turns):  # hides tools
    return "".join(f"<{r}>{t}" for r, t in turns if r != "tool")


def merged(turns):  # a system row goes into the first user turn
    head = "".join(t for r, t in turns[:1] if r == "system")
    return "".join(f"<{r}>{head if i == 1 else ''}{t}" for i, (r, t) in enumerate(turns) if not (i == 0 and r == "system"))


def counted(turns):  # numbers its turns
    return "".join(f"<{i}:{r}>{t}" for i, (r, t) in enumerate(turns))


CHAT = [("user", " hi "), ("assistant", "yes"), ("user", "more"), ("assistant", "no")]


def test_spans_of_other_templates():
    text, spans = C.render(lines, CHAT)
    assert [text[s.text_start:s.text_end] for s in spans] == ["hi", "yes", "more", "no"]
    assert [text[s.start:s.end] for s in spans] == ["user: hi\n", "assistant: yes\n", "user: more\n", "assistant: no\n"]


@pytest.mark.parametrize(("template", "turns", "at"), [
    (forgetful, CHAT, 2), (open_end, CHAT, 0), (silent, [*CHAT[:2], ("tool", "x"), *CHAT[2:]], 2), (merged, [("system", "be"), *CHAT], 0)])
def test_rewriting_is_found(template, turns, at):
    with pytest.raises(C.Rewritten) as e:
        C.render(template, turns)
    assert e.value.turn == at


def fed(template, turns, part=C.PART, context=C.CONTEXT):
    f = C.Formatter(template, part, context, C.LEARNED)
    return [p for t in turns for p in f.feed(t)] + f.done()


@pytest.mark.parametrize("n", [0, 1, 4, 5, 8, 63])
def test_parts_equal_the_whole(n):
    rng = random.Random(n)
    turns = [(rng.choice(["user", "assistant", "tool"]), f"t{i}") for i in range(n)]
    for template in (lines, C.marked_turns):
        parts = fed(template, turns, part=4, context=3)
        whole = template(turns)
        assert "".join(p["formatted"] for p in parts) == whole[len(template([])):] and sum(p["n_turns"] for p in parts) == n
        assert all(p["rewritten_at"] is None and len(p["spans"]) == p["n_turns"] for p in parts)


def test_long_range_and_late_rewriting():
    many = [("user", f"t{i}") for i in range(20)]
    assert fed(counted, many, part=4, context=3)[-1]["rewritten_at"] == 4
    assert fed(counted, many)[-1]["rewritten_at"] is None  # one part is rendered whole
    late = [("user", "a")] * 9 + [("tool", "b")] + [("user", "c")] * 3
    parts = fed(silent, late, part=4, context=2)
    assert [p["rewritten_at"] for p in parts] == [None, None, 9, 9] and [len(p["spans"]) for p in parts] == [4, 4, 0, 0]
    assert "".join(p["formatted"] for p in parts) == silent(late)


def test_work_is_linear_in_the_turns():
    said = [0]

    def template(turns):
        said[0] += len(turns)
        return C.marked_turns(turns)
    fed(template, [("user", "x")] * 5_000)
    assert said[0] < 5_000 * 2 * (C.PART + C.CONTEXT)


def test_table(spark):
    rng = random.Random(2)
    table = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice([None, "", "a\\[b]<", "ok", C.MARKS["user"][0]]))
             for c in [*range(30), None] for t in range(rng.randrange(1, 6))]
    table += [(1, None, "user", "null turn"), (1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (2, 9, "assistant", "Ö<" * 200_000)]
    table += [(99, t, "assistant", f"long {t}") for t in range(150)]
    df = spark.createDataFrame([(*r, 1, [2], 3) for r in table], "conv_id long, turn long, role string, text string, part int, spans array<int>, id int")
    got = {r.id: r for r in C.digests(C.format_conversations(df)).collect()}
    by = {}
    for c, t, r, x in sorted(table, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] is not None, (r[2] or "").encode()), (r[3] is not None, (r[3] or "").encode()))):
        by.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars, got[c].rewritten_at) == (
            len(turns), len(loss), len(C.marked_turns(turns)), None)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.digests(C.format_conversations(df.limit(0))).collect() == []
