"""Conversation repair against enumeration of all edits and a plain DP."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from almanac.llm import audit
from almanac.llm.audit import Repair, damaged, repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
NAMES = {"s": "system", "u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(audit.SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(rows):
    """(cost, audit, lines): the least of all edits with up to two
    insertions in a place."""
    kinds, best = faults(rows), None
    for marks in itertools.product(*["D" if f in ("blank", "duplicate") else "DKR" for f in kinds]):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            edits = "".join("I" * g + m for g, m in itertools.zip_longest(gaps, marks, fillvalue=""))
            cost = 3 * edits.count("I") + 4 * edits.count("D") + 3 * edits.count("R") + 3 * sum(
                f == "truncated" and m != "D" for f, m in zip(kinds, marks, strict=True))
            if best is not None and (cost, edits) >= best[:2]:
                continue
            for lead in ("", "s"):
                want = lead + "ua" * len(rows) * 3
                lines, at, row = [], 0, 0
                for edit in edits:
                    if edit in "KR":
                        role, text = rows[row]
                        lines.append((role if edit == "K" else NAMES.get(want[at], "") if want[at] != "s" else None, text))
                    if edit == "I":
                        lines.append((NAMES[want[at]] if want[at] != "s" else None, ""))
                    row += edit != "I"
                    at += edit != "D"
                if all(role is not None and (role[:1] == want[j]) for j, (role, _) in enumerate(lines)) and GRAMMAR.match(want[:len(lines)]):
                    best = (cost, edits, "\n".join(f"{r}:{t}" for r, t in lines))
                    break
    return best


def plain(rows):
    """The same DP with whole strings and nothing dropped."""
    states = {0: (0, "")}

    def inserts(held):
        for _ in range(2):
            for s, (c, e) in list(held.items()):
                t = audit.NEXT[s][1]
                held[t] = min(held.get(t, (c + 4, "")), (c + 3, e + "I"))
        return held
    states = inserts(states)
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for s, (c, e) in states.items():
            moves = [(s, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                letter, t = audit.NEXT[s]
                moves.append((t, 3 + more, "R"))
                moves += [(t, more, "K")] * (role[:1] == letter) + [(1, more, "K")] * (s == 0 and role[:1] == "s")
            for t, d, x in moves:
                new[t] = min(new.get(t, (10**9, "")), (c + d, e + x))
        states = inserts(new)
    return min(states[s] for s in (0, 3) if s in states)


def fed(rows, turns=None):
    made, seen = Repair(), {}
    for i, (role, text) in enumerate(rows):
        made.feed(turns[i] if turns else i, role, text, (role, text) in seen)
        seen[role, text] = True
    return made.done()


def random_rows(rng, n):
    text = lambda: rng.choice(["", " \t", "One.", "Two!", "cut off", "Three? ", "same."]) if rng.random() < 0.6 else f"Text {rng.random()}."
    return [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "u", ""]), text()) for _ in range(n)]


def test_against_all_edits():
    rng = random.Random(3)
    for _ in range(120):
        rows = random_rows(rng, rng.randrange(5))
        got, (cost, edits, lines) = fed(rows), enumerated(rows)
        assert (got["cost"], got["audit"]) == (cost, edits), rows
        assert got["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()


@pytest.mark.parametrize(("modulus", "commit"), [(audit.MOD, 1024), (audit.MOD, 3), (5, 64), (1, 64)])
def test_long_conversations_and_colliding_hashes(monkeypatch, modulus, commit):
    monkeypatch.setattr(audit, "MOD", modulus)
    monkeypatch.setattr(audit, "COMMIT", commit)
    rng = random.Random(9)
    for n in (1, 40, 700, 3000):
        rows = random_rows(rng, n)
        got = fed(rows)
        assert (got["cost"], got["audit"]) == plain(rows)


def test_memory_does_not_grow_with_the_conversation():
    made = Repair()
    for i in range(50_000):
        made.feed(i, ("user", "assistant")[i % 2], f"Row {i}.", False)
        assert len(made.rows) <= 2 * audit.COMMIT
    assert made.done()["audit"] == "K" * 50_000


def expected(table):
    """All of it for rows (conv, turn, role, text), damage included."""
    space = lambda x: " " if x is None else x
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = space(role), space(text)
            fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        pairs, kinds = [r[2:] for r in rows], faults([r[2:] for r in rows])
        turns = {r[1] for r in rows if r[0]}
        best = plain(pairs)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)), *best))
    return sorted(out, key=repr)


def test_table(spark):
    rng = random.Random(5)
    table = [(c, t, *random_rows(rng, 1)[0]) for c in [*range(40), 2**40, None] for t in range(rng.randrange(1, 9))]
    table += [(c, t, r, x) for c, t, r, x in table[::7]]                               # repeated rows
    table += [(3, None, "user", "Null turn."), (3, None, None, None), (3, 50, "user", "Null turn."), (4, 9, None, "Ö. " * 20_000),
              (5, 9, "user", None), (77, None, "user", "only.")]
    schema = "conv_id long, turn long, role string, text string, id int, mark string, copies int, audit string"
    df = spark.createDataFrame([(*r, 1, "m", 2, "a") for r in table], schema)
    got = repair(damaged(df)).collect()
    assert sorted(((r.id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in got), key=repr) == expected(table)
    assert repair(damaged(df.limit(0))).collect() == []


def test_nothing_left_after_damage(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    row = repair(damaged(spark.createDataFrame([(8, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in row] == [(8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
