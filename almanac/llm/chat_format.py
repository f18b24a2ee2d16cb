"""Chat formatting with a template that is a black box.

A template is any function from a list of (role, text) to a string.  Nothing is
known of it but what it answers: the turns so far are rendered with one more
turn each time, and if the longer output begins with the shorter one, what is
new is that turn's span.  If it does not, the template has rewritten history at
that turn, which is reported; the output is then kept, but has no spans.  Where
the text stands inside its span is found by rendering a rare character in its
place, and the loss mask covers the texts of the roles to be learned.

A long conversation is rendered in parts of ``PART`` turns, each after the
``CONTEXT`` turns before it, and it is checked that these render as they did, so
that the work and the memory do not grow with the square of its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns of a part, and turns before it that its rendering begins with.
PART, CONTEXT = 64, 8
#: Stands for a text; a character of Unicode's private use.  A template whose
#: own output has it gets another one of the block.
PROBES = [chr(c) for c in range(0xE000, 0xE010)]
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


class Span(NamedTuple):
    """A turn's place in its part, and its text's place, in code points; the
    end is exclusive."""

    start: int
    end: int
    text_start: int
    text_end: int
    learned: bool


class Rewritten(Exception):
    """The template changed what it had said, or hides a text."""

    def __init__(self, turn: int):
        super().__init__(turn)
        self.turn = turn


# ------------------------------------------------------------------ templates

#: Control strings of the default template, by role; other roles are named.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANSWER] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
_SPECIAL, _ESCAPED = re.compile(r"[\\\[\]<]"), re.compile(r"([\\\[\]<])\\")
_PIECE = re.compile(r"(?s)\[ROLE ((?:[\\\[\]<]\\|[^\\\[\]<])*)\] (.*) \[/ROLE\]\Z")


def escape(text: str) -> str:
    """No control string is left in the result, nor begins in it: each of them
    holds one of the characters that get a backslash after them."""
    return _SPECIAL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: every turn between the control strings of its
    role, control strings inside texts escaped reversibly."""
    out = []
    for role, text in turns:
        if role in MARKS:
            before, after = MARKS[role]
            out.append(f"{before}{escape(text)}{after}")
        else:
            out.append(f"{OTHER[0]}{escape(role)}{OTHER[1]}{escape(text)}{OTHER[2]}")
    return "".join(out)


def read_turn(piece: str) -> Turn:
    """The turn that :func:`marked_turns` wrote as ``piece``."""
    for role, (before, after) in MARKS.items():
        if piece.startswith(before) and piece.endswith(after):
            return role, unescape(piece[len(before):len(piece) - len(after)])
    role, text = _PIECE.match(piece).groups()
    return unescape(role), unescape(text)


# ------------------------------------------------------------------ rendering

def text_span(template: Template, before: list[Turn], turn: Turn, said: str, piece: str) -> tuple[int, int]:
    """Where the text stands in ``piece``, what ``turn`` added to ``said``."""
    for probe in PROBES:
        out = template([*before, (turn[0], probe)])
        if not out.startswith(said) or out.count(probe, len(said)) != 1:
            continue
        head, tail = out[len(said):].split(probe)
        if piece.startswith(head) and piece.endswith(tail) and len(head) + len(tail) <= len(piece):
            return len(head), len(piece) - len(tail)
    raise ValueError


def render(template: Template, turns: list[Turn], context: int = 0, learned: tuple[str, ...] = LEARNED) -> tuple[str, list[Span]]:
    """The output for the turns after the first ``context`` ones, and their
    spans; raises :class:`Rewritten` with the number of the turn at which
    history changed or whose text could not be found."""
    said = template(turns[:context])
    begin, spans = len(said), []
    for i in range(context, len(turns)):
        out = template(turns[:i + 1])
        if not out.startswith(said):
            raise Rewritten(i)
        try:
            start, end = text_span(template, turns[:i], turns[i], said, out[len(said):])
        except ValueError:
            raise Rewritten(i) from None
        at = len(said) - begin
        spans.append(Span(at, len(out) - begin, at + start, at + end, turns[i][0] in learned))
        said = out
    return said[begin:], spans


class Formatter:
    """One conversation, fed turn by turn; gives a part whenever one is
    whole."""

    def __init__(self, template: Template, part: int, context: int, learned: tuple[str, ...]):
        self.template, self.size, self.context, self.learned = template, part, context, learned
        self.before: list[Turn] = []
        self.turns: list[Turn] = []
        self.parts, self.n_turns, self.rewritten = 0, 0, None

    def feed(self, turn: Turn) -> list[dict]:
        self.turns.append(turn)
        return [self._part()] if len(self.turns) == self.size else []

    def done(self) -> list[dict]:
        return [self._part()] if self.turns or not self.parts else []

    def _part(self) -> dict:
        everything, n = [*self.before, *self.turns], len(self.before)
        try:
            if self.rewritten is not None:
                raise Rewritten(0)
            text, spans = render(self.template, everything, n, self.learned)
        except Rewritten as e:
            if self.rewritten is None:
                self.rewritten = self.n_turns + e.turn - n
            said, text, spans = self.template(self.before), self.template(everything), []
            text = text[len(said):] if text.startswith(said) else text
        made = {"part": self.parts, "n_turns": len(self.turns), "formatted": text, "spans": [s._asdict() for s in spans],
                "rewritten_at": self.rewritten}
        self.parts, self.n_turns = self.parts + 1, self.n_turns + len(self.turns)
        if self.context and self.rewritten is None and len(self.turns) >= self.size:
            self._check(everything, text, spans)
        self.before, self.turns = everything[-self.context:] if self.context else [], []
        return made

    def _check(self, turns: list[Turn], text: str, spans: list[Span]) -> None:
        """The turns that the next part begins with must render alike without
        what stood before them, but for the first half of them; else what the
        template says of a turn depends on more than ``context`` others."""
        kept = min(self.context, len(spans))
        short = self.template(turns[-kept:])
        sure = text[spans[-(kept - kept // 2)].start:]
        if not short.endswith(sure):
            self.rewritten = self.n_turns


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("learned", pa.bool_())])
PARTS = {"part": pa.int64(), "n_turns": pa.int64(), "formatted": pa.string(), "spans": pa.list_(SPAN), "rewritten_at": pa.int64()}
PARTS_SQL = ("part long, n_turns long, formatted string, "
             "spans array<struct<start: long, end: long, text_start: long, text_end: long, learned: boolean>>, rewritten_at long")
#: Code points of formatted text after which a batch is sent.
BATCH = 4_000_000


def _batches(rows: Iterator[tuple], id_type: pa.DataType, columns: dict) -> Iterator[pa.RecordBatch]:
    """Rows (id, values, weight) as Arrow batches of bounded weight."""
    held, weight = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], id_type),
                                           *(pa.array([x[c] for _, x in held], t) for c, t in columns.items())], names=["id", *columns])
    for key, values, w in rows:
        held.append((key, values))
        weight += w
        if weight >= BATCH or len(held) >= 4096:
            yield made()
            held, weight = [], 0
    yield made()


def _formatted(id_type: pa.DataType, template: Template, part: int, context: int, learned: tuple[str, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, now = None, None
        weigh = lambda key, parts: ((key, p, len(p["formatted"])) for p in parts)
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or key != current:
                    if now is not None:
                        yield from weigh(current, now.done())
                    current, now = key, Formatter(template, part, context, learned)
                yield from weigh(key, now.feed((role or "", text or "")))
        if now is not None:
            yield from weigh(current, now.done())

    return lambda batches: _batches(rows(batches), id_type, PARTS)


def format_conversations(rows: DataFrame, template: Template = marked_turns, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = LEARNED,
                         part: int = PART, context: int = CONTEXT) -> DataFrame:
    """(id, part, n_turns, formatted, spans, rewritten_at): conversations in
    parts of up to ``part`` turns, with the span of every turn in its part.

    A conversation's rows stand by turn (nulls first), then role, then text; a
    null role or text is empty, a null id is a conversation of its own,
    repeated rows are turns of their own.  ``rewritten_at`` is the number of the
    turn (from 0) at which the template was found to rewrite history, or to
    hide or repeat a text, and null if it never did; parts from there on have
    their output, but no spans.  In a conversation of more than ``part`` turns a
    turn's output may depend on the ``context`` turns before its part; one that
    is found to depend on more is reported likewise.  Rows of one part come in
    one task and in order, and no more than a part is held.  An empty table gives
    no rows; other columns are not looked at.
    """
    pick = lambda c: F.col(f"`{c}`")
    sorted_rows = (rows.select(pick(id_col).alias("id"), pick(turn_col).alias("turn"), pick(role_col).cast("string").alias("role"),
                               pick(text_col).cast("string").alias("text"))
                       .repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text"))
    id_type = sorted_rows.schema["id"].dataType
    return sorted_rows.mapInArrow(_formatted(to_arrow_type(id_type), template, part, context, learned),
                                  f"id {id_type.simpleString()}, {PARTS_SQL}")


DIGEST = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(),
          "formatted_chars": pa.int64(), "rewritten_at": pa.int64()}


def _digests(id_type: pa.DataType, read: Callable[[str], Turn], plain: Callable[[str], str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, values, turns, loss = None, None, None, None

        def done():
            return current, values | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}, 100

        for batch in batches:
            for key, _, n, formatted, spans, rewritten in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if values is None or key != current:
                    if values is not None:
                        yield done()
                    current, turns, loss = key, hashlib.sha256(), hashlib.sha256()
                    values = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "rewritten_at": None}
                values["formatted_chars"] += len(formatted)
                values["rewritten_at"] = rewritten
                for span in spans:
                    role, text = read(formatted[span["start"]:span["end"]])
                    turns.update(f"{role}\n{text}\n".encode())
                    values["n_turns"] += 1
                    if span["learned"]:
                        said = plain(formatted[span["text_start"]:span["text_end"]])
                        loss.update(said.encode())
                        values["loss_chars"] += len(said)
        if values is not None:
            yield done()

    return lambda batches: _batches(rows(batches), id_type, DIGEST)


def digests(parts: DataFrame, read: Callable[[str], Turn] = read_turn, plain: Callable[[str], str] = unescape) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    rewritten_at) of the output of :func:`format_conversations`, read back from
    the formatted text: the turns by their spans with ``read``, the learned
    texts by the loss mask with ``plain``; both belong to the template.  To be applied to that output as it comes,
    as it relies on a conversation's parts being in one task and in order."""
    id_type = parts.schema["id"].dataType
    kinds = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in DIGEST.items())
    return parts.mapInArrow(_digests(to_arrow_type(id_type), read, plain), f"id {id_type.simpleString()}, {kinds}")
