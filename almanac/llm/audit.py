"""Conversation structure repair by a persistent audit DP.

A conversation's rows are read in order.  For every state of the role grammar
the DP holds the cheapest edits that lead there, and of equally cheap ones the
ASCII-least audit.  Audits share their prefixes: an audit is a node that links
to the node without its last edit, with binary-lifting ancestors and a rolling
hash, so that a new edit costs one node and not a copy.  Two audits of the same
cost are compared at their longest common prefix, found by descending the
ancestors while hashes differ; nodes are interned, so a prefix that the hashes
call common is verified by being the same node, and the search is done again by
identity if it is not.

Equally cheap audits of the same rows and state are never prefixes of each
other (the cost of an audit follows from its letters and its rows), so the least
whole audit is made of least parts.

States too dear to win are dropped (``SLACK``), and the prefix that all live
audits share is written out again and again, so that memory does not grow with
the conversation: its rows stream through a task in order.  Repeats that are not adjacent are found beforehand by an aggregate on
digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP, DELETE, INSERT, REROLE, TRUNCATED = 0, 4, 3, 3, 3
#: From any state, what another would do next can be copied for at most this
#: (insert an assistant, delete a system row); a state dearer than the
#: cheapest by more can't be on a cheapest path, nor tie with one.
SLACK = 7
#: The grammar ``(s?(ua)+)?``: begin, after s, after u, after a; the letter
#: that is next (besides s at the beginning), and where it leads.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
MOD, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6
#: Rows after which the shared prefix is written out.
COMMIT = 1024


class Node:
    """An audit: its last edit, and the audit before."""

    __slots__ = ("up", "depth", "edit", "mark", "then")

    def __init__(self, parent: Node | None = None, edit: str = ""):
        self.depth = parent.depth + 1 if parent else 0
        self.edit, self.then = edit, {}
        self.mark = (parent.mark * BASE + ord(edit)) % MOD if parent else 1
        self.up = [parent] if parent else []
        while self.up and len(self.up) <= len(self.up[-1].up):
            self.up.append(self.up[-1].up[len(self.up) - 1])

    def child(self, edit: str) -> Node:
        """The audit with one more edit; always the same node."""
        found = self.then.get(edit)
        if found is None:
            found = self.then[edit] = Node(self, edit)
        return found

    def at_depth(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.up[min(len(node.up), (node.depth - depth).bit_length()) - 1]
        return node


def parted(a: Node, b: Node, same=lambda x, y: x.mark == y.mark) -> tuple[Node, Node]:
    """The first nodes, of equal depth, at which two audits of equal depth
    differ; both the same node if they don't."""
    if same(a, b):
        return a, a
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and not same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a, b


def shared(a: Node, b: Node) -> tuple[Node, Node]:
    """As :func:`parted`, for any audits: cut to the shorter one's length,
    searched by hash and verified by identity."""
    depth = min(a.depth, b.depth)
    a, b = a.at_depth(depth), b.at_depth(depth)
    x, y = parted(a, b)
    if (x is y and a is not b) or (x is not y and x.up[0] is not y.up[0]):  # hashes collided
        x, y = parted(a, b, lambda p, q: p is q)
    return x, y


def less(a: Node, b: Node) -> bool:
    """The audit ``a`` comes before ``b`` in ASCII order."""
    x, y = shared(a, b)
    return a.depth < b.depth if x is y else x.edit < y.edit


class Repair:
    """One conversation, fed row by row; ``done`` gives its result."""

    def __init__(self):
        self.root = Node()
        self.live: dict[int, tuple[int, Node]] = {}
        self._inserts({0: (0, self.root)})
        self.rows: list[tuple[str, str]] = []  # those that no committed edit has used
        self.state, self.audit, self.sha, self.lines = 0, [], hashlib.sha256(), 0
        self.turns = self.least = self.most = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def _inserts(self, states: dict[int, tuple[int, Node]]) -> None:
        """Insertions lead from 0, 1 and 3 to 2 and from there to 3; more than
        that would come back dearer."""
        for target, sources in ((2, (0, 1, 3)), (3, (2,))):
            for source in sources:
                if source in states:
                    cost, node = states[source]
                    self._offer(states, target, cost + INSERT, node, "I")
        cheapest = min(cost for cost, _ in states.values())
        self.live = {s: x for s, x in states.items() if x[0] <= cheapest + SLACK}

    @staticmethod
    def _offer(states: dict, state: int, cost: int, parent: Node, edit: str) -> None:
        held = states.get(state)
        if held is None or cost < held[0]:
            states[state] = (cost, parent.child(edit))
        elif cost == held[0]:
            node = parent.child(edit)
            if node is not held[1] and less(node, held[1]):
                states[state] = (cost, node)

    def feed(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        bare = text.strip(SPACE)
        blank, copy = not bare, repeated or self.before == (role, text)
        cut = not blank and not copy and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += copy and not blank
        self.truncated += cut
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before[0][:1] + initial not in ("su", "ua", "au")
        self.before = (role, text)
        if turn is not None:
            self.n_turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        states: dict[int, tuple[int, Node]] = {}
        for state, (cost, node) in self.live.items():
            self._offer(states, state, cost + DELETE, node, "D")
            if blank or copy:
                continue
            stay = cost + (TRUNCATED if cut else 0)
            letter, after = NEXT[state]
            self._offer(states, after, stay + REROLE, node, "R")
            if initial == letter:
                self._offer(states, after, stay + KEEP, node, "K")
            elif state == 0 and initial == "s":
                self._offer(states, 1, stay + KEEP, node, "K")
        self._inserts(states)
        self.rows.append((role, text))
        if len(self.rows) >= COMMIT and len(self.rows) % COMMIT == 0:
            self._commit()

    def _write(self, edits: str) -> None:
        """Apply edits that no later row can change."""
        used = 0
        for edit in edits:
            letter, after = NEXT[self.state]
            line = None
            if edit == "I":
                line = ROLES[letter] + ":"
            else:
                role, text = self.rows[used]
                used += 1
                if edit == "R":
                    line = f"{ROLES[letter]}:{text}"
                elif edit == "K":
                    line = f"{role}:{text}"
                    if self.state == 0 and role[:1] == "s":
                        after = 1
            if line is not None:
                self.sha.update(("\n" * (self.lines > 0) + line).encode("utf-8", "surrogatepass"))
                self.lines += 1
                self.state = after
        del self.rows[:used]
        self.audit.append(edits)

    @staticmethod
    def _edits(node: Node, depth: int) -> str:
        out = []
        while node.depth > depth:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))

    def _commit(self) -> None:
        """Write the edits common to all live audits, and begin a new tree
        below them, so that the old one can go."""
        nodes = [node for _, node in self.live.values()]
        common = nodes[0]
        for node in nodes[1:]:
            x, y = shared(common, node)
            common = x if x is y else x.up[0]
        if common.depth == 0:
            return
        self._write(self._edits(common, 0))
        self.root = Node()
        for state, (cost, node) in self.live.items():
            again = self.root
            for edit in self._edits(node, common.depth):
                again = again.child(edit)
            self.live[state] = (cost, again)

    def done(self) -> dict:
        best = None
        for state in (0, 3):
            if state in self.live:
                cost, node = self.live[state]
                if best is None or cost < best[0] or (cost == best[0] and less(node, best[1])):
                    best = (cost, node)
        self._write(self._edits(best[1], 0))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.n_turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": best[0], "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


RESULT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
          "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def _repaired(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, repair = {c: [] for c in ("id", *RESULT)}, None, None

        def close() -> None:
            if repair is not None:
                out["id"].append(current)
                for c, x in repair.done().items():
                    out[c].append(x)

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out["id"], id_type), *(pa.array(out[c], t) for c, t in RESULT.items())],
                                              names=["id", *RESULT])
            for column in out.values():
                column.clear()
            return made

        for batch in batches:
            for key, turn, role, text, present, repeated in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if repair is None or key != current:
                    close()
                    current, repair = key, Repair()
                if present:
                    repair.feed(turn, role, text, repeated)
                if len(out["id"]) >= 4096:
                    yield sent()
        close()
        yield sent()
    return run


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, copies): the rows with damage by
    ``crc32(id:turn) % 20``: 0 drops a row (``copies`` 0), 1 empties its text,
    2 takes ``.!?`` out of it, 3 repeats it (``copies`` 2), 4 makes its role
    ``user``.  Nulls: a role, a text, and an id or turn inside the hashed text
    are one space."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    i, t, text = F.col(f"`{id_col}`"), F.col(f"`{turn_col}`"), space(F.col(f"`{text_col}`"))
    fate = F.crc32(F.concat(space(i), F.lit(":"), space(t)).cast("binary")) % 20
    return rows.select(i.alias("id"), t.cast("long").alias("turn"), fate.alias("fate"), space(F.col(f"`{role_col}`")).alias("role"),
                       text.alias("text")).select(
        "id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) for every id of ``rows``, which has the columns of
    :func:`damaged`; a row with ``copies`` 0 only names its conversation.

    A conversation's rows stand by turn (nulls first), then role, then text.
    The first fault of a row counts: blank (nothing but ASCII white space),
    duplicate (role and text stand earlier in the conversation), truncated (the
    last other character is not ``.``, ``!`` or ``?``).  Edits are Keep (0),
    Rerole to user or assistant (3), Delete (4; a must for blank and duplicate
    rows) and Insert of an empty user or assistant row anywhere (3); a truncated
    row that stays adds 3.  ``audit`` has the initials of the cheapest edits
    that give role initials ``(s?(ua)+)?``, ties ASCII-least, ``repaired_sha256``
    the hash of the repaired ``role:text`` lines.  ``gaps`` counts the turns
    missing between the first and the last.

    Nulls in role or text are one space; a null id is a conversation of its
    own, null turns stand first and are in no gap.  Empty texts are blank.
    Repeated rows are duplicates.  A conversation without rows has zeros, an
    empty audit and the hash of an empty text; an empty table gives no rows.
    A conversation streams through one task, whatever its length: its hash is
    one chain over all its text, and ``audit`` is all that grows.
    """
    id_type = dict(rows.dtypes)["id"]
    here = rows.filter("copies > 0")
    mark = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    # Only those that stand at several turns: copies of one turn are adjacent.
    again = (here.select("id", mark.alias("mark"), "turn").groupBy("id", "mark")
                 .agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_if(F.col("turn").isNull()).alias("nulls"))
                 .filter((F.col("first") < F.col("last")) | ((F.col("nulls") > 0) & F.col("first").isNotNull()))
                 .select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.when(F.col("nulls") == 0, F.col("first")).alias("_first")))
    later = F.col("_mark").isNotNull() & F.col("turn").isNotNull() & (F.col("_first").isNull() | (F.col("turn") > F.col("_first")))
    rows = (rows.withColumn("mark", mark).join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
                .select("id", "turn", "role", "text", (F.col("copies") > 0).alias("present"), later.alias("repeated"),
                        F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy")).drop("copy"))
    kind = f"id {id_type}, " + ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in RESULT.items())
    arrow = to_arrow_type(rows.schema["id"].dataType)
    return rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").mapInArrow(_repaired(arrow), kind)
