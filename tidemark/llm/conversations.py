"""Repair the turn structure of conversations by the cheapest audit of edits.

A repaired conversation is empty or an optional system turn followed by pairs
of a user and an assistant turn. Every row is kept, given another role or
deleted, and empty turns may be inserted; the audit is the string of those
edits. :class:`_Repair` runs a dynamic program over the rows with one best
audit for each state of that grammar. Audits share their prefixes: an edit is a
node that points to the edit before it, to its ancestors 2, 4, 8, ... steps
back, and carries the rolling hash of the whole string up to it. Two audits of
equal cost are compared through a search for their longest common prefix over
the ancestors. Equal hashes are only believed of equal strings: a node is
looked up by length and hash, and equals the one found there if both add the
same letter to the same prefix, which is a node of its own. So by induction the
check of a whole prefix costs one comparison, and a collision only makes nodes
that are told apart.

Spark deals the rows by conversation once, marks duplicates and sorts each
conversation on disk, and a task streams through it. Edits on which all
surviving audits agree are settled, hashed and forgotten, so a long conversation
is never held whole: a task holds its undecided tail and a letter per edit. One
conversation is read by one task, as its digest is sequential.

Cases: a null counts as one blank in the key of the damage, in roles and in
texts. Rows are taken by turn, nulls first; rows that share a turn by role and
text. Equal rows after the first are duplicates. A conversation without rows
after the damage, or an empty table, has zeros, an empty audit and the digest of
the empty string. Rows with a null ``conv_id`` are one conversation. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, slices

BLANKS = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3

#: States of the grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_FINAL = (START, ASSISTANT)
#: The role that each state expects, and the state it leads to.
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_LEGAL = {"su", "ua", "au"}

#: Rows that wait before settled edits are looked for.
PENDING_ROWS = 256

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class _Node:
    """The last edit of an audit, with all edits before it."""

    __slots__ = ("up", "letter", "depth", "hash", "row", "role")

    def __init__(self, parent: _Node | None, letter: str, row: int, role: str | None):
        self.letter, self.row, self.role = letter, row, role
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(letter)) % _PRIME
        up, at, k = [parent], parent, 0
        while k < len(at.up):
            at = at.up[k]
            up.append(at)
            k += 1
        self.up = tuple(up)

    def at_depth(self, depth: int) -> _Node:
        node, k = self, len(self.up) - 1
        while node.depth > depth:
            k = min(k, len(node.up) - 1)
            while node.depth - (1 << k) < depth:
                k -= 1
            node = node.up[k]
        return node


class _Nodes:
    """Makes nodes so that equal audits are one node, whatever their hashes."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], list[_Node]] = {}

    def add(self, parent: _Node, letter: str, row: int, role: str | None) -> _Node:
        key = (parent.depth + 1, (parent.hash * _BASE + ord(letter)) % _PRIME)
        bucket = self.known.setdefault(key, [])
        for node in bucket:
            if node.up[0] is parent and node.letter == letter:
                return node
        node = _Node(parent, letter, row, role)
        bucket.append(node)
        return node


def _first_difference(a: _Node, b: _Node) -> tuple[_Node, _Node] | None:
    """The first edits in which two audits of equal length differ; None if they are equal."""
    if a is b:
        return None
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up):
            x, y = a.up[k], b.up[k]
            # Unequal hashes prove a difference; behind equal ones, identity tells equal strings from a collision.
            if x.hash != y.hash or x is not y:
                a, b = x, y
    return a, b


def less(a: _Node, b: _Node) -> bool:
    """Whether the audit ``a`` comes before ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    found = _first_difference(a.at_depth(depth), b.at_depth(depth))
    return a.depth < b.depth if found is None else found[0].letter < found[1].letter


class _Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last = None
        self.letters: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self._restart(_Node(None, "", -1, None))
        self.best: dict[int, tuple[int, _Node]] = {START: (0, self.root)}
        self.rows, self.first, self.wait = [], 0, PENDING_ROWS
        self._insert(-1)

    def _restart(self, root: _Node) -> None:
        self.root, self.nodes = root, _Nodes()

    def _offer(self, into: dict, state: int, cost: int, parent: _Node, letter: str, row: int, role: str | None) -> bool:
        held = into.get(state)
        if held is not None and held[0] < cost:
            return False
        node = self.nodes.add(parent, letter, row, role)
        if held is not None and held[0] == cost and (held[1] is node or not less(node, held[1])):
            return False
        into[state] = (cost, node)
        return True

    def _insert(self, row: int) -> None:
        """Insertions after ``row``; each costs, so a few rounds settle them."""
        moved = list(self.best)
        while moved:
            again = []
            for state in moved:
                cost, node = self.best[state]
                role, to = _NEXT[state]
                if self._offer(self.best, to, cost + COST[INSERT], node, INSERT, row, role):
                    again.append(to)
            moved = again

    def _drop_lost(self) -> None:
        """Drop states that cannot win any more, as the others could do all they can do for less.

        Behind an assistant turn the grammar expects what it expects behind a
        system turn. It allows all that it allows at the start but the keeping
        of a system row, and deleting that row makes up for it.
        """
        if ASSISTANT in self.best:
            bound = self.best[ASSISTANT][0]
            for state, more in ((SYSTEM, 0), (START, COST[DELETE])):
                if state in self.best and self.best[state][0] > bound + more:
                    del self.best[state]

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if fault is not None:
            setattr(self, fault, getattr(self, fault) + 1)
        row = self.first + len(self.rows)
        self.rows.append((role, text))
        extra = TRUNCATED if fault == "truncated" else 0
        # Audits of different numbers of rows are never equal, so earlier nodes need not be found again.
        self.nodes.known.clear()
        new: dict[int, tuple[int, _Node]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(new, state, cost + COST[DELETE], node, DELETE, row, None)
            if fault in ("blank", "duplicate"):
                continue
            wanted, to = _NEXT[state]
            if initial == wanted[0]:
                self._offer(new, to, cost + extra, node, KEEP, row, role)
            elif initial == "s" and state == START:
                self._offer(new, SYSTEM, cost + extra, node, KEEP, row, role)
            self._offer(new, to, cost + COST[REROLE] + extra, node, REROLE, row, wanted)
        self.best = new
        self._insert(row)
        self._drop_lost()
        if len(self.rows) >= self.wait:
            self._settle()

    def _write(self, path: list[_Node]) -> None:
        for node in path:
            self.letters.append(node.letter)
            if node.role is not None:
                text = "" if node.letter == INSERT else self.rows[node.row - self.first][1]
                line = f"{node.role}:{text}".encode()
                self.digest.update(b"\n" + line if self.lines else line)
                self.lines += 1

    def _path(self, node: _Node, root: _Node) -> list[_Node]:
        path = []
        while node is not root:
            path.append(node)
            node = node.up[0]
        return path[::-1]

    def _settle(self) -> None:
        """Write the edits all audits share, and begin anew behind them."""
        tails = [self._path(node, self.root) for _, node in self.best.values()]
        shared = 0
        while shared < min(map(len, tails)) and len({id(t[shared]) for t in tails}) == 1:
            shared += 1
        self._write(tails[0][:shared])
        settled = max((n.row for n in tails[0][:shared]), default=self.first - 1) + 1
        # An insertion belongs to the row before it, which may be settled already.
        self.rows, self.first = self.rows[settled - self.first :], settled
        top = _Node(None, "", settled - 1, None)
        self._restart(top)
        best = {}
        for (state, (cost, _)), tail in zip(self.best.items(), tails):
            node = top
            for old in tail[shared:]:
                node = self.nodes.add(node, old.letter, old.row, old.role)
            best[state] = (cost, node)
        self.best = best
        self.wait = max(PENDING_ROWS, 2 * len(self.rows))

    def result(self) -> tuple:
        chosen = None
        for state in _FINAL:
            if state in self.best:
                cost, node = self.best[state]
                if chosen is None or cost < chosen[0] or (cost == chosen[0] and less(node, chosen[1])):
                    chosen = (cost, node)
        cost, node = chosen
        self._write(self._path(node, self.root))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (*counts, "".join(self.letters), self.digest.hexdigest())


def _blank_for_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults put in by a hash of conversation and turn.

    A dropped row stays as one whose ``role`` is null, so that its conversation is known.
    """
    key = F.concat(_blank_for_null(F.col("conv_id")), F.lit(":"), _blank_for_null(F.col("turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = _blank_for_null(F.col("role")), _blank_for_null(F.col("text"))
    found = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    kind = F.col("_kind")
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return found.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).when(kind != 0, F.col("role")).alias("role"),
        F.when(kind != 0, changed).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``: blank, duplicate, truncated or null; rows of a conversation share a partition."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    seen = dealt.withColumn("_nth", F.row_number().over(same))
    fault = (
        F.when(shown == "", F.lit("blank"))
        .when(F.col("_nth") > 1, F.lit("duplicate"))
        .when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), F.lit("truncated"))
    )
    return seen.withColumn("fault", F.when(F.col("role").isNotNull(), fault)).drop("_nth")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``(conv_id, turn, role, text)``: counts, cost, audit and digest.

    Rows with a null role stand for rows that are gone.
    """
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    marked = faults(rows).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
        current, state, done = None, None, []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], key_type)]
            columns += [pa.array([d[i] for d in done], pa.int64()) for i in range(1, 7)]
            columns += [pa.array([d[i] for d in done], pa.string()) for i in (7, 8)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for part in slices(batches):
            key_type = part.column(0).type
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in part.columns)):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.result()))
                    current, state = conv, _Repair()
                if role is not None:
                    state.add(turn, role, text, fault)
            if done:
                yield batch()
        if state is not None:
            done.append((current, *state.result()))
            yield batch()
        release()

    schema = rows.select("conv_id").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    return marked.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, schema)
