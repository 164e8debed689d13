"""Repair of conversation structure: the cheapest edits that make the roles of a conversation take turns.

Roles count by their initials; a repaired conversation reads ``(s?(ua)+)?``. Its rows are taken by turn (nulls
first, then role, text) and each is kept (cost 0), given the role user or assistant (3) or deleted (4); empty
messages are inserted anywhere (3). Rows without a visible character and rows whose role and text were seen earlier in the conversation
have to be deleted; rows that break off (last visible character not one of ``.!?``) cost 3 more unless deleted.

The search runs over the rows once, with four states (nothing yet, after s, after u, after a). A state's best edits
so far are a linked node, whose prefix is shared with all nodes that grew from it. Among edits of one cost the least
audit (string of initials D, I, K, R) wins. Two audits are compared in logarithmic time: nodes have rolling hashes
and binary-lifting ancestors, by which the search finds their longest common prefix; that prefix is verified, and where
hashes lied the audits are compared letter by letter. Keeping the least audit per state is right: of two audits
for the same rows that end in one state at one cost, neither begins with the other, since that would be
insertions that lead back to the same state for nothing. An audit fixes its repair, as each state but the
first takes one role only.

Rows are dealt by conversation and sorted there, where Spark spills; a task reads them as a stream and holds one conversation.

Defined cases: a null role or text is one space; null turns come first and don't count for gaps; a null
conversation is one of its own; rows with ``lost`` set are not there, they only make their conversation known; a conversation
without other rows has zeros, an empty audit and no messages; repeated rows are duplicates; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3  # costs; BROKEN: of an undeleted row that breaks off
NAMES = {"u": "user", "a": "assistant"}
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = {"su", "ua", "au"}
BASE, MODULUS = 1_000_003, (1 << 61) - 1
OUT_ROWS = 2048
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Edits(NamedTuple):
    """A string of edits: its last letter behind those of ``up[0]``; ``up[k]`` is 2^k letters shorter."""
    letter: str
    size: int
    hash: int
    up: tuple[Edits, ...]


NO_EDITS = Edits("", 0, 0, ())


def grow(edits: Edits, letter: str, modulus: int = MODULUS) -> Edits:
    up = [edits]
    while len(up) <= len(up[-1].up):
        up.append(up[-1].up[len(up) - 1])
    return Edits(letter, edits.size + 1, (edits.hash * BASE + ord(letter)) % modulus, tuple(up))


def letters(edits: Edits) -> str:
    out = []
    while edits.size:
        out.append(edits.letter)
        edits = edits.up[0]
    return "".join(reversed(out))


def cut(edits: Edits, size: int) -> Edits:
    while edits.size > size:
        edits = edits.up[(edits.size - size).bit_length() - 1]
    return edits


def same(a: Edits, b: Edits) -> bool:
    """Whether two strings of one size are equal; shared prefixes are one node, where it stops."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Edits, b: Edits) -> bool:
    """Whether the string ``a`` is less than ``b``."""
    size = min(a.size, b.size)
    x, y = cut(a, size), cut(b, size)
    if x.hash == y.hash:
        if same(x, y):
            return a.size < b.size
        return letters(a) < letters(b)
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if same(x.up[0], y.up[0]):  # the longest common prefix
        return x.letter < y.letter
    return letters(a) < letters(b)


class Repair:
    """One conversation, row by row."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.rows: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.turns: tuple | None = None  # least, last, distinct
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.best = self.insert([(0, NO_EDITS), None, None, None])

    def better(self, old, cost: int, edits: Edits, letter: str):
        """The better of a state's ``old`` edits and ``edits`` with one letter more."""
        if old is None or cost < old[0]:
            return cost, grow(edits, letter, self.modulus)
        if cost == old[0]:
            new = grow(edits, letter, self.modulus)
            if less(new, old[1]):
                return cost, new
        return old

    def insert(self, best: list) -> list:
        for state in (EMPTY, SYSTEM, ASSISTANT):
            if best[state]:
                best[USER] = self.better(best[USER], best[state][0] + INSERT, best[state][1], "I")
        if best[USER]:
            best[ASSISTANT] = self.better(best[ASSISTANT], best[USER][0] + INSERT, best[USER][1], "I")
        return best

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None:
            low, last, count = self.turns or (turn, None, 0)
            self.turns = low, turn, count + (turn != last)
        initial = role[:1]
        if self.rows and self.rows[-1][0][:1] + initial not in LEGAL:
            self.illegal += 1
        end = text.rstrip(BLANK)[-1:]
        go, broken = False, 0
        if not end:
            self.blank += 1
            go = True
        elif (role, text) in self.seen:
            self.duplicate += 1
            go = True
        elif end not in ENDS:
            self.truncated += 1
            broken = BROKEN
        self.seen.add((role, text))
        self.rows.append((role, text))
        new: list = [None] * 4
        for state, old in enumerate(self.best):
            if not old:
                continue
            cost, edits = old
            new[state] = self.better(new[state], cost + DELETE, edits, "D")
            if go:
                continue
            for wanted, then in NEXT[state].items():
                if wanted == initial:
                    new[then] = self.better(new[then], cost + KEEP + broken, edits, "K")
                elif wanted in NAMES:
                    new[then] = self.better(new[then], cost + REROLE + broken, edits, "R")
        self.best = self.insert(new)

    def result(self) -> dict:
        ends = [self.best[s] for s in (EMPTY, ASSISTANT) if self.best[s]]
        cost, edits = ends[0]
        for other, more in ends[1:]:
            if other < cost or other == cost and less(more, edits):
                cost, edits = other, more
        audit = letters(edits)
        low, last, count = self.turns or (0, 0, 1)
        return {"gaps": last - low + 1 - count, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": audit, "messages": replay(audit, self.rows)}


def replay(audit: str, rows: Sequence[tuple[str, str]]) -> list[dict]:
    """The messages that the edits make of the rows."""
    state, out, left = EMPTY, [], iter(rows)
    for edit in audit:
        role, text = next(left) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["a" if state == USER else "u"]
        state = NEXT[state][role[:1]]
        out.append({"role": role, "text": text})
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           lost: Column | None = None) -> DataFrame:
    """One row per conversation: its id, counts of faults, the cost, the audit and the repaired messages."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    lost = F.coalesce(lost, F.lit(False)) if lost is not None else F.lit(False)
    rows = turns.select(F.col(conv_id), lost.alias("_lost"), F.col(turn).cast("long").alias("_turn"), space(role).alias("_role"),
                        F.when(~lost, space(text)).alias("_text"))
    dealt = rows.repartition(conv_id).sortWithinPartitions(
        conv_id, F.col("_turn").asc_nulls_first(), "_role", "_text")
    message = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([turns.schema[conv_id], *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("audit", T.StringType()), T.StructField("messages", T.ArrayType(message))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, now = [], None, None
        for conv, gone, number, who, what in _read(batches):
            if now is None or conv != key:
                if now is not None:
                    done.append({conv_id: key, **now.result()})
                if len(done) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
                key, now = conv, Repair()
            if not gone:
                now.add(number, who, what)
        if now is not None:
            done.append({conv_id: key, **now.result()})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return dealt.mapInArrow(run, schema)
