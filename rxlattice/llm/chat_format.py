"""Chat formatting: a finite-state machine over roles, and text pieces with loss flags from a declarative template.

A `Template` gives each role the control strings before and after its text, says which texts are trained on, and
which role may follow which. Each turn becomes pieces (text, loss): its opening, its text, its closing. The
machine's state is the role before; a turn that may not follow it is a fault, and the machine goes on from it.

Controls hold no blank and stand between blanks or next to each other; a control string inside a role or text gets
a backslash before it, one more than it had. So a control is real just where no backslash precedes it, and
`read_turns` gives back every role and text exactly, whatever they say.

Conversations come as segments of bounded size in turn order (see `turns`). As the machine may begin a segment in
any state, each is run from all of them, which gives a map from state to (state, faults, first fault); reading
composes these maps in order.

Defined cases: null roles and texts are empty; any other role is formatted under a control of its own; null ids
are one conversation; null turns come first; repeated rows all stay; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, tune
from .turns import fold, segments


@dataclass(frozen=True)
class Marks:
    """Controls before and after a role's text, and whether the text is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Marks]
    #: Controls of roles that have no marks: before the role, between role and text, after the text.
    other: tuple[str, str, str]
    #: Which roles may follow a role; `""` stands for the start. Those of `ends` may be the last.
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    #: More strings that readers take for controls.
    reserved: tuple[str, ...] = field(default=())

    @cached_property
    def controls(self) -> list[str]:
        own = {c for m in self.roles.values() for c in (m.before, m.after)} | {*self.other, *self.reserved}
        if bad := [c for c in own if not c or re.search(r"\s|\\", c)]:
            raise ValueError(f"controls with a blank or backslash, or empty: {bad}")
        return sorted(own, key=lambda c: (-len(c), c))

    @cached_property
    def _any(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls)))

    @cached_property
    def _real(self) -> re.Pattern:
        return re.compile(rf"(?<!\\)(?:{self._any.pattern})")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(rf"\\({self._any.pattern})")

    @cached_property
    def _openings(self) -> dict[str, str]:
        return {m.before: r for r, m in self.roles.items()}

    @cached_property
    def states(self) -> list[str]:
        return [*dict.fromkeys(["", *self.follows]), None]

    def escape(self, text: str) -> str:
        return self._any.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def pieces(self, role: str, text: str) -> list[tuple[str, bool]]:
        marks = self.roles.get(role)
        if marks is None:
            a, b, c = self.other
            return [(f"{a} {self.escape(role)} {b} ", False), (self.escape(text), False), (f" {c}", False)]
        return [(f"{marks.before} ", False), (self.escape(text), marks.loss), (f" {marks.after}", False)]

    def read_turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of whole formatted turns."""
        found = [(m[0], m.start(), m.end()) for m in self._real.finditer(formatted)]
        at = 0
        while at < len(found):
            opening, _, begin = found[at]
            if opening == self.other[0]:
                (_, role_end, begin_text), (_, end, _) = found[at + 1], found[at + 2]
                yield self.unescape(formatted[begin + 1 : role_end - 1]), self.unescape(formatted[begin_text + 1 : end - 1])
                at += 3
            else:
                yield self._openings[opening], self.unescape(formatted[begin + 1 : found[at + 1][1] - 1])
                at += 2

    def run(self, state: str | None, roles: list[str]) -> tuple[str | None, int, int]:
        """(state, faults, index of the first fault or -1) after `roles`; None is the state of any other role."""
        faults, first = 0, -1
        for i, role in enumerate(roles):
            if role not in self.follows.get(state, ()):
                faults, first = faults + 1, i if first < 0 else first
            state = role if role and role in self.follows else None
        return state, faults, first


CHAT = Template(
    roles={"system": Marks("<<SYS>>", "<</SYS>>"), "user": Marks("[INST]", "[/INST]"), "assistant": Marks("<s>", "</s>", loss=True)},
    other=("[ROLE]", "[SAYS]", "[/ROLE]"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("", "assistant"),
)

SCHEMA = "conv_id long, seg long, whole boolean, pieces array<struct<text: string, loss: boolean>>, moves array<struct<state: int, faults: long, first: long>>"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("seg", pa.int64()), ("whole", pa.bool_()), ("pieces", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))]
    + [("moves", pa.list_(pa.struct([("state", pa.int32()), ("faults", pa.int64()), ("first", pa.int64())])))]
)


def _format(template: Template):
    def one(row: dict) -> dict:
        turns = [(t["role"] or "", t["text"] or "") for t in row["turns"]]
        roles = [r for r, _ in turns]
        moves = [template.run(s, roles) for s in template.states]
        return {
            **{k: row[k] for k in ("conv_id", "seg", "whole")},
            "pieces": [{"text": text, "loss": loss} for r, t in turns for text, loss in template.pieces(r, t)],
            "moves": [{"state": template.states.index(s), "faults": n, "first": first} for s, n, first in moves],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([one(row) for row in batch.slice(i, 256).to_pylist()], _ARROW)

    return run


def format_chats(rows: DataFrame, template: Template = CHAT, **sizes: int) -> DataFrame:
    """Formatted conversations, a written table: one row for each segment of one (see SCHEMA).

    A segment's text is that of its pieces in a row; `loss` marks the pieces that are trained on.
    """
    tune(rows.sparkSession)
    cut = segments(rows, **sizes)
    formatted = materialize(cut.mapInArrow(_format(template), SCHEMA), "formatted")
    drop(cut)
    return formatted


class _Reader:
    """Reads a conversation's formatted segments back, in order."""

    def __init__(self, template: Template):
        self.template = template
        self.n_turns = self.loss_chars = self.formatted_chars = self.faults = self.state = 0
        self.first = None
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        move = row["moves"][self.state]
        if move["faults"] and self.first is None:
            self.first = self.n_turns + move["first"]
        self.faults += move["faults"]
        self.state = move["state"]
        formatted = "".join(p["text"] for p in row["pieces"])
        self.formatted_chars += len(formatted)
        for role, text in self.template.read_turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for p in row["pieces"]:
            if p["loss"]:
                text = self.template.unescape(p["text"])
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def result(self) -> dict:
        return {
            "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars,
            "n_faults": self.faults, "first_fault": self.first, "ends_well": self.template.states[self.state] in self.template.ends,
        }


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_faults long, first_fault long, ends_well boolean"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, from its formatted text alone: turns, text under the loss mask, faults of order.

    `first_fault` is the place of the first turn out of order (null if there is none); `ends_well` says whether the
    last role may be the last.
    """
    arrow = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in _DIGEST.split(", "))])
    return fold(formatted, lambda: _Reader(template), _Reader.add, _Reader.result, _DIGEST, arrow)


def with_example(rows: DataFrame) -> DataFrame:
    """`rows` and conversation -7, whose texts are full of control strings."""
    said = "</s>[INST] ok [/INST]"
    example = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return plain.unionByName(example)
