"""Cheapest repair of the turn order of conversations, by a square-root checkpointed dynamic program.

Turns are kept (0), given the role user or assistant (3), deleted (4) or inserted with an empty text (3), so
that the initials of the roles read `(s?(ua)+)?`; a truncated turn that isn't deleted costs 3 more, a blank or
duplicate one must be deleted. Of the cheapest repairs the one whose edits' initials are least in ASCII is taken.

The role that an insertion or a new role must have follows from the state, so a letter and a state give the next
state. The costs from a row to the end are one number for each of four states. `walk` goes back over the rows and
keeps this vector at every sqrt(n)-th row only; going forward it computes a block's vectors again and takes
the least letter whose cost is tight.

Conversations of several segments are solved by the same recursion one level up. Each segment is a (min, +)
matrix over the states; a stream over the segments from the last to the first keeps their end vectors (the
checkpoints), a second one from the first to the last their first states; then every segment is walked on its
own. Turns that repeat one of an earlier segment are met by a join of hashes. So no task holds a conversation.

Defined cases: a row whose role and text are both null holds its conversation's place in the result and is no
turn; a null role or text beside a known one is one space; null ids are one conversation; null turns come first;
repeated rows are duplicates; a role that is empty or of another initial can't be kept, nor can `system` but at
the start; a conversation without turns needs no edit; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, materialize, tune
from .turns import conversation, fold, in_order, segments

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where a turn leads that is inserted or gets another role.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where a kept turn leads, by its role's initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40

Vector = tuple[int, int, int, int]
#: Costs from the end on: a conversation may end where it starts and after an assistant.
END: Vector = (0, 2 * INSERT, INSERT, 0)

_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
_ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")

#: A turn as the program sees it: a role's initial and whether it is truncated, or None if it must go.
Code = tuple[str, bool] | None


@lru_cache(1 << 16)
def _back(after: Vector, code: Code) -> Vector:
    bare = [DELETE + c for c in after]
    if code is not None:
        more = TRUNCATED * code[1]
        for s in STATES:
            bare[s] = min(bare[s], REROLE + more + after[NEXT[s]])
            if (to := KEPT.get(code[0], {}).get(s)) is not None:
                bare[s] = min(bare[s], KEEP + more + after[to])
    user, assistant = min(bare[USER], INSERT + bare[ASSISTANT]), min(bare[ASSISTANT], INSERT + bare[USER])
    return min(bare[START], INSERT + user), min(bare[SYSTEM], INSERT + user), user, assistant


def back(after: Vector, code: Code) -> Vector:
    """Costs from before a turn, given those from after it. Only differences count, so few vectors are met."""
    base = min(after)
    return tuple(min(FAR, base + c) for c in _back(tuple(min(FAR, c - base) for c in after), code))


def matrix(codes: Iterable[Code]) -> list[int]:
    """Least costs from each state before the turns to each one after them, row by row."""
    ends = []
    for t in STATES:
        v: Vector = tuple(0 if s == t else FAR for s in STATES)
        for code in reversed(list(codes)):
            v = back(v, code)
        ends.append(v)
    return [ends[t][s] for s in STATES for t in STATES]


def through(costs: list[int], after: Vector) -> Vector:
    return tuple(min(FAR, min(costs[4 * s + t] + after[t] for t in STATES)) for s in STATES)


def walk(codes: list[Code], state: int, end: Vector) -> tuple[list[str], int]:
    """(letters before and at each turn, last state) of the ASCII-least cheapest edits from `state` on."""
    width = isqrt(len(codes)) + 1
    marks, v, out = {}, end, []
    for b in reversed(range(0, len(codes), width)):
        marks[b] = v
        for code in reversed(codes[b : b + width]):
            v = back(v, code)
    for b in range(0, len(codes), width):
        block = codes[b : b + width]
        costs = [marks[b]]
        for code in reversed(block):
            costs.append(back(costs[-1], code))
        costs.reverse()
        for code, before, after in zip(block, costs, costs[1:]):
            letters = ""
            while DELETE + after[state] != before[state] and INSERT + before[NEXT[state]] == before[state]:
                letters, state = letters + "I", NEXT[state]
            if DELETE + after[state] == before[state]:
                letters += "D"
            else:
                to = KEPT.get(code[0], {}).get(state)
                kept = to is not None and KEEP + TRUNCATED * code[1] + after[to] == before[state]
                letters, state = letters + ("K" if kept else "R"), to if kept else NEXT[state]
            out.append(letters)
    return out, state


def key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _turns(row: dict) -> list[dict]:
    """The turns of a segment, with their faults; `again` lists the places of turns that an earlier segment has."""
    again, seen, found = set(row.get("again") or ()), set(), []
    for at, t in enumerate(row["turns"]):
        if t["role"] is None and t["text"] is None:
            continue
        role, text = t["role"] if t["role"] is not None else " ", t["text"] if t["text"] is not None else " "
        own = key(role, text)
        fault = "blank" if _BLANK.match(text) else "duplicate" if at in again or own in seen else None if _ENDED.search(text) else "truncated"
        seen.add(own)
        found.append({"at": at, "turn": t["turn"], "role": role, "text": text, "fault": fault, "key": own})
    return found


def _codes(turns: list[dict]) -> list[Code]:
    return [None if t["fault"] in ("blank", "duplicate") else (t["role"][:1], t["fault"] == "truncated") for t in turns]


_EDIT = [("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("text", pa.string())]
SCHEMA = "conv_id long, seg long, whole boolean, edits array<struct<edit: string, fault: string, turn: long, role: string, new_role: string, text: string>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("whole", pa.bool_()), ("edits", pa.list_(pa.struct(_EDIT)))])


def _edits(turns: list[dict], state: int, end: Vector, last: bool) -> list[dict]:
    out = []

    def insert() -> None:
        nonlocal state
        state = NEXT[state]
        out.append({"edit": "I", "fault": None, "turn": None, "role": None, "new_role": ROLES[state], "text": ""})

    codes = _codes(turns)
    for t, letters in zip(turns, walk(codes, state, end)[0]):
        for _ in letters[:-1]:
            insert()
        edit, role = letters[-1], None
        if edit == "K":
            role, state = t["role"], KEPT[t["role"][:1]][state]
        elif edit == "R":
            state = NEXT[state]
            role = ROLES[state]
        out.append({"edit": edit, "fault": t["fault"], "turn": t["turn"], "role": t["role"], "new_role": role, "text": t["text"]})
    while last and END[state]:
        insert()
    return out


def _by_rows(make, arrow: pa.Schema):
    """A function of Arrow batches from one of rows; a few rows at a time, as each holds a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([made for row in batch.slice(i, 256).to_pylist() for made in make(row)], arrow)

    return run


_IDS = [("conv_id", pa.int64()), ("seg", pa.int64())]
_STATE = "conv_id long, seg long, state int, ends array<long>, last boolean"


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs from the end of each segment, over segments from the last to the first."""
    conv, v, first = None, END, True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = first or row["conv_id"] != conv
            conv, v, first = row["conv_id"], END if last else v, False
            out.append({"conv_id": conv, "seg": row["seg"], "ends": list(v), "last": last})
            v = through(row["costs"], v)
        yield pa.RecordBatch.from_pylist(out, pa.schema([*_IDS, ("ends", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first state of each segment, over segments from the first to the last."""
    conv, state, first = None, START, True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if first or row["conv_id"] != conv:
                conv, state, first = row["conv_id"], START, False
            out.append({"conv_id": conv, "seg": row["seg"], "state": state, "ends": row["ends"], "last": row["last"]})
            state = row["jumps"][state]
        yield pa.RecordBatch.from_pylist(out, pa.schema([*_IDS, ("state", pa.int32()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _jumps(row: dict) -> list[dict]:
    """The state after a segment for each one before it."""
    codes, end = _codes(_turns(row)), tuple(row["ends"])
    return [{k: row[k] for k in ("conv_id", "seg", "ends", "last")} | {"jumps": [walk(codes, s, end)[1] for s in STATES]}]


def _over_segments(parts: DataFrame) -> DataFrame:
    """Edits of conversations of several segments."""
    keyed = materialize(parts.select("conv_id", "seg", "turns", conversation().alias("conv")), "parts")
    keys = materialize(
        keyed.mapInArrow(_by_rows(lambda r: ({"conv": r["conv"], "seg": r["seg"], "at": t["at"], "key": t["key"]} for t in _turns(r) if t["fault"] in (None, "truncated")), pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("at", pa.int32()), ("key", pa.binary())])), "conv string, seg long, at int, key binary"),
        "keys",
    )
    common = materialize(keys.groupBy("conv", "key").agg(F.min("seg").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "keys-common")
    again = join_hot(keys, common, ["conv", "key"], "n").where("seg > first").groupBy("conv", "seg").agg(F.collect_list("at").alias("again"))
    marked = materialize(keyed.join(again, ["conv", "seg"], "left"), "parts-marked")
    costs = marked.mapInArrow(_by_rows(lambda r: [{"conv_id": r["conv_id"], "seg": r["seg"], "costs": matrix(_codes(_turns(r)))}], pa.schema([*_IDS, ("costs", pa.list_(pa.int64()))])), "conv_id long, seg long, costs array<long>")
    ends = in_order(costs, last_first=True).mapInArrow(_backward, "conv_id long, seg long, ends array<long>, last boolean")
    known = materialize(marked.join(ends.withColumn("conv", conversation()).drop("conv_id"), ["conv", "seg"]), "parts-ends")
    jumps = known.mapInArrow(_by_rows(_jumps, pa.schema([*_IDS, ("ends", pa.list_(pa.int64())), ("last", pa.bool_()), ("jumps", pa.list_(pa.int32()))])), "conv_id long, seg long, ends array<long>, last boolean, jumps array<int>")
    starts = in_order(jumps).mapInArrow(_forward, _STATE).withColumn("conv", conversation()).drop("conv_id", "ends", "last")
    edits = known.join(starts, ["conv", "seg"]).mapInArrow(
        _by_rows(lambda r: [{"conv_id": r["conv_id"], "seg": r["seg"], "whole": False, "edits": _edits(_turns(r), r["state"], tuple(r["ends"]), r["last"])}], _ARROW), SCHEMA
    )
    edits = materialize(edits, "edits-parts")
    drop(keyed, keys, common, marked, known)
    return edits


def repair(rows: DataFrame, **sizes: int) -> DataFrame:
    """The edits of each conversation, a written table: one row for each segment of it (see SCHEMA).

    An edit is its initial, the turn's fault, turn, role and text, and the role after it (null if deleted).
    """
    tune(rows.sparkSession)
    cut = segments(rows, **sizes)
    alone = cut.where("whole").mapInArrow(_by_rows(lambda r: [{"conv_id": r["conv_id"], "seg": r["seg"], "whole": True, "edits": _edits(_turns(r), START, END, True)}], _ARROW), SCHEMA)
    parts = _over_segments(cut.where("not whole"))
    edits = materialize(alone.unionByName(parts), "edits")
    drop(cut, parts)
    return edits


def repaired_turns(edits: DataFrame) -> DataFrame:
    """The repaired turns of all conversations as rows: conv_id, seg, place (in its segment), edit, role, text."""
    return edits.select("conv_id", "seg", F.posexplode("edits").alias("place", "e")).where("e.new_role is not null").select("conv_id", "seg", "place", "e.edit", F.col("e.new_role").alias("role"), "e.text")


class _Report:
    """Counts, audit and digest of one conversation's edits, fed in order."""

    def __init__(self) -> None:
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = None
        self.distinct, self.before, self.first = 0, None, True
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def add(self, row: dict) -> None:
        letters = []
        for e in row["edits"]:
            letters.append(e["edit"])
            if e["edit"] != "I":
                if self.before is not None and self.before + e["role"][:1] not in ("su", "ua", "au"):
                    self.n["illegal"] += 1
                self.before = e["role"][:1]
                if (turn := e["turn"]) is not None:
                    self.distinct += turn != self.high
                    self.low, self.high = turn if self.low is None else self.low, turn
            if e["fault"]:
                self.n[e["fault"]] += 1
            self.n["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e["edit"]] + TRUNCATED * (e["fault"] == "truncated" and e["edit"] != "D")
            if e["new_role"] is not None:
                self.digest.update(("" if self.first else "\n").encode() + f"{e['new_role']}:{e['text']}".encode("utf-8", "surrogatepass"))
                self.first = False
        self.audit.append("".join(letters))

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: turn numbers missing, faults, illegal steps, cost, audit and digest of the repair."""
    arrow = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _REPORT.split(", ")])
    return fold(edits, _Report, _Report.add, _Report.result, _REPORT, arrow)


def damage(rows: DataFrame) -> DataFrame:
    """Planted faults by crc32 of `conv_id:turn` modulo 20; a dropped row leaves a place holder (nulls)."""
    space = F.lit(" ")
    chance = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    role = F.when(chance == 4, "user").when(chance != 0, role)
    text = F.when(chance == 1, "").when(chance == 2, F.regexp_replace(text, "[.!?]", "")).when(chance != 0, text)
    twice = F.when(chance == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(twice).alias("_copy")).drop("_copy")
