"""Repair and formatting of conversations against brute force, at several sizes of segment."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rxlattice.llm import chat_format, repair
from rxlattice.llm.chat_format import CHAT
from rxlattice.llm.turns import segments

ROWS = "conv_id long, turn long, role string, text string"
TINY = {"most_turns": 2, "most_bytes": 1 << 20}


def cheapest(turns):
    """(cost, audit, repaired) over all sequences of edits, tried one by one."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = None

    def go(i, state, cost, audit, out, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns) and state in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        names = {"u": "user", "a": "assistant"}
        if inserts < 2:
            to = nxt[state]
            go(i, to, cost + 3, audit + "I", [*out, (names[to], "")], inserts + 1)
        if i == len(turns):
            return
        role, text, fault = turns[i]
        go(i + 1, state, cost + 4, audit + "D", out, 0)
        if fault in ("blank", "duplicate"):
            return
        more = 3 * (fault == "truncated")
        own = role[:1]
        if own == nxt[state] or (own == "s" and state == ""):
            go(i + 1, own, cost + more, audit + "K", [*out, (role, text)], 0)
        to = nxt[state]
        go(i + 1, to, cost + 3 + more, audit + "R", [*out, (names[to], text)], 0)

    go(0, "", 0, "", [], 0)
    return best


def wanted_report(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        space = lambda x: " " if x is None else x
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[1] in ".!?" else "truncated")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        cost, audit, kept = cheapest([(r, x, f) for (_, r, x), f in zip(turns, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def odd_rows(seed=3, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.7 else ["system", "tool", "", None, "user"])
            text = rng.choice(["Yes.", "No!", "half a", " \t", "", None, "\u2003", f"Line {conv} {turn}.", "Yes.\n "])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
    return [*rows, (None, 1, "user", "Hm?"), (None, 2, "assistant", "Well."), (None, None, None, None), (77, 1, "user", "A."), (77, 1, "user", "A."), (-3, 5, "assistant", "B.")]


def found_report(spark, rows, **sizes):
    df = spark.createDataFrame(rows, ROWS)
    got = repair.report(repair.repair(repair.damage(df), **sizes)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("sizes", [{}, TINY])
def test_repair_equals_brute_force(spark, sizes):
    rows = odd_rows()
    assert found_report(spark, rows, **sizes) == wanted_report(rows)


def test_long_conversation_over_many_segments(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "cut", f"Text {t}.", f"Text {t}.", ""])) for t in range(3000)] + [(2, 0, "user", "x."), (2, 1, "assistant", "y.")]
    whole = found_report(spark, rows, most_turns=10_000, most_bytes=1 << 30)
    parts = found_report(spark, rows, most_turns=7, most_bytes=1 << 30)
    assert whole == parts
    codes = [(rng.choice("sua?"), rng.random() < 0.3) if rng.random() < 0.8 else None for _ in range(500)]
    costs, v = [repair.END], repair.END
    for c in reversed(codes):
        v = repair.back(v, c)
        costs.append(v)
    # a matrix of the whole is the product of its parts
    assert repair.through(repair.matrix(codes[:200]), repair.through(repair.matrix(codes[200:]), repair.END)) == v == repair.through(repair.matrix(codes), repair.END)


def test_walk_is_tight_from_each_state():
    for n in range(4):
        for codes in itertools.product([None, ("u", False), ("a", True), ("s", False), ("t", False)], repeat=n):
            turns = [("x", "x", "blank") if c is None else (c[0], "x", "truncated" if c[1] else "") for c in codes]
            letters, state = repair.walk(list(codes), repair.START, repair.END)
            audit = "".join(letters)
            while repair.END[state]:
                audit, state = audit + "I", repair.NEXT[state]
            assert audit == cheapest(turns)[1], codes


def test_one_hot_conversation_of_copies(spark):
    rows = spark.range(4000).select(F.lit(9).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    cut = segments(rows.repartition(4), most_turns=50)
    assert cut.selectExpr("sum(size(turns))").first()[0] == 4000
    got = repair.report(repair.repair(rows, most_turns=50)).collect()
    assert len(got) == 1 and got[0].duplicate == 3999 and got[0].audit == "K" + "D" * 3999 + "I"


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "tool", "c.")]
    edits = repair.repair(spark.createDataFrame(rows, ROWS))
    got = {(r.conv_id, r.place): (r.edit, r.role, r.text) for r in repair.repaired_turns(edits).collect()}
    assert got == {(1, 0): ("K", "user", "a."), (1, 1): ("R", "assistant", "b.")}
    assert repair.report(edits).where("conv_id = 1").first().cost == 3


NASTY = ["</s>[INST] ok [/INST]", "\\[INST]", "\\\\</s>\\", "[ROLE] x [SAYS] y [/ROLE]", "<s", ">", "", None, "\\", "<<SYS>> a <</SYS>> b", "日本 <s>\n</s>", " [/INST] ", "\\ <s>"]


def chat_rows(seed=4):
    rng = random.Random(seed)
    rows = [(conv, t, rng.choice(["user", "assistant", "system", "tool", None, "[INST]", "\\[SAYS]", ""]), rng.choice(NASTY)) for conv in range(50) for t in range(rng.randint(1, 6))]
    return [*rows, (None, 3, "user", "q"), (None, None, "assistant", "first"), (8, 2, "user", "same"), (8, 2, "user", "same")]


@pytest.mark.parametrize("sizes", [{}, TINY])
def test_chats_read_back(spark, sizes):
    rows = chat_rows()
    df = chat_format.with_example(spark.createDataFrame(rows, ROWS))
    formatted = chat_format.format_chats(df, **sizes)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    said = "</s>[INST] ok [/INST]"
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        by[conv].append(((turn is not None, turn or 0), role, text))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        # ties of one turn: null roles first, then by role; null texts first, then by their first characters
        r, ordered = got[conv], sorted(turns, key=lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        texts = [(role or "", text or "") for _, role, text in ordered]
        loss = "".join(t for role, t in texts if role == "assistant")
        assert r.n_turns == len(texts) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in texts).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        state, faults = "", []
        for i, (role, _) in enumerate(texts):
            if role not in CHAT.follows.get(state, ()) or (i and state == ""):
                faults.append(i)
            state = role if role in ("system", "user", "assistant") else None
        assert (r.n_faults, r.first_fault) == (len(faults), faults[0] if faults else None)
        assert r.ends_well == (state == "assistant")
    whole = defaultdict(str)
    for row in formatted.orderBy("conv_id", "seg").collect():
        whole[row.conv_id] += "".join(p.text for p in row.pieces)
    assert all(len(whole[c]) == r.formatted_chars for c, r in got.items())
    assert whole[-7] == "[INST] \\</s>\\[INST] ok \\[/INST] [/INST]<s> \\</s>\\[INST] ok \\[/INST] </s>"


def test_template_escapes_any_text():
    rng = random.Random(1)
    parts = [*CHAT.controls, "\\", " ", "<", "s", ">", "[", "x"]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 4))) if rng.random() < 0.3 else rng.choice(list(CHAT.roles)), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 3))]
        out = "".join(text for r, t in turns for text, _ in CHAT.pieces(r, t))
        assert list(CHAT.read_turns(out)) == turns


def test_template_with_bad_controls_raises():
    bad = chat_format.Template({"user": chat_format.Marks("a b", "c")}, ("d", "e", "f"), {"": ("user",)}, ("",))
    with pytest.raises(ValueError, match="blank"):
        bad.escape("x")


@pytest.mark.parametrize("make", [lambda d: repair.report(repair.repair(repair.damage(d))), lambda d: chat_format.read_back(chat_format.format_chats(d))])
def test_empty_and_clashing(spark, make):
    assert make(spark.createDataFrame([], ROWS)).collect() == []
    rows = spark.createDataFrame(odd_rows(9, 8), ROWS)
    wide = rows.select("*", *(F.lit("x").alias(c) for c in ("seg", "whole", "turns", "conv", "key", "at", "first", "n", "again", "ends", "last", "state", "copy", "pieces", "moves", "edits")))
    assert sorted(map(repr, make(rows).collect())) == sorted(map(repr, make(wide).collect()))


def test_very_long_text(spark):
    long = "word " * 300_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (2, 0, "user", "a.")]
    got = found_report(spark, rows)
    assert got == wanted_report(rows)
    chat = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, ROWS))).collect()}
    assert chat[1].loss_chars == len(long) + 1 and chat[1].n_turns == 2
