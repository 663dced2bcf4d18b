"""Fill-in-middle over compressed frames against brute force, at several frame sizes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rxlattice.llm import fim

RNG = random.Random(2)


def text(n):
    return "".join(RNG.choice(["line ", "é", "日本\n", "\n", "a b c\n", "\r\n", "x"]) for _ in range(n))


TEXTS = [None, "", "\n", "a", "a\nb", "a\nb\n", "\n\n\n", "x<P>y", "<S>", "é<M>\n", "<P", "S>", "no newline " * 50, "<<P", *(text(RNG.randint(1, 400)) for _ in range(60)), text(40_000)]


def wanted(doc_id, body, rate=100):
    body = body or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", body)
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not body or any(m in body for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, body
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("size", [5, 64, fim.FRAME])
def test_equals_brute_force(spark, size):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    outputs = fim.transform(fim.write_texts(docs, size), size=size)
    out = {r.doc_id: r for r in fim.output_texts(outputs).collect()}
    got = {r.doc_id: r for r in fim.read_back(outputs).collect()}
    assert len(got) == len(TEXTS)
    for i, body in enumerate(TEXTS):
        n, form, p, m, want = wanted(i, body)
        assert out[i].output == want
        assert tuple(got[i]) == (i, n, form, p, m, digest(want), digest(body or ""))
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_rate(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.form for r in fim.transform(fim.write_texts(docs), rate=40).collect()}
    assert got == {i: wanted(i, b, 40)[1] for i, b in enumerate(TEXTS)}


def test_frames_between_the_cuts_are_copied(spark, monkeypatch):
    lines = [f"line {i} {RNG.random()}\n" for i in range(20_000)]
    [stored] = fim.write_texts(spark.createDataFrame([(3, "".join(lines))], "doc_id long, text string"), 4096).collect()
    read = []
    plain = fim.Frames.plain
    monkeypatch.setattr(fim.Frames, "plain", lambda self, i: read.append(i) or plain(self, i))
    monkeypatch.setattr(fim, "_by_rows", lambda one, schema: one)
    out = fim._transform(100, 50, 7, 4096)(stored.asDict())
    assert len(stored.frames) > 100 and len(set(read)) <= 4
    assert len(set(out["frames"]) & set(stored.frames)) >= len(stored.frames) - 3
    assert b"".join(fim.restored(fim.Frames(out["frames"], out["bytes"]), out["form"])) == "".join(lines).encode()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a\nb\nc"), (5, "q\nr\n"), (5, "q\nr\n"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, fim.fill_in_middle(docs).collect()))
    assert len(got) == 4 and got[0] == got[1]
    h = [int(hashlib.sha256(b"7:").hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    assert fim.hashes(None) == h
    wide = docs.select("*", *(F.lit("x").alias(c) for c in ("n", "frames", "bytes", "form", "lines", "chars", "marked")))
    assert sorted(map(repr, fim.fill_in_middle(wide).collect())) == got
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
