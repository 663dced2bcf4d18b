"""Scores and measures recomputed by plain Python, and the values promised for odd texts."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rxlattice.llm import fertility, quality_model, toxicity
from rxlattice.llm.text import mix
from rxlattice.llm.tokens import vocabulary

RNG = random.Random(11)
SYLLABLES = ["an", "er", "th", "ou", "ing", "st", "re", "lo", "ka", "mi", "é", "ß"]
ODD = [None, "", " \n\t ", "é", "A", "日本 語", "x " * 30]


def prose(n, rng=RNG):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- fertility


def measures(text, model):
    ids = [i for w in words(text) for i in model.encode(w)]
    chars = sum(map(len, words(text)))
    if not ids:
        return 0.0, 0.0, 0.0
    shares = [c / len(ids) for c in Counter(ids).values()]
    return chars / len(ids), sum(model.is_byte(i) for i in ids) / len(ids), -sum(p * math.log2(p) for p in shares)


def test_fertility_measures_and_bands(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(4)
    rows = [(i, prose(rng.randint(60, 120), rng), rng.choice(["de", "en"])) for i in range(130)]
    rows += [(1000 + i, "".join(rng.choice("qxzjvk") for _ in range(9)) + " " + prose(70, rng), "en") for i in range(5)] + [(2000, " ".join("xqzj" * 3 for _ in range(80)), "en")]
    rows += [(3000 + i, " ".join("".join(rng.choices("qxzjvkwp", k=9)) for _ in range(90)), "en") for i in range(3)]
    rows += [(9000 + i, t, None) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in fertility.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    want = {i: measures(t, model) for i, t, _ in rows}
    for i, _, _ in rows:
        assert (got[i].chars_per_token, got[i].byte_share, got[i].entropy) == pytest.approx(want[i], abs=1e-9), i
    # the bands, group by group, from exact quartiles
    groups = defaultdict(list)
    keyed = {i: [(got[i].script, lang or "", int(math.log2(max(got[i].n_words, 1)))), (got[i].script, lang or ""), (got[i].script,)] for i, _, lang in rows}
    for i in keyed:
        if not got[i].base_failed:
            for k in keyed[i]:
                groups[k].append([round(v, 3) for v in want[i]])
    for i in keyed:
        low, high, most_bytes, least = fertility.BANDS[got[i].script]
        c, b, e = want[i]
        keep = not got[i].base_failed and low <= c <= high and b <= most_bytes and e >= least
        edges = {"c": [low, high], "b": [None, most_bytes], "e": [least, fertility.MOST_ENTROPY]}
        for k in reversed(keyed[i]):  # from the script to the finest group
            n = len(groups[k])
            for m, values, slack in zip("cbe", zip(*groups[k]), fertility.LEAST_DEVIATION.values()):
                q = np.quantile(values, [0.25, 0.5, 0.75])
                under, over = (max(abs(x - q[1]) / 0.6745, slack) for x in (q[0], q[2]))
                own = (q[1] - fertility.BELOW * under, q[1] + fertility.ABOVE * over)
                edges[m] = [None if e is None else (n * o + fertility.WEIGHT * e) / (n + fertility.WEIGHT) for o, e in zip(own, edges[m])]
        keep = keep and edges["c"][0] <= c <= edges["c"][1] and b <= edges["b"][1] and edges["e"][0] <= e <= edges["e"][1]
        assert got[i].kept == keep, i
    assert any(not got[3000 + i].kept for i in range(3)) and not got[2000].kept
    for i in (9000, 9001, 9002):  # null, empty and blank
        r = got[i]
        assert (r.n_words, r.word_chars, r.chars_per_token, r.byte_share, r.entropy, r.base_failed, r.kept, r.script) == (0, 0, 0, 0, 0, True, False, "other")


# ---- quality


def quality_score(text, weights):
    """The score of one text, gram by gram."""
    own = words(text)
    if not own:
        return 0.0
    raw = (text or "").encode() + b" "
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    kind = [1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else c for c in raw]
    total = 0.0
    for codes, width, salt in ((lower, 3, 11), (kind, 4, 12)):
        counts = Counter()
        for i in range(len(codes) - width + 1):
            key = 0
            for c in codes[i : i + width]:
                key = (key * 257 + int(c)) % 2**64
            counts[int(mix(np.array([(key + (salt << 56)) % 2**64], np.uint64))[0]) >> (64 - quality_model.BITS)] += 1
        total += sum(weights[k] * math.sqrt(n / len(raw)) for k, n in counts.items())
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in own]
    same = sum(a == b for a, b in zip(low, low[1:]))
    first = 1 << quality_model.BITS
    return total + weights[first] * same / len(low) + weights[first + 1] * (len(low) - len(set(low))) / len(low) + weights[first + 2] / math.sqrt(len(low))


def test_quality_scores_by_plain_python(spark):
    rng = np.random.default_rng(3)
    model = quality_model.Ordinal(rng.normal(size=(1 << quality_model.BITS) + 3), np.array([-0.4, 0.3]))
    texts = [*ODD, *(prose(n) for n in (1, 2, 5, 40, 300)), "Same same SAME word. 123 ABC"]
    got = {r.doc_id: r for r in quality_model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        s = quality_score(t, model.weights)
        below = [1 / (1 + math.exp(-(x - s))) for x in model.thresholds]
        assert (got[i].expected_grade, got[i].tail_probability) == pytest.approx((sum(1 - b for b in below), 1 - below[0]), abs=1e-9), i
        assert got[i].selected == (1 - below[0] >= quality_model.TAIL)
    flat = 1 / (1 + math.exp(-0.4))
    for i in (0, 1, 2):  # no feature, so the thresholds alone
        assert got[i].tail_probability == pytest.approx(flat)


# ---- toxicity


def marginals(emit, a):
    """Marginals of state 1 in one chain, by enumerating all its taggings."""
    total, one = 0.0, [0.0] * len(emit)
    for tags in itertools.product((0, 1), repeat=len(emit)):
        w = math.exp(sum(e for e, t in zip(emit, tags) if t) + sum(a[p][q] for p, q in zip(tags, tags[1:])))
        total += w
        for i, t in enumerate(tags):
            one[i] += w * t
    return [x / total for x in one]


def test_toxicity_scores_by_enumeration(spark):
    rng = np.random.default_rng(8)
    model = toxicity.Field(rng.normal(scale=0.5, size=1 << toxicity.BITS), -0.7, rng.normal(size=(2, 2)), np.array([-2.0, 1.5, 0.7, 0.2]))
    texts = [None, "", " \n ", "one", "It is so. This one too!\nAnd a third line here? yes no", "vile words, (really) vile. ok"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        tagged = toxicity.Tagged([(t or "").encode()])
        found, own = [], words(t)
        # chains: a word that ends with . ! or ? ends one, and so does a line
        chains, line = [], 0
        for chunk in (t or "").split("\n"):
            for k, w in enumerate(words(chunk)):
                if not chains or k == 0 or chains[-1][-1][-1] in ".!?":
                    chains.append([])
                chains[-1].append(w)
        at = 0
        for chain in chains:
            emit = [model.weights[f].sum() + model.bias for f in tagged.features[at : at + len(chain)]]
            found += marginals(emit, model.transitions)
            at += len(chain)
        assert at == len(own)
        x = [1, max(found, default=0), math.log1p(sum(found)), math.log1p(1000 * sum(found) / max(len(own), 1))]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.link))))
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(want >= 0.7)
        assert [s.marginal for s in got[i].spans] == pytest.approx([m for m in found if m >= 0.5])
        assert [t[s.start : s.end] for s in got[i].spans] == [w for w, m in zip(own, found) if m >= 0.5]
    assert got[0].score == got[1].score == got[2].score == pytest.approx(1 / (1 + math.exp(2.0)))


def test_word_labels_by_counting():
    bad = [f"{prose(6)} vilest thing {prose(4)}" for _ in range(12)]
    good = [prose(12) for _ in range(40)]
    texts, labels = [*bad, *good], np.array([1] * 12 + [0] * 40)
    parts = [toxicity.Tagged([t.encode() for t in texts])]
    got = toxicity.word_labels(parts, [labels])[0]
    per_doc = defaultdict(set)
    for doc, row in zip(parts[0].words.doc, parts[0].features):
        per_doc[int(doc)] |= set(row.tolist())
    inside, outside = Counter(), Counter()
    for doc, found in per_doc.items():
        (inside if labels[doc] else outside).update(found)

    def typical(f):
        odds = math.log((inside[f] + 0.5) / 13) - math.log((outside[f] + 0.5) / 41)
        return odds >= toxicity.LEAST_ODDS and inside[f] >= max(toxicity.LEAST_DOCS, toxicity.LEAST_SHARE * 12)

    want = [float(labels[doc] and any(typical(f) for f in row.tolist())) for doc, row in zip(parts[0].words.doc, parts[0].features)]
    assert got.tolist() == want and sum(want) >= 12
