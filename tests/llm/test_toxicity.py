import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import textnum as X
from folio.llm import toxicity


def test_marginals_against_all_taggings():
    r = np.random.default_rng(4)
    for sizes in ([1, 4, 0, 6], [0], [3]):
        e, turn, first = r.normal(size=sum(sizes)) * 2, r.normal(size=(2, 2)), np.concatenate([[0], np.cumsum(sizes)])
        got = toxicity.marginals(e, first, turn)
        for a, b in itertools.pairwise(first):
            own = np.zeros(b - a)
            total = 0.0
            for tags in itertools.product((0, 1), repeat=b - a):
                w = np.exp(sum(e[a + i] * t for i, t in enumerate(tags)) + sum(turn[x, y] for x, y in itertools.pairwise(tags)))
                total += w
                own += w * np.array(tags)
            assert np.allclose(got[a:b], own / total)


def test_stretches_of_long_texts_give_the_same_marginals():
    r = np.random.default_rng(6)
    for turn in (r.normal(size=(2, 2)), np.array([[2.0, -2.0], [-2.0, 2.0]]), np.zeros((2, 2))):
        sizes = [900, 3, 0, 2000, 1500]
        e, first = r.normal(size=sum(sizes)) * 2 - 1, np.concatenate([[0], np.cumsum(sizes)])
        whole = toxicity.marginals(e, first, turn)
        assert toxicity.reach(turn) < 700
        assert np.abs(whole - toxicity.marginals(e, first, turn, stretch=100)).max() < 1e-8


def corpus(n, seed):
    r = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(300)], ["vileone", "viletwo", "grumblat", "grumbler"]
    rows = []
    for i in range(n):
        words, toxic = [r.choice(plain) for _ in range(r.randrange(20, 80))], i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learns_words_and_finds_spans(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 1.0), (1001, "", 1.0), (1002, "W1 é Vileone w2 " + "w3 " * 30000, 1.0), (1002, "w1", 1.0), (None, "w7", 0.0)], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in rows if i % 4] + [(None, 1, 1), (3, None, 1), (5, 1, 0), (5, 1, 0)], "doc_id long, toxic int, text int")
    got = toxicity.tag(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 605 and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x for x in got if x.doc_id is not None and x.doc_id < 1002}
    wrong = [i for i, _, x in rows if i % 4 == 0 and (by[i].score >= 0.3) != bool(x)]
    assert len(wrong) <= 3
    (long,) = [x for x in got if x.doc_id == 1002 and x.spans]
    assert [(s.start, s.stop) for s in long.spans] == [(5, 12)]
    assert by[1000].score == by[1001].score == min(x.score for x in got)


def test_words_of_a_rare_language(spark):
    """Five of 305 toxic texts are of another language: each language's words are found, and no others."""
    r = random.Random(3)
    plain, other = [f"w{i}q" for i in range(300)], [f"z{i}q" for i in range(100)]
    rows = []
    for i in range(3000):
        rare = i % 60 == 1
        words, toxic = [r.choice(other if rare else plain) for _ in range(r.randrange(20, 60))], i % 10 == 0 or i in (1, 61, 121, 181, 241)
        if toxic:
            for at in r.sample(range(1, len(words) - 1), 2):
                words[at] = "malvado" if rare else "vileone"
        rows.append((i, " ".join(words), int(toxic)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    found = set(toxicity.seeds(sample, sum(x for *_, x in rows), sum(not x for *_, x in rows)).tolist())
    own = {x for w in ("malvado", "vileone") for k in (None, *toxicity.HEADS) for x in X.words(*X.flat(pa.array([w])), X.ALNUM).hashes(k).tolist()}
    assert found == own


def test_tails_of_a_binomial():
    n, total, p = np.array([3, 0, 5, 14]), np.array([3, 4, 9, 14]), 0.25
    want = [sum(math.comb(b, k) * p**k * (1 - p) ** (b - k) for k in range(a, b + 1)) for a, b in zip(n, total, strict=True)]
    assert np.allclose(np.exp(toxicity._log_tail(n, total, p)), want)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.spans for x in toxicity.tag(docs, toxicity.fit(docs, none)).collect()] == [[], []]
    assert toxicity.tag(docs.filter("false"), toxicity.fit(docs.filter("false"), none)).count() == 0


M64 = (1 << 64) - 1


def plain_hash(raw):
    """The hash of a word's bytes, in plain integers."""
    x = sum(int(X._VALUES[b]) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(raw)) + len(raw) & M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_tags(text, crf):
    """Score, sum of squared marginals and spans of one text, token by token."""
    import re

    raw = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode()
    places = [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", raw)]
    words = [raw[a:b] for a, b in places]
    edge = 0x5851F42D4C957F2D
    e = []
    for i, w in enumerate(words):
        own = [plain_hash(w), *(plain_hash(w[:k]) for k in toxicity.HEADS), plain_hash(words[i - 1]) if i else edge, plain_hash(words[i + 1]) if i + 1 < len(words) else edge]
        at = [(h * (2 * k + 0x9E3779B97F4A7C15) & M64) >> (64 - toxicity.BITS) for k, h in enumerate(own)]
        e.append(crf.bias + sum(float(np.float32(crf.emit[k][a])) for k, a in enumerate(at)))
    t = crf.turn
    ahead, back = [], [0.0] * len(e)
    for i, x in enumerate(e):
        ahead.append(x + (0.0 if not i else np.logaddexp(t[0, 1], t[1, 1] + ahead[-1]) - np.logaddexp(t[0, 0], t[1, 0] + ahead[-1])))
    for i in range(len(e) - 2, -1, -1):
        a = e[i + 1] + back[i + 1]
        back[i] = np.logaddexp(t[1, 0], t[1, 1] + a) - np.logaddexp(t[0, 0], t[0, 1] + a)
    p = [1 / (1 + math.exp(-(a + b))) for a, b in zip(ahead, back, strict=True)]
    expected = sum(x * x for x in p)
    spans = []
    for i, (a, b) in enumerate(places):
        if p[i] >= toxicity.SPAN:
            if spans and spans[-1][3] == i - 1:
                spans[-1][1:] = [b, [*spans[-1][2], p[i]], i]
            else:
                spans.append([a, b, [p[i]], i])
    shown = [(len(raw[:a].decode()), len(raw[:b].decode()), sum(q) / len(q)) for a, b, q, _ in spans]
    return 1 / (1 + math.exp(-(crf.curve[0] + crf.curve[1] * math.log(expected + toxicity.LEAST)))), expected, shown


def test_scores_and_spans_token_by_token(spark, monkeypatch):
    rows = corpus(400, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    crf = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    r = random.Random(5)
    bits = ["VileOne", "viletwo", "grumblat,", "é", "ß漢", "w1", "w2.", "w3", "😀", "grumbler"]
    texts = [None, "", "..", *(" ".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(60)), " ".join(r.choice(bits[3:9]) for _ in range(9000)) + " vileone"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for row in toxicity.tag(frame, crf).collect():
        score, expected, spans = plain_tags(texts[row.doc_id], crf)
        assert (row.score, row.expected) == pytest.approx((score, expected), rel=1e-6, abs=1e-9)
        assert [(s.start, s.stop) for s in row.spans] == [(a, b) for a, b, _ in spans]
        assert [s.p for s in row.spans] == pytest.approx([q for _, _, q in spans], abs=1e-6)
        found += len(spans)
    assert found > 50
