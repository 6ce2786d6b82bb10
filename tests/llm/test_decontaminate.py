import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import decontaminate as D
from folio.llm import textnum as X

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(pattern, text):
    """Smallest edit distance to any stretch, and the first end with it."""
    col = list(range(len(pattern) + 1))
    best, end = col[-1], 0
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(col[i - 1] + (p != c), col[i] + 1, new[i - 1] + 1))
        col = new
        if col[-1] < best:
            best, end = col[-1], j
    return best, end


@settings(max_examples=400, deadline=None)
@given(pattern=st.lists(st.integers(0, 3), min_size=1, max_size=90), text=st.lists(st.integers(0, 3), max_size=60))
def test_myers_is_the_plain_distance(pattern, text):
    mask = {}
    for i, w in enumerate(pattern):
        mask[w] = mask.get(w, 0) | 1 << i
    assert D.search(mask, len(pattern), text) == plain(pattern, text)


def test_against_all_pairs(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(60)] + ["é", "The"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 9, 30, 70])))) for i in range(25)] + [(25, None), (26, "-- !"), (27, "")]
    docs = [(0, None), (1, ""), (2, "!")]
    for i in range(3, 250):
        own = [r.choice(vocab) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            item = words(r.choice(items)[1])
            for _ in range(r.randrange(1 + len(item) // 3)):
                at = r.randrange(len(item)) if item else 0
                kind = r.randrange(3)
                if item and kind == 0:
                    item[at] = "zz"
                elif item and kind == 1:
                    item.pop(at)
                else:
                    item.insert(at, r.choice(vocab))
            at = r.randrange(len(own) + 1)
            own[at:at] = item
        docs.append((i, r.choice([" ", "\n", ", "]).join(own)))
    docs += [(250, "x " * 30000 + items[5][1])]
    want = {}
    for d, text in docs:
        for t, item in items:
            p = words(item)
            if p:
                distance, end = plain(p, words(text))
                if distance <= len(p) // 4:
                    want[d, t] = (distance, len(p), end)
    docs.append(docs[60])
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        monkeypatch.setattr(D, "BLOCK_ITEMS", block)
        got = {(x.doc_id, x.item_id): (x.distance, x.item_words, x.stop_word) for x in D.matches(df, bench).collect()}
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert got == want
    left = {x.doc_id for x in D.clean(df, bench).collect()}
    assert left == {i for i, _ in docs} - {d for d, _ in want}


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, bench).count() == 0 and D.clean(docs, bench).count() == 1


def test_case_of_any_script(spark):
    item = "Évaluer où l'été à Besançon brûlait, très près d'une forêt: größere Straße, ядро, ΟΔΟΣ, ılık İzmir"
    docs = [(1, "x " * 9 + item.upper()), (2, item.lower() + " y"), (3, item), (4, "x y z"), (5, item.swapcase())]
    bench = spark.createDataFrame([(7, item), (8, item.upper())], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in D.matches(docs, bench).collect()}
    assert got == {(d, t): 0 for d in (1, 2, 3, 5) for t in (7, 8)}
    assert [x.doc_id for x in D.clean(docs, bench).collect()] == [4]


def test_folding_keeps_words_in_place():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]

    def own(texts):
        data, at = D.folded(*X.flat(pa.array(texts)))
        w = X.words(data, at, X.ALNUM)
        raw = w.data.tobytes()
        return w.per_row.tolist(), [raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]

    n, plain_ = own(every)
    assert n == [len(words(c)) for c in every]
    assert plain_ == own([c.upper() for c in every])[1] == own([c.lower() for c in every])[1]
    raw = np.frombuffer(b"\xff\xc3\x89 A", np.uint8)
    assert D.folded(raw, np.array([0, 5]))[0].tobytes() == b"\xff\xc3\xa9 a"
