import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import components, minhash
from folio.llm import textnum as X

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """n_shingles by row, component by doc_id"""
    sets = [shingle_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return [len(s) for s in sets], {i: root(i) for i, _ in rows}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["é", "X", "|"]
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(8)):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 20)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append("\n".join(copy) if r.random() < 0.2 else " ".join(copy))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_shingles_and_estimates():
    r = random.Random(2)
    a = [str(i) for i in range(400)]
    b = a[:]
    b[300:] = [str(r.random()) for _ in range(100)]
    t = pa.array([" ".join(a), " ".join(b), "x y", None, "x  Y"])
    s, first = minhash.shingles(X.words(*X.flat(t)))
    assert np.diff(first).tolist() == [396, 396, 1, 0, 1]
    own = [set(s[first[i] : first[i + 1]].tolist()) for i in range(5)]
    assert own[2] == own[4] and len(own[0] & own[1]) == 296
    sign = minhash.signatures(s, first)
    assert abs((sign[0] == sign[1]).mean() - 296 / 496) < 0.15
    assert (sign[2] == sign[4]).all() and (sign[3] == 0xFFFFFFFF).all()
    for k in (0, 2):
        assert len(set(sign[k].tolist())) == minhash.SIZE


@pytest.mark.parametrize("n", [1, 7, 60, 500, 3000])
def test_steps_together_give_the_plain_signature(n):
    """Element by element, as the paper has it, with the same random numbers."""
    e = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n).astype(np.uint64))
    m, want = 40, np.full(40, 0xFFFFFFFF, dtype=np.int64)
    for x in e:
        order = list(range(m))
        for j in range(m):
            z = int(X.mix(np.array([x], np.uint64) * np.uint64(0xA24BAED4963EE407) + np.array([j], np.uint64) * np.uint64(0x9FB21C651E98DF25))[0])
            k = (((z >> 32) * (m - j)) >> 32) + j
            order[j], order[k] = order[k], order[j]
            want[order[j]] = min(want[order[j]], j << 24 | z & 0xFFFFFF)
    assert minhash.signatures(e, np.array([0, len(e)]), m)[0].tolist() == want.tolist()


@pytest.mark.parametrize("block", [1000, 2])
def test_components_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(block)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(3)
    got = {x.doc_id: x for x in minhash.near_duplicates(df).collect()}
    sizes, comp = brute(rows)
    assert len(got) == len(rows)
    assert {i: got[i].component_id for i, _ in rows} == comp
    assert [got[i].n_shingles for i, _ in rows] == sizes
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_pairs_meet_by_whole_keys(spark):
    """Low bytes that agree in a band are no meeting: such a pair is verified where its whole keys first agree."""
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 24, minhash.SIZE).astype(np.uint32)
    b, c = a.copy(), a.copy()
    b[3] += 256  # band 0: low bytes agree, values do not
    b[3 * minhash.ROWS :: 7] += 1
    c[5 * minhash.ROWS :: 9] += 1
    keys, rows = X.signed(minhash.bands(np.stack([a, b, c]))), []
    for band in range(minhash.BANDS):
        for k in range(3):
            sets = [[1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6]]
            rows.append((int(keys[k, band]), band, 7 + k, 8 - k, 7 + k, int((keys[:, band] == keys[k, band]).sum()), [a, b, c][k].astype(np.uint8).tobytes(), keys[k].tolist(), sets[k]))
    members = spark.createDataFrame(rows, "key long, band int, id long, n long, component long, members long, sign binary, bands array<long>, shingles array<long>").filter("members > 1")
    blocks = minhash._blocks(minhash._earlier(members))
    met = {x for p, q in ((0, 1), (0, 2), (1, 2)) for x in [int((keys[p] == keys[q]).argmax())]}
    assert met == {0, 1}
    asked = {(x.key, x.id) for x in minhash._in_question(blocks, 75).collect()}
    assert asked == {(int(keys[0, 0]), 7), (int(keys[0, 0]), 9), (int(keys[0, 1]), 7), (int(keys[0, 1]), 8), (int(keys[0, 1]), 9)}
    alone = blocks.filter("id <> 9")
    assert [sorted((x.a, x.b)) for x in minhash._links_in_blocks(alone, 75).distinct().collect()] == [[7, 8]]


def test_no_pair_that_shares_a_band_is_lost():
    """5,000 pairs at 0.75 to 0.8, by threes and more in a bucket: each that shares a band is held against each other once."""
    r, lost, shared = np.random.default_rng(8), 0, 0
    for _ in range(1000):
        base = r.integers(0, 1 << 60, 400).astype(np.uint64)
        sets = []
        for _ in range(3):
            own = base.copy()
            k = r.integers(20, 30)
            own[r.choice(400, k, replace=False)] = r.integers(0, 1 << 60, k)
            sets.append(np.unique(own))
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        sign = minhash.signatures(np.concatenate(sets), first)
        keys = X.signed(minhash.bands(sign))
        low = sign.astype(np.uint8)
        for a, b in ((0, 1), (0, 2), (1, 2)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if not 75 <= 100 * common / (len(sets[a]) + len(sets[b]) - common) <= 85 or not (keys[a] == keys[b]).any():
                continue
            shared += 1
            found = 0
            for band in np.flatnonzero(keys[a] == keys[b]).tolist():
                rows = sorted((len(sets[k]), k) for k in (a, b))
                t = pa.table({"key": [1, 1], "i": [0, 0], "j": [0, 0], "band": [band] * 2, "n": [n for n, _ in rows], "id": [k for _, k in rows], "component": [k for _, k in rows], "block": [0, 0], "sign": [low[k].tobytes() for _, k in rows], "earlier": [keys[k, :band].tolist() for _, k in rows]})
                t = t.set_column(t.schema.get_field_index("earlier"), "earlier", t["earlier"].cast(pa.list_(pa.int64())))
                found += sum(len(own) for own, _ in minhash._candidates(t, 75))
            lost += found != 1
    assert shared > 2000 and lost <= shared // 2000


def test_a_very_long_text(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    near = [w if r.random() > 0.01 else "x" for w in words]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "w1 w2")], "doc_id long, text string")
    got = {x.doc_id: (x.component_id, x.n_shingles) for x in minhash.near_duplicates(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 3} and got[1][1] == len(shingle_set(" ".join(words)))


def test_odd_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (3, "z " * 9), (5, "z " * 9), (9, text)], "doc_id long, text string")
    got = sorted(((x.doc_id or -1, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df).collect()), key=str)
    assert [g for g in got if g[0] == -1] == [(-1, 4, None, True)]
    assert {g[2] for g in got if g[0] != -1} == {3} and len(got) == 6
    assert minhash.near_duplicates(df.filter("false")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (1, 2), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1}
