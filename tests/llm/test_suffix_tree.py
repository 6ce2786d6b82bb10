import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import suffix_tree as S

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def held(doc):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % 7 == 2


def brute(rows, depth, divergence):
    def symbols(text):
        return b"\n" * depth + b"".join(w.encode() + b" " for w in words(text)) + b"\n"

    n = defaultdict(Counter)
    count, texts = Counter(), 0
    for doc, text in rows:
        if not held(doc):
            texts += 1
            count.update(words(text))
            s = symbols(text)
            for i in range(depth, len(s)):
                for level in range(depth + 1):
                    n[s[i - level : i]][s[i]] += 1
    kept = {b""}
    for ctx, own in n.items():
        if ctx:
            up, a, b = n[ctx[1:]], sum(own.values()), sum(n[ctx[1:]].values())
            if sum(v * math.log(v / a / (up[x] / b)) for x, v in own.items()) >= divergence * len(own):
                kept |= {ctx[k:] for k in range(len(ctx))}

    def p(ctx, x):
        if not ctx:
            return (n[b""][x] + 1) / (sum(n[b""].values()) + 256)
        if ctx not in kept:
            return p(ctx[1:], x)
        own = n[ctx]
        return (own[x] + len(own) * p(ctx[1:], x)) / (sum(own.values()) + len(own))

    total, distinct = sum(count.values()) + texts, len(count) + (texts > 0)
    below = total + distinct + 1
    out = []
    for doc, text in rows:
        w, s = words(text), symbols(text)
        base = sum(math.log10((count[x] + 1) / below) for x in w) + math.log10((texts + 1) / below)
        score = sum(math.log10(p(s[i - depth : i], s[i])) for i in range(depth, len(s)))
        out.append((doc, held(doc), len(w) + 1, sum(count[x] > 0 for x in w) + (texts > 0), total, base, score))
    return out


ROWS = [(i, t) for i, t in enumerate([None, "", " ", "A a b", "\x00\x01 é", "the cat the dog the cat " * 8])]


def corpus(n):
    r = random.Random(n)
    syllables = ["ba", "ko", "ri", "tu", "é", "Z"]
    vocab = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(40)]
    return ROWS + [(10 + i, " ".join(r.choice(vocab) for _ in range(r.randrange(40)))) for i in range(n)] + [(None, "ba ko"), (11, "tu"), (11, "tu")]


@pytest.mark.parametrize(("most_rows", "most_words"), [(10**6, 10**6), (0, 5), (0, 300), (0, 0)])
def test_against_plain_counts(spark, most_rows, most_words):
    rows = corpus(60)
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, score int, word string").repartition(3)
    is_held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = S.score(df, is_held, 3, 1.0, most_rows, most_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    want = sorted(brute(rows, 3, 1.0), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-11)


def test_probabilities_of_a_context_sum_to_one(spark):
    import numpy as np

    df = spark.createDataFrame(corpus(60), "doc_id long, text string")
    counted = S.counts(df, 3)
    rows = S.tagged(S.tree(counted.filter("kind = 0"), 3, 1.0)).toPandas()
    total = counted.filter("kind = 0").toPandas().n.sum()
    tree = S.Tree(rows.tagged.to_numpy(np.int64), np.append(rows.value.to_numpy(np.float64), 0), total, 3)
    for ctx in (b"\n\n\n", b" ba", b"zzz", b"ko "):
        code = np.array([int.from_bytes(ctx + bytes([x]), "big") for x in range(256)], np.uint64)
        assert (10 ** tree.score(code)).sum() == pytest.approx(1, abs=1e-6)


def test_a_very_long_text(spark):
    """3 MB in one row, beyond a piece's bytes: scored as the sum over its words, each in its context."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(500_000))
    df = spark.createDataFrame([(1, long), (2, "abc " * 50), (3, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in S.score(df, F.col("doc_id") == 2, most_rows=0, most_words=1000).collect()}
    same = {x.doc_id: x for x in S.score(df, F.col("doc_id") == 2).collect()}
    assert got[1].n_tokens == got[1].n_known == 500_001 and got[1].score > got[1].base_score * 1.5
    for k in got:
        assert got[k].score == pytest.approx(same[k].score, rel=1e-11)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.score(df, F.lit(True)).collect()}
    assert got[1].score == pytest.approx(4 * math.log10(1 / 256)) and got[1].train_tokens == 0 and got[2].n_tokens == 1
    assert S.score(df.filter("false"), F.lit(False)).count() == 0


@pytest.mark.parametrize("piece", [1, 50, 10**6])
@pytest.mark.parametrize("depth", [1, 2, 5, 6])
def test_tree_against_plain_counts(spark, depth, piece):
    """Contexts beyond NEAR bytes are judged group by group, however the groups are cut into pieces."""
    n = defaultdict(Counter)
    for _, text in corpus(20):
        s = b"\n" * depth + b"".join(w.encode() + b" " for w in words(text)) + b"\n"
        for i in range(depth, len(s)):
            for level in range(depth + 1):
                n[s[i - level : i]][s[i]] += 1
    kept = {b""}
    for ctx, own in n.items():
        if ctx:
            up, a, b = n[ctx[1:]], sum(own.values()), sum(n[ctx[1:]].values())
            if sum(v * math.log(v / a / (up[x] / b)) for x, v in own.items()) >= 0.5 * len(own):
                kept |= {ctx[k:] for k in range(len(ctx))}

    def p(ctx, x):
        if not ctx:
            return (n[b""][x] + 1) / (sum(n[b""].values()) + 256)
        own = n[ctx]
        return (own[x] + len(own) * p(ctx[1:], x)) / (sum(own.values()) + len(own))

    want = {(len(c), int.from_bytes(c + bytes([x]), "big")): math.log10(p(c, x)) for c in kept for x in n[c]}
    want |= {(64 + len(c), int.from_bytes(c, "big")): math.log10(len(n[c]) / (sum(n[c].values()) + len(n[c]))) for c in kept if c}
    counted = S.counts(spark.createDataFrame(corpus(20), "doc_id long, text string"), depth).filter("kind = 0")
    rows = S.tree(counted, depth, 0.5, piece).collect()
    got = {(r.level, r.key): r.value for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-11, abs=1e-14) for k in want)


def test_the_driver_starts_few_jobs(spark):
    """A tree of 6 levels, joined level by level, took the driver three jobs a level and more, and the memory of their plans."""
    sc, group = spark.sparkContext, "jobs of a tree"
    counted = S.counts(spark.createDataFrame(corpus(60), "doc_id long, text string"))
    counted.cache().count()
    before = set(sc.statusTracker().getJobIdsForGroup(group))
    sc.setJobGroup(group, group)
    try:
        S.tree(counted.filter("kind = 0"))
        assert len(set(sc.statusTracker().getJobIdsForGroup(group)) - before) <= 60
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        counted.unpersist()


def test_the_driver_holds_a_table_once(spark):
    """Its arrays, and beside them no more than one part of a few."""
    import tracemalloc

    n = 1_000_000
    rows = spark.range(n, numPartitions=16).selectExpr("id AS key", "id / 2 AS value")
    tracemalloc.start()
    try:
        key, value = S._packed(rows, "<f8", n, 1)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 1.5 * 16 * n
    assert sorted(key) == list(range(n)) and (value[:-1] == key / 2).all() and value[-1] == 0


def test_counts_of_billions(spark):
    """Products of two counts go beyond 63 bits."""
    n = 4_000_000_000
    counted = spark.createDataFrame([(0x0A0A61, n), (0x0A6162, n), (0x616263, n)], "key long, n long")
    for depth in (2, 1):
        rows = counted if depth == 2 else counted.selectExpr("key & 65535 AS key", "n")
        got = {(r.level, r.key): r.value for r in S.tree(rows, depth).collect()}
        assert got[1, 0x6162] == pytest.approx(math.log10((n + n / (3 * n + 256)) / (n + 1)))
