import random
import re

from folio.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_phrases_against_brute_force(spark):
    r = random.Random(5)
    bits = ["under the MIT License.", "Apache License,\nVersion 2", "CC BY-NC", "cc by", "nc", "the mit", "under", "license", "é", "version 2", "\x7f", "mit-license", "All rights reserved.", "x" * 50]
    texts = [None, "", " ", "cc by nc"] + [r.choice([" ", "-", "\n"]).join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(400)] + ["cc " * 40000 + "cc by nc"]
    rows = [(i // 2, t, "label") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)
    got = sorted((x.doc_id, x.n_words, x.n_base, x.first_word if x.n_base else -1, x.last_word if x.n_base else -1, x.base_labels) for x in licenses.scan(df).collect())
    want = sorted((i, n, k, -1 if a is None else a, -1 if b is None else b, s) for i, t, _ in rows for n, k, a, b, s in [brute(t)])
    assert got == want
    for x in licenses.scan(df).collect():
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1 and (not x.n_base or x.score == 1)


def test_templates(spark):
    notice = "x y. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: z"
    worn = notice.replace("are permitted", "is allowed")
    far = notice.replace("source and binary", "binary and source")
    df = spark.createDataFrame([(1, notice), (2, worn), (3, far), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "rights reserved all")], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(df).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["bsd-text", "bsd-text", "", "gpl", ""]
    assert got[1].score == 1 > got[2].score > 0.8 and got[1].spans[0].first_word == 2


def plain_labels(texts):
    """Labels of each text by the module's rule, word by word."""
    words = [WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts]
    n = {}
    for w in words:
        for x in set(w):
            n[x] = n.get(x, 0) + 1
    out = []
    for w in words:
        found = {label for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
        for t in licenses.TEMPLATES:
            own = t.text.split()
            have = set(own) & set(w)
            if len(have) < 0.6 * len(set(own)):
                continue
            best = sorted(have, key=lambda x: (n.get(x, 0), licenses.X.hash_word(x, licenses.X.ALNUM)))[:4]
            hits = sorted((i - j, x) for i, x in enumerate(w) if x in best for j, y in enumerate(own) if x == y)
            groups = []
            for h in hits:
                if groups and h[0] - groups[-1][-1][0] <= 4:
                    groups[-1].append(h)
                else:
                    groups.append([h])
            for g in groups:
                window = w[max(0, g[0][0] - 4) : max(0, g[-1][0] + len(own) + 4)]
                keys = all(any(window[i : i + len(k.split())] == k.split() for i in range(len(window))) for k in t.keys)
                if len({x for _, x in g}) >= min(2, len(best)) and keys and len(set(own) & set(window)) >= 0.6 * len(set(own)):
                    found.add(t.label)
        out.append(",".join(sorted(found)))
    return out


def test_labels_against_the_rule_in_plain_python(spark):
    r = random.Random(8)
    texts = [None, ""]
    for _ in range(600):
        parts = []
        for _ in range(r.randrange(1, 4)):
            w = r.choice(licenses.TEMPLATES).text.split() if r.random() < 0.7 else list(r.choice([*licenses.PHRASES]).split())
            w = [x for x in w if r.random() > r.choice([0, 0.05, 0.3])]
            for _ in range(r.choice([0, 0, 1, 3])):
                w.insert(r.randrange(len(w) + 1), r.choice(["new", "the", "software"]))
            parts += w + [f"z{r.randrange(50)}" for _ in range(r.randrange(6))]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.labels for x in licenses.scan(df).collect()}
    want = plain_labels(texts)
    assert sum(bool(x) for x in want) > 300 and [got[i] for i in range(len(texts))] == want


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
