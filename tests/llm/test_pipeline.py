import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P


def test_stages_against_plain_python(spark, tmp_path):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    bad = ["vileone", "viletwo", "grumblat", "grumbler"]
    item = " ".join(f"q{i}" for i in range(30))
    docs, toxic = [], {}
    for i in range(500):
        words = [r.choice(vocab) for _ in range(60)]
        toxic[i] = i % 7 == 0
        if toxic[i]:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words), "en", "s", 0))
    copy = docs[1][1].split()
    copy[3] = "other"
    near, leak, none = (600, " ".join(copy), "en", "s", 0), (601, f"w1 w2 {item} w3", "en", "s", 0), (602, None, None, None, None)
    docs += [near, leak, none]
    path = str(tmp_path)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(t)) for i, t in toxic.items()], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = P.run(spark, path).collect()
    want = {i for i, t in toxic.items() if not t} | {602}
    got = {x.doc_id for x in out}
    assert len(got ^ want) <= 3 and 600 not in got and 601 not in got
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    for doc in list(got)[:50]:
        pieces = sorted((x for x in out if x.doc_id == doc), key=lambda x: x.start)
        text = next(d[1] for d in docs if d[0] == doc) or ""
        assert np.frombuffer(b"".join(bytes(x.ids) for x in pieces), "<u4").tolist() == [*ids(text, add_special_tokens=False).ids, 1]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, frame, path).columns == frame.columns


def stage_tables(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30))), (None, None), (2, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score double, kept string, component_id long, row string, key long"


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = stage_tables(spark, str(tmp_path), [], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, rows without doc_id, ties, a very long text, and columns named as the operators' own."""
    r = random.Random(2)
    text = " ".join(f"a{i}" for i in range(40))
    leak = "x1 " + " ".join(f"q{i}" for i in range(30)) + " x2"
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(150_000))
    bodies = [(5, text), (5, text), (None, text), (9, text + " end"), (None, leak), (3, leak), (3, leak.upper()), (7, None), (7, ""), (None, None), (8, " "), (11, long), (None, "own words here of a row without an id"), (12, "b")]
    rows = [(d, t, None, "s", None, 0.9, "k", 1, "r", 2) for d, t in bodies]
    docs = stage_tables(spark, str(tmp_path), rows, SCHEMA)
    safe = P.drop_toxic(spark, docs, str(tmp_path))
    assert safe.columns == docs.columns and safe.count() == len(rows)
    kept = P.drop_near_duplicates(spark, docs, str(tmp_path))
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    assert kept.columns == docs.columns and [x for x in got if x[1] and x[1].startswith("a0")] == [(5, text)]
    assert {(d, t): n for (d, t), n in got.items() if t is None or not t.strip()} == {(7, None): 1, (7, ""): 1, (None, None): 1, (8, " "): 1}
    assert sum(n for (_, t), n in got.items() if t and t.lower() == leak) == 1 and got[11, long] == got[12, "b"] == 1 and sum(got.values()) == 9
    clean = P.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and Counter((x.doc_id, x.text) for x in clean.collect()) == Counter(b for b in bodies if not b[1] or b[1].lower() != leak)
    packed = P.pack(spark, docs, str(tmp_path)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {x.doc_id for x in packed} == {d for d, _ in bodies}
