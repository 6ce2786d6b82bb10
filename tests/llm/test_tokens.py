"""Token ids, packing and directly addressable codes against the tokenizers library itself."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import dac, packing, tokens
from folio.llm.tokens import Encoder

FILES = {"byte_bpe_50k.json": "byte_level", "word_bpe_49k.json": "word_end"}
ODD = ["", " ", "  a", "a  b\n\n c\t", "it's we'll 'tis", "<|endoftext|> x<|startoftext|>", "é é ΑΣ Σ.", "a b  c\x1cd\x85e", "漢字かな 12345 ١٢", "x" * 500, "\n\nA\r\n b ", "!!! ??? ...a", "́ a", " ́"]


@functools.cache
def plain(name):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    lib.encode_special_tokens = True
    return lambda text: lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \n\tab'st.É́ \x1c\x85 Σσ0"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_ids_are_the_library_s(name, texts):
    got = Encoder.of(name, FILES[name]).encode([*texts, *ODD, None])
    want = plain(name)
    assert [x.tolist() for x in got] == [want(t) for t in [*texts, *ODD]] + [[]]


SPACES = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
NOT_QUITE = [chr(c) for c in (0x1C, 0x1F, 0x84, 0xA1, 0x1681, 0x180E, 0x200B, 0x2027, 0x202A, 0x2030, 0x2060, 0x3001, 0xFEFF)]


@pytest.mark.parametrize("name", FILES)
def test_all_white_space_and_its_neighbours(name):
    r = random.Random(5)
    texts = ["".join(r.choice([*SPACES, *NOT_QUITE, " ", " ", "a", "bé", "9", "'", "'s", ".", "\x01", "×", "…", "\u0301", "<"]) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    got, want = Encoder.of(name, FILES[name]).encode(texts), plain(name)
    assert [x.tolist() for x in got] == [want(t) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_a_very_long_text_is_encoded_in_parts(name, monkeypatch):
    r = random.Random(6)
    words = ["word", "Другое", "x" * 60, "a\n\n b", "\u3000 ", "it's", "123", "\u00a0c"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    texts = ["short one", long, None, "z" * 5000, ""]
    monkeypatch.setattr(tokens, "PART_BYTES", 1000)
    got, want = Encoder.of(name, FILES[name]).encode(texts), plain(name)
    assert [x.tolist() for x in got] == [want(t or "") for t in texts]


@pytest.mark.parametrize("most", [0, 20_000])
def test_a_full_table_starts_anew(most, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", most)
    encoder, want, r = Encoder("byte_bpe_50k.json", "byte_level"), plain("byte_bpe_50k.json"), random.Random(7)
    for _ in range(20):
        texts = [" ".join(f"w{r.randrange(500)}" for _ in range(50)) for _ in range(10)]
        assert [x.tolist() for x in encoder.encode(texts)] == [want(t) for t in texts]
        assert encoder.known.n <= 530


def test_cuts_that_share_a_hash_are_told_apart(monkeypatch):
    made = tokens._Cuts.__init__

    def blunt(self, *args):
        made(self, *args)
        self.hash &= np.uint64(3)

    monkeypatch.setattr(tokens._Cuts, "__init__", blunt)
    texts = ["some words that all fall into four hashes", "and some more words that fall there"]
    encoder, want = Encoder("byte_bpe_50k.json", "byte_level"), plain("byte_bpe_50k.json")
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [want(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(ids=st.lists(st.integers(0, 65535), max_size=3000), widths=st.sampled_from([(8, 8), (16,), (8, 8, 8)]), seed=st.integers(0, 99))
def test_codes_give_any_id(ids, widths, seed):
    reader = dac.Reader(dac.encode(np.array(ids, dtype=np.uint32), widths))
    r = random.Random(seed)
    at = [r.randrange(len(ids)) for _ in range(50)] if ids else []
    assert len(reader) == len(ids)
    assert reader.get(np.array(at, dtype=np.int64)).tolist() == [ids[i] for i in at]
    a = r.randrange(len(ids) + 1)
    b = r.randrange(a, len(ids) + 1)
    assert reader.range(a, b).tolist() == ids[a:b]


def test_an_id_too_large_is_refused():
    with pytest.raises(ValueError):
        dac.encode(np.array([1 << 16]), (8, 8))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i}", "z") for i, t in texts], "doc_id long, text string, start string, ids string")


CASES = [(5, "Some words here, and more."), (2, None), (9, ""), (2, "b b b"), (2, "b b b"), (7, "tok en " * 4000), (11, "x")]


def test_token_file_reads_back(spark):
    want_ids = plain("word_bpe_49k.json")
    got = dac.read_documents(dac.token_file(rows(spark, CASES), segment_ids=100), dac.crc32_of, "ids_crc32 long").orderBy("start").collect()
    docs = sorted(CASES, key=lambda x: x[0])
    at = 0
    assert len(got) == len(docs)
    # Rows of one doc_id: by a hash of the text, so either may be first.
    texts = {doc: [t for d, t in docs if d == doc] for doc, _ in docs}
    for (doc, _), row in zip(docs, got, strict=True):
        text = next(t for t in texts[doc] if len(want_ids(t or "")) + 1 == row.n_tokens)
        texts[doc].remove(text)
        ids = [*want_ids(text or ""), 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_packing_is_whole_and_gapless(spark):
    docs = CASES + [(100 + i, "word " * (i * 7 % 900)) for i in range(300)]
    got = [r.asDict() for r in packing.pack(rows(spark, docs).repartition(3), open_windows=4).withColumn("ids", F.col("ids")).collect()]
    want_ids = plain("byte_bpe_50k.json")
    by_seq, by_doc = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
    assert len(by_seq) * 2048 - total < 0.02 * total + 2048
    for doc, text in docs:
        if doc == 2:
            continue
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist()
        assert ids == [*want_ids(text or ""), 1] and all(r["doc_tokens"] == len(ids) for r in pieces)
    assert sum(r["length"] for r in by_doc[2]) == 2 * len(want_ids("b b b")) + 3


def plain_windows(docs, length, most, slack):
    """Best fit, said plainly: (doc, start, size, window) of each piece, in the order that windows are emitted; leftovers as one list."""
    open_, out, closed = [], [], 0
    for doc, size in docs:
        start = 0
        while size - start >= length:
            out.append([(doc, start, length)])
            start += length
        while start < size:
            rest = size - start
            free = [length - sum(n for _, _, n in w) for w in open_]
            able = [k for k in range(len(open_)) if free[k] >= rest]
            if able:
                k = min(able, key=lambda k: (free[k], k))
                open_[k].append((doc, start, rest))
                start = size
                if free[k] == rest:
                    out.append(open_.pop(k))
            elif len(open_) < most:
                open_.append([(doc, start, rest)])
                start = size
            else:
                k = min(range(len(open_)), key=lambda k: (free[k], k))
                if free[k] > slack:
                    open_[k].append((doc, start, free[k]))
                    start += free[k]
                out.append(open_.pop(k))
    return out, [p for w in open_ for p in w]


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 250), max_size=80), most=st.integers(1, 6), slack=st.sampled_from([0, 4, 16]))
def test_windows_are_placed_by_best_fit(sizes, most, slack):
    windows, found = packing.Windows(100, most, slack), []
    for doc, size in enumerate(sizes):
        windows.add(doc, range(size), found)
    left = []
    windows.rest(left)
    want, want_left = plain_windows(list(enumerate(sizes)), 100, most, slack)
    got = {}
    for doc, start, ids, window, offset in found:
        assert offset == sum(n for _, _, n in got.setdefault(window, []))
        assert list(ids) == list(range(start, start + len(ids)))
        got[window].append((doc, start, len(ids)))
    assert [got[k] for k in sorted(got)] == want
    assert [(doc, start, len(ids)) for doc, start, ids, *_ in left] == want_left


def test_empty_tables(spark):
    none = rows(spark, [(1, "a")]).filter("false")
    assert packing.pack(none).count() == 0
    assert dac.read_documents(dac.token_file(none), dac.crc32_of, "ids_crc32 long").count() == 0
