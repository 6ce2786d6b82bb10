"""Licence scans by a positional index of rare words.

IDF of all licence words is counted over all files. A file that has enough of a template's words is looked up by its own
words of highest IDF among them: their postings tell where in the template they stand, so every hit says where the template
would have to begin. Hits of different words that agree on that place, within a little slack, make a candidate, which is
verified: its mandatory key phrases must stand there word for word, and enough of its words must be there.
A phrase is a template that is mandatory as a whole: each place of its rarest word is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as X
from .common import modest


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  #: mandatory key phrases


# The phrases of the base contract, and notices as their licences ask for them.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    Template("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Template("agpl", "licensed under the gnu affero general public license version", ("gnu affero general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "obtaining a copy")),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("apache-2-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def _hashes(text: str) -> np.ndarray:
    return X.hash_words(text, X.ALNUM)


@dataclass
class Index:
    """What a scan looks up. ``idf`` of each word of the vocabulary; ``rare``: words of a file that are looked up for a template."""

    idf: np.ndarray
    phrases: dict[str, str]
    templates: tuple[Template, ...]
    rare: int = 4
    slack: int = 4
    min_share: float = 0.6
    vocabulary: np.ndarray = field(init=False)

    def __post_init__(self):
        self.vocabulary = vocabulary(self.phrases, self.templates)
        place = {int(h): i for i, h in enumerate(self.vocabulary)}
        self.words = [[place[int(h)] for h in _hashes(t)] for t in (*self.phrases, *(t.text for t in self.templates))]
        self.labels = [*self.phrases.values(), *(t.label for t in self.templates)]
        self.keys = [[np.array([place[int(h)] for h in _hashes(k)]) for k in t.keys] for t in self.templates]
        n = len(self.phrases)
        self.anchor = [max(range(len(w)), key=lambda i, w=w: (self.idf[w[i]], -i)) for w in self.words[:n]]
        #: Postings by template and word: places of the word in it.
        self.postings: list[dict[int, list[int]]] = []
        self.member = np.zeros((len(self.templates), len(self.vocabulary)), dtype=np.float32)
        for t, own in enumerate(self.words[n:]):
            held: dict[int, list[int]] = {}
            for at, w in enumerate(own):
                held.setdefault(w, []).append(at)
            self.postings.append(held)
            self.member[t, list(held)] = 1
        self.least = np.ceil(self.min_share * self.member.sum(axis=1) - 1e-9)

    def scan(self, at: np.ndarray, row: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Finds in words ``at`` (places in the vocabulary, else -1) of ``row``: (template, row, first word, words, share). Phrases come first among templates."""
        out, n = [], len(self.phrases)
        for t in range(n):
            own, anchor = self.words[t], self.anchor[t]
            begin = np.flatnonzero(at == own[anchor]) - anchor
            begin = begin[(begin >= 0) & (begin + len(own) <= len(at))]
            begin = begin[row[begin] == row[begin + len(own) - 1]] if len(begin) else begin
            for j, w in enumerate(own):
                begin = begin[at[begin + j] == w]
            out += [(t, int(row[b]), int(b - first[row[b]]), len(own), 1.0) for b in begin]
        # Which licence words each file has, and how many of each template's.
        has = np.zeros((len(first) - 1, len(self.vocabulary)), dtype=bool)
        known = at >= 0
        has[row[known], at[known]] = True
        some = np.flatnonzero(has.any(axis=1))
        rows, kinds = np.nonzero(has[some].astype(np.float32) @ self.member.T >= self.least) if len(self.templates) else ((), ())
        for r, t in zip(some[rows].tolist() if len(rows) else (), kinds.tolist() if len(rows) else (), strict=True):
            here, held = at[first[r] : first[r + 1]], self.postings[t]
            best = sorted((w for w in held if has[r, w]), key=lambda w: (-self.idf[w], w))[: self.rare]
            hits = sorted((int(b) - place, w) for w in best for b in np.flatnonzero(here == w) for place in held[w])
            own, need, a = self.words[n + t], min(2, len(best)), 0
            while a < len(hits):
                b = a
                while b + 1 < len(hits) and hits[b + 1][0] - hits[b][0] <= self.slack:
                    b += 1
                if len({w for _, w in hits[a : b + 1]}) >= need:
                    window = here[max(0, hits[a][0] - self.slack) : max(0, hits[b][0] + len(own) + self.slack)]
                    share = len(set(own) & set(window.tolist())) / len(held)
                    if share >= self.min_share and all(_stands(window, k) for k in self.keys[t]):
                        out.append((n + t, r, max(0, hits[a][0]), len(own), share))
                a = b + 1
        return out


def _stands(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([words[j : j + n] == w for j, w in enumerate(phrase)]).any())


def vocabulary(phrases: dict[str, str], templates: tuple[Template, ...]) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for t in (*phrases, *(t.text for t in templates), *(k for t in templates for k in t.keys))]))


def document_frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """In how many rows of ``docs`` each word stands: one small vector a task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, found = X.Lookup(words), np.zeros(len(words), dtype=np.int64)
        for _, data, at in X.pieces(batches):
            w = X.words(data, at, X.ALNUM)
            place = lookup.find(w.hashes())
            own = place >= 0
            pairs = np.unique(w.row[own].astype(np.int64) * len(words) + place[own])
            found += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), pa.array(found)], names=["word", "n"])

    out = np.zeros(len(words), dtype=np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row a word of the templates
        out[r.word] = r.n
    return out


SPAN = "struct<label:string,first_word:bigint,n_words:bigint,share:double>"
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null and empty texts have no words, no labels and score 0. Repeated rows are scanned each; other columns
    are ignored; an empty table gives no rows. Score: the largest share of a found template's words, 1 for a phrase.
    """
    phrases = PHRASES if phrases is None else phrases
    modest(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = vocabulary(phrases, templates)
    idf = -np.log1p(document_frequencies(narrow, words).astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lookup, n = Index(idf, phrases, templates), X.Lookup(words), len(phrases)
        for batch, data, at in X.pieces(batches):
            w = X.words(data, at, X.ALNUM)
            found: dict[int, list] = {}
            for t, r, start, size, share in index.scan(lookup.find(w.hashes()), w.row, w.first):
                found.setdefault(r, []).append((t, start, size, share))
            rows = range(batch.num_rows)
            base = {r: [h for h in hits if h[0] < n] for r, hits in found.items()}
            names = lambda hits: ",".join(sorted({index.labels[h[0]] for h in hits}))
            cols = [
                batch.column("doc_id"), pa.array(w.per_row, pa.int64()), pa.array([len(base.get(r, ())) for r in rows], pa.int64()),
                pa.array([min((h[1] for h in base.get(r, ())), default=None) for r in rows], pa.int64()), pa.array([max((h[1] for h in base.get(r, ())), default=None) for r in rows], pa.int64()),
                pa.array([names(base.get(r, ())) for r in rows], pa.string()), pa.array([names(found.get(r, ())) for r in rows], pa.string()),
                pa.array([max((h[3] for h in found.get(r, ())), default=0.0) for r in rows], pa.float64()),
                pa.array([[{"label": index.labels[t], "first_word": s, "n_words": k, "share": p} for t, s, k, p in sorted(found.get(r, ()))] for r in rows], pa.list_(_SPAN)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return narrow.mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>")
