"""Toxic spans by a linear-chain conditional random field (CRF) of two tags.

Labels are of documents, so tokens are labelled first: a word or stem is toxic that stands in more toxic texts
than chance would put it in, hardly ever in others, and between ever other neighbours. The last keeps out what only copies of one text
share. Its places in toxic texts are tagged 1, all else 0. The CRF learns from windows of these tokens, by
features of each word, its stems and both neighbours, and from the tag before. Forward and backward messages give each
token's marginal p. A text's sum of p squared over all tokens, that is how many tokens two independent taggings both
mark on average, gives its score by a logistic curve. The curve is fitted on a fifth of the labelled sample, which the CRF does
not learn from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as X
from .common import forget, modest, tables, written

BITS = 17
#: Bytes at the beginning of a word that count as its stem.
HEADS = (4, 5, 6)
FEATURES = 3 + len(HEADS)
WINDOW = 48
#: Toxic tokens that a text without any counts as having.
LEAST = 0.02
#: Tokens of one stretch of a long text, and how far a marginal may be off where stretches meet.
STRETCH, SLIGHT = 4096, 1e-9


@dataclass(frozen=True)
class Bounds:
    """The sample that the classifier is fitted on; everything else covers all rows."""

    toxic_docs: int = 6000
    clean_docs: int = 12000
    toxic_windows: int = 12000
    clean_windows: int = 12000
    #: How many toxic texts a word must stand in to be taken for toxic, however many there are: a rare language has few.
    least_texts: int = 3
    #: Of the words taken for toxic, how many may be so by chance (Benjamini and Hochberg 1995), as words of mislabelled texts are.
    chance: float = 0.05


@dataclass
class Crf:
    emit: np.ndarray  #: FEATURES by 2**BITS: weight of tag 1 over tag 0
    bias: float
    turn: np.ndarray  #: 2 by 2: from tag, to tag
    curve: tuple[float, float] = (-2.0, 1.0)  #: log odds of a text at 1 expected toxic token, and their slope by its log

    def score(self, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log(expected + LEAST), -40, 40)))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.full(features.shape[1], self.bias, dtype=np.float64)
        for k in range(FEATURES):
            out += self.emit[k][features[k]]
        return out


def units(w: X.Words) -> list[np.ndarray]:
    """Hashes of each word and of its stems."""
    return [w.hashes(), *(w.hashes(k) for k in HEADS)]


def features(w: X.Words, own: list[np.ndarray]) -> np.ndarray:
    """FEATURES by words: places in the tables of weights."""
    shift, hashes = np.uint64(64 - BITS), own[0]
    edge = np.uint64(0x5851F42D4C957F2D)
    first, last = np.zeros((2, len(hashes)), dtype=bool)
    first[w.first[:-1][w.per_row > 0]] = True
    last[w.first[1:][w.per_row > 0] - 1] = True
    before = np.where(first, edge, np.roll(hashes, 1))
    after = np.where(last, edge, np.roll(hashes, -1))
    odd = [np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in range(FEATURES)]
    return np.stack([((x * m) >> shift).astype(np.int32) for x, m in zip((*own, before, after), odd, strict=True)])


def _log_mix(a: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Log ratio, tag 1 over 0, after a step along the chain from log ratio ``a``."""
    return np.logaddexp(turn[0, 1], turn[1, 1] + a) - np.logaddexp(turn[0, 0], turn[1, 0] + a)


def reach(turn: np.ndarray) -> int:
    """Tokens after which what stood before no longer moves a log ratio by more than SLIGHT.

    A step shrinks any difference of log ratios by tanh(d / 4) at least, d being the log cross ratio of the moves
    (Birkhoff 1957), and leaves none above d.
    """
    d = abs(turn[0, 0] + turn[1, 1] - turn[0, 1] - turn[1, 0])
    return 1 if d <= SLIGHT else 2 + int(np.ceil(np.log(SLIGHT / d) / np.log(np.tanh(d / 4))))


def marginals(emission: np.ndarray, first: np.ndarray, turn: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """P(tag 1) of each token; ``first``: n + 1, tokens before each sequence. Long ones are cut into stretches that overlap by ``reach``."""
    size = np.diff(first)
    if not len(size) or size.max() <= 2 * stretch:
        return _marginals(emission, first, turn)
    more, parts = reach(turn), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        cuts = [*range(a, b, stretch)] if b - a > 2 * stretch else [a]
        parts += [(max(a, c - more), min(b, e + more), c, e) for c, e in zip(cuts, [*cuts[1:], b], strict=True)]
    places = np.concatenate([[0], np.cumsum([hi - lo for lo, hi, _, _ in parts])])
    found = _marginals(np.concatenate([emission[lo:hi] for lo, hi, _, _ in parts]), places, turn)
    return np.concatenate([found[at + c - lo : at + e - lo] for at, (lo, _, c, e) in zip(places.tolist(), parts, strict=False)])


def _marginals(emission: np.ndarray, first: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """All sequences step together, the longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, length = first[:-1][order], size[order]
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # sequences longer than t
    ahead = np.empty_like(emission)
    state = np.zeros(len(order))
    for t, n in enumerate(live):
        at = begin[:n] + t
        state = emission[at] + (_log_mix(state[:n], turn) if t else 0.0)
        ahead[at] = state
    back = np.zeros_like(emission)
    stop = begin + length
    turned = turn.T
    state = np.zeros(len(order))
    for t, n in enumerate(live[1:], 1):
        at = stop[:n] - 1 - t
        state = _log_mix(emission[at + 1] + back[at + 1], turned)
        back[at] = state
    return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))


def train(rows: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Crf:
    """Log likelihood by Adagrad. ``rows``: windows by FEATURES by WINDOW, -1 beyond a window's end; ``tags``: windows by WINDOW."""
    crf = Crf(np.zeros((FEATURES, 1 << BITS)), -2.0, np.zeros((2, 2)))
    seen, seen_bias, seen_turn, order = np.full_like(crf.emit, 1e-6), 1e-6, np.full((2, 2), 1e-6), np.random.default_rng(seed)
    for _ in range(epochs if len(rows) else 0):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            x, y = rows[part], tags[part].astype(float)
            there = x[:, 0] >= 0
            e = np.where(there, crf.bias + sum(crf.emit[k][np.maximum(x[:, k], 0)] for k in range(FEATURES)), 0.0)
            n, steps = e.shape
            a, b = np.empty_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for t in range(1, steps):
                a[:, t] = np.where(there[:, t], e[:, t] + _log_mix(a[:, t - 1], crf.turn), a[:, t - 1])
            for t in range(steps - 2, -1, -1):
                b[:, t] = np.where(there[:, t + 1], _log_mix(e[:, t + 1] + b[:, t + 1], crf.turn.T), 0.0)
            p = np.where(there, 1 / (1 + np.exp(-np.clip(a + b, -60, 60))), 0.0)
            slope = (np.where(there, y, 0.0) - p) / n
            # Expected less observed moves between neighbours, from forward and backward messages.
            both = there[:, 1:] & there[:, :-1]
            joint = np.stack([crf.turn[i, j] + i * a[:, :-1] + j * (e[:, 1:] + b[:, 1:]) for i in (0, 1) for j in (0, 1)])
            joint = np.exp(joint - joint.max(axis=0))
            joint /= joint.sum(axis=0)
            moved = np.stack([(y[:, :-1] == i) & (y[:, 1:] == j) for i in (0, 1) for j in (0, 1)])
            g = (np.where(both, moved - joint, 0.0).sum(axis=(1, 2)) / n).reshape(2, 2)
            seen_turn += g * g
            crf.turn += rate * g / np.sqrt(seen_turn)
            g = slope.sum()
            seen_bias += g * g
            crf.bias += rate * g / np.sqrt(seen_bias)
            for k in range(FEATURES):
                at, own = np.unique(x[:, k][there], return_inverse=True)
                g = np.bincount(own, slope[there], len(at)) - decay * crf.emit[k][at]
                seen[k][at] += g * g
                crf.emit[k][at] += (rate if k < FEATURES - 2 else rate / 3) * g / np.sqrt(seen[k][at])
    return crf


def _places(sample: DataFrame) -> DataFrame:
    """A row a place of a word or stem: unit, both neighbours as one number, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in X.pieces(batches):
            w = X.words(data, at, X.ALNUM)
            own = units(w)
            around = X.mix(np.roll(own[0], 1)) * np.uint64(3) + np.roll(own[0], -1)
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[w.row]
            for k, unit in enumerate(own):
                new = np.full(len(unit), not k) | (unit != own[0])
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(unit[new])), pa.array(X.signed(around[new])), pa.array(doc[new], pa.int64())], names=["unit", "around", "doc_id"])

    return sample.mapInArrow(run, "unit long, around long, doc_id long")


def _texts_with(sample: DataFrame) -> DataFrame:
    """unit, n: in how many texts a word or stem stands; summed in each piece before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in X.pieces(batches):
            w = X.words(data, at, X.ALNUM)
            own = units(w)
            new = [np.full(len(unit), not k) | (unit != own[0]) for k, unit in enumerate(own)]
            unit, row = np.concatenate([u[k] for u, k in zip(own, new, strict=True)]), np.concatenate([w.row[k] for k in new])
            order = np.lexsort((row, unit))
            unit, row = unit[order], row[order]
            other = np.ones(len(unit), dtype=bool)
            other[1:] = unit[1:] != unit[:-1]
            begin = np.flatnonzero(other)
            other[1:] |= row[1:] != row[:-1]
            n = np.add.reduceat(other.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(X.signed(unit[begin])), pa.array(n)], names=["unit", "n"])

    return sample.mapInArrow(run, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _log_tail(n: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Log of the chance that of ``total`` texts n or more are toxic, if each is with chance ``share``."""
    if not len(n):
        return np.zeros(0)
    n, total = n.astype(np.int64), total.astype(np.int64)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total.max() + 1)))])
    out = np.empty(len(n))
    for i, (a, b) in enumerate(zip(n.tolist(), total.tolist(), strict=True)):
        k = np.arange(a, b + 1)
        terms = log_factorial[b] - log_factorial[k] - log_factorial[b - k] + k * np.log(share) + (b - k) * np.log1p(-share)
        out[i] = terms.max() + np.log(np.exp(terms - terms.max()).sum())
    return out


def seeds(sample: DataFrame, n_toxic: int, n_clean: int, bounds: Bounds = Bounds()) -> np.ndarray:
    """Hashes of words and stems taken for toxic: in toxic texts and between different neighbours oftener than by chance, and with log odds of 4 or more between texts.

    No bound grows with the number of toxic texts, so that words of a rare language or source count by their own evidence.
    """
    places = _places(sample.filter("toxic = 1"))
    # First by unit and neighbours, then by unit: no task gathers a unit's places.
    around = places.groupBy("unit", "around").agg(F.count("*").alias("n")).groupBy("unit").agg(F.count("*").alias("kinds"))
    texts = places.groupBy("unit", "doc_id").agg(F.count("*").alias("n")).groupBy("unit").agg(F.count("*").alias("texts"))
    known = texts.join(around, "unit").select("unit", F.least("texts", "kinds").alias("n"))
    known = written(known.filter(F.col("n") >= bounds.least_texts), "toxic-words")
    tested = known.count()
    # Fewer texts than this do not reach the log odds even if no clean text has the word.
    least = 0.5 * np.exp(4) * (n_toxic + 1) / (n_clean + 1) - 0.5
    clean = _texts_with(sample.filter("toxic = 0")).withColumnRenamed("n", "clean")
    odds = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    known = known.filter(F.col("n") >= float(least) - 1e-6).join(clean, "unit", "left").fillna(0, ["clean"]).filter(odds >= 4)
    known = known.orderBy("unit").toPandas()  # words of a bounded sample that hardly any clean text has
    found, n, clean = known.unit.to_numpy(np.int64).view(np.uint64), known.n.to_numpy(float), known.clean.to_numpy(float)
    tail = _log_tail(n, n + clean, n_toxic / max(n_toxic + n_clean, 1))
    order = np.sort(tail)
    passing = np.flatnonzero(order <= np.log(bounds.chance * np.arange(1, len(order) + 1) / max(tested, 1)))
    return found[tail <= order[passing[-1]]] if len(passing) else found[:0]


def _windows(sample: DataFrame, found: np.ndarray) -> DataFrame:
    """Windows of tokens around toxic words of toxic texts, and one of each clean text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = X.Lookup(found)
        for batch, data, at in X.pieces(batches):
            w = X.words(data, at, X.ALNUM)
            own = units(w)
            h, f, label = own[0], features(w, own), batch.column("toxic").to_numpy(zero_copy_only=False)
            tag = np.logical_or.reduce([lookup.find(u) >= 0 for u in own]) & (label[w.row] == 1)
            rows, tags, kinds, orders = [], [], [], []
            for r in range(batch.num_rows):
                a, b = int(w.first[r]), int(w.first[r + 1])
                if a == b:
                    continue
                blocks = range(a, b, WINDOW)
                chosen = [s for s in blocks if tag[s : min(s + WINDOW, b)].any()] if label[r] == 1 else [blocks[int(h[a] % np.uint64(len(blocks)))]]
                for s in chosen:
                    e = min(s + WINDOW, b)
                    x, y = np.full((FEATURES, WINDOW), -1, np.int32), np.zeros(WINDOW, np.uint8)
                    x[:, : e - s], y[: e - s] = f[:, s:e], tag[s:e]
                    rows.append(x.tobytes()), tags.append(y.tobytes()), kinds.append(int(label[r])), orders.append(int(X.signed(X.mix(h[s : s + 1]))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(tags, pa.binary()), pa.array(kinds, pa.int32()), pa.array(orders, pa.int64())], names=["x", "y", "toxic", "place"])

    return sample.mapInArrow(run, "x binary, y binary, toxic int, place long")


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Crf:
    """Learns from rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks, up to ``bounds``, chosen by a hash of doc_id.

    Rows of ``labels`` with nulls are skipped; of several for one doc_id the largest holds. Of several rows of ``docs`` with
    one doc_id the least text is learned from. Without a toxic label the model finds nothing.
    """
    before = tables()
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = []
    for kind, most in ((1, bounds.toxic_docs), (0, bounds.clean_docs)):
        chosen.append(known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    chosen = chosen[0].unionByName(chosen[1])
    picked = F.broadcast(chosen)  # bounds.toxic_docs + bounds.clean_docs rows at most
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(5)) == 0).alias("curve")), "toxic-sample")
    for_curve, sample = sample.filter("curve"), sample.filter("not curve")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = seeds(sample, n.get(1, 0), n.get(0, 0), bounds)
    windows = _windows(sample, found)
    taken = [windows.filter(F.col("toxic") == k).orderBy("place", "x").limit(most) for k, most in ((1, bounds.toxic_windows), (0, bounds.clean_windows))]
    rows = taken[0].unionByName(taken[1]).select("x", "y").toPandas()  # so many windows at most
    x = np.stack([np.frombuffer(v, np.int32).reshape(FEATURES, WINDOW) for v in rows.x]) if len(rows) else np.zeros((0, FEATURES, WINDOW), np.int32)
    y = np.stack([np.frombuffer(v, np.uint8) for v in rows.y]) if len(rows) else np.zeros((0, WINDOW), np.uint8)
    crf = train(x, y) if y.any() else Crf(np.zeros((FEATURES, 1 << BITS)), -20.0, np.zeros((2, 2)))
    seen = tag(for_curve.select("doc_id", "text"), crf).select("doc_id", "expected").join(F.broadcast(chosen), "doc_id").select("expected", "toxic").toPandas()  # a fifth of the sample's rows
    if len(seen):
        crf.curve = _logistic(np.log(seen.expected.to_numpy() + LEAST), seen.toxic.to_numpy(float))
    forget(before)
    return crf


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope, by Newton's steps."""
    both, w = np.stack([np.ones_like(x), x], axis=1), np.array([-2.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -40, 40)))
        w = w + np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + ridge * np.eye(2), both.T @ (y - p) - ridge * (w - [-2.0, 1.0]))
    return float(w[0]), max(float(w[1]), 0.0)


#: Marginal from which a token is part of a span.
SPAN = 0.5


def tag(docs: DataFrame, crf: Crf, carry: list[str] | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, score, expected (sum of squared marginals), spans (start, stop in code points, mean marginal).

    With ``carry``, those columns of ``docs``, text among them, and as the last one the score instead: a row for each row, with no join.
    Null and empty texts have the lowest score and no spans; repeated rows are scored each; other columns are ignored.
    """
    modest(docs.sparkSession)
    small = Crf(crf.emit.astype(np.float32), crf.bias, crf.turn, crf.curve)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(small))  # FEATURES * 2**BITS weights: 3 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch, data, at in X.pieces(batches, limit=2 << 20):
            w = X.words(data, at, X.ALNUM)
            p = marginals(own.emissions(features(w, units(w))), w.first, own.turn) if len(w.start) else np.zeros(0)
            expected = np.bincount(w.row, p * p, batch.num_rows) if len(p) else np.zeros(batch.num_rows)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            last = None
            for i in np.flatnonzero(p >= SPAN):
                r, a, b = int(w.row[i]), int(w.start[i]), int(w.end[i])
                if last == (r, i - 1):
                    held = spans[r][-1]
                    held[1] = b
                    held[2].append(float(p[i]))
                else:
                    spans[r].append([a, b, [float(p[i])]])
                last = (r, i)
            shown = []
            for r, held in enumerate(spans):
                if held:
                    before = np.concatenate([[0], np.cumsum((w.data[at[r] : at[r + 1]] & 0xC0) != 0x80)])
                    held = [{"start": int(before[a - at[r]]), "stop": int(before[b - at[r]]), "p": sum(q) / len(q)} for a, b, q in held]
                shown.append(held)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(expected)), pa.array(expected), pa.array(shown, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())])))], names=["doc_id", "score", "expected", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if carry is None:
        return narrow.mapInArrow(run, "doc_id long, score double, expected double, spans array<struct<start:bigint,stop:bigint,p:double>>")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])
                p = pa.concat_arrays([x.column("score") for x in run(iter([texts]))])
                yield pa.RecordBatch.from_arrays([*batch.columns, p], names=[*carry, score_name])

    score_name = "_score"
    while score_name in carry:
        score_name += "_"
    return docs.select(*carry).mapInArrow(scores, T.StructType([*docs.select(*carry).schema.fields, T.StructField(score_name, T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
