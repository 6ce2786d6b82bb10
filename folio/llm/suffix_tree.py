"""A probabilistic suffix tree (Ron, Singer and Tishby 1996) as a language model.

Symbols are bytes: a text is its lower-cased words, a space behind each, and a line break, which no word holds,
as its end. Contexts are up to DEPTH bytes before a symbol. Each context of the training texts is counted; one is
retained if its next symbols diverge enough from those of its suffix, one byte shorter, and so are all suffixes of a
retained one. A symbol's probability in a retained context is smoothed with that of the next shorter one
(Witten and Bell), and at the root with one more of each byte. A text is scored by the longest retained suffix
at each place.

Counts, the tree and word counts are tables that grow with the corpus. Scoring has the tree, and counts of frequent words, as
arrays on each executor while they are below a stated size; beyond it frequent grams alone are scored there and the rest are
joined with the tree, as rare words always are with their counts. All are doubles, so either way gives the same score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as X
from .common import forget, tables, tidy, written

DEPTH = 6
#: Nats by which a context must describe its next symbols better than its suffix does, by each kind of next symbol.
DIVERGENCE = 2.0
#: Rows of the tree that executors hold as arrays, about 27 bytes each with their table; a larger one is joined instead.
MOST_ROWS = 6_000_000
#: Frequent words, and beyond MOST_ROWS frequent grams, that executors hold; all others are joined.
MOST_WORDS = 500_000
#: Bytes of the contexts whose tables Spark joins level by level; on 30 to 40 MB of text the last of these has 58,000 to 89,000
#: rows, and the commonest 3 bytes end the contexts of 0.7 % of all grams, which go to one task (of 2 bytes 2 %, of 4 0.1 %).
NEAR = 3
_SPACE, _END = 0x20, 0x0A
_HELD = 3_000_000
_PIECE = 300_000
_COUNT, _MUST = 128, 129


def stream(w: X.Words, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a piece, ``depth`` ends before each text; where texts begin; which symbols are predicted."""
    size = w.end - w.start
    n = len(w.first) - 1
    total = np.concatenate([[0], np.cumsum(size + 1)])
    begin = total[w.first[:-1]] + (depth + 1) * np.arange(n)
    out = np.full(int(total[-1]) + (depth + 1) * n, _SPACE, dtype=np.uint8)
    shift = total[:-1] - w.start + (depth + 1) * w.row + depth
    inside = np.repeat(w.start - total[:-1] + np.arange(len(size)), size) + np.arange(int(size.sum()))
    out[inside + np.repeat(shift, size)] = w.data[inside]
    own = np.ones(len(out), dtype=bool)
    for k in range(depth):
        out[begin + k], own[begin + k] = _END, False
    out[np.append(begin[1:], len(out))[: n] - 1] = _END
    return out, begin, own


def grams(symbols: np.ndarray, own: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Of each predicted symbol: it in the low byte, the ``depth`` symbols before it above."""
    s = symbols.astype(np.uint64)
    code = s.copy()
    for k in range(1, depth + 1):
        code[k:] |= s[:-k] << np.uint64(8 * k)
    return code[own]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(keys) else n


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind (0: gram, 1: word, 2: text), key, n over all ``texts`` (text): summed up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        n_texts = 0

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(X.signed(k)), pa.array(n[a : a + 100_000].astype(np.int64))], names=["kind", "key", "n"])

        for batch, data, at in X.pieces(batches):
            w = X.words(data, at)
            n_texts += batch.num_rows
            symbols, _, own = stream(w, depth)
            for kind, keys in ((0, grams(symbols, own, depth)), (1, w.hashes())):
                held[kind].append(_tally(keys))
                if sum(len(p[0]) for p in held[kind]) > _HELD:
                    held[kind] = [_counted(held[kind])]
                    if len(held[kind][0][0]) > 0.7 * _HELD:
                        yield from out(kind, *held[kind].pop())
        for kind in (0, 1):
            if held[kind]:
                yield from out(kind, *_counted(held[kind]))
        yield from out(2, np.zeros(1, np.uint64), np.array([n_texts]))

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _mask(level: int) -> Column:
    return F.lit((1 << 8 * (level + 1)) - 1)


def _low(bytes_: int) -> np.uint64:
    return np.uint64((1 << 8 * bytes_) - 1)


class _Level:
    """The distinct grams of a level, sorted, with their counts; ``ctx`` their contexts, ``of`` the place of a gram's context."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, self.n = gram, n.astype(np.float64)
        ctx = gram >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        self.first, self.ctx, self.kinds = first, ctx[first], np.diff(np.append(first, len(gram)))
        self.all = np.add.reduceat(self.n, first)
        self.of = np.repeat(np.arange(len(first)), self.kinds)


def _branches(gram: np.ndarray, n: np.ndarray, near: int, depth: int, divergence: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``_deep`` from all grams of some contexts of ``near`` bytes."""
    tallies = {depth: _counted([(gram, n)])}
    for level in range(depth - 1, near - 1, -1):
        more = tallies[level + 1]
        tallies[level] = _counted([(more[0] & _low(level + 1), more[1])])
    g = {level: _Level(*t) for level, t in tallies.items()}
    up = {level: np.searchsorted(g[level - 1].gram, g[level].gram & _low(level)) for level in range(near + 1, depth + 1)}
    kept: dict[int, np.ndarray] = {}
    for level in range(depth, near, -1):
        own, less, at = g[level], g[level - 1], up[level]
        s = np.add.reduceat(own.n * np.log(own.n * less.all[less.of[at]] / less.n[at]), own.first)
        kept[level] = s - own.all * np.log(own.all) >= divergence * own.kinds
        if level < depth:
            kept[level][np.searchsorted(own.ctx, g[level + 1].ctx[kept[level + 1]] & _low(level))] = True
    none = lambda x: np.zeros(len(x))
    yield _COUNT, g[near].gram, none(g[near].gram), none(g[near].gram), tallies[near][1]
    must = np.unique(g[near + 1].ctx[kept[near + 1]] & _low(near))
    yield _MUST, must, none(must), none(must), np.zeros(len(must), np.int64)
    a, b = none(g[near].gram), np.ones(len(g[near].gram))
    for level in range(near + 1, depth + 1):
        own, at = g[level], up[level]
        kinds, below = own.kinds[own.of], (own.all + own.kinds)[own.of]
        a, b = (own.n + kinds * a[at]) / below, kinds * b[at] / below
        there = kept[level][own.of]
        yield level, own.gram[there], a[there], b[there], tallies[level][1][there]
        there = kept[level]
        yield 64 + level, own.ctx[there], np.log10(own.kinds[there] / (own.all + own.kinds)[there]), none(own.ctx[there]), np.zeros(int(there.sum()), np.int64)


def _deep(gram_counts: DataFrame, near: int, depth: int, divergence: float, piece: int) -> DataFrame:
    """What the contexts longer than ``near`` bytes give: level, key, value, share, n. All grams whose contexts end in the same
    ``near`` bytes are in one task, so it knows all counts of the levels above these, and what is retained, by itself. It takes
    the groups one after another, ``piece`` grams or one group at a time.

    Levels near + 1 to depth: a retained gram's probability is value + share times that of its last near + 1 bytes. 64 + level:
    contexts as in ``tree``. _COUNT: grams of level near with their n. _MUST: contexts of near bytes that have retained ones below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for level, key, value, share, own in _branches(keys, n, near, depth, divergence):
                for a in range(0, len(key), 100_000):
                    k, at = key[a : a + 100_000], slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), level, np.int32)), pa.array(X.signed(k)), pa.array(value[at]), pa.array(share[at]), pa.array(own[at])], names=["level", "key", "value", "share", "n"])

        held, rows, enough = [], 0, piece
        for batch in batches:
            held.append((batch.column("gram").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            rows += batch.num_rows
            if rows < enough:
                continue
            keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            group = (keys >> np.uint64(8)) & _low(near)
            changes = np.flatnonzero(group[1:] != group[:-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield from out(keys[:cut], n[:cut])
            held, rows = [(keys[cut:].copy(), n[cut:].copy())], len(keys) - cut
            # A group beyond a piece is looked at again only once it has doubled.
            enough = max(piece, 2 * rows)
        if rows:
            yield from out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        tidy()

    end = F.shiftright("gram", 8).bitwiseAND(_mask(near - 1))
    dealt = gram_counts.select(F.col("key").alias("gram"), "n", end.alias("end")).repartition("end").sortWithinPartitions("end").select("gram", "n")
    return written(dealt.mapInArrow(run, "level int, key long, value double, share double, n long"), "branches")


def tree(gram_counts: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE, piece: int = _PIECE) -> DataFrame:
    """The retained tree as rows (level, key, value). level 0 to depth: key is a gram of that many context bytes, value its
    log10 probability. level 64 + l: key is a retained context of l bytes, value log10 of what it leaves to its suffix.

    Contexts of up to NEAR bytes, whose tables are small, are counted and judged level by level; all longer ones at once where
    their grams are (``_deep``). Level by level these cost the driver most of its plans, threads and memory.
    """
    before = tables()
    near = min(NEAR, depth)
    deep = _deep(gram_counts, near, depth, divergence, piece) if near < depth else None
    counted = deep.filter(F.col("level") == _COUNT) if deep is not None else gram_counts
    g = {near: counted.select(F.col("key").alias("gram"), "n")}
    for level in range(near - 1, -1, -1):
        g[level] = written(g[level + 1].groupBy(F.col("gram").bitwiseAND(_mask(level)).alias("gram")).agg(F.sum("n").alias("n")), "grams")
    context = lambda column: F.shiftright(F.col(column), 8)
    ctx = {level: g[level].groupBy(context("gram").alias("ctx")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds")) for level in g}
    kept: dict[int, DataFrame] = {}
    for level in range(near, 0, -1):
        up = g[level - 1].select(F.col("gram").alias("up"), F.col("n").alias("up_n"), context("gram").alias("up_ctx")).join(ctx[level - 1].select(F.col("ctx").alias("up_ctx"), F.col("all").alias("up_all")), "up_ctx")
        own = g[level].select(F.col("n").cast("double").alias("n"), context("gram").alias("ctx"), F.col("gram").bitwiseAND(_mask(level - 1)).alias("up"))
        scored = own.join(up, "up").groupBy("ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log(F.col("n") * F.col("up_all") / F.col("up_n"))).alias("s"))
        good = scored.filter(F.col("s") - F.col("all") * F.log(F.col("all")) >= divergence * F.col("kinds")).select("ctx")
        if level < near:
            good = good.unionByName(kept[level + 1].select(F.col("ctx").bitwiseAND(F.lit((1 << 8 * level) - 1)).alias("ctx"))).distinct()
        elif deep is not None:
            good = good.unionByName(deep.filter(F.col("level") == _MUST).select(F.col("key").alias("ctx"))).distinct()
        kept[level] = written(good, "contexts")
    total = g[0].agg(F.sum("n")).first()[0] or 0
    p = g[0].select("gram", ((F.col("n") + 1) / F.lit(float(total + 256))).alias("p"))
    out = [p.select(F.lit(0).alias("level"), F.col("gram").alias("key"), F.log10("p").alias("value"))]
    for level in range(1, near + 1):
        here = ctx[level].join(kept[level], "ctx", "left_semi")
        rows = g[level].withColumn("ctx", context("gram")).join(here, "ctx").withColumn("up", F.col("gram").bitwiseAND(_mask(level - 1)))
        p = rows.join(p.select(F.col("gram").alias("up"), F.col("p").alias("up_p")), "up").select("gram", ((F.col("n") + F.col("kinds") * F.col("up_p")) / (F.col("all") + F.col("kinds"))).alias("p"))
        p = written(p, "states")
        out.append(p.select(F.lit(level).alias("level"), F.col("gram").alias("key"), F.log10("p").alias("value")))
        out.append(here.select(F.lit(64 + level).alias("level"), F.col("ctx").alias("key"), F.log10(F.col("kinds") / (F.col("all") + F.col("kinds"))).alias("value")))
    if deep is not None:
        states = deep.filter(F.col("level").between(near + 1, depth)).withColumn("gram", F.col("key").bitwiseAND(_mask(near)))
        out.append(states.join(p, "gram").select("level", "key", F.log10(F.col("value") + F.col("share") * F.col("p")).alias("value")))
        out.append(deep.filter(F.col("level").between(64 + near + 1, 64 + depth)).select("level", "key", "value"))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    rows = written(rows, "tree")
    forget(before, rows)
    return rows


#: Bits of the number of grams whose scores a worker remembers, each in the one place that its hash gives.
_MEMO = 21
_NO_GRAM = np.uint64((1 << 64) - 1)


class Tree:
    """The tree as arrays; ``value`` has a 0 behind the last, for what is not found."""

    _held: tuple[str, Tree] | None = None

    def __init__(self, tagged: np.ndarray, value: np.ndarray, total: int, depth: int):
        self.depth, self.unseen = depth, -np.log10(total + 256)
        self.lookup, self.value = X.Lookup(tagged.view(np.uint64)), value
        self.known, self.known_p = np.full(1 << _MEMO, _NO_GRAM), np.zeros(1 << _MEMO)

    @classmethod
    def of(cls, name: str, *arrays) -> Tree:
        """A worker's tree of this name: built once for all of its tasks."""
        if cls._held is None or cls._held[0] != name:
            cls._held = (name, cls(*arrays))
        return cls._held[1]

    @staticmethod
    def _tag(level, key: np.ndarray) -> np.ndarray:
        return (np.asarray(level).astype(np.uint64) << np.uint64(56)) | key.astype(np.uint64)

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's low byte after the others. Grams met lately are remembered."""
        place = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO)).astype(np.int64)
        out = self.known_p[place]
        new = np.flatnonzero(self.known[place] != code)
        if len(new):
            own, place = code[new], place[new]
            out[new] = p = self._score(own)
            # Of several at one place the last stays, in both arrays.
            self.known[place], self.known_p[place] = own, p
        return out

    def _score(self, code: np.ndarray) -> np.ndarray:
        out, todo, own = np.zeros(len(code)), np.arange(len(code)), code
        for level in range(self.depth, -1, -1):
            gram = own & np.uint64((1 << 8 * (level + 1)) - 1)
            at = self.lookup.find(self._tag(level, gram))
            hit = at >= 0
            out[todo[hit]] += self.value[at[hit]]
            miss = ~hit
            todo, own, gram = todo[miss], own[miss], gram[miss]
            if not level:
                out[todo] += self.unseen
            elif len(todo):
                at = self.lookup.find(self._tag(64 + level, gram >> np.uint64(8)))
                out[todo] += self.value[at]
        return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:bigint,n:bigint>>, grams array<struct<gram:bigint,n:bigint>>"
_PAIR = {name: pa.list_(pa.struct([(name, pa.int64()), ("n", pa.int64())])) for name in ("word", "gram")}


def _pairs(name: str, row: np.ndarray, key: np.ndarray, rows: int) -> pa.Array:
    """Distinct keys of each row with their counts, as a list column."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(row)))
    begin = np.searchsorted(row[new], np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.StructArray.from_arrays([pa.array(X.signed(key[new])), pa.array(n.astype(np.int64))], names=[name, "n"]))


def _packed(rows: DataFrame, kind: str, size: int, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All ``size`` rows of a (long, number) table as two arrays, the second with ``spare`` zeros behind. Executors pack them
    and each is copied to its place as it comes, so that the driver holds these bytes alone, and once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([a.astype("<i8").tobytes()], pa.binary()), pa.array([b.astype(kind).tobytes()], pa.binary())], names=["a", "b"])

    a, b, at = np.empty(size, "<i8"), np.zeros(size + spare, kind), 0
    if size:
        for r in rows.coalesce(8).mapInArrow(run, "a binary, b binary").toLocalIterator():
            end = at + len(r.a) // 8
            a[at:end], b[at:end] = np.frombuffer(r.a, "<i8"), np.frombuffer(r.b, kind)
            at = end
    assert at == size, (at, size)
    return a, b


def tagged(rows: DataFrame) -> DataFrame:
    """A tree's rows as (level in the top byte and key, value)."""
    return rows.select(F.shiftleft(F.col("level").cast("long"), 56).bitwiseOR(F.col("key")).alias("tagged"), "value")


def _frequent(counted: DataFrame, key: str, n: str, most: int) -> tuple[DataFrame, int]:
    """The rows of the largest counts and their number, ``most`` at most: whole counts, from the one on that still fits."""
    least, total, held = None, 0, 0
    for r in counted.groupBy(F.col(n).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).toLocalIterator():
        total += r.k
        if total > most:
            break
        least, held = r.c, total
    return counted.filter(F.col(n) >= (least if least is not None else 1 << 62)).select(key, n), held


def _joined_scores(codes: DataFrame, rows: DataFrame, total: int, depth: int) -> DataFrame:
    """gram, p of distinct ``codes`` by joins with the tree, where it is too large for arrays."""
    out = codes.withColumn("p", F.lit(0.0)).withColumn("open", F.lit(True))
    for level in range(depth, -1, -1):
        here = rows.filter(F.col("level") == level).select(F.col("key").alias("at"), "value")
        out = out.withColumn("at", F.col("gram").bitwiseAND(_mask(level))).join(here, "at", "left")
        out = out.withColumn("found", F.col("open") & F.col("value").isNotNull()).withColumn("p", F.col("p") + F.when(F.col("found"), F.col("value")).otherwise(0.0)).withColumn("open", F.col("open") & ~F.col("found")).drop("value", "found", "at")
        if level:
            here = rows.filter(F.col("level") == 64 + level).select(F.col("key").alias("at"), "value")
            out = out.withColumn("at", F.shiftright(F.col("gram").bitwiseAND(_mask(level)), 8)).join(here, "at", "left").withColumn("p", F.col("p") + F.when(F.col("open"), F.coalesce("value", F.lit(0.0))).otherwise(0.0)).drop("value", "at")
    return out.select("gram", (F.col("p") + F.when(F.col("open"), F.lit(-float(np.log10(total + 256)))).otherwise(0.0)).alias("p"))


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, divergence: float = DIVERGENCE, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS) -> DataFrame:
    """Learns from the rows of ``docs`` (doc_id, text) that aren't ``held_out`` and scores all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts are the
    end alone. Repeated rows count each; other columns are ignored. With nothing to learn from, every byte is
    equally likely; an empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    counted = written(counts(narrow.filter(~F.col("held_out")), depth), "counts")
    words = counted.filter("kind = 1").select(F.col("key").alias("word"), F.col("n").alias("c"))
    sums = {r.kind: (r.n, r.k) for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}  # three rows
    (total, _), (n_words, kinds), (n_texts, _) = (sums.get(k, (0, 0)) for k in range(3))
    train_tokens, distinct = n_words + n_texts, kinds + (n_texts > 0)
    below = float(train_tokens + 1 * (distinct + 1))
    rows = tree(counted.filter("kind = 0"), depth, divergence)
    size = rows.count()
    common, held = _frequent(words, "word", "c", most_words)
    frequent = _packed(common, "<i8", held)  # most_words rows at most
    whole = size <= most_rows
    if whole:
        known_p = _packed(tagged(rows), "<f8", size, 1)  # most_rows rows at most
    else:
        grams_, held = _frequent(counted.filter("kind = 0"), "key", "n", most_words)
        known_p = _packed(_joined_scores(grams_.select(F.col("key").alias("gram")), rows, total, depth), "<f8", held)  # most_words rows at most
    shared = spark.sparkContext.broadcast((frequent[0].view(np.uint64), frequent[1], *known_p))
    name = uuid.uuid4().hex
    del frequent, known_p
    tidy()  # the driver's Python outlives this query too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, c, *known_p = shared.value
        lookup = X.Lookup(word)
        model = Tree.of(name, *known_p, total, depth) if whole else None
        grams_known = None if whole else X.Lookup(known_p[0].view(np.uint64))
        known_log = np.log10((c + 1) / below)
        end_log = np.log10((n_texts + 1) / below)
        for batch, data, at in X.pieces(batches):
            w = X.words(data, at)
            n, h = batch.num_rows, w.hashes()
            place = lookup.find(h)
            hit = place >= 0
            base = np.bincount(w.row[hit], known_log[place[hit]], n) + end_log
            n_known = np.bincount(w.row[hit], minlength=n) + int(n_texts > 0)
            symbols, begin, own = stream(w, depth)
            code = grams(symbols, own, depth)
            length = np.diff(np.append(begin, len(symbols))) - depth
            text = np.repeat(np.arange(n), length)
            if whole:
                p, left = model.score(code), pa.nulls(n, _PAIR["gram"])
            else:
                place = grams_known.find(code)
                there = place >= 0
                p = np.where(there, known_p[1][place], 0.0) if len(known_p[1]) else np.zeros(len(code))
                left = _pairs("gram", text[~there], code[~there], n)
            value = pa.array(np.bincount(text, p, n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(w.per_row + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), value, _pairs("word", w.row[~hit], h[~hit], n), left], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "grams"])

    done = written(narrow.mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(words, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(below))).alias("more_base"))
    out = done.drop("rare", "grams").join(rare, "row", "left")
    if not whole:
        every = done.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.n")
        p = written(_joined_scores(every.select("gram").distinct(), rows, total, depth), "gram-scores")
        more = every.join(p, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("p")).alias("more_score"))
        out = out.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    known, base = F.col("n_known") + F.coalesce("more_known", F.lit(0)), F.col("base") + F.coalesce("more_base", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
