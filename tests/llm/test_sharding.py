import bisect
import math
import random
from collections import Counter

import numpy as np
import pytest

from folio.llm.sharding import hilbert_index, hilbert_shards


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_and_steps_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    index = hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 10, 24, 1000])
def test_counts_and_slots(spark, n):
    rows = [(i if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", float(i * i % 97), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size double, slots string")
    got = hilbert_shards(df, ["source", "size"], ["doc_id"], 24).collect()
    assert len(got) == n
    per = Counter(r.shard for r in got)
    if n:
        counts = [per.get(s, 0) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    for s, c in per.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(c))


@pytest.mark.parametrize(("n", "shards"), [(7, 24), (500, 24), (999, 10)])
def test_shard_and_slot_against_ranks_in_plain_python(spark, n, shards):
    r = random.Random(n)
    rows = [(i, r.choice([None, "", "en", "https://a/" + "x" * 3000, "https://b", "é"]), r.choice([None, *map(float, range(60))]), i, "p", "r") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, size double, shard long, place string, rank string").repartition(3)
    got = hilbert_shards(df, ["lang", "size"], ["doc_id"], shards, 4).collect()
    assert set(got[0].asDict()) == {"doc_id", "lang", "size", "place", "rank", "hilbert", "shard", "slot"} and all((x.place, x.rank) == ("p", "r") for x in got)

    def edges(values):
        """Exact quantiles: the least value that 1/16, 2/16, ... of all do not exceed."""
        values = sorted(values)
        return sorted({values[-(-k * len(values) // 16) - 1] for k in range(1, 16)}) if values else []

    langs, sizes = [x[1] or "" for x in rows], [x[2] for x in rows]
    by_lang, by_size = edges(langs), edges([v for v in sizes if v is not None])
    cells = [(bisect.bisect_right(by_lang, a), bisect.bisect_right(by_size, -math.inf if b is None else b)) for a, b in zip(langs, sizes, strict=True)]
    curve = hilbert_index(np.array(cells), 4).tolist()
    order = sorted(range(n), key=lambda i: (curve[i], i))
    want = {i: (curve[i], rank * shards // n, rank - -(-(rank * shards // n) * n // shards)) for rank, i in enumerate(order)}
    assert {x.doc_id: (x.hilbert, x.shard, x.slot) for x in got} == want


def test_shards_are_narrow_in_every_dimension(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "cast(hash(id) % 1000 as double) as a", "cast(hash(id, 1) % 1000 as double) as b")
    got = hilbert_shards(df, ["a", "b"], ["doc_id"], 16).groupBy("shard").agg({"a": "max", "b": "max"}).collect()
    lows = hilbert_shards(df, ["a", "b"], ["doc_id"], 16).groupBy("shard").agg({"a": "min", "b": "min"}).collect()
    spans = {r.shard: (r["max(a)"], r["max(b)"]) for r in got}
    assert np.mean([max(spans[r.shard][0] - r["min(a)"], spans[r.shard][1] - r["min(b)"]) for r in lows]) < 1100


def test_strings_with_a_common_beginning_order_the_rows(spark):
    df = spark.range(8000).selectExpr("id as doc_id", "concat('https://host', lpad(cast(pmod(hash(id), 400) as string), 3, '0'), '.org/é') as source", "cast(pmod(hash(id, 1), 1000) as double) as size")
    got = hilbert_shards(df, ["source", "size"], ["doc_id"], 16).selectExpr("shard", "int(substr(source, 13, 3)) as host").groupBy("shard").agg({"host": "stddev"}).collect()
    assert len(got) == 16 and np.mean([r["stddev(host)"] for r in got]) < 60
