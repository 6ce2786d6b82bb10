import numpy as np
import pytest

from folio.llm import embed_dedup as D


def brute(x, ids, ok, cosine=0.9):
    u = np.where(ok[:, None], x, 1)
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    g = (u @ u.T >= cosine) & ok[:, None] & ok[None, :]
    np.fill_diagonal(g, False)
    low = ids.copy()
    while True:
        new = np.array([min([low[i], *low[g[i]]]) for i in range(len(ids))])
        if (new == low).all():
            return g.sum(axis=1), low
        low = new


def test_hadamard_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 64)).astype(np.float32)
    y = D.rotate(x, D.rotations(64, 1)[0])
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-3)


@pytest.mark.parametrize(("dim", "width"), [(2, 1), (24, 2), (64, 1), (64, 2), (64, 3), (64, 4), (64, 5), (384, 2), (384, 3), (384, 4), (768, 3), (768, 4), (1024, 4), (1536, 2)])
def test_pairs_at_the_limit_meet(dim, width):
    n = 150 if dim > 64 else 1000
    x, y = D.pairs_at(dim, 0.9, n, seed=dim + width)
    assert np.allclose((x * y).sum(axis=1), 0.9)
    tables = D.tables_for(dim, width, 0.9)
    met = D.meet(D.codes(x, width, tables), D.codes(y, width, tables)).any(axis=1)
    assert met.mean() >= 0.97


def test_widths_of_large_collections_are_tested():
    """A hundred thousand million vectors of 64 dimensions need a width of 6, of 384 or more one of 4."""
    for dim, widest in ((64, 6), (384, 4), (768, 4), (1024, 4)):
        assert np.ceil(np.log(D.SPARSE * 1e11) / np.log(2 * dim)) <= widest <= D.WIDEST


@pytest.mark.parametrize(("block", "width"), [(1000, 2), (1000, 3), (7, 2)])
def test_against_brute_force(spark, monkeypatch, block, width):
    monkeypatch.setattr(D, "BLOCK", block)
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 24))
    x = np.concatenate([base[r.integers(0, 40, 300)] + r.normal(size=(300, 24)) * r.choice([0.05, 0.2, 0.35], (300, 1)), base[:5], base[:5], 3 * base[:3]])
    ids = r.permutation(1000)[: len(x)].astype(np.int64)
    rows = [(int(i), [float(v) for v in vec], 0, "c") for i, vec in zip(ids, x, strict=True)]
    odd = [(2000, None, 0, ""), (2001, [0.0] * 24, 0, ""), (2002, [None] + [1.0] * 23, 0, ""), (2003, [float("nan")] * 24, 0, ""), (2004, [], 0, ""), (2005, [1.0, 2.0], 0, ""), (2006, [1.0, 2.1], 0, "")]
    df = spark.createDataFrame([*rows, *odd, (None, [1.0, 2.0], 0, "")], "vec_id long, embedding array<double>, n int, class string").repartition(3)
    got = {v.vec_id: v for v in D.near_duplicates(df, width=width).collect()}
    n, low = brute(x, ids, np.ones(len(x), bool))
    assert len(got) == len(x) + len(odd) + 1
    missed = sum(int(abs(got[i].n_links - k)) for i, k in zip(ids.tolist(), n.tolist(), strict=True))
    assert missed <= 0.01 * n.sum() and all(got[i].n_links <= k for i, k in zip(ids.tolist(), n.tolist(), strict=True))
    assert np.mean([got[i].component_id == c for i, c in zip(ids.tolist(), low.tolist(), strict=True)]) > 0.98
    assert [got[i].n_links for i in range(2000, 2007)] == [0] * 5 + [1, 1] and got[2006].component_id == 2005
    assert got[None].n_links == 0 and got[None].kept


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(v.vec_id, v.n_links, v.component_id) for v in D.near_duplicates(df).orderBy("vec_id").collect()] == [(1, 2, 1), (1, 2, 1), (4, 2, 1)]
    assert D.near_duplicates(df.filter("false")).count() == 0
