"""Whitening against exact rational arithmetic and plain numpy, and its edge cases."""

import math
from fractions import Fraction

import numpy as np

from panelspark.llm import queries, whitening


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, vector string")


def by_hand(rows, components):
    """Covariance in fractions, then eigh; rows by position."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    d = [[n * r[j] - s[j] for j in range(dims)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    w = np.array([[float(Fraction(v, n)) for v in r] for r in d]) @ vectors / np.sqrt(values)
    return n, [sum(v * v for v in r) for r in d], w, values / np.trace(cov), cov


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 3)]
    rows += [rows[0], (None, rows[1][1])]  # repeated rows and null ids take part
    out = [(900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, []), (906, [1e300] + [0.0] * 5)]
    n, deviation, w, share, cov = by_hand(rows, 4)
    got = whitening.whiten(frame(spark, rows + out), components=4).collect()
    assert len(got) == len(rows) and {r.n for r in got} == {n}
    key = lambda r: (r[0] is None, r[0] or 0)
    got, want = sorted(got, key=key), sorted(range(len(rows)), key=lambda i: key(rows[i]))
    assert [int(r.deviation) for r in got] == [deviation[i] for i in want]
    mine, plain = np.array([r.whitened for r in got]), w[want]
    signs = np.sign((mine * plain).sum(0))
    assert np.allclose(mine * signs, plain, rtol=0, atol=1e-9) and np.allclose(got[0].explained, share, rtol=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(4)).max() < 1e-10


def test_scatter_is_exact_for_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 3)) * 1e12)] + [(99, [2.0**55, -(2.0**55), 3.0])]
    taken, dims = whitening.vectors(frame(spark, rows), "vec_id", "embedding", 64.0)
    fit = whitening.measure(taken, dims, 64.0, 1_000_000)
    got = {r.i: list(map(int, r.entries)) for r in whitening.scatter(taken, fit, 64.0, 1_000_000).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(r[j] for r in x) for j in range(3)]
    d = [[len(x) * r[j] - s[j] for j in range(3)] for r in x]
    assert got == {i: [sum(r[i] * r[j] for r in d) for j in range(3)] for i in range(3)}
    most = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame(spark, rows[:50] + [(99, [2.0**30, 1.0, 3.0])])).collect()}
    assert len(most) == 51 and min(most.values()) > 0
    assert [r.vec_id for r in whitening.whiten(frame(spark, rows)).collect() if r.deviation is None] == [99]  # beyond 38 digits


def test_degenerate_vectors(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(int(r.deviation), r.whitened, r.identity_error) for r in one] == [(0, [], 0.0)] * 2
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()  # one direction alone varies
    assert {len(r.whitened) for r in line} == {1} and line[0].identity_error < 1e-12


def test_primes_hold_the_product():
    for product in (1, 2**21, 2**200):
        got = whitening.primes(product)
        assert math.prod(got) > product and len(set(got)) == len(got)
        assert all(p % k for p in got for k in range(2, 1449)) and max(got) < 2**21


def test_op11_on_its_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, deviation, w, share, _ = by_hand(rows, 32)
    got = queries.op11_whitening(spark, sf).collect()
    assert len(got) == n * 32
    at = {v: i for i, (v, _) in enumerate(rows)}
    mine = np.zeros_like(w)
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]]) and abs(r.explained - share[r.component - 1]) < 1e-10
        mine[at[r.vec_id], r.component - 1] = r.whitened
    assert np.allclose(mine * np.sign((mine * w).sum(0)), w, atol=1e-6) and got[0].identity_error < 1e-9
