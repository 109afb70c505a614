"""Whitening against exact sums and an eigendecomposition of the integer covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from shelfcast.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, whitened string"


def run(spark, vectors, **options):
    rows = [(i, v, 1, "clash", "clash", "clash") for i, v in vectors]
    return whitening.whitened_components(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()


def brute(vectors, components=16):
    """Per usable row: id, deviation and whitened values up to sign; and the shares of variance."""
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in usable)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)) for _, v in usable]
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in distinct])
    _, values, axes = np.linalg.svd(centred)
    e = np.concatenate([values, np.zeros(dim)])[:dim] ** 2 / n
    k = min(components, int((e > e[0] * 1e-24).sum()))
    out = {}
    for (i, _), row in zip(usable, x):
        own = np.array([float(Fraction(n * c - s, n)) for c, s in zip(row, sums)])
        out[i] = (sum((n * c - s) ** 2 for c, s in zip(row, sums)), axes[:k] @ own / np.sqrt(e[:k]))
    return n, out, e[:k] / e.sum()


def check(got, vectors, tolerance=1e-6):
    n, expected, shares = brute(vectors)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == set(expected)
    signs = None
    for i, (deviation, values) in expected.items():
        rows = sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, len(shares) + 1))
        assert {(r.n, r.deviation) for r in rows} == {(n, deviation if deviation < 2**63 else None)}
        assert [r.explained for r in rows] == pytest.approx(list(shares), rel=1e-6)
        assert all(r.identity_error <= 1e-6 for r in rows)
        ours = np.array([r.whitened for r in rows])
        assert np.abs(ours) == pytest.approx(np.abs(values), abs=tolerance)
        large = np.abs(values) > 1e-3
        signs = np.zeros(len(shares)) if signs is None else signs
        now = np.sign(ours * values) * large
        assert not (signs * now < 0).any()
        signs = np.where(signs == 0, now, signs)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    spread = rng.normal(0, 1, (300, 24)) * np.linspace(8, 0.5, 24) @ np.linalg.qr(rng.normal(0, 1, (24, 24)))[0]
    vectors = list(enumerate(spread.astype(np.float32).tolist()))
    vectors += [(1000 + i, vectors[7][1]) for i in range(150)]  # a third are copies
    vectors += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, [1.0, 2.0])]
    check(run(spark, vectors), vectors)


def test_ill_conditioned_and_deficient_rows(spark):
    """Dimensions that differ by nine orders of size, two that repeat another and one that is constant."""
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (200, 6)) * np.array([1e9, 1e6, 1e3, 30, 4, 1])
    whole = np.floor(base)
    wide = np.column_stack([whole, whole[:, 3], -whole[:, 5], np.full(200, 5.0)])
    vectors = list(enumerate((wide.astype(np.float32)).tolist()))
    got = run(spark, vectors)
    assert len({r.component for r in got}) == 8 - 2
    check(got, vectors, 1e-5)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector has no variance
    two = run(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])])
    assert sorted((r.vec_id or 0, r.component, r.n, abs(round(r.whitened, 9)), r.explained) for r in two) == [
        (0, 1, 2, 1.0, 1.0), (1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]
    huge = run(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])
    assert {r.deviation for r in huge} == {None} and all(math.isfinite(r.whitened) for r in huge)


def test_triangular_solves():
    rng = np.random.default_rng(1)
    factors = [np.triu(rng.normal(0, 1, (9, 9))) + 9 * np.eye(9) for _ in range(2)]
    rows = rng.normal(0, 1, (20, 9))
    assert np.allclose(whitening.solved(rows, factors) @ factors[1] @ factors[0], rows)
