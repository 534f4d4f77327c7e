import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import whitening


def ask(spark, rows, k=16):
    frame = spark.createDataFrame(
        [(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<float>, n double, data string"
    )
    return whitening.whiten(frame.select("vec_id", whitening.integers("embedding", 64, 1_000_000).alias("x")), k)


def usable(rows):
    return [
        (i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v])
        for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]


def check(found, rows, k=16):
    given = usable(rows)
    fit = np.array(sorted({tuple(x) for _, x in given}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(Fraction(int(c) * n - int(s), n)) for c, s in zip(x, sums)] for x in fit])
    variance, axes = np.linalg.eigh(centred.T @ centred / n)
    variance, axes = variance[::-1], axes[:, ::-1]
    rank = min(k, int((variance > variance[0] * 1e-12).sum()))
    got = {}
    for r in found.collect():
        got.setdefault(r.component, []).append(r)
    assert sorted(got) == list(range(1, rank + 1))
    gaps = np.abs(np.subtract.outer(variance, variance)) + np.eye(len(variance)) * variance[0]
    for c, own in got.items():
        assert len(own) == len(given)
        e = variance[c - 1]
        exact = {i: (sum((n * v - s) ** 2 for v, s in zip(x, sums)), x) for i, x in given}
        for r in own:
            assert r.n == n and r.identity_error < 1e-10
            assert r.deviation == exact[r.vec_id][0]
            assert r.explained == pytest.approx(e / variance.sum(), rel=1e-10)
        if gaps[c - 1].min() > 1e-6 * variance[0]:
            x = np.array([exact[r.vec_id][1] for r in own], dtype=float)
            want = (x - np.array([float(Fraction(int(s), n)) for s in sums])) @ axes[:, c - 1] / math.sqrt(e)
            values = np.array([r.whitened for r in own])
            sign = 1 if values @ want > 0 else -1
            assert np.abs(sign * values - want).max() < 1e-6


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    spread = rng.normal(size=(300, 20)) * np.linspace(0.1, 3, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(spread @ np.linalg.qr(rng.normal(size=(20, 20)))[0])]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(2000, None), (2001, [None] + [0.0] * 19)]
    rows += [(2002, [float("nan")] * 20), (2003, [float("-inf")] + [1.0] * 19), (2004, [])]
    check(ask(spark, rows), rows)


def test_no_spread_in_some_dimensions_and_few_rows(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [*v, 1.0, 1.0, 2 * v[0]]) for i, v in enumerate((rng.integers(-9, 9, (40, 3)) / 4).tolist())]
    check(ask(spark, flat), flat)
    few = [(i, v) for i, v in enumerate(rng.normal(size=(5, 12)).tolist())]
    check(ask(spark, few), few)


def test_equal_variances(spark):
    """A cross: every direction has the same variance, which one start alone cannot show."""
    rows = [(i, v) for i, v in enumerate([*np.eye(6).tolist(), *(-np.eye(6)).tolist()])]
    found = ask(spark, rows, 4).collect()
    assert {r.component for r in found} == {1, 2, 3, 4}
    assert all(r.identity_error < 1e-10 and r.explained == pytest.approx(1 / 6, rel=1e-2) for r in found)


def test_none_and_one(spark):
    assert ask(spark, []).collect() == []
    assert ask(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect() == []
    other = [(1, [1.0, 2.0]), (2, [3.0, 0.5]), (3, [1.0])]
    assert {r.vec_id for r in ask(spark, other).collect()} == {1, 2}


def test_repeated_and_nameless_rows_come_back(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 0.0]), (3, [5.0, 5.0])]
    found = ask(spark, rows)
    assert sorted((r.vec_id or 0, r.component) for r in found.collect()) == [
        (0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2),
    ]


def test_large_values_keep_their_digits(spark):
    rows = [(i, [v, 1e9 + v]) for i, v in enumerate([0.0, 1.0, 2.0, 5.0])]
    large = spark.createDataFrame([(i, [int(64 * c) for c in v]) for i, v in rows], "vec_id long, x array<long>")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(large, 1).collect()}
    values = [found[i, 1].whitened for i in range(4)]
    assert np.std(values) == pytest.approx(1, abs=1e-12)
    huge = large.withColumn("x", F.transform("x", lambda v: v * 2**27))
    deviations = {r.vec_id: r.deviation for r in whitening.whiten(huge, 1).collect()}
    assert deviations == {0: None, 1: None, 2: 0, 3: None}
