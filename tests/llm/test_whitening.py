import math
import random
from fractions import Fraction

import numpy as np
import pytest

from logsift.llm import whitening
from logsift.llm.registry import op12_whitening

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whole(c):
    return math.floor(1024 * c) + 100_000


def brute(rows, top=8):
    """(vec_id, component) -> n, deviation, |whitened|, explained, with the covariance in fractions."""
    kept = [(i, [whole(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, size = len(kept), len(kept[0][1]) if kept else 0
    sums = [sum(x[d] for _, x in kept) for d in range(size)]
    cov = [[sum(Fraction(n * x[a] - sums[a], n) * Fraction(n * x[b] - sums[b], n) for _, x in kept) / n for b in range(size)] for a in range(size)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    trace = sum(values)
    out = []
    for i, x in kept:
        deviation = sum((n * x[d] - sums[d]) ** 2 for d in range(size))
        offset = np.array([float(Fraction(n * x[d] - sums[d], n)) for d in range(size)])
        for k in range(min(top, size)):
            e = values[-1 - k]
            out.append((i, k + 1, n, deviation, abs(offset @ vectors[:, -1 - k] / math.sqrt(e)), e / trace))
    return sorted(out, key=repr)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], f"vec_id long, embedding array<{kind}>, n int, whitened string")
    found = whitening.whiten(df, **options)
    assert found.columns == NAMES
    return sorted((tuple(r) for r in found.collect()), key=repr)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert abs(g[4]) == pytest.approx(w[4], rel=1e-7, abs=1e-7) and g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] < 1e-9


def test_against_fractions(spark):
    draw = np.random.default_rng(1)
    base = (draw.normal(size=(60, 12)) * np.arange(1, 13)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (100, None), (101, [None] * 12), (102, [math.nan] * 12), (103, [math.inf] + [0.0] * 11)]
    same(run(spark, rows), brute(rows))
    same(run(spark, rows, top=3), brute(rows, 3))
    few = [(i, v[:4]) for i, v in rows[:60]]
    same(run(spark, few), brute(few))


def test_signs_are_one_choice(spark):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 5), draw.gauss(0, 1), draw.gauss(0, 0.1)]) for i in range(40)]
    got = {(r[0], r[1]): r[4] for r in run(spark, rows)}
    for k in (1, 2, 3):
        assert abs(sum(got[i, k] for i in range(40))) < 1e-9
        assert sum(got[i, k] ** 2 for i in range(40)) / 40 == pytest.approx(1)


def test_large_entries_stay_exact(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([1.0, -1.0]) * 2.0 ** draw.randint(20, 48), draw.uniform(-1, 1) * 2.0**46, draw.random() * 2.0**44]) for i in range(30)]
    got, want = run(spark, rows, "double"), brute(rows)
    for g, w in zip(got, want, strict=True):
        assert g[3] == (w[3] if w[3] < 2**63 else None)
        assert abs(g[4]) == pytest.approx(w[4], rel=1e-6, abs=1e-6) and g[5] == pytest.approx(w[5], rel=1e-6)
    spread = [(i, [1e300 * (-1) ** i, draw.random()]) for i in range(4)]
    assert len(run(spark, spread, "double")) in (4, 8)


def test_degenerate_lists(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    assert run(spark, [(1, [0.5, 0.25])]) == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    got = run(spark, line)
    assert [r[4] is None for r in got] == [False, True, True] * 5 and all(r[6] < 1e-9 for r in got)
    assert got[0][5] == pytest.approx(1)


def test_lists_by_length(spark):
    draw = random.Random(4)
    two = [(i, [draw.random() * 9, draw.random()]) for i in range(20)]
    three = [(100 + i, [draw.random() * 9, draw.random() * 3, draw.random()]) for i in range(20)]
    got = run(spark, two + three)
    same([r for r in got if r[0] < 100], brute(two))
    same([r for r in got if r[0] >= 100], brute(three))


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").limit(60).collect()
    same(run(spark, [(r[0], r[1]) for r in rows]), brute([(r[0], r[1]) for r in rows]))
    found = op12_whitening(spark, "/root/testdata/sf0.01")
    assert found.columns == NAMES and found.count() == 8 * 500
