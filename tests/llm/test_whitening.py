import math
import random

import numpy as np
import pytest

from tallylog.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", None) for i, v in rows], SCHEMA)


def vectors(seed, n, dims, size=1.0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * size
    return [(i, v.tolist()) for i, v in enumerate(mixed)]


def expected(rows):
    """n, deviations by place, covariance (exact sums, then doubles)."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    far = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    y = [[n * a - s for a, s in zip(v, sums)] for v in x]
    cov = [[sum(v[i] * v[j] for v in y) / n**3 for j in range(len(sums))] for i in range(len(sums))]
    return n, far, np.array(cov), np.array(y, dtype=object)


def check(rows, found, tolerance=1e-9):
    n, far, cov, y = expected(rows)
    values, vecs = np.linalg.eigh(cov)
    k = min(8, len(cov))
    assert len(found) == n * k
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        e, u = values[-c], vecs[:, -c]
        own = by_component[c]
        assert sorted(r.deviation_digits for r in own) == sorted(map(str, far))
        assert {r.deviation for r in own} == {f if f < 2**63 else None for f in far}
        wanted = (y.astype(float) / n) @ u / math.sqrt(e)
        of = {}
        for (i, _), w in zip(rows, wanted):
            of.setdefault(i, []).append(w)
        got = {}
        for r in own:
            got.setdefault(r.vec_id, []).append(r.whitened)
        sign = 1 if all(np.allclose(sorted(got[i]), sorted(of[i]), atol=tolerance, rtol=tolerance) for i in of) else -1
        for i in of:
            assert np.allclose(sorted(got[i]), sorted(sign * w for w in of[i]), atol=tolerance, rtol=tolerance)
        assert all(r.n == n and math.isclose(r.explained, e / np.trace(cov), rel_tol=1e-9) for r in own)
        assert {r.identity_error for r in own} == {own[0].identity_error} and own[0].identity_error < 1e-9


@pytest.mark.parametrize("n,dims,size", [(300, 12, 1.0), (150, 3, 0.01), (200, 9, 5e4)])
def test_against_plain_numbers(spark, monkeypatch, n, dims, size):
    monkeypatch.setattr(whitening, "ROWS", 64)
    monkeypatch.setattr(whitening, "SLAB_WORDS", 16)
    rows = vectors(n, n, dims, size)
    rows += rows[:4] + [(None, rows[0][1])]
    random.Random(1).shuffle(rows)
    bad = [(900, None), (901, [1.0] * (dims - 1) + [None]), (902, [1.0] * (dims - 1) + [math.nan])]
    bad += [(903, [math.inf] + [0.0] * (dims - 1)), (904, []), (905, [1.0] * (dims + 1)), (906, [1e15] * dims)]
    found = whitening.whiten(frame(spark, rows + bad).repartition(5)).collect()
    check(rows, found)


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [(-1) ** i * 2.0**33 * (i + 1), float(i * i), 0.5 * i]) for i in range(40)]
    found = whitening.whiten(frame(spark, rows)).collect()
    n, far, _, _ = expected(rows)
    assert {(r.vec_id, r.deviation_digits) for r in found} == {(i, str(f)) for (i, _), f in zip(rows, far)}
    assert {r.deviation for r in found} == {None if f >= 2**63 else f for f in far}


def test_cross_products_are_exact():
    rng = np.random.default_rng(4)
    for bits in (1, 12, 51):
        x = rng.integers(0, 2**bits, (130, 5)).astype(np.uint64)
        counts = np.zeros((2 * bits - 1, 5, 5), np.int64)
        whitening.cross_counts(whitening.bit_planes(x, bits), counts)
        got = [[sum(int(counts[s, i, j]) << s for s in range(2 * bits - 1)) for j in range(5)] for i in range(5)]
        assert got == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(5)] for i in range(5)]


def test_dimensions_without_variance(spark):
    rows = [(i, [float(i), 2.0, -1.0]) for i in range(5)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in found if r.whitened is not None} == {1}
    assert len(found) == 15 and all(r.identity_error < 1e-12 for r in found)
    alone = whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in alone] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]


def test_most_frequent_length_counts(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [3.0, 4.0]), (4, [5.0])]
    assert {r.vec_id for r in whitening.whiten(frame(spark, rows)).collect()} == {1, 3}


def test_empty_table(spark):
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)]).where("vec_id > 1")).collect() == []
    assert whitening.deviations(frame(spark, [(1, None)])).collect() == []
