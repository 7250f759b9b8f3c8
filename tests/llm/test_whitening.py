import math

import numpy as np
import pytest

from readaloud.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>, x string, n string, dim string"


def brute(rows):
    """Integer vectors, exact deviations and a dense eigendecomposition."""
    fine = [(i, [math.floor(64 * float(np.float32(c))) + 10 ** 6 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in fine]
    return fine, n, sums, values[::-1], vectors[:, ::-1], deviation


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def shaped(n, d, seed=3, ratio=0.9):
    rng = np.random.default_rng(seed)
    mix = np.linalg.qr(rng.standard_normal((d, d)))[0] * (ratio ** np.arange(d))
    return (rng.standard_normal((n, d)) @ mix.T * 3 + rng.standard_normal(d)).astype(np.float32).tolist()


@pytest.mark.parametrize("d,ratio", [(64, 0.9), (64, 0.995), (5, 0.7), (32, 0.9)])
def test_equals_dense_eigenvectors(spark, d, ratio):
    vectors = shaped(700, d, ratio=ratio)
    rows = [*enumerate(vectors), *((900 + i, vectors[7]) for i in range(300)), (7, vectors[7]), (None, vectors[9]),
            (1, None), (2, []), (3, [None] + vectors[0][1:]), (4, [float("nan")] + vectors[0][1:]), (5, [float("-inf")] + vectors[0][1:]), (6, [1.0])]
    fine, n, sums, values, axes, deviation = brute([r for r in rows if r[0] != 6 or len(r[1]) > 1])
    got = whiten(table(spark, rows)).collect()
    k = min(16, d)
    assert len(got) == len(fine) * k and {r.component for r in got} == set(range(1, k + 1))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert sorted((r.vec_id is None, r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(
        (i is None, i, v) for (i, _), v in zip(fine, deviation))
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for (i, x), v in zip(fine, deviation):
        centred = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        for c in range(k):
            row = by_row[i, v][c + 1][0]
            want = centred @ axes[:, c] / math.sqrt(values[c])
            sign = signs.setdefault(c, 1 if row.whitened * want > 0 else -1)
            assert abs(row.whitened - sign * want) < 1e-8 * max(1, abs(want))
            assert abs(row.explained - values[c] / values.sum()) < 1e-10


def test_lower_rank_gives_fewer_components(spark):
    rng = np.random.default_rng(1)
    flat = (rng.integers(-50, 50, (200, 3)) @ rng.integers(-3, 4, (3, 40)) / 64).astype(np.float32).tolist()
    got = whiten(table(spark, list(enumerate(flat)))).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0])]])
def test_without_variance_there_is_nothing(spark, rows):
    assert whiten(table(spark, rows)).collect() == []


def test_huge_entries(spark):
    """Beyond the bound entries count as the bound; a deviation beyond a long is null."""
    rows = [(i, [float(i), -float(i % 7)]) for i in range(50)] + [(99, [3e38, -3e38])]
    got = whiten(table(spark, rows)).collect()
    # beside such an entry the others' variance is rounding: one component
    assert len(got) == 51 and {(r.component, r.deviation) for r in got} == {(1, None)}
