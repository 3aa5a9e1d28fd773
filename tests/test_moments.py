"""Pair moments in tiles: as one computation over all rows, gaps and far values included."""

import numpy as np

from tablecare.operators import moments


def table(spark, x, parts):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(parts)


def test_many_columns_in_tiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 11)) * 10.0 ** rng.integers(-6, 9, 11) + 1e6
    x[rng.random(x.shape) < 0.2 * (np.arange(11) % 3 == 0)] = np.nan
    x[:, 10] = np.nan
    got = {(r["i"], r["j"]): r for r in moments.pair_moments(table(spark, x, 7), tile=4, group=3).collect()}
    assert len(got) == 55
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        assert r["n"] == both.sum() and (r["lox"], r["hix"], r["loy"], r["hiy"]) == (a.min(), a.max(), b.min(), b.max())
        want = (((a - a.mean()) ** 2).sum(), ((b - b.mean()) ** 2).sum(), ((a - a.mean()) * (b - b.mean())).sum())
        assert np.allclose((r["sxx"], r["syy"], r["sxy"]), want, rtol=1e-6, atol=1e-6 * np.sqrt(want[0] * want[1]))


def test_complete_tiles_are_sent_small():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 64))
    full = moments.block_moments(x)
    assert len(moments.pack(full)) < 10 * 64 * 64 and all(np.array_equal(full[c], moments.unpack(moments.pack(full))[c]) for c in moments.PAIR)
    x[3, 5] = np.nan
    gap = moments.block_moments(x)
    assert all(np.array_equal(gap[c], moments.unpack(moments.pack(gap))[c]) for c in moments.PAIR)
    a, b = moments.block_moments(x[:40]), moments.block_moments(x[40:])
    both = moments.merge(a, b)
    assert all(np.allclose(both[c], gap[c]) for c in moments.PAIR)
