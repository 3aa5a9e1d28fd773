"""Frequent values: the same as counting everything, whatever proof is needed."""

import random
from collections import Counter

import pytest

from tablecare.operators import heavy
from tablecare.operators.recommend import column_modes, frequent_values

SHAPES = {
    "few": lambda rng, i: f"v{rng.randint(0, 4)}",
    "skewed": lambda rng, i: f"hot{rng.randint(0, 2)}" if rng.random() < 0.6 else f"cold{i}",
    "flat": lambda rng, i: f"u{rng.randint(0, 400)}",          # no proof: counts are nearly alike
    "unique": lambda rng, i: f"id{i}",
    "gaps": lambda rng, i: None if i % 3 else "x",
    "nothing": lambda rng, i: None,
}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [tuple(f(rng, i) for f in SHAPES.values()) for i in range(4000)]
    names = [n + "." for n in SHAPES]
    return spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(names)))).toDF(*names).repartition(5), rows


@pytest.mark.parametrize("tracked", [8, 64, 1024])
@pytest.mark.parametrize("n", [1, 5])
def test_top_values(table, tracked, n):
    df, rows = table
    got = {(r["name"], r["rank"]): (r["value"], r["n"]) for r in heavy.frequent(df, df.columns, tracked).top(n).collect()}
    want = {}
    for k, name in enumerate(df.columns):
        counts = Counter(r[k] for r in rows if r[k] is not None)
        want |= {(name, i): vn for i, vn in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}
    assert got == want


def test_values_over_a_share_and_modes(table):
    df, rows = table
    kept = frequent_values(df, df.columns, 0.01)
    for k, name in enumerate(df.columns):
        counts = Counter(r[k] for r in rows if r[k] is not None)
        keep = sorted(v for v, c in counts.items() if c >= 0.01 * counts.total())
        assert kept[name] == (keep, len(keep) < len(counts))
    modes = column_modes(df, df.columns)
    assert modes == {name: min(c, key=lambda v: (-c[v], v)) for k, name in enumerate(df.columns)
                     if (c := Counter(r[k] for r in rows if r[k] is not None))}


def test_summaries_bound_every_count():
    import pyarrow as pa
    rng = random.Random(4)
    values = [f"v{int(rng.paretovariate(0.5)) % 5000}" for _ in range(20_000)]
    s = heavy.MisraGries(50)
    for i in range(0, len(values), 700):
        s.add(pa.array(values[i:i + 700]))
    s.shrink()
    counts = Counter(values)
    assert len(s.counts) <= 50 and s.lost > 0
    assert all(s.counts[v] <= c <= s.counts[v] + s.lost for v, c in counts.items())


def test_only_tracked_values_are_shuffled(table):
    df, _ = table
    f = heavy.frequent(df, ["unique."], 16)
    assert f.counters.count() <= 16 * 5 and f.lost[0] > 0
