"""Column expressions: snake_case, trimming, guards, rounding, quantiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.functions.numeric import rnd, skewness_unbiased
from tablecare.functions.quantiles import approx_quantiles, exact_quantiles
from tablecare.functions.text import edge_trim, guarded_double, parse_datetime, snake_case, snake_case_name
from tablecare.sources.files import repair_header


@pytest.mark.parametrize("name,expected", [
    ("Score (Team1 - Team2)", "score_team1_team2"), ("FullTimeResult", "full_time_result"),
    ("__x--y", "x_y"), ("", "unnamed"), ("éàB c", "éàb_c"), ("Order Total", "order_total")])
def test_snake_case(spark, name, expected):
    assert snake_case_name(name) == expected
    got = spark.createDataFrame([(name,)], "s string").select(snake_case(F.col("s"))).first()[0]
    assert got == expected


def test_edge_trim_unicode(spark):
    vals = ["  x 　", "\t y\n", "z", " w "]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "s string").select(edge_trim(F.col("s"))).collect()]
    assert got == [v.strip() for v in vals]


def test_numeric_guard(spark):
    vals = ["10", " 10 ", "10d", "10f", "1_000", "1,000", "inf", ".5", "-3e2", "abc"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "s string")
           .select(guarded_double(F.col("s"))).collect()]
    assert got == [10.0, 10.0, None, None, None, None, None, 0.5, -300.0, None]


def test_datetime_formats(spark):
    vals = ["2026-01-01", "2026-1-1", "2026-02-30", "01/02/2026", "2026", "2026-01-01 10:11:12"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "s string")
           .select(parse_datetime(F.col("s"))).collect()]
    assert [g is not None for g in got] == [True, False, False, True, False, True]


def test_rounding_is_half_up_on_binary_values(spark):
    got = spark.range(1).select(rnd(F.lit(1.005), 2), rnd(F.lit(2.5), 0), rnd(F.lit(-0.12345), 4)).first()
    assert tuple(got) == (1.0, 3.0, -0.1234)


def test_skewness_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert abs(df.select(skewness_unbiased(F.col("x"))).first()[0] - 1.7636326148) < 1e-9


def _np_quant(vals, q):
    return float(np.quantile(np.array(vals, dtype=float), q))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rnd_ = random.Random(seed)
    n = rnd_.choice([1, 2, 7, 500, 3000])
    a = [rnd_.choice([rnd_.gauss(0, 1), float(rnd_.randint(0, 5)), 1e6 * rnd_.random(), None]) for _ in range(n)]
    hot = [3.0] * (n // 3) + [rnd_.expovariate(0.01) for _ in range(n - n // 3)]
    df = spark.createDataFrame([(x, y) for x, y in zip(a, hot)], "a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    for col, vals in (("a", a), ("b", hot)):
        clean = [v for v in vals if v is not None]
        for p, g in zip(probs, got[col]):
            if not clean:
                assert g is None
            else:
                assert math.isclose(g, _np_quant(clean, p), rel_tol=1e-12, abs_tol=1e-12), (col, p)


def test_quantiles_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert got == {"a": [None], "b": [5.0]}
    assert approx_quantiles(df, ["b"], [0.5]) == {"b": [5.0]}


def test_repair_header():
    assert repair_header(["a", "a", "", " b ", "a_2"]) == ["a", "a_2", "unnamed_3", "b", "a_2_2"]


def test_quantiles_on_infinite_and_wide_columns(spark):
    """More rows than are counted by value; infinities, both ends of the double range, many decades."""
    import numpy as np
    n = 70_000
    df = spark.range(n).selectExpr(
        "CASE WHEN id = 7 THEN double('Infinity') WHEN id = 8 THEN double('-Infinity') ELSE id * 0.5 END AS a",
        "CASE WHEN id = 1 THEN 1.7e308 WHEN id = 2 THEN -1.7e308 ELSE (id % 1000) - 500.0 END AS b",
        "pow(double(2), double(id % 1801 - 900)) * (1 + id) * (CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END) AS c",
        "CASE WHEN id % 2 = 0 THEN 0.0D ELSE 5e-324D * (id % 5) END AS d")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], probs)
    vals = df.toPandas()
    for col in "abcd":
        v = np.sort(vals[col].to_numpy())
        for p, g in zip(probs, got[col]):
            h = p * (n - 1)
            lo, hi = v[int(np.floor(h))], v[int(np.ceil(h))]
            assert g == (lo if lo == hi or h == int(h) else lo + (hi - lo) * (h - int(h))), (col, p)
