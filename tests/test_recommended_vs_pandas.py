"""Recommended cleaning (R1-R4) against the same steps done with pandas."""

import random

import pandas as pd
import pytest

from tablecare.operators.recommend import recommended_clean


def _pandas_recommended(pdf: pd.DataFrame) -> pd.DataFrame:
    df = pdf.copy()
    for c in ["x", "y"]:                                  # R1 median imputation (numeric with NaN)
        if df[c].isna().any():
            df[c] = df[c].fillna(df[c].median())
    if df["cat"].isna().any():                          # R2 mode imputation (ties → smallest)
        df["cat"] = df["cat"].fillna(sorted(df["cat"].mode())[0])
    for c in ["x", "y"]:                                  # R3 winsorize 1-99 %
        p1, p99 = df[c].quantile(0.01), df[c].quantile(0.99)
        if ((df[c] < p1) | (df[c] > p99)).sum() > 0:
            df[c] = df[c].clip(lower=p1, upper=p99)
    vc = df["cat"].value_counts(normalize=True)           # R4 rare → Other
    rare = vc[vc < 0.01].index.tolist()
    if rare:
        df["cat"] = df["cat"].replace(rare, "Other")
    return df


def test_recommended_matches_pandas(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.gauss(0, 10), rng.gauss(100, 1)]), float(rng.randint(0, 1000)),
             rng.choice([None] + ["a"] * 30 + ["b"] * 30 + ["c"] * 10 + [f"r{rng.randint(0, 500)}"]))
            for _ in range(1500)]
    pdf = pd.DataFrame(rows, columns=["x", "y", "cat"])
    out, _log, spec = recommended_clean(spark.createDataFrame(rows, "x double, y double, cat string"))
    want = _pandas_recommended(pdf)
    got = out.toPandas()
    key = ["x", "y", "cat"]
    a = got.sort_values(key).reset_index(drop=True)
    b = want.sort_values(key).reset_index(drop=True)
    assert list(a["cat"]) == list(b["cat"])
    for c in ["x", "y"]:
        assert a[c].tolist() == pytest.approx(b[c].tolist(), rel=1e-12, abs=1e-12)
    assert set(spec.clips) == {"x", "y"} and "cat" in spec.frequent
