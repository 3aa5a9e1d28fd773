"""Operators on headers that no plain reference resolves: dots, spaces, back-ticks, names that differ in case."""

import pytest
from pyspark.sql import functions as F

from tablecare.operators import explore as X
from tablecare.operators import recommend as R
from tablecare.operators.clean import null_missing_tokens, safe_clean, trim_text
from tablecare.operators.model import hash_split, ridge_fit, standardize, train_baseline
from tablecare.operators.profile import drop_duplicate_rows, duplicate_rows, load_overview, profile
from tablecare.sources.files import flatten_text, load_summary, preview, read_csv

PLAIN = ["num", "other", "cat", "when", "more"]
ODD = ["Rev. (USD)", "rev. (usd)", "a`b", "a b.c", "A B.c"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(float(i % 17), float(i * i % 23) if i % 5 else None, ["x", " y ", "N/A", None][i % 4], f"2024-01-{i % 28 + 1:02d}", i % 3) for i in range(120)]
    plain = spark.createDataFrame(rows + rows[:7], "num double, other double, cat string, when string, more long")
    return plain, plain.toDF(*ODD)


def back(values):
    names = dict(zip(ODD, PLAIN))
    return [tuple(names.get(x, x) for x in r) for r in values]


def rows(df):
    return sorted(back(df.collect()), key=str)


@pytest.mark.parametrize("op", [
    X.missing_by_column, X.missing_summary, X.correlation_matrix, X.box_stats, duplicate_rows, load_overview, trim_text, null_missing_tokens,
    drop_duplicate_rows, flatten_text, preview,
    lambda d: X.histogram(d, d.columns[0]), lambda d: X.distribution_stats(d, d.columns[1]), lambda d: X.category_frequency(d, d.columns[2]),
    lambda d: X.scatter_stats(d, *d.columns[:2]), lambda d: X.time_trend(d, d.columns[3], d.columns[0]),
    lambda d: X.time_trend_buckets(d, d.columns[3], d.columns[0]), lambda d: X.grouped_agg(d, d.columns[2], d.columns[0]),
    lambda d: X.grouped_agg(d, d.columns[2], d.columns[1], "median"), lambda d: X.unordered_dedup(d, d.columns[:2], d.columns[3:]),
    lambda d: hash_split(d, d.columns[:2]), lambda d: standardize(d, d.columns[:2]), lambda d: R.winsorize(d, 0.1, 0.9)[0],
    lambda d: R.group_rare(d, 0.3)[0], lambda d: R.quality_diff(d, drop_duplicate_rows(d)),
    lambda d: R.mode_impute(R.median_impute(d, profile(d))[0], profile(d))[0]], ids=str)
def test_same_result_as_on_plain_names(tables, op):
    plain, odd = tables
    a, b = op(plain), op(odd)
    assert rows(a) == rows(b)
    assert back([b.columns]) == [tuple(a.columns)]


def test_profile(tables):
    a, b = (profile(t, "t") for t in tables)
    assert back([(c["name"], c["unique_count"], c["mean"], c["outlier_pct"], str(c["top_values"])) for c in b.columns]) == \
        [(c["name"], c["unique_count"], c["mean"], c["outlier_pct"], str(c["top_values"])) for c in a.columns]


def test_safe_clean_and_models(tables):
    plain, odd = tables
    assert safe_clean(odd).df.count() == safe_clean(plain).df.count()
    assert load_summary(odd).first()["columns"] == ODD
    fits = []
    for t in tables:
        n = t.columns
        m = train_baseline(t, n[0], profile(t), [n[4], n[3], n[0]], task_type="regression", max_iter=20)
        fits.append(sorted((round(r["coefficient"], 9), r["rank"]) for r in m.importance.collect()))
    assert fits[0] == fits[1]
    assert ridge_fit(odd, [ODD[0]], ODD[4]) == ridge_fit(plain, ["num"], "more")


def test_csv_header_with_a_dot(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Rev. (USD),b\n1, x \n2,y\n")
    df = read_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["Rev. (USD)", "b"] and df.select(F.sum(F.col("`Rev. (USD)`").cast("int"))).first()[0] == 3
    assert {c["name"]: c["unique_count"] for c in profile(df).columns} == {"Rev. (USD)": 2, "b": 2}
