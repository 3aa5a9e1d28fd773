"""Edge cases: empty table, all-null, constant, single row, ties, NaN."""

import math

from pyspark.sql import functions as F

from tablecare.operators import explore as X
from tablecare.operators.profile import profile, profile_columns_df
from tablecare.operators.recommend import group_rare, mode_impute, winsorize


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "a double, b string")
    p = profile(df)
    assert p.n_rows == 0 and p.duplicates_count == 0
    assert [c["missing_pct"] for c in p.columns] == [0.0, 0.0]
    rows = profile_columns_df(df, "t").collect()
    assert len(rows) == 2 and all(r["missing_count"] == 0 for r in rows)


def test_all_null_constant_single_row(spark):
    df = spark.createDataFrame([(None, 1.0, "x")], "a double, b double, c string")
    p = profile(df)
    a, b, c = p.columns
    assert a["missing_count"] == 1 and a["min"] is None and a["outlier_pct"] == 0.0
    assert b["is_constant"] and b["std"] is None and b["outlier_pct"] == 0.0
    assert c["top_values"] == [("x", 1)]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "a double")
    p = profile(df)
    assert p.columns[0]["missing_count"] == 1
    assert p.columns[0]["mean"] == 1.5


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    out, modes = mode_impute(df, profile(df))
    assert modes == {"c": "a"}
    assert out.where(F.col("c").isNull()).count() == 0


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaaz"], "c string")
    assert profile(df).columns[0]["top_values"][:3] == [("a", 2), ("b", 2), ("c", 2)]


def test_group_rare_bounded_keep_list(spark):
    vals = ["common"] * 990 + [f"r{i}" for i in range(10)]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    out, grouped = group_rare(df)
    assert grouped == {"c": ["common"]}
    assert {r[0]: r[1] for r in out.groupBy("c").count().collect()} == {"common": 990, "Other": 10}


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    out, clips = winsorize(df)
    lo, hi = clips["x"]
    assert math.isclose(lo, 0.99) and math.isclose(hi, 98.01)
    assert out.where(F.col("x").isNull()).count() == 1
    assert out.agg(F.min("x")).first()[0] == lo


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 2.0), (3.0, 5.0, 3.5)], "a double, b double, c double")
    m = {(r["x"], r["y"]): r["r"] for r in X.correlation_matrix(df).collect()}
    assert m[("a", "b")] is None and m[("b", "b")] is None and m[("a", "a")] == 1.0
    assert m[("a", "c")] == m[("c", "a")] and m[("a", "c")] > 0.99
    assert X.missing_summary(df).first()["cols_with_missing"] == 0


def test_correlation_pairs_with_gaps(spark):
    """Rows where only x is present must not touch the pair; x constant where y is present gives NULL."""
    rows = [(1e8 + i, float(i), 0.1) for i in range(10)] + [(0.0, None, 7.0), (4e12, None, -3.0)]
    df = spark.createDataFrame(rows, "x double, y double, k double").repartition(3)
    m = {(r["x"], r["y"]): r["r"] for r in X.correlation_matrix(df).collect()}
    assert m[("x", "y")] == m[("y", "x")] == 1.0 and m[("k", "y")] is None and m[("k", "k")] == 1.0
    far = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    m = {(r["x"], r["y"]): r["r"] for r in X.correlation_matrix(far).collect()}
    assert m == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}


def test_unordered_dedup_keeps_different_members(spark):
    df = spark.createDataFrame([(1, "a_b", "c"), (2, "a", "b_c"), (3, "a", None), (4, "a", "a"), (5, "c", "a_b"), (6, None, "a")],
                               "id int, p string, q string")
    assert sorted(r["id"] for r in X.unordered_dedup(df, ["p", "q"], ["id"]).collect()) == [1, 2, 3, 4]


def test_dedup_with_maps(spark):
    from tablecare.operators.profile import drop_duplicate_rows, duplicate_rows
    df = spark.sql("SELECT 1 AS a, map('k', 1) AS m UNION ALL SELECT 1, map('k', 1) UNION ALL SELECT 1, map('k', 2)")
    assert drop_duplicate_rows(df).count() == 2 and duplicate_rows(df).first()[0] == 1


def test_long_integers_stay_integers(spark):
    from tablecare.operators.clean import safe_clean
    ids = ["1234567890123456781", "1234567890123456782", "1234567890123456783"]
    out = safe_clean(spark.createDataFrame([(i,) for i in ids], "id string")).df
    assert sorted(r["id"] for r in out.collect()) == [int(i) for i in ids]
    big = safe_clean(spark.createDataFrame([("12345678901234567890",), ("5",)], "id string")).df
    assert dict(big.dtypes)["id"] == "decimal(38,0)"     # as doubles, different long integers would become equal


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    h = {r["bin"]: r["n"] for r in X.histogram(df, "x").collect()}
    assert h[0] == 2 and sum(h.values()) == 2 and len(h) == 30


def test_clean_pipeline_with_checkpoint(spark):
    from tablecare.operators.recommend import clean
    rows = [(" a ", "1"), ("a", "1"), ("b", "NULL")] + [("c", str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "`Group Name` string, Amount string")
    cleaned, log, after, mapping = clean(df, recommended=True, materialize="checkpoint")
    assert mapping == {"Group Name": "group_name", "Amount": "amount"}
    assert after.n_rows == cleaned.count() == 202
    actions = [r["action"] for r in log.orderBy("step").collect()]
    assert actions[0] == "normalize_column_names" and actions[-1] == "recommended_cleaning_complete"
    assert "median_imputation" in actions and cleaned.where("amount IS NULL").count() == 0


def test_dedup_tells_null_layouts_apart(spark):
    from tablecare.operators.profile import drop_duplicate_rows, duplicate_rows
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), ("b", "c")], "x string, y string")
    h = {r[0] for r in df.select(F.xxhash64("x", "y")).collect()}
    assert len(h) == 2                      # the two NULL layouts collide
    assert duplicate_rows(df).first()[0] == 1
    assert sorted((tuple(r) for r in drop_duplicate_rows(df).collect()), key=str) == \
        sorted([(None, "a"), ("a", None), ("b", "c")], key=str)


def test_profile_approximate_mode_is_close(spark):
    from tests.conftest import SF_SMALL
    from tablecare.sources.tables import load_table
    li = load_table(spark, SF_SMALL, "lineitem")
    exact = {c["name"]: c for c in profile(li, "l").columns}
    approx = {c["name"]: c for c in profile(li, "l", distinct="approx", quantile_method="approx").columns}
    for name, c in exact.items():
        a = approx[name]
        assert a["missing_count"] == c["missing_count"] and a["mean"] == c["mean"]
        assert abs(a["unique_count"] - c["unique_count"]) <= max(2, 0.1 * c["unique_count"])
        if c["column_type"] == "categorical":
            assert a["top_values"] == c["top_values"]
        if c["column_type"] == "numeric":
            assert abs(a["outlier_pct"] - c["outlier_pct"]) <= 1.0


def test_integers_beyond_64_bits_stay_apart(spark):
    from tablecare.operators.clean import safe_clean
    long = ["18446744073709551617", "18446744073709551618", "18446744073709551619", "7"]
    wide = ["1" * 39, "2" * 39, "1" * 39 + "0", "7"]
    df = spark.createDataFrame(list(zip(long, wide, ["1.5", "18446744073709551617", "18446744073709551618", "2"], "1234", strict=True)),
                               "a string, b string, c string, d string")
    out = safe_clean(df)
    types = dict(out.df.dtypes)
    assert types == {"a": "decimal(38,0)", "b": "string", "c": "string", "d": "bigint"}
    assert sorted(int(r["a"]) for r in out.df.collect()) == sorted(map(int, long))
    assert safe_clean(df.select("a")).df.count() == 4 and safe_clean(df.select("b")).df.count() == 4
