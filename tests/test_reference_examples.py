"""The reference's own test examples, re-expressed on Spark."""

from pyspark.sql import types as T

from tablecare.operators.clean import safe_clean
from tablecare.operators.profile import profile


def test_safe_cleaning_normalizes_columns_missing_tokens_and_duplicates(spark):
    df = spark.createDataFrame([(" Ada ", "10"), ("Ada", "10"), ("NULL", "20")], ["Customer Name", "Order Total"])
    res = safe_clean(df)
    cleaned = res.df
    assert cleaned.columns == ["customer_name", "order_total"]
    rows = cleaned.orderBy("order_total").collect()
    assert len(rows) == 2
    assert [r["order_total"] for r in rows] == [10, 20]
    assert sum(r["customer_name"] is None for r in rows) == 1
    actions = {r["action"] for r in res.log.collect()}
    assert actions >= {"normalize_column_names", "trim_whitespace", "normalize_missing_tokens",
                       "remove_duplicates", "safe_cleaning_complete"}


def test_profile_reports_core_shape_and_column_types(spark):
    schema = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("segment", T.StringType()),
                           T.StructField("date", T.StringType())])
    df = spark.createDataFrame([(10.0, "A", "2026-01-01"), (12.0, "B", "2026-01-02"), (None, "B", "2026-01-03")],
                               schema)
    p = profile(df)
    assert p.n_rows == 3 and p.n_cols == 3
    assert p.duplicates_count == 0
    assert "amount" in p.numeric_cols
    assert "segment" in p.categorical_cols
    assert "date" in p.datetime_cols
    assert "Dataset has 3 rows and 3 columns." in p.summary_text


def test_cleaning_log_steps_and_counts(spark):
    df = spark.createDataFrame([(" Ada ", "10"), ("Ada", "10"), ("NULL", "20")], ["Customer Name", "Order Total"])
    log = {r["action"]: r for r in safe_clean(df).log.collect()}
    assert log["normalize_column_names"]["n"] == 2
    assert log["normalize_missing_tokens"]["n"] == 1
    assert log["remove_duplicates"]["n"] == 1
    assert log["safe_cleaning_complete"]["details"] == "Safe cleaning finished. Rows: 3 -> 2"
    assert log["type_coercion"]["details"] == "Coerced 1 columns: order_total -> numeric"
