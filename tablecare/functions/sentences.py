"""The sentences of logs and summaries, each written once and filled in as text, as a Column or as SQL."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The details of every cleaning action, and the parts of the profile summary.
DETAILS = {
    "normalize_column_names": "Renamed {n} columns to snake_case",
    "trim_whitespace": "Trimmed whitespace in {n} string columns",
    "normalize_missing_tokens": "Converted {n} missing value tokens to NaN",
    "type_coercion": "Coerced {n} columns: {items}",
    "remove_duplicates": "Removed {n} duplicate rows",
    "safe_cleaning_complete": "Safe cleaning finished. Rows: {before} -> {n}",
    "median_imputation": "Imputed {n} numeric columns with median: {items}",
    "mode_imputation": "Imputed {n} categorical columns with mode: {items}",
    "winsorize_outliers": "Winsorized outliers in {n} columns (1st-99th percentile)",
    "group_rare_categories": "Grouped rare categories (<1%) to 'Other' in {n} columns",
    "recommended_cleaning_complete": "Recommended cleaning finished. Final rows: {n}",
}
SUMMARY = {
    "size": "Dataset has {rows} rows and {cols} columns.",
    "types": "Numeric columns: {numeric}, Categorical: {categorical}, Datetime: {datetime}.",
    "duplicates": "Found {duplicates} duplicate rows.",
    "missing": "Columns with >10% missing: {missing}.",
    "constant": "{constant} constant/near-constant columns detected.",
}


def _parts(template: str) -> list[tuple[str, str | None]]:
    return [(text, field) for text, field, _, _ in Formatter().parse(template)]


def as_column(template: str, **values: Column) -> Column:
    return F.concat(*[x for text, field in _parts(template) for x in
                      ([F.lit(text)] if text else []) + ([values[field].cast("string")] if field else [])])


def as_sql(template: str, **values: str | int) -> str:
    """DuckDB text; a number or an expression for every field."""
    return " || ".join(x for text, field in _parts(template) for x in
                       (["'" + text.replace("'", "''") + "'"] if text else []) + ([f"({values[field]})"] if field else []))


def entry(action: str, n: int, **values) -> tuple[str, str, int]:
    """(action, details, n) of a log row."""
    return action, DETAILS[action].format(n=n, **values), n
