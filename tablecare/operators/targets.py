"""Target-column candidates (T1-T8) over a long column-profile table.

Input: the ``profile_columns`` layout (one row per column of *many* tables:
``table_name, pos, name, column_type, unique_count, missing_count,
is_constant, min, max``) plus ``n_rows`` per table. Every window partitions
by ``table_name`` and holds one row per column of that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ID_NAME_PATTERNS, LEAKAGE_NAME_PATTERNS, contains_any

LEAKAGE_WARNING = "This column may be derived from the outcome (potential leakage)"


def is_id_like(name: Column, unique_count: Column, n_rows: Column, strict: bool = False) -> Column:
    """Name holds an id pattern (substring; ``strict`` = whole words), or
    the column is ≥ 95 % unique on more than ten rows."""
    low = F.lower(name)
    if strict:
        by_name = low.rlike(r"(^|_)(id|uuid|index|pk|key)(_|$)")
    else:
        by_name = contains_any(low, ID_NAME_PATTERNS)
    return by_name | ((n_rows > 10) & (unique_count >= n_rows * 0.95))


def is_leakage_name(name: Column) -> Column:
    """Name suggests a post-outcome column."""
    return contains_any(F.lower(name), LEAKAGE_NAME_PATTERNS)


def _fmt0(x: Column) -> Column:
    """'%.0f' with round-half-even, as Python formats it."""
    return F.bround(x, 0).cast("bigint").cast("string")


def with_flags(prof: DataFrame) -> DataFrame:
    return prof.withColumns({
        "is_id_like": is_id_like(F.col("name"), F.col("unique_count"), F.col("n_rows")),
        "is_leakage_risk": is_leakage_name(F.col("name"))})


def candidate_list(prof: DataFrame, limit: int = 10) -> DataFrame:
    """Every non-id, non-constant column, confidence .5, schema order,
    at most ``limit`` per table."""
    f = with_flags(prof).where(~F.col("is_id_like") & ~F.col("is_constant"))
    w = Window.partitionBy("table_name").orderBy("pos")
    return (f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("table_name", F.col("name").alias("column"), F.lit(0.5).alias("confidence"),
                    F.format_string("%s column with %d unique values", F.col("column_type"),
                                    F.col("unique_count")).alias("reason"),
                    F.col("column_type").alias("col_type"), "is_leakage_risk",
                    F.lit(None).cast("string").alias("warning"), F.col("rank").cast("int")))


def validate_suggestions(suggestions: DataFrame, prof: DataFrame) -> DataFrame:
    """T4: keep suggested columns that exist and are not id-like; attach the
    leakage flag, warning and column type. ``suggestions``: (table_name,
    column, confidence, reason, rank)."""
    p = with_flags(prof).select("table_name", F.col("name").alias("column"), "column_type",
                                "is_id_like", "is_leakage_risk")
    j = suggestions.join(p, ["table_name", "column"]).where(~F.col("is_id_like"))
    return j.select("table_name", "column", F.col("confidence").cast("double"), "reason",
                    F.col("column_type").alias("col_type"), "is_leakage_risk",
                    F.when(F.col("is_leakage_risk"), F.lit(LEAKAGE_WARNING)).alias("warning"),
                    F.col("rank").cast("int"))


def rejected_suggestions(suggestions: DataFrame, prof: DataFrame) -> DataFrame:
    """T4 rejects: suggested columns that are missing or id-like."""
    ok = validate_suggestions(suggestions, prof).select("table_name", "column")
    return suggestions.join(ok, ["table_name", "column"], "left_anti")


def supplement(validated: DataFrame, prof: DataFrame, task_types: DataFrame | None = None,
               minimum: int = 3) -> DataFrame:
    """T5: top up every table's validated list to ``minimum`` candidates
    (numeric .4 first, then categorical .3 / .2, in profile order) unless the
    table's task type is 'eda'. ``task_types``: (table_name, task_type)."""
    f = with_flags(prof).where(~F.col("is_id_like") & ~F.col("is_constant"))
    extra = f.join(validated.select("table_name", F.col("column").alias("name")), ["table_name", "name"], "left_anti")
    is_num = F.col("column_type") == "numeric"
    conf = F.when(is_num, 0.4).when(F.col("unique_count") <= 20, 0.3).otherwise(0.2)
    reason = F.when(is_num & F.col("min").isNotNull() & F.col("max").isNotNull(),
                    F.concat(F.lit("Numeric column (range: "), _fmt0(F.col("min")), F.lit(" to "),
                             _fmt0(F.col("max")), F.lit(")"))) \
        .when(is_num, F.format_string("Numeric column (%d unique values)", F.col("unique_count"))) \
        .otherwise(F.format_string("Categorical column (%d categories)", F.col("unique_count")))
    w = Window.partitionBy("table_name").orderBy(F.when(is_num, 0).otherwise(1), conf.desc(), F.col("pos"))
    have = validated.groupBy("table_name").agg(F.count(F.lit(1)).alias("have"),
                                               F.max("rank").alias("last_rank"))
    ranked = (extra.withColumn("r", F.row_number().over(w))
              .join(have, "table_name", "left")
              .withColumn("have", F.coalesce("have", F.lit(0)))
              .where(F.col("r") <= F.lit(minimum) - F.col("have")))
    if task_types is not None:
        ranked = ranked.join(task_types, "table_name", "left").where(
            F.coalesce(F.col("task_type"), F.lit("unknown")) != "eda")
    add = ranked.select("table_name", F.col("name").alias("column"), conf.alias("confidence"),
                        reason.alias("reason"), F.col("column_type").alias("col_type"), "is_leakage_risk",
                        F.lit(None).cast("string").alias("warning"),
                        (F.coalesce("last_rank", F.lit(0)) + F.col("r")).cast("int").alias("rank"))
    return validated.unionByName(add)


def accept_gate(candidates: DataFrame) -> DataFrame:
    """Per table, the chosen target when exactly one candidate exists and
    its confidence ≥ .95; otherwise NULL and confirmation needed."""
    g = candidates.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.min_by("column", "rank").alias("best"), F.min_by("confidence", "rank").alias("best_confidence"))
    auto = (F.col("n_candidates") == 1) & (F.col("best_confidence") >= 0.95)
    return g.select("table_name", F.col("n_candidates").cast("bigint"),
                    F.when(auto, F.col("best")).alias("chosen_target"),
                    (~auto).alias("needs_confirmation"))


def task_type(prof: DataFrame, requested: Column | None = None) -> DataFrame:
    """Task type per column from (distinct, non-null rows, type)."""
    n = F.col("n_rows") - F.col("missing_count")
    u = F.col("unique_count")
    ratio = F.when(n > 0, u / n).otherwise(F.lit(0.0))
    req = requested if requested is not None else F.lit(None).cast("string")
    t = (F.when(F.col("column_type") != "numeric", "classification")
         .when(u <= 10, "classification").when(ratio > 0.5, "regression").when(u > 20, "regression")
         .when(req.isin("classification", "regression"), req).otherwise("classification"))
    return prof.select("table_name", F.col("name").alias("column"), t.alias("task_type"))


def task_type_interactive(prof: DataFrame) -> DataFrame:
    """Default task type offered interactively."""
    n = F.col("n_rows") - F.col("missing_count")
    u = F.col("unique_count")
    ratio = u / F.greatest(n, F.lit(1))
    t = (F.when(F.col("column_type") != "numeric", "classification")
         .when((u <= 10) | (ratio < 0.05), "classification").otherwise("regression"))
    return prof.select("table_name", F.col("name").alias("column"), t.alias("task_type"))
