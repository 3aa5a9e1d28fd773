"""Model metrics and report rows (M10-M14, M16-M20) over any
``(actual, predicted)`` table, optionally keyed by ``run_id`` so results of
many runs are computed in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.text import LEAKAGE_FEATURE_TERMS_EXPLAIN, LEAKAGE_FEATURE_TERMS_SUMMARY, contains_any


def _keys(df: DataFrame, run_col: str | None) -> list[str]:
    return [run_col] if run_col and run_col in df.columns else []


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
              run_col: str | None = None) -> DataFrame:
    """Long confusion matrix (actual, predicted, n)."""
    k = _keys(df, run_col)
    return (df.groupBy(*k, F.col(actual).cast("string").alias("actual"),
                       F.col(predicted).cast("string").alias("predicted"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
             run_col: str | None = None) -> DataFrame:
    """Share of rows with actual = predicted."""
    k = _keys(df, run_col)
    eq = (F.col(actual).cast("string") == F.col(predicted).cast("string")).cast("double")
    return df.groupBy(*k).agg(rnd(F.avg(eq)).alias("accuracy"))


def macro_f1(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
             run_col: str | None = None) -> DataFrame:
    """Unweighted mean F1 over the union of actual and predicted labels;
    a label with no support and no prediction scores 0 (zero_division=0).

    Built from the confusion table (one row per label pair), so the per-label
    counts come from a small aggregate."""
    k = _keys(df, run_col)
    cm = confusion(df, actual, predicted, run_col)
    per_label = cm.select(*k, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                 .otherwise(0).alias("tp"), F.when(F.col("actual") != F.col("predicted"), F.col("n"))
                 .otherwise(0).alias("fn"), F.lit(0).cast("bigint").alias("fp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("fn"), F.when(F.col("actual") != F.col("predicted"), F.col("n"))
                 .otherwise(0).alias("fp")))).alias("s")).select(*k, "s.*")
    lab = per_label.groupBy(*k, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return lab.groupBy(*k).agg(rnd(F.avg(f1)).alias("macro_f1"))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       run_col: str | None = None) -> DataFrame:
    """RMSE, MAE and R² (1 − SSres/SStot; NULL when SStot = 0)."""
    k = _keys(df, run_col)
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    g = df.groupBy(*k).agg(F.avg((a - p) * (a - p)).alias("mse"), F.avg(F.abs(a - p)).alias("mae"),
                           F.sum((a - p) * (a - p)).alias("ss_res"), F.var_pop(a).alias("var"),
                           F.count(F.lit(1)).alias("n"))
    return g.select(*k, rnd(F.sqrt("mse")).alias("rmse"), rnd(F.col("mae")).alias("mae"),
                    rnd(1 - F.try_divide(F.col("ss_res"), F.col("var") * F.col("n"))).alias("r2"))


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(predicted, residual = actual − predicted) for every row."""
    return df.select(F.col(predicted).cast("double").alias("predicted"),
                     (F.col(actual).cast("double") - F.col(predicted).cast("double")).alias("residual"))


def quality_band(task_type: Column, accuracy_col: Column, r2_col: Column) -> Column:
    """Good / Medium / Weak."""
    return (F.when(task_type == "classification",
                   F.when(accuracy_col >= 0.75, "Good").when(accuracy_col >= 0.5, "Medium").otherwise("Weak"))
            .otherwise(F.when(r2_col >= 0.5, "Good").when(r2_col >= 0.2, "Medium").otherwise("Weak")))


def leakage_suspects(importance: DataFrame, target_col: Column | None = None,
                     terms: list[str] | None = None, top_n: int = 10) -> DataFrame:
    """Features among the top ``top_n`` whose lower-cased name contains
    an outcome term (or the target's own name when given)."""
    t = terms if terms is not None else LEAKAGE_FEATURE_TERMS_EXPLAIN
    low = F.lower(F.col("feature"))
    cond = contains_any(low, t)
    if target_col is not None:
        cond = cond | (F.instr(low, F.lower(target_col)) > 0)
    return importance.where((F.col("rank") <= top_n) & cond)


def leakage_summary(importance: DataFrame, target_col: Column) -> DataFrame:
    """M16 as the written summary has it: its own term list, the top five."""
    return leakage_suspects(importance, target_col, LEAKAGE_FEATURE_TERMS_SUMMARY, 5)


def _sign(c: Column) -> Column:
    return F.when(c > 0, "positive").otherwise("negative")


def key_drivers(importance: DataFrame, top_n: int = 5) -> DataFrame:
    """Top features with effect sign and magnitude. A classifier's ranking
    coefficient is a mean absolute value, so its ``effect`` is always positive;
    ``signed_effect`` has the direction where there is one (two classes, or a
    regression), else NULL."""
    signed = F.when(F.col("signed_coefficient").isNotNull(), _sign(F.col("signed_coefficient")))
    return importance.where(F.col("rank") <= top_n).select(
        *[c for c in importance.columns if c in ("run_id",)], "feature", "rank", _sign(F.col("coefficient")).alias("effect"),
        signed.alias("signed_effect"), F.abs("coefficient").alias("magnitude"))


def rank_coefficients(coefs: DataFrame, top_n: int = 20) -> DataFrame:
    """M15 on a long (run_id, feature, class_index, coefficient) table of many
    runs: a classifier's features (``class_index`` given) rank by mean
    |coefficient| over classes, a regression's (NULL) by the coefficient itself;
    the top ``top_n`` by |value| per run, ties by name."""
    g = coefs.groupBy("run_id", "feature").agg(
        F.count("class_index").alias("k"), F.avg(F.abs("coefficient")).alias("mean"), F.first("coefficient").alias("one"))
    g = g.select("run_id", "feature", F.when(F.col("k") > 0, F.col("mean")).otherwise(F.col("one")).alias("coefficient"),
                 F.when(F.col("k") <= 1, F.col("one")).alias("signed_coefficient"))
    w = Window.partitionBy("run_id").orderBy(F.abs("coefficient").desc(), F.col("feature"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def report_rows(predictions: DataFrame) -> DataFrame:
    """M19 for many runs in one job: (run_id, task_type, actual, predicted) →
    (run_id, task_type, test_rows, accuracy, macro_f1, rmse, mae, r2)."""
    cls = predictions.where("task_type = 'classification'")
    reg = predictions.where("task_type = 'regression'")
    size = predictions.groupBy("run_id", "task_type").agg(F.count(F.lit(1)).cast("bigint").alias("test_rows"))
    out = size
    for part in (accuracy(cls, run_col="run_id"), macro_f1(cls, run_col="run_id"), regression_metrics(reg, run_col="run_id")):
        out = out.join(part, "run_id", "left")
    return out


def analysis_facts(profile_rows: DataFrame, cleaning_log: DataFrame, report: DataFrame, results: int) -> DataFrame:
    """One facts row per model run — row and column counts, numeric and
    categorical column counts, number of cleaning actions and results, the
    small-sample flag (< 100 rows), the run's task type and metrics, accuracy
    "out of ten" and R² as a percentage. ``profile_rows`` has one row per
    column (n_rows, column_type); its counts, and the log's, are one-row
    aggregates whose values enter as literals."""
    p = profile_rows.agg(F.max("n_rows").alias("n"), F.count(F.lit(1)).alias("c"),
                         F.count_if(F.col("column_type") == "numeric").alias("num"),
                         F.count_if(F.col("column_type") == "categorical").alias("cat")).first()
    n_rows = int(p["n"] or 0)
    return report.select(
        "run_id", F.lit(n_rows).cast("bigint").alias("n_rows"), F.lit(int(p["c"])).alias("n_cols"),
        F.lit(int(p["num"])).alias("numeric_columns"), F.lit(int(p["cat"])).alias("categorical_columns"),
        F.lit(cleaning_log.count()).cast("bigint").alias("cleaning_actions"), F.lit(results).alias("results"),
        F.lit(n_rows < 100).alias("small_sample"), "task_type", "accuracy", "macro_f1", "rmse", "r2",
        F.floor(F.col("accuracy") * 10).cast("int").alias("accuracy_out_of_ten"),
        F.floor(F.col("r2") * 100).cast("int").alias("r2_percent"))
