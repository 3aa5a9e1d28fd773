"""Recommended cleaning (R1-R6) and the before/after comparison (Q1).

Every statistic is a distributed aggregate whose result is bounded by the
number of columns, then applied as literals in one projection:

* R1 medians: exact distributed quantiles (sketch, then proof by counting);
* R2 modes: top-1 of the Misra-Gries candidates, ties → smallest value;
* R3 1st/99th percentiles on the imputed table, then ``greatest/least``;
* R4 rare grouping: instead of the (unbounded) set of rare values we collect
  the *frequent* values — a value with share ≥ 1 % — of which there are at
  most 100 per column, so the ``isin`` list has a proven bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_position, field_type, is_missing, with_values
from ..functions.numeric import family_of
from ..functions.quantiles import quantiles
from ..functions.sentences import DETAILS, as_column, entry
from .clean import LOG_SCHEMA, CleanResult, safe_clean
from .heavy import frequent
from .profile import Profile, duplicate_rows, outlier_counts, profile

RARE_SHARE = 0.01


def _is_plain_numeric(dt: T.DataType) -> bool:
    return family_of(dt) == "numeric"


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent non-null value per column; ties → smallest value."""
    if not columns:
        return {}
    return {columns[r["k"]]: r["value"] for r in frequent(df, columns).top(1).select("k", "value").collect()}


def frequent_values(df: DataFrame, columns: list[str], share: float = RARE_SHARE) -> dict[str, tuple[list[str], bool]]:
    """Per text column: values with share ≥ ``share`` of non-null values (at
    most 1/share of them) and whether any rarer value exists."""
    if not columns:
        return {}
    p, col = by_position(df)
    row = p.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    got = frequent(df, columns).at_least({i: share * row[f"n{i}"] for i in range(len(columns))}).collect()
    keep: dict[str, list[str]] = {c: [] for c in columns}
    for r in got:
        keep[columns[r["k"]]].append(r["value"])
    kept = [sum(r["n"] for r in got if r["k"] == i) for i in range(len(columns))]
    return {c: (sorted(keep[c]), kept[i] < row[f"n{i}"]) for i, c in enumerate(columns)}


@dataclass
class RecommendedSpec:
    medians: dict[str, float]
    modes: dict[str, str]
    clips: dict[str, tuple[float, float]]
    frequent: dict[str, list[str]]


def median_impute(df: DataFrame, prof: Profile, method: str = "exact") -> tuple[DataFrame, dict[str, float]]:
    """Numeric columns with missing values → fill with the median."""
    cols = [c["name"] for c in prof.columns if c["column_type"] == "numeric" and c["missing_count"] > 0
            and c["name"] in df.columns]
    qs = quantiles(df, cols, [0.5], method=method) if cols else {}
    med = {c: v[0] for c, v in qs.items() if v[0] is not None}
    return with_values(df, {c: lambda x, m=m: F.coalesce(x.cast("double"), F.lit(m)) for c, m in med.items()}) if med else df, med


def mode_impute(df: DataFrame, prof: Profile) -> tuple[DataFrame, dict[str, str]]:
    """R2: categorical columns with missing values → fill with the mode."""
    cols = [c["name"] for c in prof.columns if c["column_type"] == "categorical" and c["missing_count"] > 0
            and c["name"] in df.columns and family_of(field_type(df, c["name"])) == "text"]
    modes = column_modes(df, cols)
    return with_values(df, {c: lambda x, m=m: F.coalesce(x, F.lit(m)) for c, m in modes.items()}) if modes else df, modes


def winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99,
              method: str = "exact") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Clip every numeric column with values outside [p_lower, p_upper];
    NULLs stay NULL."""
    cols = [f.name for f in df.schema.fields if _is_plain_numeric(f.dataType)]
    if not cols:
        return df, {}
    qs = quantiles(df, cols, [lower, upper], method=method)
    bounds = {c: (v[0], v[1]) for c, v in qs.items() if v[0] is not None}
    if not bounds:
        return df, {}
    outside = outlier_counts(df, bounds)
    clips = {c: b for c, b in bounds.items() if outside[c] > 0}
    return with_values(df, {c: lambda x, b=b: clip_column(x, *b) for c, b in clips.items()}) if clips else df, clips


def clip_column(c, lo: float, hi: float):
    d = c.cast("double")
    return F.when(d.isNotNull(), F.greatest(F.least(d, F.lit(hi)), F.lit(lo)))


def group_rare(df: DataFrame, share: float = RARE_SHARE) -> tuple[DataFrame, dict[str, list[str]]]:
    """Values with share < ``share`` of a text column's non-null values →
    'Other'."""
    cols = [f.name for f in df.schema.fields if family_of(f.dataType) == "text"]
    fv = frequent_values(df, cols, share)
    grouped = {c: keep for c, (keep, has_rare) in fv.items() if has_rare}
    return with_values(df, {c: lambda x, keep=keep: F.when(x.isNull() | x.isin(keep), x).otherwise(F.lit("Other"))
                            for c, keep in grouped.items()}) if grouped else df, grouped


def recommended_clean(df: DataFrame, prof: Profile | None = None, method: str = "exact"
                      ) -> tuple[DataFrame, DataFrame, RecommendedSpec]:
    """R1 → R2 → R3 → R4 with a log. ``prof`` must describe ``df``
    itself (profiled when omitted, which avoids stale-name skips); only its
    column types and missing counts are used, so the light (one-pass)
    profile suffices."""
    spark = df.sparkSession
    prof = prof or profile(df, light=True)
    step1, med = median_impute(df, prof, method)
    step2, modes = mode_impute(step1, prof)
    step3, clips = winsorize(step2, method=method)
    step4, grouped = group_rare(step3)
    rows = []
    if med:
        rows.append(entry("median_imputation", len(med), items=", ".join(list(med)[:5])))
    if modes:
        rows.append(entry("mode_imputation", len(modes), items=", ".join(list(modes)[:5])))
    if clips:
        rows.append(entry("winsorize_outliers", len(clips)))
    if grouped:
        rows.append(entry("group_rare_categories", len(grouped)))
    log = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], LOG_SCHEMA)
    done = "recommended_cleaning_complete"
    tail = step4.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(len(rows) + 1).alias("step"), F.lit(done).alias("action"), as_column(DETAILS[done], n=F.col("n")).alias("details"),
        F.col("n").cast("bigint").alias("n"))
    return step4, log.unionByName(tail), RecommendedSpec(med, modes, clips, grouped)


def clean(df: DataFrame, recommended: bool = False, materialize: str = "checkpoint",
          output_path: str | None = None, fmt: str = "parquet"):
    """Safe cleaning, optional recommended cleaning on a profile of the
    cleaned table, re-profile, optional write. Returns (cleaned, log,
    profile_after, mapping).

    The deduplicated table feeds several passes; ``materialize`` keeps it
    between them: "checkpoint" (written to the shared ``spark.checkpoint.dir``,
    cutting lineage), "persist" (cached; the caller releases the returned
    table), or "none"."""
    from ..session import cut_lineage
    from ..sources.files import write_table
    res: CleanResult = safe_clean(df)
    cleaned, log = res.df, res.log
    if materialize == "persist":
        cleaned = cleaned.persist()
    elif materialize == "checkpoint":
        cleaned = cut_lineage(cleaned)
    if recommended:
        cleaned, rlog, _ = recommended_clean(cleaned)
        k = log.count()
        log = log.unionByName(rlog.withColumn("step", (F.col("step") + F.lit(k)).cast("int")))
    after = profile(cleaned)
    if output_path:
        write_table(cleaned, output_path, fmt)
    return cleaned, log, after, res.mapping


def overview_row(df: DataFrame, side: str) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows. The two
    one-row aggregates are stacked and folded by a global aggregate (no
    join)."""
    fields = df.schema.fields
    p, _ = by_position(df)
    gaps = [F.when(is_missing(F.col(f"c{i}"), f.dataType), 1).otherwise(0) for i, f in enumerate(fields)]
    miss = F.sum(F.aggregate(F.array(*gaps), F.lit(0).cast("long"), lambda a, x: a + x)) if fields else F.lit(0)
    base = p.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                 F.coalesce(miss, F.lit(0)).cast("bigint").alias("missing_total"),
                 F.lit(None).cast("bigint").alias("duplicates"))
    dup = duplicate_rows(df).select(F.lit(None).cast("bigint").alias("rows"),
                                    F.lit(None).cast("bigint").alias("missing_total"), "duplicates")
    return base.unionByName(dup).agg(
        F.lit(side).alias("side"), F.max("rows").alias("rows"), F.lit(len(fields)).cast("int").alias("columns"),
        F.max("missing_total").alias("missing_total"), F.max("duplicates").alias("duplicates"))


def quality_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q1: rows/columns/missing/duplicates before and after, plus the change
    (before − after) as a third row, from the two rows."""
    b = overview_row(before, "before")
    a = overview_row(after, "after")
    rows = {r["side"]: r for r in b.unionByName(a).collect()}   # two rows
    names = ("rows", "columns", "missing_total", "duplicates")
    change = ("change", *(rows["before"][c] - rows["after"][c] for c in names))
    return before.sparkSession.createDataFrame([tuple(rows["before"]), tuple(rows["after"]), change], b.schema)
