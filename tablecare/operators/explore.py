"""Exploration results (V1-V8, V10, V13) and wording helpers.

Each function returns a lazy DataFrame holding what a chart would draw;
drawing itself is out of scope. Statistics that need order statistics use
the exact distributed quantiles (an eager step whose driver-side result is a
handful of numbers per column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_position, field_type
from ..functions.numeric import (as_double, equal_width_bin, family_of, rnd, safe_corr,
                                 skewness_unbiased)
from ..functions.quantiles import grouped_median, quantiles
from ..functions.text import (OUTCOME_KEYWORDS, QUALITY_KEYWORDS, TEMPORAL_KEYWORDS, contains_any,
                              parse_datetime)
from .heavy import frequent
from .moments import pair_moments


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns a numeric-only selection would keep (booleans excluded)."""
    return [f.name for f in df.schema.fields if family_of(f.dataType) == "numeric"]


# ---- V1 ---------------------------------------------------------------------------------

def missing_by_column(df: DataFrame) -> DataFrame:
    """V1: (name, missing) for columns with missing values, ascending.

    Uses the long-layout column statistics (one ``groupBy(column)`` whose
    generated code does not grow with the number of columns)."""
    from .profile import column_stats
    names = F.array(*[F.lit(f.name) for f in df.schema.fields])
    st = column_stats(df, datetime_vote=False)
    return (st.where(F.col("missing") > 0).orderBy("missing", "k")
            .select(F.element_at(names, F.col("k") + 1).alias("name"), F.col("missing").cast("bigint").alias("missing")))


def missing_summary(df: DataFrame) -> DataFrame:
    """V1 totals: total missing cells and columns with missing values (0 when
    nothing is missing)."""
    m = missing_by_column(df)
    return m.agg(F.coalesce(F.sum("missing"), F.lit(0)).cast("bigint").alias("total_missing"),
                 F.count(F.lit(1)).cast("bigint").alias("cols_with_missing"))


# ---- V2 ---------------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """V2: equal-width histogram over [min, max], last bin closed, empty bins
    included. min/max come from one small aggregate and enter the binning
    pass as literals; empty bins come from a ``range`` of bin numbers joined
    on the bin key."""
    spark = df.sparkSession
    p, col = by_position(df)
    v = p.select(as_double(col(column)).alias("v")).where(F.col("v").isNotNull())
    mm = v.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    if mm["mn"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    mn, mx = float(mm["mn"]), float(mm["mx"])
    counts = (v.select(equal_width_bin(F.col("v"), F.lit(mn), F.lit(mx), bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    w = (F.lit(mx) - F.lit(mn)) / F.lit(float(bins))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (frame.join(counts, "bin", "left")
            .select("bin", rnd(F.lit(mn) + F.col("bin") * w).alias("lo"),
                    rnd(F.lit(mn) + (F.col("bin") + 1) * w).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def distribution_stats(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """V2 stats: mean, median, sample std, bias-corrected skewness (4 dp)."""
    med = quantiles(df, [column], [0.5], method=method)[column][0]
    p, col = by_position(df)
    v = as_double(col(column))
    return p.agg(rnd(F.avg(v)).alias("mean"), rnd(F.stddev_samp(v)).alias("std"),
                  rnd(skewness_unbiased(v)).alias("skewness"), F.count(v).cast("bigint").alias("n")
                  ).select("mean", (rnd(F.lit(med)) if med is not None else F.lit(None).cast("double"))
                           .alias("median"), "std", "skewness", "n")


# ---- V3 ---------------------------------------------------------------------------------

def category_frequency(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """V3: top-N categories by count (ties → value ascending)."""
    p, col = by_position(df)
    top = frequent(p.select(col(column).cast("string").alias("value")), ["value"]).top(top_n)
    return top.select("value", "n").orderBy(F.col("n").desc(), F.col("value").asc())


# ---- V4 / V5 ----------------------------------------------------------------------------

def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V4: long (x, y, r) over all numeric pairs, pairwise-complete; r NULL
    for constant input; diagonal 1.0 (NULL for a constant column).

    One pass (:mod:`.moments`): every partition centres each pair on the rows
    where both are present, and the partitions' tiles are merged by the
    parallel formula, so sums of far apart magnitudes never cancel, whatever
    stands in rows where only one of the two is present. A pair is constant if
    an extreme pair of it is equal."""
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "x string, y string, r double")
    p, col = by_position(df, "p")
    vals = p.select(*[as_double(col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    g = pair_moments(vals).select("i", "j", "sxx", "syy", "sxy", (F.col("lox") < F.col("hix")).alias("vx"), (F.col("loy") < F.col("hiy")).alias("vy"))
    r = F.col("sxy") / (F.sqrt("sxx") * F.sqrt("syy"))
    r = F.when(F.col("vx") & F.col("vy") & (F.col("sxx") > 0) & (F.col("syy") > 0) & ~F.isnan(r),
               rnd(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))))
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("vx"), F.lit(1.0))).otherwise(r)
    every = spark.range(len(cols)).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(len(cols) - 1))).alias("j"))
    g = every.join(g, ["i", "j"], "left")   # pairs without a common row: r NULL
    names = F.array(*[F.lit(c) for c in cols])
    res = g.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
                   r.alias("r"))
    s1 = F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("r"))
    s2 = F.struct(F.col("b").alias("x"), F.col("a").alias("y"), F.col("r"))
    arr = F.when(F.col("a") == F.col("b"), F.array(s1)).otherwise(F.array(s1, s2))
    return res.select(F.explode(arr).alias("s")).select("s.*")


def correlation_summary(corr: DataFrame) -> DataFrame:
    """V4 summary: strongest |r| off the diagonal (NULL cells ignored) and the
    number of features."""
    return corr.agg(F.max(F.when(F.col("x") != F.col("y"), F.abs("r"))).alias("max_correlation"),
                    F.count_distinct("x").cast("bigint").alias("num_features"))


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """V5 points: rows where both are present (every row, no cap)."""
    p, col = by_position(df)
    return p.select(as_double(col(x)).alias("x"), as_double(col(y)).alias("y")).dropna()


def scatter_sample(df: DataFrame, x: str, y: str, keys: list[str], cells: int = 32, per_cell: int = 4) -> DataFrame:
    """V5 for display: (x, y, cell_x, cell_y, n), at most ``per_cell`` points of every cell of a ``cells`` × ``cells``
    grid over the points' extent, with the number ``n`` of points in the cell.

    Every occupied cell keeps a point, so outliers show, and ``n`` keeps the density. A cell keeps the points
    whose keys have the smallest hashes, the same ones whatever the partitions, and each task keeps that many
    per cell before the shuffle."""
    p, col = by_position(df)
    key = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    points = p.select(as_double(col(x)).alias("x"), as_double(col(y)).alias("y"), key.alias("key")).where("x IS NOT NULL AND y IS NOT NULL")
    e = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if e[0] is None:
        return df.sparkSession.createDataFrame([], "x double, y double, cell_x int, cell_y int, n bigint")
    cell = {"cell_x": equal_width_bin(F.col("x"), F.lit(e[0]), F.lit(e[1]), cells), "cell_y": equal_width_bin(F.col("y"), F.lit(e[2]), F.lit(e[3]), cells)}
    placed = points.withColumns(cell)
    first = Window.partitionBy("cell_x", "cell_y").orderBy(F.md5("key"), "x", "y")
    kept = placed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_cell).drop("r", "key")
    size = placed.groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(F.broadcast(size), ["cell_x", "cell_y"]).select("x", "y", "cell_x", "cell_y", "n")   # at most cells² rows


def scatter_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """V5: r over complete pairs (NULL with fewer than two points) and n."""
    p = scatter_points(df, x, y)
    n = F.count(F.lit(1))
    return p.agg(F.when(n > 1, rnd(safe_corr(F.col("x"), F.col("y")))).alias("correlation"),
                 n.cast("bigint").alias("n_points"))


# ---- V6 ---------------------------------------------------------------------------------

def box_stats(df: DataFrame, columns: list[str] | None = None, method: str = "exact") -> DataFrame:
    """V6: q1, median, q3, whiskers at the furthest point within 1.5·IQR and
    the count of points beyond, per column (default: first six numerics)."""
    from .profile import tukey_fences
    cols = columns or numeric_columns(df)[:6]
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], method=method)
    structs = []
    p, col = by_position(df)
    for c in cols:
        q1, med, q3 = qs[c]
        v = as_double(col(c))
        lo_b, hi_b = (None, None) if q1 is None else tukey_fences(q1, q3)
        def lit(x):
            return F.lit(x).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("name"), rnd(lit(q1)).alias("q1"), rnd(lit(med)).alias("median"),
            rnd(lit(q3)).alias("q3"),
            rnd(F.min(F.when(v >= lit(lo_b), v))).alias("whisker_lo"),
            rnd(F.max(F.when(v <= lit(hi_b), v))).alias("whisker_hi"),
            F.count_if((v < lit(lo_b)) | (v > lit(hi_b))).cast("bigint").alias("n_outliers")))
    return p.agg(F.array(*structs).alias("a")).select(F.inline("a"))


# ---- V7 ---------------------------------------------------------------------------------

def _points(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """(ts, value) where both are present."""
    p, col = by_position(df)
    c = col(date_col)
    ts = parse_datetime(c) if family_of(field_type(df, date_col)) == "text" else c.cast("timestamp_ntz")
    return p.select(ts.alias("ts"), as_double(col(value_col)).alias("value")).dropna()


def time_trend(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """V7: (ts, value) for rows where both are present, ordered by time."""
    return _points(df, date_col, value_col).orderBy("ts", "value")


def time_trend_summary(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    t = time_trend(df, date_col, value_col)
    return t.agg(F.count(F.lit(1)).cast("bigint").alias("n_points"),
                 F.concat_ws(" to ", F.min("ts").cast("string"), F.max("ts").cast("string")).alias("date_range"))


def time_trend_buckets(df: DataFrame, date_col: str, value_col: str, unit: str = "day") -> DataFrame:
    """V7 at scale: one point per ``date_trunc(unit)`` bucket (n, mean)."""
    t = _points(df, date_col, value_col)
    return (t.groupBy(F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz").alias("bucket"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), rnd(F.avg("value")).alias("mean")))


def time_line(df: DataFrame, date_col: str, value_col: str, pixels: int = 800) -> DataFrame:
    """V7 for display: (pixel, ts, value), in order of time, of the points that a line of ``pixels`` columns needs.

    The pixels of a line depend, per column, on its first, last, lowest and highest point alone: the first and last
    join it to its neighbours, the others span it. One aggregate keeps those four."""
    points = _points(df, date_col, value_col).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    a, b = points.agg(F.min("us"), F.max("us")).first()
    if a is None:
        return df.sparkSession.createDataFrame([], "pixel int, ts timestamp_ntz, value double")
    pixel = F.expr(f"cast(((us - {a}) * {pixels}) div {b - a + 1} AS INT)")
    by_time, by_value = F.struct("ts", "value"), F.struct("value", "ts")
    kept = points.groupBy(pixel.alias("pixel")).agg(
        F.min(by_time).alias("a"), F.max(by_time).alias("b"), F.min(by_value).alias("c"), F.max(by_value).alias("d"))
    four = F.array_distinct(F.array(*[F.struct(F.col(f"{x}.ts").alias("ts"), F.col(f"{x}.value").alias("value")) for x in "abcd"]))
    return kept.select("pixel", F.inline(four)).orderBy("ts", "value")


# ---- V8 ---------------------------------------------------------------------------------

GROUPED_AGGS = {
    "mean": lambda v: F.avg(v),
    "sum": lambda v: F.sum(v),
    "count": lambda v: F.count(v).cast("double"),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "std": lambda v: F.stddev_samp(v),
    "nunique": lambda v: F.count_distinct(v).cast("double"),
}


def grouped_agg(df: DataFrame, group_col: str, value_col: str, agg: str = "mean", top: int = 10) -> DataFrame:
    """V8: aggregate of ``value_col`` per non-null group, top ``top`` by value
    (ties → group ascending). Partial aggregation before the shuffle keeps
    hot groups cheap; the median is resolved by bucket counts per group."""
    if agg != "median" and agg not in GROUPED_AGGS:
        raise ValueError(f"aggregation must be one of {sorted([*GROUPED_AGGS, 'median'])}")
    p, col = by_position(df)
    rows = p.select(col(group_col).cast("string").alias("grp"), col(value_col).alias("value")).where(F.col("grp").isNotNull())
    if agg == "median":
        every = rows.select("grp").distinct()
        g = every.join(grouped_median(rows, "grp", "value"), "grp", "left").select("grp", rnd(F.col("median")).alias("value"))
    else:
        g = rows.groupBy("grp").agg(rnd(GROUPED_AGGS[agg](as_double(F.col("value")))).alias("value"))
    return g.orderBy(F.col("value").desc_nulls_last(), F.col("grp").asc()).limit(top)


# ---- V10 --------------------------------------------------------------------------------

def unordered_signature(cols: list[Column], extra: list[Column] | None = None) -> Column:
    """Order-insensitive key: the sorted distinct values of ``cols`` as an array
    (NULL is a member like any other), with ``extra`` parts beside it. No
    values are joined into one string, so no separator can be mistaken."""
    members = F.array_sort(F.array_distinct(F.array(*[c.cast("string") for c in cols])))
    return F.struct(*[e.alias(f"e{i}") for i, e in enumerate(extra or [])], members.alias("members"))


def unordered_dedup(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """Keep the first row (by ``order_by``) of every unordered set of
    ``cols``. ``min_by`` aggregates partially before the shuffle, so a hot
    signature never lands whole in one task."""
    p, col = by_position(df)
    row, order = F.struct(*p.columns), F.struct(*[col(c) for c in order_by])
    return (p.groupBy(unordered_signature([col(c) for c in cols]).alias("sig"))
            .agg(F.min_by(row, order).alias("r")).select("r.*").toDF(*df.columns))


# ---- X1 / X2 / V13 ----------------------------------------------------------------------

def intent_flags(df: DataFrame, text_col: str) -> DataFrame:
    """Outcome / temporal / quality keyword flags per text."""
    low = F.lower(F.col(text_col))
    return df.withColumns({"is_outcome": contains_any(low, OUTCOME_KEYWORDS),
                           "is_temporal": contains_any(low, TEMPORAL_KEYWORDS),
                           "is_quality": contains_any(low, QUALITY_KEYWORDS)})


def correlation_labels(corr: DataFrame, r_col: str = "r") -> DataFrame:
    """Strength (strong > .7, moderate > .4, else weak) and direction."""
    a = F.abs(F.col(r_col))
    return corr.withColumns({
        "strength": F.when(F.col(r_col).isNull(), None).when(a > 0.7, "strong").when(a > 0.4, "moderate")
        .otherwise("weak"),
        "direction": F.when(F.col(r_col).isNull(), None).when(F.col(r_col) > 0, "positive").otherwise("negative")})


# Relevance of a result type and its reason, by the intent flag
# that matters for it: type → (flag, (level, reason) if set, (level, reason) if not).
RELEVANCE: dict[str, tuple[str | None, tuple[str, str] | None, tuple[str, str]]] = {
    "missing_values_bar": ("is_quality", ("High", "Data quality is central to your analysis goal"),
                           ("Low", "Data quality overview, not directly addressing the main question")),
    "numeric_distribution": (None, None, ("Medium", "Provides context on data distribution and outliers")),
    "categorical_frequency": (None, None, ("Medium", "Shows category distribution in the data")),
    "correlation_heatmap": ("is_outcome", ("High", "Shows relationships between features relevant to outcomes"),
                            ("Medium", "Useful for understanding feature relationships")),
    "scatter": ("is_outcome", ("High", "Visualizes potential relationships between key variables"),
                ("Medium", "Exploratory view of variable relationships")),
    "boxplot_outliers": (None, None, ("Medium", "Provides context on data distribution and outliers")),
    "time_trend": ("is_temporal", ("High", "Directly addresses temporal analysis goal"),
                   ("Low", "Temporal view, may not directly address the question")),
    "grouped_bar": ("is_outcome", ("High", "Compares metrics across categories relevant to outcomes"),
                    ("Medium", "Shows categorical comparisons")),
}
OTHER_RELEVANCE = ("Medium", "Exploratory visualization")


def relevance(chart_type: Column, flags: dict[str, Column]) -> Column:
    """(relevance, reason) for a result type given intent flags."""
    def pair(p: tuple[str, str]) -> Column:
        return F.struct(F.lit(p[0]).alias("relevance"), F.lit(p[1]).alias("reason"))
    out = pair(OTHER_RELEVANCE)
    for kind, (flag, if_set, if_not) in RELEVANCE.items():
        mine = pair(if_not) if flag is None else F.when(flags[flag], pair(if_set)).otherwise(pair(if_not))
        out = F.when(chart_type == kind, mine).otherwise(out)
    return out


def result_relevance(df: DataFrame, text_col: str, key_cols: list[str],
                     chart_types: list[str] | None = None) -> DataFrame:
    """V13 over a table of texts: every text × every result type (an
    ``explode`` of a literal array — a projection, not a join)."""
    types = chart_types or list(RELEVANCE)
    f = intent_flags(df.select(*key_cols, text_col), text_col)
    x = f.select(*key_cols, "is_outcome", "is_temporal", "is_quality",
                 F.explode(F.array(*[F.lit(t) for t in types])).alias("chart_type"))
    rel = relevance(F.col("chart_type"), {f: F.col(f) for f in ("is_outcome", "is_temporal", "is_quality")})
    return x.select(*key_cols, "chart_type", rel.getField("relevance").alias("relevance"),
                    rel.getField("reason").alias("reason"))
