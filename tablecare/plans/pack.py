"""V9: default exploration pack — a plan of result specs derived from the
profile, and a runner that turns each spec into a lazy DataFrame over the
same input."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import explore as X
from ..operators.profile import Profile

PACK_SIZE = 7
PLAN_SCHEMA = T.StructType([
    T.StructField("chart_index", T.IntegerType()), T.StructField("chart_type", T.StringType()),
    T.StructField("column", T.StringType()), T.StructField("x_column", T.StringType()),
    T.StructField("y_column", T.StringType()), T.StructField("columns", T.StringType()),
    T.StructField("aggregation", T.StringType()), T.StructField("signature", T.StringType()),
])


@dataclass(frozen=True)
class Rule:
    """A result that is planned when its columns exist: parameter → (column
    class, place), with a slice for a list. ``instead_of`` names a type that
    takes precedence."""
    kind: str
    columns: dict[str, tuple[str, int | slice]] = field(default_factory=dict)
    least: dict[str, int] = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)
    instead_of: str | None = None

    def spec(self, have: dict[str, list[str]], planned: list[dict]) -> dict | None:
        need = {c: 1 for c, _ in self.columns.values()} | self.least
        if any(len(have[c]) < n for c, n in need.items()) or any(p["type"] == self.instead_of for p in planned):
            return None
        return {"type": self.kind, **{k: have[c][at] for k, (c, at) in self.columns.items()}, **self.fixed}


RULES = [
    Rule("missing_values_bar"),
    Rule("numeric_distribution", {"column": ("numeric", 0)}),
    Rule("categorical_frequency", {"column": ("categorical", 0)}, fixed={"top_n": 10}),
    Rule("correlation_heatmap", least={"numeric": 2}),
    Rule("scatter", {"x_column": ("numeric", 0), "y_column": ("numeric", 1)}, least={"numeric": 2}),
    Rule("boxplot_outliers", {"columns": ("numeric", slice(6))}),
    Rule("time_trend", {"date_column": ("datetime", 0), "value_column": ("numeric", 0)}),
    Rule("grouped_bar", {"group_column": ("categorical", 0), "value_column": ("numeric", 0)}, fixed={"aggregation": "mean"},
         instead_of="time_trend"),
]
#: Rules that fill the pack up, one result per further column of their class.
PADDING = [Rule("numeric_distribution", {"column": ("numeric", 0)}),
           Rule("categorical_frequency", {"column": ("categorical", 0)}, fixed={"top_n": 10})]


def default_plan(p: Profile) -> list[dict]:
    """Results planned from the column classes by RULES, then, up to the
    pack's size, PADDING over the columns not shown yet, then missing bars."""
    have = {"numeric": p.numeric_cols, "categorical": p.categorical_cols, "datetime": p.datetime_cols}
    plan: list[dict] = []
    for rule in RULES:
        spec = rule.spec(have, plan)
        if spec:
            plan.append(spec)
    for rule in PADDING:
        (kind, _), = rule.columns.values()
        plan += [rule.spec({**have, kind: [c]}, plan) for c in have[kind][1:]]
    plan += [{"type": "missing_values_bar"}] * PACK_SIZE
    return plan[:PACK_SIZE]


def spec_key(spec: dict) -> tuple:
    """What makes two specs the same: type, the set of columns, aggregation."""
    single = [v for k, v in spec.items() if k.endswith("column")]
    return spec["type"], frozenset(single + list(spec.get("columns", []))), spec.get("aggregation", "")


def signature(spec: dict) -> str:
    """The key as text, for display: type | sorted columns | aggregation."""
    kind, cols, agg = spec_key(spec)
    return f"{kind}|{'_'.join(sorted(cols))}|{agg}"


def dedup_specs(specs: list[dict]) -> list[dict]:
    """Drop specs whose key was already seen (first wins)."""
    return list({spec_key(s): s for s in reversed(specs)}.values())[::-1]


def plan_df(spark: SparkSession, plan: list[dict]) -> DataFrame:
    rows = [(i, s["type"], s.get("column") or s.get("group_column") or s.get("date_column"),
             s.get("x_column"), s.get("y_column") or s.get("value_column"),
             ",".join(s["columns"]) if s.get("columns") else None, s.get("aggregation"), signature(s))
            for i, s in enumerate(plan)]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def run_spec(df: DataFrame, spec: dict) -> DataFrame:
    t = spec["type"]
    if t == "missing_values_bar":
        return X.missing_by_column(df)
    if t == "numeric_distribution":
        return X.histogram(df, spec["column"])
    if t == "categorical_frequency":
        return X.category_frequency(df, spec["column"], spec.get("top_n", 10))
    if t == "correlation_heatmap":
        return X.correlation_matrix(df)
    if t == "scatter":
        return X.scatter_stats(df, spec["x_column"], spec["y_column"])
    if t == "boxplot_outliers":
        return X.box_stats(df, spec.get("columns"))
    if t == "time_trend":
        return X.time_trend_buckets(df, spec["date_column"], spec["value_column"])
    if t == "grouped_bar":
        return X.grouped_agg(df, spec["group_column"], spec["value_column"], spec.get("aggregation", "mean"))
    raise ValueError(f"unknown result type {t}")


def run_pack(df: DataFrame, p: Profile) -> dict[int, DataFrame]:
    """Plan → {index: lazy DataFrame} over the same input."""
    return {i: run_spec(df, s) for i, s in enumerate(dedup_specs(default_plan(p)))}


def _items(kind: str, r: DataFrame) -> DataFrame:
    """A result as (item, value) rows."""
    def rows(*pairs):
        return r.select(F.inline(F.array(*[F.struct(i.alias("item"), v.cast("double").alias("value")) for i, v in pairs])))
    if kind == "missing_values_bar":
        return rows((F.col("name"), F.col("missing")))
    if kind == "numeric_distribution":
        return rows((F.col("bin").cast("string"), F.col("n")))
    if kind == "categorical_frequency":
        return rows((F.col("value"), F.col("n")))
    if kind == "correlation_heatmap":
        return rows((F.concat_ws(" ~ ", "x", "y"), F.col("r")))
    if kind == "scatter":
        return rows(*[(F.lit(c), F.col(c)) for c in ("correlation", "n_points")])
    if kind == "boxplot_outliers":
        return rows(*[(F.concat_ws(".", F.col("name"), F.lit(c)), F.col(c))
                      for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")])
    if kind == "time_trend":
        return rows((F.date_format("bucket", "yyyy-MM-dd"), F.col("mean")))
    return rows((F.col("grp"), F.col("value")))


def pack_results(df: DataFrame, p: Profile) -> DataFrame:
    """V9 as one run: (chart_index, chart_type, item, value) of every planned result."""
    specs = dedup_specs(default_plan(p))
    parts = [_items(s["type"], r).select(F.lit(i).alias("chart_index"), F.lit(s["type"]).alias("chart_type"), "item", "value")
             for (i, r), s in zip(run_pack(df, p).items(), specs, strict=True)]
    return reduce(DataFrame.unionByName, parts)
