"""Exact quantiles of many columns at once, fully distributed.

Spark's ``percentile`` merges a value→count map for the whole column into one
task, which does not survive a high-cardinality column at scale. Here a
quantile takes two passes over the table and a look at a few values:

* a target is an order statistic (0-based rank ``r`` among the non-null
  values of a column); linear interpolation needs ranks ``floor(h)`` and
  ``ceil(h)`` with ``h = q·(n-1)`` (numpy "linear", DuckDB ``quantile_cont``);
* the first pass builds a mergeable quantile sketch of every column
  (``percentile_approx``, whose size does not depend on the rows) and asks it
  for values a little below and above each target: a bracket;
* the second pass counts, per bracket, the values below it and inside it. The
  counts are exact, so they prove whether the bracket holds its ranks;
* the third reads only rows with a value inside some bracket and counts them
  value by value; a running count finds the ranks.

A bracket that does not hold its ranks, or holds more than 65,536 values, is
resolved by *histogram refinement*, which needs no sketch: each round counts
rows per (bracket, bucket) and keeps the bucket that holds the rank. Buckets
are monotone in the value whatever its scale: a bracket wider than 2 % of its
value is cut into 64 parts of every octave of ``|v|`` (zero and the infinities
apart), so no difference of two far values is ever taken; a narrower one into
65,536 equal parts. The 52 mantissa bits are used up after three of those.

Hot values (one value holding a third of the rows) resolve at once because
their bracket has min == max. The driver never holds more than one row per
target per pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .columns import by_position
from .numeric import as_double

_BRACKET_SCHEMA = T.StructType([
    T.StructField("b", T.IntegerType(), False),
    T.StructField("k", T.IntegerType(), False),
    T.StructField("lo", T.DoubleType(), False),
    T.StructField("hi", T.DoubleType(), False),
    T.StructField("kind", T.StringType(), False),
])
_TARGET_SCHEMA = T.StructType([
    T.StructField("b", T.IntegerType(), False),
    T.StructField("tid", T.IntegerType(), False),
    T.StructField("t", T.LongType(), False),
])


BUCKETS = 65_536
#: Accuracy of the sketch: ranks are off by at most one in so many values.
SKETCH = 10_000
#: Columns in one wide aggregate, which bounds its generated code.
COLUMNS_AT_ONCE = 40


def _octave_bucket(v):
    """Signed 1/64-octave of ``v``: grows with it over the whole double range."""
    part = F.floor(F.log2(F.abs(v)) * 64.0).cast("double") + 80_000.0
    part = F.when(F.abs(v) == float("inf"), F.lit(200_000.0)).otherwise(part)
    return F.when(v == 0.0, F.lit(0.0)).otherwise(F.signum(v) * part)


@dataclass
class _Target:
    k: int
    rank: int           # global 0-based rank inside column k
    lo: float
    hi: float
    offset: int         # number of column values ordered before the bracket
    count: int          # values inside the bracket
    value: float | None = None


def _chunks(items: list, size: int = COLUMNS_AT_ONCE) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def column_counts(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """(non-null count, min, max) per column in one fused aggregate."""
    p, col = by_position(df)
    aggs = []
    for i, c in enumerate(columns):
        v = as_double(col(c))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = p.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def _sketched(values: DataFrame, columns: int, probs: list[float]) -> dict[int, tuple]:
    """Pass 1: per column position (count, min, max, the sketch's value around every probability: low, high, …)."""
    edges = [min(1.0, max(0.0, p + d / SKETCH)) for p in probs for d in (-2.0, 2.0)]
    out = {}
    for ks in _chunks(list(range(columns))):
        row = values.agg(*[a for k in ks for a in (
            F.count(f"v{k}").alias(f"n{k}"), F.min(f"v{k}").alias(f"lo{k}"), F.max(f"v{k}").alias(f"hi{k}"),
            F.percentile_approx(f"v{k}", edges, SKETCH).alias(f"s{k}"))]).first()
        for k in ks:
            out[k] = (row[f"n{k}"], row[f"lo{k}"], row[f"hi{k}"], row[f"s{k}"])
    return out


def _counted(values: DataFrame, brackets: dict[int, list[tuple[float, float]]]) -> dict[tuple, tuple[int, int]]:
    """Pass 2: how many values of its column lie below each bracket, and inside it."""
    out = {}
    for ks in _chunks(sorted(brackets)):
        asked = [(k, lo, hi) for k in ks for lo, hi in brackets[k]]
        row = values.agg(*[a for i, (k, lo, hi) in enumerate(asked) for a in (
            F.count_if(F.col(f"v{k}") < lo).alias(f"b{i}"), F.count_if(F.col(f"v{k}").between(lo, hi)).alias(f"i{i}"))]).first()
        out |= {b: (row[f"b{i}"], row[f"i{i}"]) for i, b in enumerate(asked)}
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], *,
                    stats: dict[str, tuple[int, float | None, float | None]] | None = None,
                    ) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles ``probs`` for each numeric column.

    Returns ``{column: [value per prob]}``; ``None`` for columns without
    non-null values. ``stats`` may pass precomputed (count, min, max); columns
    known to have few values then need no sketch."""
    if not columns:
        return {}
    spark = df.sparkSession
    p, col = by_position(df)
    values = p.select(*[as_double(col(c)).alias(f"v{k}") for k, c in enumerate(columns)])
    few = stats is not None and max((stats[c][0] or 0) for c in columns) <= BUCKETS
    sketch = {} if few else _sketched(values, len(columns), probs)
    sizes = {k: stats[c] if few else sketch[k][:3] for k, c in enumerate(columns)}

    targets: list[_Target] = []
    needs: dict[tuple[int, int], _Target] = {}
    plan: dict[str, list[tuple[int, int, float] | None]] = {}
    around: dict[tuple[int, int], tuple[float, float]] = {}      # the sketch's bracket of a target
    for k, c in enumerate(columns):
        n, lo, hi = sizes[k]
        if not n:
            plan[c] = [None] * len(probs)
            continue
        rows = []
        for i, q in enumerate(probs):
            h = q * (n - 1)
            r0 = int(math.floor(h))
            r1 = min(r0 + 1, n - 1)
            rows.append((r0, r1, h - r0))
            for r in (r0, r1):
                if (k, r) not in needs:
                    t = _Target(k, r, float(lo), float(hi), 0, int(n))
                    if lo == hi:
                        t.value = float(lo)
                    elif n > BUCKETS:
                        # the sketch's ends are values of the column; the outermost ranks reach to its extremes
                        at = sketch[k][3][2 * i:2 * i + 2]
                        around[(k, r)] = (float(lo) if q * SKETCH <= 2 else at[0], float(hi) if (1 - q) * SKETCH <= 2 else at[1])
                    needs[(k, r)] = t
                    targets.append(t)
        plan[c] = rows
    if around:
        brackets: dict[int, list] = {}
        for (k, _), b in around.items():
            if b not in brackets.setdefault(k, []):
                brackets[k].append(b)
        counts = _counted(values, brackets)
        for (k, r), (lo, hi) in around.items():
            below, inside = counts[(k, lo, hi)]
            if below <= r < below + inside:      # proven; otherwise the whole column stays the bracket
                t = needs[(k, r)]
                t.lo, t.hi, t.offset, t.count = lo, hi, below, inside
                if lo == hi:
                    t.value = lo

    while open_t := [t for t in targets if t.value is None]:
        # distinct brackets; bounded by the number of targets (columns × probs × 2)
        brackets_of: dict[tuple, int] = {}
        for t in open_t:
            brackets_of.setdefault((t.k, t.lo, t.hi, t.offset, t.count), len(brackets_of))
        br_rows = [(b, k, lo, hi, "value" if cnt <= BUCKETS else "linear" if _narrow(lo, hi) else "octave")
                   for (k, lo, hi, _off, cnt), b in brackets_of.items()]
        tg_rows = [(brackets_of[(t.k, t.lo, t.hi, t.offset, t.count)], i, t.rank - t.offset) for i, t in enumerate(open_t)]
        table = spark.createDataFrame(br_rows, _BRACKET_SCHEMA)
        tgts = spark.createDataFrame(tg_rows, _TARGET_SCHEMA)

        # a row matters only if some column falls in a bracket, and then only those columns
        inside_of: dict[int, object] = {}
        for k, lo, hi, _, _ in brackets_of:
            cond = F.col(f"v{k}").between(lo, hi)
            inside_of[k] = inside_of[k] | cond if k in inside_of else cond
        pre = reduce(lambda a, b: a | b, inside_of.values())
        long = values.where(pre).select(F.inline(F.array(*[
            F.struct(F.lit(k).cast("int").alias("k"), F.when(cond, F.col(f"v{k}")).alias("v")) for k, cond in inside_of.items()])))
        src = long.where(F.col("v").isNotNull())

        j = src.join(F.broadcast(table),   # bounded by columns × probabilities
                     (src.k == table.k) & src.v.between(table.lo, table.hi))
        v = F.col("v")
        share = (v - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(5e-324))
        linear = F.least(F.floor(share * float(BUCKETS)), F.lit(BUCKETS - 1)).cast("double")
        bucket = (F.when(F.col("kind") == "value", v).when(F.col("kind") == "octave", _octave_bucket(v))
                  .otherwise(linear))
        hist = (j.groupBy("b", bucket.alias("key"))
                .agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("vmin"), F.max("v").alias("vmax")))
        w = Window.partitionBy("b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
        hit = (tgts.join(hist, "b")
               .where((F.col("t") >= F.col("before")) & (F.col("t") < F.col("before") + F.col("cnt")))
               .select("tid", "before", "cnt", "vmin", "vmax"))
        for row in hit.collect():
            t = open_t[row["tid"]]
            if row["vmin"] == row["vmax"]:
                t.value = float(row["vmin"])
            else:
                t.offset += int(row["before"])
                t.lo, t.hi, t.count = float(row["vmin"]), float(row["vmax"]), int(row["cnt"])

    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(columns):
        vals = []
        for r in plan[c]:
            if r is None:
                vals.append(None)
                continue
            r0, r1, frac = r
            a, b = needs[(k, r0)].value, needs[(k, r1)].value
            vals.append(a if frac == 0 or a == b else a + (b - a) * frac)
        out[c] = vals
    return out


def _narrow(lo: float, hi: float) -> bool:
    """A bracket that spans at most 2 % of its value."""
    return math.isfinite(lo) and math.isfinite(hi) and lo * hi > 0 and min(abs(lo), abs(hi)) > 0.98 * max(abs(lo), abs(hi))


def grouped_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(grp, n, median) of the non-null values of every non-null group, exact.

    The same refinement with the brackets of all groups as a table: groups are
    unbounded, so nothing of them reaches the driver but the number still
    open. The window holds the buckets of one group's bracket."""
    p, col = by_position(df)
    src = p.select(col(group).cast("string").alias("grp"), as_double(col(value)).alias("v")).dropna()
    size = src.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array(*[F.struct(F.lit(i).alias("side"), F.floor((F.col("n") - 1 + i) / 2).cast("long").alias("t")) for i in (0, 1)])
    state = cut_lineage(size.select("grp", "n", F.inline(ranks), "lo", "hi", F.col("n").alias("cnt"),
                                    F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("found")))
    first = True
    while state.where(F.col("found").isNull()).limit(1).count():
        todo = state.where(F.col("found").isNull())
        inside = src.join(todo.select("grp", "side", "t", "lo", "hi", "cnt"), "grp").where(F.col("v").between(F.col("lo"), F.col("hi")))
        v = F.col("v")
        linear = F.least(F.floor((v - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(5e-324)) * float(BUCKETS)),
                         F.lit(BUCKETS - 1)).cast("double")
        key = F.when(F.col("cnt") <= BUCKETS, v).otherwise(_octave_bucket(v) if first else linear)
        hist = (inside.groupBy("grp", "side", "t", key.alias("key"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        w = Window.partitionBy("grp", "side").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        hit = hist.where((F.col("t") >= F.col("before")) & (F.col("t") < F.col("before") + F.col("c")))
        new = hit.select("grp", "side", (F.col("t") - F.col("before")).alias("t"), "lo", "hi", F.col("c").alias("cnt"),
                         F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("found"))
        done = state.where(F.col("found").isNotNull())
        state = cut_lineage(done.unionByName(new.join(todo.select("grp", "side", "n"), ["grp", "side"]).select(*done.columns)))
        first = False
    return state.groupBy("grp").agg(F.first("n").alias("n"), (F.min("found") + (F.max("found") - F.min("found")) * 0.5).alias("median"))


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """One-pass ``percentile_approx`` (returns actual data values; opt-in)."""
    if not columns:
        return {}
    p, col = by_position(df)
    row = p.agg(*[F.percentile_approx(as_double(col(c)), probs, accuracy).alias(f"q{i}")
                  for i, c in enumerate(columns)]).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: list[str], probs: list[float], method: str = "exact",
              stats=None) -> dict[str, list[float | None]]:
    if method == "approx":
        return approx_quantiles(df, columns, probs)
    return exact_quantiles(df, columns, probs, stats=stats)
