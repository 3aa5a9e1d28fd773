"""A column profile that grows with its table.

Every input file has one state row per column, of bounded size: counts, extremes and moments, a distinct
sketch, a Misra-Gries summary of frequent values and a histogram of 64 buckets an octave. All of them
merge, so a table that got new files is profiled by reading those alone: ``update`` adds the rows of files
it does not know (by path, size and time of change), ``merged_profile`` puts together the rows of the
files that are there. It does not matter in how many steps or in which order files came.

Exact in the merged profile: rows, missing values, types and the datetime vote, minimum, maximum, and
mean and deviation up to the rounding of sums; top values and distinct counts where no summary had to
let a value go (``exact`` says so). Otherwise the distinct count is the sketch's estimate (within about
2 %) and the top counts are lower bounds. Quartiles come from the histogram, within about 1 % of their
value, and with them the outlier share. Duplicate rows need the rows themselves and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_text, is_missing
from ..functions.numeric import as_double, family_of
from ..functions.quantiles import _octave_bucket
from ..functions.text import parse_datetime
from ..session import ship
from .heavy import MisraGries
from .profile import Profile, _py_round, top_k_values, tukey_fences

#: Logarithm of the distinct sketch's size.
SKETCH_LOG = 12
FILE = ["path", "size", "changed"]
STATE = ("path string, size bigint, changed timestamp, k int, name string, dtype string, n bigint, missing bigint, c bigint, lo double, hi double, "
         "mean double, m2 double, dates bigint, sketch binary, lost bigint, counters array<struct<value:string,n:bigint>>, "
         "buckets array<struct<bucket:double,n:bigint>>")


def _counters(columns: int) -> Callable:
    """Summaries of the text columns behind the file's path, one per file and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of = None, []

        def rows() -> pa.RecordBatch:
            for s in of:
                s.shrink()
            made = [(at, k, v, n) for k, s in enumerate(of) for v, n in [(None, s.lost), *s.counts.items()] if v is not None or n]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.string()), pa.array([r[1] for r in made], pa.int32()),
                                               pa.array([r[2] for r in made], pa.string()), pa.array([r[3] for r in made], pa.int64())],
                                              names=["path", "k", "value", "n"])
        for b in batches:
            paths = b.column(0).dictionary_encode()
            for i, path in enumerate(paths.dictionary.to_pylist()):
                if path != at:
                    if of:
                        yield rows()
                    at, of = path, [MisraGries() for _ in range(columns)]
                mine = b if len(paths.dictionary) == 1 else b.filter(pc.equal(paths.indices, i))
                for k, s in enumerate(of):
                    s.add(mine.column(k + 1).drop_null())
        if of:
            yield rows()
    return run


def file_states(df: DataFrame) -> DataFrame:
    """State rows of the files that ``df``, a plain read of files, is made of."""
    spark = df.sparkSession
    ship(spark)
    fields = df.schema.fields
    source = df.select("*", F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time"))
    rows = source.toDF(*[f"c{i}" for i in range(len(fields))], *FILE)
    structs = []
    for i, f in enumerate(fields):
        c, fam = F.col(f"c{i}"), family_of(f.dataType)
        v = as_double(c.cast("int") if fam == "boolean" else c) if fam in ("numeric", "boolean") else F.lit(None).cast("double")
        date = parse_datetime(c).isNotNull() if fam == "text" else F.lit(False)
        structs.append(F.struct(F.lit(i).alias("k"), is_missing(c, f.dataType).alias("gap"), v.alias("v"), date.alias("date"), as_text(c, f.dataType).alias("t")))
    long = rows.select(*FILE, F.inline(F.array(*structs)))
    key = ["path", "k"]
    basic = long.groupBy(*FILE, "k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("gap").alias("missing"), F.count("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), F.count_if("date").alias("dates"),
        F.hll_sketch_agg("t", F.lit(SKETCH_LOG)).alias("sketch"))
    tracked = (rows.select("path", *[as_text(F.col(f"c{i}"), f.dataType).alias(f"t{i}") for i, f in enumerate(fields)])
               .mapInArrow(_counters(len(fields)), "path string, k int, value string, n bigint")
               .groupBy("path", "k", "value").agg(F.sum("n").alias("n")).groupBy(*key).agg(
                   F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("lost"),
                   F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n"))).alias("counters")))   # TRACKED a task of the file
    spread = (long.where("v IS NOT NULL").groupBy(*key, _octave_bucket(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
              .groupBy(*key).agg(F.collect_list(F.struct("bucket", "n")).alias("buckets")))   # 64 an octave
    names = F.array(*[F.lit(f.name) for f in fields])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
    out = basic.join(tracked, key, "left").join(spread, key, "left")
    cols = {"name": F.element_at(names, F.col("k") + 1), "dtype": F.element_at(types, F.col("k") + 1), "lost": F.coalesce("lost", F.lit(0))}
    return out.withColumns(cols).select(*T.StructType.fromDDL(STATE).names)


def update(spark: SparkSession, files: list[str] | str, state_path: str, fmt: str = "parquet") -> list[str]:
    """Add the states of the files under ``files`` that ``state_path`` (Parquet, appended to) does not hold yet;
    the paths that were read."""
    listed = _listed(spark, files)
    known = _stored(spark, state_path)
    fresh = listed if known is None else listed.join(known.select(*FILE).distinct(), FILE, "left_anti")
    new = [r["plain"] for r in fresh.select("plain").collect()]   # file names, as Spark's own listing
    if new:
        file_states(spark.read.format(fmt).load(new)).write.mode("append").parquet(state_path)
    return new


def _listed(spark: SparkSession, files: list[str] | str) -> DataFrame:
    """Path, size and time of change of the files; their content is not read."""
    found = spark.read.format("binaryFile").load(files)
    return found.select(F.col("path").alias("plain"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_modification_time").alias("changed"))


def _stored(spark: SparkSession, state_path: str) -> DataFrame | None:
    try:
        return spark.read.schema(STATE).parquet(state_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def current_states(spark: SparkSession, files: list[str] | str, state_path: str) -> DataFrame:
    """The stored rows of the files that are there now; a file that changed or went counts no more."""
    known = spark.read.schema(STATE).parquet(state_path)
    return known.join(_listed(spark, files), FILE, "left_semi")


def merged_columns(states: DataFrame) -> DataFrame:
    """One row per column: the states of all files put together."""
    total = states.groupBy("k", "name", "dtype").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum(F.col("c") * F.col("mean")).alias("s"), F.sum("dates").alias("dates"), F.sum("lost").alias("lost"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    total = total.withColumn("mu", F.try_divide("s", "c"))
    # sums of squares about the common mean; a row per column goes to every task
    about = states.join(F.broadcast(total.select(F.col("k").alias("of_k"), "mu")), F.col("k") == F.col("of_k"))
    m2 = about.groupBy(F.col("k").alias("m_k")).agg(F.sum(F.col("m2") + F.col("c") * (F.col("mean") - F.col("mu")) ** 2).alias("m2"))
    values = states.select("k", F.inline("counters")).groupBy("k", "value").agg(F.sum("n").alias("n"))
    seen = values.groupBy(F.col("k").alias("v_k")).agg(F.count(F.lit(1)).alias("seen"))
    return (total.join(m2, F.col("k") == F.col("m_k"), "left").join(seen, F.col("k") == F.col("v_k"), "left")
            .select("k", "name", "dtype", "n", "missing", "c", "lo", "hi", "mu", F.sqrt(F.try_divide(F.col("m2"), F.col("c") - 1)).alias("sd"), "dates",
                    F.when(F.col("lost") == 0, F.coalesce("seen", F.lit(0))).otherwise(F.greatest("estimate", F.coalesce("seen", F.lit(0)))).alias("unique_count"),
                    (F.col("lost") == 0).alias("exact")))


def merged_values(states: DataFrame, top_n: int = 5) -> DataFrame:
    """(k, value, n, rank) of the most frequent values."""
    return top_k_values(states.select("k", F.inline("counters")).groupBy("k", "value").agg(F.sum("n").alias("n")), top_n)


def merged_profile(states: DataFrame, table_name: str = "table", top_n: int = 5) -> Profile:
    """The profile that the states add up to; see the module docstring for what is exact."""
    columns = sorted(merged_columns(states).collect(), key=lambda r: r["k"])          # a row per column
    tops: dict[int, list] = {}
    for r in merged_values(states, top_n).collect():
        tops.setdefault(r["k"], []).append((r["rank"], r["value"], int(r["n"])))
    spread = {r["k"]: sorted((x["bucket"], x["n"]) for x in r["b"]) for r in
              states.select("k", F.inline("buckets")).groupBy("k", "bucket").agg(F.sum("n").alias("n"))
              .groupBy("k").agg(F.collect_list(F.struct("bucket", "n")).alias("b")).collect()}   # 64 numbers an octave and column
    out = []
    for r in columns:
        n, gaps, kind = int(r["n"]), int(r["missing"]), _type_class(r)
        rec = dict(pos=r["k"], name=r["name"], dtype=r["dtype"], column_type=kind, missing_count=gaps,
                   missing_pct=_py_round(100.0 * gaps / n, 2) if n else 0.0, unique_count=int(r["unique_count"]), exact=bool(r["exact"]),
                   is_constant=r["unique_count"] <= 1, min=None, max=None, mean=None, std=None, outlier_pct=None, high_cardinality=None, top_values=None)
        if kind == "numeric" and r["c"]:
            rec.update(min=r["lo"], max=r["hi"], mean=_py_round(r["mu"], 4), std=_py_round(r["sd"], 4),
                       outlier_pct=_outlier_share(spread[r["k"]], r["lo"], r["hi"]))
        elif kind == "numeric":
            rec.update(outlier_pct=0.0)
        elif kind in ("categorical", "nested"):
            rec.update(high_cardinality=r["unique_count"] > 50, top_values=[(v, c) for _, v, c in sorted(tops.get(r["k"], []))])
        out.append(rec)
    return Profile(table_name, int(columns[0]["n"]) if columns else 0, len(columns), 0, out)


def _type_class(r) -> str:
    t = r["dtype"]
    if t in ("timestamp", "timestamp_ntz", "date") or (t == "string" and 0 < r["dates"] == r["n"] - r["missing"]):
        return "datetime"
    if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or t.startswith("decimal"):
        return "numeric"
    return "nested" if t.startswith(("array", "map", "struct")) else "categorical"


def _edges(bucket: float, lo: float, hi: float) -> tuple[float, float]:
    """The values a bucket stands for, within the column's extremes."""
    if bucket == 0.0 or abs(bucket) >= 200_000.0:
        x = 0.0 if bucket == 0.0 else float("inf") * bucket
        return x, x
    a, b = (2.0 ** ((abs(bucket) - 80_000.0 + d) / 64.0) for d in (0, 1))
    a, b = (a, b) if bucket > 0 else (-b, -a)
    return min(max(a, lo), hi), max(min(b, hi), lo)


def _outlier_share(buckets: list[tuple[float, int]], lo: float, hi: float) -> float:
    total = sum(n for _, n in buckets)

    def quantile(q: float) -> float:
        rank, before = q * (total - 1), 0
        for b, n in buckets:
            if rank < before + n:
                x, y = _edges(b, lo, hi)
                return x if x == y else x + (y - x) * (rank - before + 0.5) / n
            before += n
        return hi
    low, high = tukey_fences(quantile(0.25), quantile(0.75))
    out = 0.0
    for b, n in buckets:
        x, y = _edges(b, lo, hi)
        beyond = (1.0 if x < low or x > high else 0.0) if x == y else max(0.0, min(y, low) - x) / (y - x) + max(0.0, y - max(x, high)) / (y - x)
        out += n * min(1.0, beyond)
    return _py_round(100.0 * out / total, 2)
