"""Safe cleaning (C1-C9) and the renamed-columns listing (Q2).

``fit_safe_clean`` runs ONE aggregate over the table (trim changes, new
nulls from missing tokens, numeric and datetime votes for every text column)
and returns a small :class:`SafeCleanSpec`. ``apply_safe_clean`` is then a
pure projection plus ``dropDuplicates`` — lazy, codegen'd, and reusable on
any DataFrame with the same schema (including a stream, see
``tablecare.streaming``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import with_values
from ..functions.numeric import family_of
from ..functions.sentences import DETAILS, as_column, entry
from .profile import drop_duplicate_rows
from ..functions.text import (edge_trim, first_free, guarded_double, is_missing_token, parse_datetime, snake_case,
                              snake_case_name)

LOG_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("n", T.LongType()),
])
#: Type of a column of integers some of which a bigint cannot hold.
LONG_INTEGER = "decimal(38,0)"
INTEGER_GUARD = r"^\s*[+-]?[0-9]+\s*$"


def rename_map(names: list[str]) -> list[tuple[str, str]]:
    """(original, snake_case) per column; a repeat gets the first of
    ``_1``, ``_2`` … that no earlier column has."""
    taken: set[str] = set()
    return [(name, first_free(snake_case_name(name), taken, 1)) for name in names]


def rename_map_df(names: DataFrame, table_col: str = "table_key", pos_col: str = "pos",
                  name_col: str = "original") -> DataFrame:
    """C2 over a long table of (table, position, name): the same rule for
    every table at once. One group holds one table's column list; its names
    are folded in column order, so a generated name is never given twice."""
    item = F.struct(F.col(pos_col).cast("int").alias("pos"), F.col(name_col).alias("original"),
                    snake_case(F.col(name_col)).alias("base"))
    listed = names.groupBy(table_col).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def free(taken, base):
        tries = F.transform(F.sequence(F.lit(0), F.size(taken)),
                            lambda i: F.when(i == 0, base).otherwise(F.concat_ws("_", base, i.cast("string"))))
        return F.element_at(F.filter(tries, lambda n: ~F.array_contains(taken, n)), 1)

    cleaned = F.aggregate("items", F.array().cast("array<string>"),
                          lambda taken, x: F.concat(taken, F.array(free(taken, x["base"]))))
    pairs = F.arrays_zip(F.col("items").alias("item"), cleaned.alias("cleaned"))
    return listed.select(table_col, F.explode(pairs).alias("p")).select(
        table_col, F.col("p.item.pos").alias("pos"), F.col("p.item.original").alias(name_col), F.col("p.cleaned").alias("cleaned"))


def rename_columns(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    mapping = rename_map(df.columns)
    return df.toDF(*[new for _, new in mapping]), mapping


def renamed_columns_df(spark: SparkSession, mapping: list[tuple[str, str]]) -> DataFrame:
    """Q2: pairs whose name changed."""
    return spark.createDataFrame([(o, n) for o, n in mapping if o != n],
                                 "original string, cleaned string")


def trim_text(df: DataFrame) -> DataFrame:
    """Strip leading/trailing Unicode whitespace in all text columns."""
    return with_values(df, {n: edge_trim for n in text_columns(df)})


def null_missing_tokens(df: DataFrame) -> DataFrame:
    """C4: exact, case-sensitive missing tokens → NULL in text columns."""
    return with_values(df, {n: lambda x: F.when(~is_missing_token(x), x) for n in text_columns(df)})


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if family_of(f.dataType) == "text"]


@dataclass
class SafeCleanSpec:
    mapping: list[tuple[str, str]]
    text_cols: list[str]
    trimmed_cols: list[str]
    new_nulls: int
    coerced: list[tuple[str, str]] = field(default_factory=list)   # (column, "numeric[:type]"/"datetime")
    rows_before: int = 0


def _tokenized(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Project trimmed (``__t{i}``) and token-nulled (``__k{i}``) text once.

    The two selects stay separate plan nodes (Catalyst does not inline an
    expensive expression referenced several times), so the trim regex runs
    once per value however many guards read the result."""
    trimmed = df.select("*", *[edge_trim(F.col(c)).alias(f"__t{i}") for i, c in enumerate(text_cols)])
    return trimmed.select("*", *[F.when(~is_missing_token(F.col(f"__t{i}")), F.col(f"__t{i}")).alias(f"__k{i}")
                                 for i in range(len(text_cols))])


def _vote_long(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Vote counts per text column in the long layout, one row per column
    position ``k``: n, trimmed (raw ≠ trimmed), tokens (missing tokens),
    non_null, numeric_ok, integer_ok, datetime_ok. One ``groupBy(k)`` —
    constant code size for any number of columns."""
    staged = _tokenized(df, text_cols)
    long = staged.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col(c).alias("raw"), F.col(f"__t{i}").alias("t"),
                 F.col(f"__k{i}").alias("tok")) for i, c in enumerate(text_cols)])))
    tok = F.col("tok")
    return long.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw") != F.col("t")).alias("trimmed"),
        F.count_if(is_missing_token(F.col("t"))).alias("tokens"), F.count(tok).alias("non_null"),
        F.count(guarded_double(tok)).alias("numeric_ok"), F.count(F.when(tok.rlike(INTEGER_GUARD), F.trim(tok).try_cast("bigint"))).alias("integer_ok"),
        F.count_if(tok.rlike(INTEGER_GUARD)).alias("integers"),
        F.count(F.when(tok.rlike(INTEGER_GUARD), F.trim(tok).try_cast(LONG_INTEGER))).alias("long_ok"),
        F.count(parse_datetime(tok)).alias("datetime_ok"))


def vote_table(df: DataFrame) -> DataFrame:
    """C5/C6 vote per text column as a lazy DataFrame (after trim + tokens):
    (name, non_null, numeric_ok, datetime_ok, to_numeric, to_datetime)."""
    renamed, _ = rename_columns(df)
    text_cols = [f.name for f in renamed.schema.fields if family_of(f.dataType) == "text"]
    names = F.array(*[F.lit(c) for c in text_cols])
    v = _vote_long(renamed, text_cols)
    num = (F.col("numeric_ok") >= F.col("non_null") * 0.8) & (F.col("numeric_ok") > 0)
    dt = ~num & (F.col("datetime_ok") >= F.col("non_null") * 0.8) & (F.col("datetime_ok") > 0)
    return v.select(F.element_at(names, F.col("k") + 1).alias("name"),
                    F.col("non_null").cast("bigint").alias("non_null"),
                    F.col("numeric_ok").cast("bigint").alias("numeric_ok"),
                    F.col("datetime_ok").cast("bigint").alias("datetime_ok"),
                    num.alias("to_numeric"), dt.alias("to_datetime"))


def fit_safe_clean(df: DataFrame) -> SafeCleanSpec:
    """One aggregate over the renamed table decides everything (one row per
    text column comes back)."""
    renamed, mapping = rename_columns(df)
    text_cols = [f.name for f in renamed.schema.fields if family_of(f.dataType) == "text"]
    got = {r["k"]: r for r in _vote_long(renamed, text_cols).collect()} if text_cols else {}
    n = int(got[0]["n"]) if got else int(renamed.count())
    spec = SafeCleanSpec(mapping=mapping, text_cols=text_cols, rows_before=n,
                         trimmed_cols=[c for i, c in enumerate(text_cols) if i in got and got[i]["trimmed"] > 0],
                         new_nulls=sum(int(r["tokens"]) for r in got.values()))
    for i, c in enumerate(text_cols):
        if i not in got:
            continue
        r = got[i]
        nn, nu, dt = int(r["non_null"]), int(r["numeric_ok"]), int(r["datetime_ok"])
        if nu >= nn * 0.8 and nu > 0 and int(r["integers"]) > int(r["integer_ok"]):
            # integers beyond 64 bits: as doubles, different ones would become equal
            if int(r["long_ok"]) == nn:
                spec.coerced.append((c, f"numeric:{LONG_INTEGER}"))
        elif nu >= nn * 0.8 and nu > 0:
            # pandas keeps int64 only when every value is an integer and nothing is missing
            as_int = int(r["integer_ok"]) == nn == n
            spec.coerced.append((c, "numeric:bigint" if as_int else "numeric"))
        elif dt >= nn * 0.8 and dt > 0:
            spec.coerced.append((c, "datetime"))
    return spec


def apply_safe_clean(df: DataFrame, spec: SafeCleanSpec, dedup: bool = True) -> DataFrame:
    """Rename → trim → tokens → coerce (one projection) → dedup."""
    renamed = df.toDF(*[new for _, new in spec.mapping])
    kinds = dict(spec.coerced)
    text = [f.name for f in renamed.schema.fields if f.name in spec.text_cols]
    idx = {c: i for i, c in enumerate(text)}
    staged = _tokenized(renamed, text)
    cols = []
    for f in renamed.schema.fields:
        c = F.col(f.name)
        if f.name in idx:
            tok = F.col(f"__k{idx[f.name]}")
            kind = kinds.get(f.name)
            if kind and kind.startswith("numeric:"):
                c = F.trim(tok).try_cast(kind.split(":")[1])
            elif kind == "numeric":
                c = guarded_double(tok)
            elif kind == "datetime":
                c = parse_datetime(tok)
            else:
                c = tok
        cols.append(c.alias(f.name))
    out = staged.select(*cols)
    return drop_duplicate_rows(out) if dedup else out


def safe_clean_log(spark: SparkSession, spec: SafeCleanSpec, cleaned: DataFrame) -> DataFrame:
    """C8 as a lazy DataFrame: only the final row count needs the cleaned
    table, and it is computed only if the log is read."""
    rows = []
    renamed = [(o, n) for o, n in spec.mapping if o != n]
    if renamed:
        rows.append(entry("normalize_column_names", len(renamed)))
    if spec.trimmed_cols:
        rows.append(entry("trim_whitespace", len(spec.trimmed_cols)))
    if spec.new_nulls > 0:
        rows.append(entry("normalize_missing_tokens", spec.new_nulls))
    if spec.coerced:
        items = [f"{c} -> {k.split(':')[0]}" for c, k in spec.coerced]
        rows.append(entry("type_coercion", len(items), items=", ".join(items[:5]) + ("..." if len(items) > 5 else "")))
    fixed = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], LOG_SCHEMA)
    before = spec.rows_before
    k = len(rows)
    after = cleaned.agg(F.count(F.lit(1)).alias("after"))
    gone, left = F.lit(before) - F.col("after"), F.col("after")
    tail = after.select(F.explode(F.array(
        F.struct(F.lit(k + 1).alias("step"), F.lit("remove_duplicates").alias("action"),
                 as_column(DETAILS["remove_duplicates"], n=gone).alias("details"), gone.cast("bigint").alias("n")),
        F.struct(F.lit(k + 2).alias("step"), F.lit("safe_cleaning_complete").alias("action"),
                 as_column(DETAILS["safe_cleaning_complete"], before=F.lit(before), n=left).alias("details"),
                 left.cast("bigint").alias("n")))).alias("r")).select("r.*")
    tail = tail.where((F.col("action") != "remove_duplicates") | (F.col("n") > 0))
    # the complete-row keeps its step number even when no duplicate row was logged
    tail = tail.withColumn("step", F.when((F.col("action") == "safe_cleaning_complete")
                                          & (F.lit(before) == F.col("n")), F.lit(k + 1)).otherwise(F.col("step")))
    return fixed.unionByName(tail.select(F.col("step").cast("int"), "action", "details", "n"))


@dataclass
class CleanResult:
    df: DataFrame
    log: DataFrame
    spec: SafeCleanSpec

    @property
    def mapping(self) -> dict[str, str]:
        return {o: n for o, n in self.spec.mapping if o != n}


def safe_clean(df: DataFrame) -> CleanResult:
    """Fit (one action) + lazy apply + lazy log."""
    spec = fit_safe_clean(df)
    cleaned = apply_safe_clean(df, spec)
    return CleanResult(cleaned, safe_clean_log(df.sparkSession, spec, cleaned), spec)
