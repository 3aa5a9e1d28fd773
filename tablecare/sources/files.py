"""File sources and sinks.

All reads go through Spark's distributed readers with an explicit schema;
only the header line is parsed on the driver.
"""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_position, with_values
from ..functions.numeric import family_of
from ..functions.text import first_free, flatten_newlines
from ..session import ensure_checkpoint_dir
from .ranges import csv_records, first_record, json_records

CORRUPT = "_malformed"


def repair_header(names: list[str]) -> list[str]:
    """Blank names → ``unnamed_<k>`` (1-based); a repeat gets the first of
    ``_2``, ``_3`` … that no earlier column has."""
    stripped = [str(n or "").strip() for n in names]
    taken: set[str] = set()
    return [first_free(n or f"unnamed_{k}", taken, 2) for k, n in enumerate(stripped, 1)]


def _header_names(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = first_record(spark, path, sep)
    if first is None:
        raise ValueError(f"{path} is empty")
    return next(csv.reader(io.StringIO(first), delimiter=sep))


def _field_count(record: Column, sep: str) -> Column:
    """Fields of a raw CSV record: separators outside quotes, plus one."""
    bare = F.regexp_replace(record, '"([^"]|"")*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1


def _raw_csv(spark: SparkSession, path: str, names: int, sep: str, multiline: bool) -> DataFrame:
    """Fields as ``_c0`` …; ``CORRUPT`` holds the raw record wherever the number of fields is not ``names``."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(names)]
                          + [T.StructField(CORRUPT, T.StringType())])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "sep": sep}
    if multiline:
        rows = csv_records(spark, path, sep).where(~F.col("first"))
        return rows.select(F.from_csv("text", schema.toDDL(), options).alias("r")).select("r.*")
    raw = spark.read.schema(schema).options(header=True, columnPruning=False, enforceSchema=True, **options).csv(path)
    # Spark refuses a query of the malformed column alone, so every query asks for the first field as well
    return raw.where(F.coalesce(F.length("_c0"), F.lit(0)) >= 0)


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", flatten: bool = True, repair: bool = True,
             multiline: bool = True, reject_empty: bool = True) -> DataFrame:
    """CSV with header and quoted multi-line fields.

    Rows with too many fields are dropped whatever the extra fields hold
    (``csv_dropped_rows`` counts them), rows with too few are NULL-padded. All
    columns are read as strings; typing is the job of the cleaning vote
    (C5/C6). A table without rows is rejected unless ``reject_empty`` is off.

    Many tasks read one file although quoted fields may hold line breaks: a
    first pass over the bytes settles where each task's range starts within
    the quotes (:mod:`.ranges`). ``multiline=False`` saves that pass for files
    known to have no quoted line break."""
    header = _header_names(spark, path, sep)
    names = repair_header(header) if repair else header
    raw = _raw_csv(spark, path, len(names), sep, multiline)
    fits = F.col(CORRUPT).isNull() | (_field_count(F.col(CORRUPT), sep) <= len(names))
    df = raw.where(fits).drop(CORRUPT).toDF(*names)
    df = flatten_text(df) if flatten else df
    return non_empty(df, path) if reject_empty else df


def csv_dropped_rows(spark: SparkSession, path: str, *, sep: str = ",", multiline: bool = True) -> int:
    """Number of rows ``read_csv`` drops for having too many fields."""
    n = len(_header_names(spark, path, sep))
    raw = _raw_csv(spark, path, n, sep, multiline)
    return raw.where(F.col(CORRUPT).isNotNull() & (_field_count(F.col(CORRUPT), sep) > n)).count()


def read_json(spark: SparkSession, path: str, *, lines: bool = False, flatten: bool = True, mode: str = "FAILFAST",
              reject_empty: bool = True) -> DataFrame:
    """Array-of-records JSON documents, or one object after another. A malformed record raises;
    ``mode="DROPMALFORMED"`` drops such records instead.

    Many tasks cut a document into its records (:mod:`.ranges`), which are written as JSON lines to
    the shared checkpoint folder and read from there, so that the schema is inferred from all of them.
    ``lines=True`` reads JSON lines as they are."""
    if not lines:
        found = json_records(spark, path, strict=mode == "FAILFAST")
        target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
        found.select(F.translate("text", "\r\n", "  ").alias("value")).write.text(target)
        path = target
    df = spark.read.option("mode", mode).json(path)
    df = flatten_text(df) if flatten else df
    return non_empty(df, path) if reject_empty else df


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no rows or no columns."""
    if not df.columns or df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def flatten_text(df: DataFrame) -> DataFrame:
    """In every text column replace newlines by spaces and strip — one
    projection, no UDF."""
    return with_values(df, {f.name: flatten_newlines for f in df.schema.fields if family_of(f.dataType) == "text"})


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows under an explicit total order, NULL shown as ''."""
    p, col = by_position(df)
    keys = order_by or df.columns
    return (p.orderBy(*[col(k).asc_nulls_first() for k in keys]).limit(n)
            .select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in p.columns]).toDF(*df.columns))


def load_summary(df: DataFrame) -> DataFrame:
    """I8: one row (n_rows, n_cols, columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the cleaned table (CSV with header and doubled quotes when
    asked, as :func:`read_csv` reads it; parquet by default)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)

