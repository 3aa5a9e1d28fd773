"""Helpers shared by the operators: reading tables, tables written in the shared
checkpoint folder, and row-wise Arrow maps that keep the input's columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than the six ASCII white spaces.
WORD_RX = r"[^\x20\x09-\x0D]+"
#: A frame with at most this many (narrow) rows may be broadcast; the count is taken first.
BROADCAST_ROWS = 100_000
#: Bytes of rows that Spark hands a Python worker at once: both sides hold such a batch, and buffers of its size, per core.
BATCH_BYTES = 2 << 20
#: Bits of the table that marks documents needed for verification; 64 to a row, so its size is fixed.
MARK_BITS = 1 << 22


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tablecare_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tablecare-code-")) / "tablecare_code.zip"  # the driver serves it to executors
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._tablecare_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most about ``BATCH_BYTES`` at once from now on, unless the session sets a size of its own.

    Spark's 10,000 rows of whole texts (at most 64 MB) would take several times that per core, outside the JVM's heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: What ``written`` has made in each of the open ``passing`` blocks, the innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` into the folder named by ``spark.checkpoint.dir`` and read it back.

    Later passes start from files that every executor sees, so a lost executor
    costs only its own tasks. With ``stays`` they outlive the innermost ``passing`` block."""
    spark = df.sparkSession
    ship(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    blocks = _MADE.get()[:-1] if stays else _MADE.get()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Delete the files of frames that came from ``written`` (or of their paths), when nothing reads them any more.

    Spark deletes the shuffle files behind them once the driver's garbage is collected, which is asked for here."""
    for f in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(f if isinstance(f, str) else f._path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        spark._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``written`` makes inside is deleted when the block ends, unless it ``stays``: a frame that
    is used later must not read it."""
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield
    finally:
        _MADE.reset(token)
        discard(spark, *made)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written frame for broadcast if it has at most ``rows`` rows; else leave
    the join to the planner, which then shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def _marks(ids: DataFrame, key: str) -> DataFrame:
    """A bit table of the hashes of ``ids``: at most 65,536 rows, so broadcasting it is safe."""
    bit = F.pmod(F.xxhash64(key), F.lit(MARK_BITS))
    return (ids.select(bit.alias("_b")).groupBy(F.shiftright("_b", 6).alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("_bits")))


_MARKED = "(shiftrightunsigned(_bits, cast(_bit & 63 as int)) & 1) = 1"


def marked(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ``ids``: a superset, found without shuffling ``docs``."""
    bit = F.pmod(F.xxhash64(key), F.lit(MARK_BITS))
    return (docs.withColumn("_bit", bit).join(F.broadcast(_marks(ids, key)), F.shiftright("_bit", 6) == F.col("_word"))
            .where(F.expr(_MARKED)).drop("_bit", "_word", "_bits"))


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is not among ``ids`` for sure, and the others."""
    bit = F.pmod(F.xxhash64(key), F.lit(MARK_BITS))
    known = rows.withColumn("_bit", bit).join(F.broadcast(_marks(ids, key)), F.shiftright("_bit", 6) == F.col("_word"), "left")
    unsure = F.coalesce(F.expr(_MARKED), F.lit(False))
    return known.where(~unsure).select(*rows.columns), known.where(unsure).select(*rows.columns)


def arrow_map(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable],
              keep: list[str] | None = None) -> DataFrame:
    """Add columns computed batch by batch in Python.

    ``make()`` is called once per task and returns ``f(batch) -> list of arrays``, one
    per field, as long as the batch. ``keep`` names the input columns that stay
    (default: all); one with a new column's name is replaced."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    types = to_arrow_schema(T.StructType(fields)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            made = f(b)
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            cols += [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *[x.name for x in fields]])

    return df.mapInArrow(run, schema)


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by integer keys, regrouped so that no group spans two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0]
                          for k, c in zip(keys, cols, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def texts(batch: pa.RecordBatch, name: str, size: int = 256, size_bytes: int = 0) -> Iterator[list[str]]:
    """The column's strings (null: empty), ``size`` rows at a time; with ``size_bytes``, fewer where they are
    longer together (but always one)."""
    col = batch.column(batch.schema.get_field_index(name))
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if size_bytes else None
    i = 0
    while i < len(col):
        n = size
        if size_bytes:
            n = min(size, max(1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size_bytes, side="right")) - i))
        yield [x or "" for x in col.slice(i, n).to_pylist()]
        i += n


def hashed_sample(df: DataFrame, n: int, *identity: Column | str) -> list:
    """At most ``n`` rows in order of a hash of ``identity``, the same ones on every run.

    The rows are counted first and thinned by the hash to about twice ``n``, so that the tasks
    together send that many, however many tasks there are."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in identity], F.lit(104_729))
    total = df.count()
    if total > 2 * n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2.0 * n / total))
    return df.withColumn("_h", h).orderBy("_h").limit(n).collect()


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RX)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
