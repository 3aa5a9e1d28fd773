"""Frequent values without counting every value.

A full frequency table shuffles every distinct value of a column. The frequent ones need less: each
task keeps a Misra-Gries summary per column, at most ``TRACKED`` counters and the total it had to take
off them, so that a value's count lies between its counter and the counter plus that error, and a value
without a counter occurs at most as often as the error says. Summaries of all tasks merge by adding up
counters and errors, so the shuffle holds at most ``TRACKED`` rows per column and task.

Nothing was taken off a column with few distinct values: its counters are the counts. Otherwise the
counters name the candidates, a second pass counts those alone, and the exact counts prove the result
if the least of them exceeds the error, the most that any other value can have. A column without
that proof (many values of nearly the same count) is counted in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_text, by_position, field_type
from ..session import cut_lineage, ship

#: Counters a task keeps per column.
TRACKED = 1024
#: Candidates of the second pass go to every task if there are at most so many; more are counted in full.
CANDIDATES = 100_000


class MisraGries:
    """Counters of one column in one task; ``lost`` is what was taken off each of them."""

    def __init__(self, tracked: int = TRACKED):
        self.tracked, self.counts, self.lost = tracked, Counter(), 0

    def add(self, values: pa.Array) -> None:
        """Adds non-null values."""
        seen = pc.value_counts(values)
        self.counts.update(dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist())))
        if len(self.counts) > 2 * self.tracked:
            self.shrink()

    def shrink(self) -> None:
        """Takes off every counter what the largest one beyond ``tracked`` has."""
        if len(self.counts) > self.tracked:
            off = sorted(self.counts.values(), reverse=True)[self.tracked]
            self.lost += off
            self.counts = Counter({v: n - off for v, n in self.counts.items() if n > off})


def _summaries(columns: int, tracked: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [MisraGries(tracked) for _ in range(columns)]
        for b in batches:
            for k, s in enumerate(of):
                s.add(b.column(k).drop_null())
        for k, s in enumerate(of):
            s.shrink()
            if not s.counts and not s.lost:
                continue
            rows = [(None, s.lost), *s.counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.int64())], names=["k", "value", "n"])
    return run


@dataclass
class Frequent:
    """Merged summaries: ``counters`` (k, value, n) and ``lost``, the error per column position."""

    texts: DataFrame
    columns: list[str]
    counters: DataFrame
    lost: dict[int, int]

    def named(self, rows: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(c) for c in self.columns])
        return rows.withColumn("name", F.element_at(names, F.col("k") + 1))

    def _counted(self, ks: list[int], only: DataFrame | None) -> DataFrame:
        """Exact (k, value, n) of the columns ``ks``, of the values in ``only`` if given."""
        long = self.texts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("value")) for k in ks]))).where("value IS NOT NULL")
        if only is not None:
            long = long.join(F.broadcast(only.select("k", "value")), ["k", "value"], "left_semi")   # at most CANDIDATES rows
        return long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))

    def _proven(self, at_least: DataFrame, keep: Callable[[DataFrame], DataFrame], least: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(k, value, n) of the wanted values.

        ``at_least`` gives per column the count that a candidate's counter must reach less the error, ``keep``
        picks the wanted among exact counts and ``least`` gives per column the count that must exceed the error."""
        spark = self.texts.sparkSession
        exact = [k for k in range(len(self.columns)) if not self.lost.get(k)]
        unsure = [k for k in range(len(self.columns)) if self.lost.get(k)]
        out = keep(self.counters.where(F.col("k").isin(exact))) if exact else None
        if unsure:
            lost = spark.createDataFrame([(k, self.lost[k]) for k in unsure], "k int, lost long")
            bar = at_least.join(F.broadcast(lost), "k")                      # a row per column
            open_ = bar.where(F.col("bar") > F.col("lost"))
            wanted = cut_lineage(self.counters.join(F.broadcast(open_), "k").where(F.col("n") + F.col("lost") >= F.col("bar")).select("k", "value"))
            counted = None
            if wanted.limit(CANDIDATES + 1).count() <= CANDIDATES:
                counted = cut_lineage(keep(self._counted(unsure, wanted)))
                proof = least(counted).join(F.broadcast(lost), "k").where(F.col("least") > F.col("lost"))
                proven = {r[0] for r in proof.select("k").collect()}
            else:
                proven = set()
            if proven:
                done = counted.where(F.col("k").isin(list(proven)))
                out = done if out is None else out.unionByName(done)
            rest = [k for k in unsure if k not in proven]
            if rest:
                full = keep(self._counted(rest, None))
                out = full if out is None else out.unionByName(full)
        return out

    def top(self, n: int) -> DataFrame:
        """(k, name, value, n, rank): the ``n`` most frequent values per column, ties by value."""
        w = Window.partitionBy("k").orderBy(F.col("n").desc(), F.col("value").asc())

        def keep(rows: DataFrame) -> DataFrame:
            return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

        def least(rows: DataFrame) -> DataFrame:   # of a full ranking; a shorter one proves nothing
            return rows.where(F.col("rank") == n).select("k", F.col("n").alias("least"))
        bar = least(keep(self.counters)).withColumnRenamed("least", "bar")
        return self.named(self._proven(bar, keep, least)).select("k", "name", "value", "n", "rank")

    def at_least(self, counts: dict[int, float]) -> DataFrame:
        """(k, name, value, n): the values that occur at least ``counts[k]`` times."""
        spark = self.texts.sparkSession
        bar = spark.createDataFrame([(k, float(c)) for k, c in counts.items()], "k int, bar double")

        def keep(rows: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(bar), "k").where(F.col("n") >= F.col("bar")).drop("bar")   # a row per column
        return self.named(self._proven(bar, keep, lambda rows: bar.withColumnRenamed("bar", "least"))).select("k", "name", "value", "n")


def frequent(df: DataFrame, columns: list[str], tracked: int = TRACKED) -> Frequent:
    """Summaries of the text form of ``columns`` in one pass; ``k`` is a column's place in the list."""
    ship(df.sparkSession)
    p, col = by_position(df)
    texts = p.select(*[as_text(col(c), field_type(df, c)).alias(f"t{k}") for k, c in enumerate(columns)])
    parts = texts.mapInArrow(_summaries(len(columns), tracked), "k int, value string, n bigint")
    merged = cut_lineage(parts.groupBy("k", "value").agg(F.sum("n").alias("n")))
    lost = {r["k"]: int(r["n"]) for r in merged.where("value IS NULL").collect()}   # a row per column
    return Frequent(texts, columns, merged.where("value IS NOT NULL"), lost)
