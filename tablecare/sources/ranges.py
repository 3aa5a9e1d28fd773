"""Records of one large CSV or JSON file, read by many tasks.

A record may hold the very character that ends pieces of the file (a line break in quotes, a brace in
a string), so a task that starts in the middle of a file cannot tell where it stands. Each byte range
is therefore read twice. The first time a task works out what the range does to a reader in *each*
state it might be in: a map from the state before to the state after, which for two states is one of
stay, swap, or always the same. Such maps compose, and a window over the ranges of a file (one small
row each) gives the state at every range's start. The second time each task knows it and cuts records.
A record that crosses ranges is put together from its fragments, which alone are shuffled.

The file is cut by Spark's text reader, at line breaks for CSV and at closing braces for JSON. Both
readings must cut it alike: the number of splits Spark aims at, which otherwise follows the live
executors, is fixed for the session if it was not, and a range the first reading did not see is an
error, never a wrong record. Files are told apart by a 64-bit hash of their path. The states of all
ranges go to every task: 33 bytes for every ``spark.sql.files.maxPartitionBytes`` of input.
"""

from __future__ import annotations

import re
from functools import partial
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship

PIN = "spark.sql.files.minPartitionNum"
#: Records sent to Spark in one batch: at most so many, or of so many characters.
BATCH_ROWS, BATCH_CHARS = 10_000, 8 << 20
#: White space between JSON values, and the mark some files begin with.
BLANK = "\ufeff \t\r\n"
SPLIT = ("file bigint, block bigint, of_size bigint, end0 boolean, end1 boolean, add0 bigint, add1 bigint, low0 bigint, low1 bigint, "
         "size bigint, base int")
RECORD = "file bigint, owner bigint, block bigint, first boolean, text string"


class Quotes:
    """The automaton of CSV quotes over lines: inside a quoted field or not.

    A field is quoted if it starts with a quote; a doubled quote in it is a quote; what follows the
    closing quote belongs to the field as it stands."""

    end = "\n"

    def __init__(self, sep: str):
        self.sep = sep
        self.opening = sep + '"'

    def mark(self, c: Column) -> Column:
        """The pieces the first reading needs: those without a quote change nothing."""
        return F.when(c.contains('"'), c)

    def after(self, piece: str | None, inside: bool) -> tuple[bool, int]:
        if piece is None or '"' not in piece:
            return inside, 0
        at = 0
        if not inside:
            if not piece.startswith('"'):
                at = piece.find(self.opening)
                if at < 0:
                    return False, 0
                at += len(self.sep)
            at += 1
        while True:   # here: within quotes, from ``at``
            at = piece.find('"', at)
            if at < 0:
                return True, 0
            if piece.startswith('"', at + 1):
                at += 2
                continue
            # the field ends at the next separator, and the next quoted one starts after any
            at = piece.find(self.sep, at + 1)
            if at < 0:
                return False, 0
            at = at if piece.startswith(self.opening, at) else piece.find(self.opening, at)
            if at < 0:
                return False, 0
            at += len(self.opening)


class Brackets:
    """The automaton of JSON over pieces that end at a closing brace: inside a string or not, and how deep.

    ``after`` counts the piece's brackets outside strings, its own closing brace included."""

    end = "}"
    STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
    REST = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)

    def mark(self, c: Column) -> Column:
        return c

    def after(self, piece: str | None, inside: bool) -> tuple[bool, int]:
        piece = piece or ""
        if inside:
            closed = self.REST.match(piece)
            if not closed:
                return True, 0
            piece = piece[closed.end():]
        bare = self.STRING.sub("", piece)
        opened = bare.find('"')
        if opened >= 0:
            bare = bare[:opened]
        depth = bare.count("{") + bare.count("[") - bare.count("]")
        return (True, depth) if opened >= 0 else (False, depth - 1)


def pieces_of(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, block, at, value): the file's pieces, each in the byte range it starts in, in order within a range."""
    ship(spark)
    if spark.conf.get(PIN, None) is None:
        spark.conf.set(PIN, str(spark.sparkContext.defaultParallelism))
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("_metadata.file_size").alias("of_size"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, int]]:
    """(file, block, values, size of the file) for the runs of rows of one range within each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield int(file[i]), int(block[i]), b.column(3).slice(i, j - i).to_pylist(), b.column(2)[i].as_py()


class _Effect:
    """What the pieces so far do to a reader that came in one state: the state it is in, how much deeper it is, and
    the least depth at which it stood outside quotes after a piece (null: never)."""

    def __init__(self, inside: bool):
        self.inside, self.add, self.low = inside, 0, None

    def take(self, rules, piece: str | None) -> None:
        self.inside, add = rules.after(piece, self.inside)
        self.add += add
        if not self.inside and (self.low is None or self.add < self.low):
            self.low = self.add


def _first_reading(rules) -> Callable:
    schema = pa.schema([(x.split()[0], {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[x.split()[1]]) for x in SPLIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, into, size, base = None, None, None, 0, None

        def effect() -> pa.RecordBatch:
            row = (*at, out.inside, into.inside, out.add, into.add, out.low, into.low, size, base)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)
        for file, block, values, of_size in _ranges(batches):
            if (file, block, of_size) != at:
                if at:
                    yield effect()
                at, out, into, size, base = (file, block, of_size), _Effect(False), _Effect(True), 0, None
            for v in values:
                if base is None and v and not v.isspace():
                    base = 1 if v.lstrip(BLANK).startswith("[") else 0
                size += 1 + (len(v.encode()) if v else 0)
                out.take(rules, v)
                into.take(rules, v)
        if at:
            yield effect()
    return run


def states(pieces: DataFrame, rules) -> DataFrame:
    """Per range: ``inside`` and ``depth`` at its start, whether that is ``between`` records, else the range that the open
    record began in (``owner``), ``base`` (the depth of its file's records), and the file's last depth and pieces' size.

    The composition of two-state maps: the last range that leads to one state whatever came before gives it,
    and the swaps since then turn it."""
    marked = pieces.withColumn("value", rules.mark(F.col("value")))
    seen = cut_lineage(marked.mapInArrow(_first_reading(rules), SPLIT))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed, swap = F.col("end0") == F.col("end1"), F.col("end0") & ~F.col("end1")
    turned = seen.withColumn("swaps", F.sum(swap.cast("long")).over(upto))
    last = F.last(F.when(fixed, F.struct("end0", "swaps")), ignorenulls=True).over(before)
    turned = turned.withColumn("last", last).withColumn("swaps_before", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    odd = (F.col("swaps_before") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    known = turned.withColumn("inside", F.coalesce(F.col("last.end0"), F.lit(False)) != odd)
    add = F.when(F.col("inside"), F.col("add1")).otherwise(F.col("add0"))
    low = F.when(F.col("inside"), F.col("low1")).otherwise(F.col("low0"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = (known.withColumn("depth", F.coalesce(F.sum(add).over(before), F.lit(0)))
             .withColumn("base", F.coalesce(F.first("base", ignorenulls=True).over(whole), F.lit(0)))
             .withColumn("last_depth", F.sum(add).over(whole)).withColumn("read", F.sum("size").over(whole)))
    # the record that is open at a range's start began in the last range that started between records or left one
    known = (known.withColumn("between", ~F.col("inside") & (F.col("depth") <= F.col("base")))
             .withColumn("left", F.coalesce(F.col("depth") + low <= F.col("base"), F.lit(False))))
    known = known.withColumn("owner", F.last(F.when(F.col("between") | F.col("left"), F.col("block")), ignorenulls=True).over(before))
    return known.select("file", "block", "of_size", "inside", "depth", "base", "between", "owner", "last_depth", "read")


def _second_reading(rules, table: dict, cutter: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        cut, at = None, None

        def batch():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                               pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())],
                                              names=[x.split()[0] for x in RECORD.split(", ")])
        for file, block, values, _ in _ranges(batches):
            if (file, block) != at:
                if cut:
                    out.extend(cut.close())
                at = (file, block)
                if at not in table:
                    raise RuntimeError("the file was cut into other ranges than before; read it again")
                cut = cutter(rules, file, block, *table[at])
            for v in values:
                for r in cut.feed(v):
                    out.append(r)
                    chars += len(r[4])
                    if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch()
                        out, chars = [], 0
        if cut:
            out.extend(cut.close())
        if out:
            yield batch()
    return run


class Lines:
    """Cuts CSV records out of the lines of one range. Blank records are left out; each line's own ``\\r`` goes."""

    def __init__(self, rules, file, block, inside, depth, base, owner):
        self.rules, self.file, self.block = rules, file, block
        self.inside, self.owner = inside, owner if inside else block
        self.lines: list[str] = []
        self.split = inside          # the record began in an earlier range
        self.first = block == 0      # no record of the file yet

    def record(self, whole: bool) -> list[tuple]:
        text = "\n".join(self.lines)
        self.lines = []
        if whole and not text:
            return []
        made = (self.file, None if whole else self.owner, self.block, self.first, text)
        self.first, self.split, self.owner = False, False, self.block
        return [made]

    def feed(self, line: str) -> list[tuple]:
        line = line.removesuffix("\r")
        if self.block == 0 and self.first and not self.lines:
            line = line.removeprefix("﻿")
        self.lines.append(line)
        self.inside = self.rules.after(line, self.inside)[0]
        return [] if self.inside else self.record(not self.split)

    def close(self) -> list[tuple]:
        return self.record(False) if self.lines else []


class Objects:
    """Cuts the objects of a JSON array (or of a plain sequence) out of the pieces of one range."""

    def __init__(self, rules, file, block, inside, depth, base, owner, strict=True):
        self.rules, self.file, self.block = rules, file, block
        self.inside, self.depth, self.base, self.strict = inside, depth, base, strict
        self.split = inside or depth > base
        self.owner = owner if self.split else block
        self.open = self.split
        self.parts: list[str] = []

    def feed(self, piece: str) -> list[tuple]:
        if not self.open:
            start = piece.find("{")
            between = piece if start < 0 else piece[:start]
            level = self.depth + between.count("[") - between.count("]")
            if self.strict and (between.strip(BLANK + ",[]") or (start >= 0 and level != self.base)):
                raise ValueError("malformed JSON: " + between[:200])
            if start < 0 or level != self.base:
                self.inside, add = self.rules.after(piece, False)
                self.depth += add
                return []
            piece = piece[start:]
            self.depth = level
            self.open = True
        self.inside, add = self.rules.after(piece, self.inside)
        self.depth += add
        self.parts.append(piece + "}")
        return [] if self.inside or self.depth > self.base else self.record(not self.split)

    def record(self, whole: bool) -> list[tuple]:
        text = "".join(self.parts)
        self.parts, self.open = [], False
        made = (self.file, None if whole else self.owner, self.block, False, text)
        self.split, self.owner = False, self.block
        return [made]

    def close(self) -> list[tuple]:
        return self.record(False) if self.parts else []


def records(pieces: DataFrame, known: DataFrame, rules, cutter: Callable, glue: str) -> DataFrame:
    """(first, text): the records; ``first`` marks the first of each file."""
    fields = ["file", "block", "inside", "depth", "base", "owner", "between"]
    rows = known.select(*fields).toArrow()
    cols = {c: rows.column(c).to_pylist() for c in fields}
    table = {(f, b): state for f, b, *state in zip(*(cols[c] for c in fields[:-1]))}
    read = pieces.mapInArrow(_second_reading(rules, table, cutter), RECORD)
    if all(cols["between"]):   # no record crosses a range; only one that its file leaves open is a fragment, and whole
        return read.select("first", "text")
    part = F.struct("block", "text")
    joined = (read.where("owner IS NOT NULL").groupBy("file", "owner")   # the fragments of one record
              .agg(F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), glue).alias("text")))
    return read.where("owner IS NULL").select("first", "text").unionByName(joined.select("first", "text"))


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(first, text): the records of one or many CSV files as text, quoted line breaks kept as ``\\n``."""
    rules = Quotes(sep)
    pieces = pieces_of(spark, path, rules.end)
    return records(pieces, states(pieces, rules), rules, Lines, "\n")


def first_record(spark: SparkSession, path: str, sep: str = ",") -> str | None:
    """The first CSV record of the first file, from as few lines as it takes."""
    rules = Quotes(sep)
    lines = pieces_of(spark, path, rules.end).where("block = 0").select("value")
    n = 1
    while True:
        got = [r[0] for r in lines.take(n)]
        cut = Lines(rules, 0, 0, False, 0, 0, 0)
        found = [r for line in got for r in cut.feed(line)] or (cut.close() if len(got) < n else [])
        if found or len(got) < n:
            return found[0][4] if found else None
        n *= 8


def json_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(text): the objects of each file's array, or of a plain sequence of objects. Anything else between
    them, or brackets that do not close, is an error if ``strict``, and left out otherwise."""
    rules = Brackets()
    pieces = pieces_of(spark, path, rules.end)
    known = cut_lineage(states(pieces, rules))
    if strict:
        # a file that does not end in a brace counts one too many; a byte order mark is not read
        over = F.col("read") - F.col("of_size")
        deep = F.col("last_depth") + F.when(over.isin(1, -2), 1).otherwise(0)
        if not known.where(deep != 0).isEmpty():
            raise ValueError(f"malformed JSON: brackets in {path} do not close")
    return records(pieces, known, rules, partial(Objects, strict=strict), "").select("text")
