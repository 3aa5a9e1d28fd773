"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; a byte is a mark where some of the hash's bits are zero, and
a mark ends a chunk if the one before it is at least ``least`` bytes away. The bits tested depend on
the last 16 bytes alone, so an insertion moves only the boundaries right behind it. Chunks without a
boundary are cut at ``most`` bytes. Equal chunks are found by a 64-bit digest; a single chance
collision cannot make a passage, since a passage needs several chunks in a row. Runs of neighbouring
chunks that each occur in more than one row are the repeated passages, from ``min_words`` words on;
they are parted where chunks that stand in an earlier row meet chunks that stand here first.

How the work is spread: every row keeps its chunks as one array; digests are counted with a partial
sum before the shuffle, so a frequent chunk is one row per task; the digests found twice are marked
in a bit table of fixed size, and only chunks it lets through are joined with them.

Defined results: null and empty texts have no chunks; repeated rows repeat each other wholly if they
are long enough; repeats inside one row alone do not count; of equal passages, that of the row that
stands first in the input is the one kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, complete_groups, texts, written

#: Random numbers of the gear hash, which has 16 bits and so a window of 16 bytes.
GEAR = np.random.default_rng(1729).integers(0, 1 << 16, 256, dtype=np.uint16)
#: Bits of the table that marks digests found twice; 64 to a row, so its size is fixed.
MARK_BITS = 1 << 24


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: sum of GEAR[byte] << age, built by doubling the window."""
    h = GEAR[data]
    for w in (1, 2, 4, 8):
        older = h[:-w] << np.uint16(w)
        h = h.copy()
        h[w:] += older
    return h


def boundaries(data: np.ndarray, least: int, mask_bits: int, most: int) -> np.ndarray:
    """Ends of the chunks of one text (UTF-8), never inside a character."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    marks = np.flatnonzero(gear_hashes(data) >> np.uint16(16 - mask_bits) == 0) + 1
    ends = marks[np.diff(marks, prepend=-least) >= least]
    ends = ends[ends < n]
    ends = np.append(ends[(data[ends] & 0xC0) != 0x80], n)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > most)
    if len(wide):
        more = []
        for k in wide.tolist():
            begin, end = int(ends[k - 1]) if k else 0, int(ends[k])
            while end - begin > most:
                begin += most
                while data[begin] & 0xC0 == 0x80:
                    begin -= 1
                more.append(begin)
        ends = np.sort(np.concatenate((ends, more)))
    return ends


def chunk_table(docs: DataFrame, least: int, mask_bits: int, most: int, text: str, key: str,
                place: str | None = None) -> DataFrame:
    """Per row: doc_id, row_id (the column ``place``, or else its place in the input), digests and ends (bytes) of its chunks."""
    def make():
        def f(batch):
            sizes, ends_of, digests = [], [], []
            for part in texts(batch, "_text"):
                for x in part:
                    data = x.encode("utf-8", "surrogatepass")
                    ends = boundaries(np.frombuffer(data, np.uint8), least, mask_bits, most)
                    sizes.append(len(ends))
                    ends_of.append(ends)
                    begin = 0
                    for end in ends.tolist():
                        digests.append(xxhash.xxh3_64_intdigest(data[begin:end]))
                        begin = end
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
            d = np.array(digests, np.uint64).view(np.int64)
            e = np.concatenate([*ends_of, np.empty(0, np.int64)]).astype(np.int32)
            return [pa.ListArray.from_arrays(offsets, pa.array(d)), pa.ListArray.from_arrays(offsets, pa.array(e))]
        return f

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"),
                       (F.monotonically_increasing_id() if place is None else F.col(place)).alias("row_id"))
    fields = [T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]
    return written(arrow_map(rows, fields, make, ["doc_id", "row_id"]).where(F.size("digests") > 0), "chunks")


def _parts(at: np.ndarray, start: np.ndarray, end: np.ndarray, again: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last chunk of the parts of the runs that begin at ``at``, and whether a part is removable:
    it is if all its chunks stand in an earlier row and it has ``least`` bytes itself."""
    begins = np.zeros(len(start), bool)
    begins[at] = True
    cut = np.flatnonzero(begins | np.concatenate(([True], again[1:] != again[:-1])))
    last = np.append(cut[1:], len(start)) - 1
    removable = again[cut] & (end[last] - start[cut] >= least)
    keep = begins[cut] | np.concatenate(([True], removable[1:] != removable[:-1]))  # neighbours that are alike after all
    cut, removable = cut[keep], removable[keep]
    return cut, np.append(cut[1:], len(start)) - 1, removable


def repeated_passages(docs: DataFrame, min_words: int = 20, least: int = 12, mask_bits: int = 4, most: int = 256,
                      text: str = "text", key: str = "doc_id", place: str | None = None) -> DataFrame:
    """One row per repeated passage of a row: doc_id, row_id, start and length (bytes of the UTF-8
    text), n_chunks, n_rows (rows that hold its most frequent chunk) and removable (every chunk
    stands in an earlier row). A passage of which only a part long enough stands in earlier rows
    is given in such parts, one row each.

    A passage of ``min_words`` words is taken as six bytes a word."""
    table = chunk_table(docs, least, mask_bits, most, text, key, place)
    known = (table.select("row_id", F.explode(F.array_distinct("digests")).alias("d")).groupBy("d")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row")).where("n_rows > 1"))
    known = written(known, "chunks-known")
    bit = F.pmod("d", F.lit(MARK_BITS))
    marks = (known.select(bit.alias("_b")).groupBy(F.shiftright("_b", 6).alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("_bits")))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    zipped = F.arrays_zip(F.col("digests").alias("d"), starts.alias("start"), F.col("ends").alias("end"))
    parts = table.select("row_id", F.posexplode(zipped).alias("place", "c")).select("row_id", "place", "c.*")
    parts = (parts.join(F.broadcast(marks), F.shiftright(bit, 6) == F.col("_word"))
             .where(F.expr(f"(shiftrightunsigned(_bits, cast(pmod(d, {MARK_BITS}) & 63 as int)) & 1) = 1")))
    hits = parts.join(known, "d").select("row_id", "place", "start", "end", "n_rows", (F.col("first_row") < F.col("row_id")).alias("again"))
    dealt = hits.repartition("row_id").sortWithinPartitions("row_id", "place")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, ["row_id"]):
            row, place, start, end, count = (t.column(c).to_numpy() for c in ("row_id", "place", "start", "end", "n_rows"))
            at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))))
            runs_at, whole = at, end[np.append(at[1:], len(row)) - 1] - start[at] >= 6 * min_words  # the run as it was detected
            at, last, removable = _parts(at, start, end, t.column("again").to_numpy(zero_copy_only=False).astype(bool), 6 * min_words)
            out = pa.RecordBatch.from_arrays(
                [pa.array(row[at]), pa.array(start[at].astype(np.int64)), pa.array((end[last] - start[at]).astype(np.int64)),
                 pa.array((last - at + 1).astype(np.int64)), pa.array(np.maximum.reduceat(count, at)), pa.array(removable)],
                names=["row_id", "start", "length", "n_chunks", "n_rows", "removable"])
            yield out.filter(pa.array(whole[np.searchsorted(runs_at, at, "right") - 1]))

    found = dealt.mapInArrow(runs, "row_id long, start long, length long, n_chunks long, n_rows long, removable boolean")
    return table.select("doc_id", "row_id").join(found, "row_id").select(
        "doc_id", "row_id", "start", "length", "n_chunks", "n_rows", "removable")


def without_repeats(docs: DataFrame, min_words: int = 20, text: str = "text", key: str = "doc_id", **chunking) -> DataFrame:
    """``docs`` with every passage cut out that lies wholly behind its first occurrences.

    The rows are written once with a number, as their places in two scans of the input may differ."""
    known = written(docs.withColumn("_rid", F.monotonically_increasing_id()), "chunks-rows")
    found = repeated_passages(known, min_words, text=text, key=key, place="_rid", **chunking).where("removable")
    cuts = found.groupBy(F.col("row_id").alias("_cut_row")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_cuts"))
    rows = known.join(cuts, F.col("_rid") == F.col("_cut_row"), "left")
    data = F.encode(F.col(text), "UTF-8")
    state = F.aggregate("_cuts", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out")), lambda s, c: F.struct(
        (c["start"] + c["length"]).alias("at"),
        F.concat(s["out"], F.substring(data, (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))).alias("out")))
    rest = F.decode(F.concat(state["out"], F.substring(data, (state["at"] + 1).cast("int"), F.octet_length(F.col(text)))), "UTF-8")
    return rows.withColumn(text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(rest)).select(*docs.columns)
