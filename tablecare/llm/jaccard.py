"""Similarity join on word shingles with a count-vector R-tree.

Every document becomes the set of its shingles (hashed to 64 bits); equal sets form one class.
Shingles are also hashed into ``GROUPS`` groups, and the counts per group make a class a point.
The overlap of two sets is at most the sum over groups of the smaller count, and that of anything
below two R-tree nodes at most the sum of the smaller upper corners; pairs of nodes and points
that cannot reach the similarity are cut off, the others are verified on the whole sets.

How the work is spread: two sets of similarity ``t`` share one of the first ``n - ceil(t n) + 1``
hashes of either (the prefix) in any order that holds for all sets, so an R-tree is built for every
prefix hash that classes of different components share, and no similar pair is missed. The order is
by how often hashes occur, as counted in a table of fixed size, and then by the hashes themselves:
those of a passage that many texts have come last and call for no large trees. Only connections are
wanted, so:

1. every class is paired with the best bounded of a few classes of like size that share one of its
   four smallest hashes; the pairs are verified and components are formed: large groups of near copies
   merge here without listing their pairs;
2. the prefix hashes are shuffled, and hashes whose classes all lie in one component fall away;
   a hash shared by a handful of classes gives its pairs (a tree of one leaf), which are made
   distinct and bounded by their points; for every other an R-tree join emits, per pair of
   components, the candidates with the highest bounds. The candidates are verified and components
   merged. Hashes that held a candidate back go another round with a larger number of them.

A hash shared by more than ``shard`` classes is dealt into blocks, and every pair of blocks is a
task of its own. Sets are verified on 32 bits of every hash, which can only count too much; pairs
that pass by three shingles or less are verified again on all 64 bits.

Defined results: null and empty texts have no shingles, link with nothing and are their own
component; a text of fewer words than a shingle is one shingle; repeated rows and equal texts
share a component; a null doc_id counts as larger than all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, complete_groups, discard, marked, parted, passing, small_batches, texts, written
from .graph import components

GROUPS, COARSE = 512, 64
#: Points under an R-tree leaf, and nodes under an inner node.
LEAF, FAN = 32, 16
#: Pairs compared at once.
PAIRS = 1 << 15
#: Candidate pairs of a shard kept before the best are taken.
HELD = 1 << 17
#: A hash shared by at most this many classes gives all its pairs.
FEW = 8
#: Smallest hashes used to merge near copies before the join.
FIRST = 4
#: Hubs that a class is compared with there.
HUBS = 3
#: Candidates per class and other component, round by round; the last has no limit.
ROUNDS = (4, 64, None)
#: Hashes that begin with the same bits are counted together, in a cell.
CELL_BITS = 22
#: Cells with fewer hashes than 2 to this power are of level 0 and come first in a prefix.
LEAST_LEVEL = 4
#: Cells above level 0; if more have enough hashes, it begins at a higher level.
FREQUENT = 1 << 17
#: Bytes of text that are hashed at once.
SLICE = 1 << 19
#: Places of prefix hashes share a number with the hash: so many low bits of it, which the hash gives up.
PLACE_BITS = 24
#: Hashes below it, on average a quarter of a set, are compared before whole sets are sent.
LOW = 1 << 62


_RANDOM = np.random.default_rng(4099).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = _RANDOM[_LOWER]  # A-Z hash as a-z
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of texts' word shingles, over many texts at once.

    A word's hash is a polynomial of its bytes, taken as a difference of running sums."""

    def __init__(self, width: int):
        self.width = width
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << n.bit_length()
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word of bytes that begin and end between words."""
        self._grow(len(data) + 1)
        edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_RANDOM[data], self.powers[:len(data)], out=sums[1:])
        np.cumsum(sums, out=sums)
        return start, _mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        parts = [x.encode("utf-8", "surrogatepass") for x in batch]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        starts, hashes, a = [], [], 0
        while a < len(data):   # a slice at a time, cut behind a space, so that memory does not follow the longest text
            b = min(a + SLICE, len(data))
            while b < len(data) and not _SPACE[data[b - 1]]:
                back = np.flatnonzero(_SPACE[data[a:b]])
                b = a + int(back[-1]) + 1 if len(back) else min(b + SLICE, len(data))
            start, hashed = self._words(data[a:b])
            starts.append(start + a)
            hashes.append(hashed)
            a = b
        start, words = np.concatenate(starts), np.concatenate(hashes)
        texts_end = np.cumsum([len(p) + 1 for p in parts])
        at = np.concatenate(([0], np.searchsorted(start, texts_end)))
        k = self.width
        full = self._shingles(words, k) if len(words) >= k else words[:0]
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            s = full[a:b - k + 1] if b - a >= k else self._shingles(words[a:b], b - a) if b > a else words[:0]
            s = np.sort(s)
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
        return out

    @staticmethod
    def _shingles(words: np.ndarray, k: int) -> np.ndarray:
        n = len(words) - k + 1
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + words[i:n + i]
        return _mix(s)


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1 if n else 0


def point_of(s: np.ndarray) -> bytes:
    """Count of shingles per group, up to 255."""
    return np.minimum(np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8).tobytes()


def packed(point: bytes) -> bytes:
    """A point as it is stored and shuffled: about a quarter of its bytes."""
    c = zlib.compressobj(9, zlib.DEFLATED, -10, 4, zlib.Z_RLE)
    return c.compress(point) + c.flush()


def unpacked(points: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(x, -10, GROUPS) for x in points.to_pylist()), np.uint8).reshape(-1, GROUPS)


def overlap_bound(p: np.ndarray, q: np.ndarray, full: int = 255) -> np.ndarray:
    """Largest possible overlap of points, row by row; unbounded where both counts are cut off at ``full``."""
    m = np.minimum(p, q)
    out = m.sum(1, dtype=np.int64)
    out[m.max(1, initial=0) == full] = 1 << 60
    return out


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, width: int, text: str) -> bytes:
    """The level of every cell, a byte each, deflated: the logarithm of its hashes in all rows, or 0.

    A task tells of cells with more hashes than by chance only. Levels make an order and rule nothing out."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held = Shingler(width), np.zeros(1 << CELL_BITS, np.uint32)
        for b in batches:
            for part in texts(b, text, size_bytes=SLICE):
                np.add.at(held, _cells(np.concatenate(shingle(part))), np.uint32(1))
        usual = held.mean()
        often = np.flatnonzero(held > 2 * usual + 4)
        yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64()), pa.array(held[often] - int(usual), pa.int64())], names=["cell", "n"])

    small_batches(spark)
    with passing(spark):
        sums = docs.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        found = written(sums.select("cell", F.floor(F.log2("n")).cast("int").alias("level")).where(F.col("level") >= LEAST_LEVEL), "jaccard-frequent")
        total, least = 0, 256
        for r in found.groupBy("level").count().orderBy(F.desc("level")).collect():
            total += r["count"]
            if total > FREQUENT:
                break
            least = r["level"]
        taken = found.where(F.col("level") >= least).toArrow()
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[taken.column("cell").to_numpy()] = taken.column("level").to_numpy()
    return zlib.compress(levels.tobytes(), 1)


def prefix(s: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """The first hashes of a sorted set by level and hash."""
    n, level = prefix_length(len(s), percent), levels[_cells(s)]
    rare = s[level == 0]
    return rare[:n] if len(rare) >= n else s[np.argsort(level, kind="stable")[:n]]


def features(docs: DataFrame, width: int, percent: int, text: str, key: str, place: str | None = None) -> DataFrame:
    """Per row: ``row_id`` (the column ``place``, or else the place in the input), key, n, class digest (c1, c2), counts per group,
    prefix hashes and the FIRST smallest hashes.

    Counts and hashes are null but for a class's first row in its task."""
    fields = [T.StructField("n", T.LongType()), T.StructField("c1", T.LongType()),
              T.StructField("c2", T.LongType()), T.StructField("point", T.BinaryType()),
              T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("first", T.ArrayType(T.LongType()))]
    deflated = frequency_levels(docs, width, text)

    def make():
        shingle, seen, levels = Shingler(width), set(), np.frombuffer(zlib.decompress(deflated), np.uint8)

        def f(batch):
            cols = [[], [], [], [], [], []]
            for part in texts(batch, text, size_bytes=SLICE):
                for s in shingle(part):
                    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    c, first = (int(d[0]), int(d[1])), False
                    if len(s) and c not in seen:
                        first = True
                        seen.add(c)
                    row = (len(s), *c, packed(point_of(s)) if first else None,
                           prefix(s, percent, levels).view(np.int64) if first else None,
                           s[:min(FIRST, prefix_length(len(s), percent))].view(np.int64) if first else None)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            return cols
        return f

    rows = docs.select(key, text, (F.monotonically_increasing_id() if place is None else F.col(place)).alias("row_id"))
    return written(arrow_map(rows, fields, make, [key, "row_id"]), "jaccard-features")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, text: str, key: str,
           name: str, screen: bool = False) -> DataFrame:
    """The (a, b) pairs of class nodes that are similar, on their whole shingle sets; with ``screen``, pairs
    that the hashes below LOW rule out are dropped before whole sets are sent."""
    spark = docs.sparkSession
    with passing(spark):   # the sets go as soon as they are compared
        near = written(_compare(pairs, classes, docs, width, percent, text, key, np.uint32, screen), f"{name}-32", stays=True)
    close = near.where("spare <= 2").select("a", "b")
    if not close.limit(1).count():
        return near.select("a", "b")
    with passing(spark):
        sure = _compare(close, classes, docs, width, percent, text, key, np.uint64)
        return written(near.where("spare > 2").select("a", "b").union(sure.select("a", "b")), name, stays=True)


def _compare(pairs, classes, docs, width, percent, text, key, kind, screen=False) -> DataFrame:
    """Similar pairs with ``spare``, the shingles their overlap has beyond the least; hashes cut to ``kind``."""
    digest = F.struct("c1", "c2")
    one = classes.select(F.col("node").alias("a"), digest.alias("ca"), F.col("doc").alias("da"))
    two = classes.select(F.col("node").alias("b"), digest.alias("cb"), F.col("doc").alias("db"))
    pairs = pairs.select("a", "b").join(one, "a").join(two, "b")
    wanted = pairs.select(F.col("da").alias(key)).union(pairs.select("db"))
    shift = np.uint64(64 - 8 * np.dtype(kind).itemsize)

    def make():
        shingle, seen = Shingler(width), set()

        def f(batch):
            cols = [[], [], [], [], []]
            for part in texts(batch, text, size_bytes=SLICE):
                for s in shingle(part):
                    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    c = (int(d[0]), int(d[1]))
                    low = s[:np.searchsorted(s, np.uint64(LOW))] if screen else s[:0]
                    sent = (None, None) if c in seen else ((low >> shift).astype(kind).tobytes(), (s >> shift).astype(kind).tobytes())
                    for col, v in zip(cols, (*c, len(s), *sent), strict=True):
                        col.append(v)
                    seen.add(c)
            return cols
        return f

    fields = [T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("size", T.LongType()),
              T.StructField("low", T.BinaryType()), T.StructField("shingles", T.BinaryType())]
    source = marked(docs.select(key, text), wanted, key)
    sets = written(arrow_map(source, fields, make, []).where("shingles is not null"), "jaccard-sets")
    if screen:
        pairs = written(_overlapping(pairs, sets, "low", percent, kind), "jaccard-screened")
    return _overlapping(pairs, sets, "shingles", percent, kind).select("a", "b", "spare")


def _overlapping(pairs: DataFrame, sets: DataFrame, column: str, percent: int, kind) -> DataFrame:
    """Pairs that may be similar by what ``column`` holds of their sets, as if they shared all the rest."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spare = []
            for x, y, m, n in zip(b.column(4), b.column(5), b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True):
                s, t = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                rest = min(m - len(s), n - len(t))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
                spare.append(both + rest - -(-percent * (m + n) // (100 + percent)))
            spare = pa.array(spare, pa.int64())
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), spare], names=["a", "b", "ca", "cb", "spare"])
            out = out.filter(pc.greater_equal(spare, 0))
            del b
            pa.default_memory_pool().release_unused()   # the sets of the next pairs take their place
            yield out

    digest = F.struct("c1", "c2")
    one = sets.select(digest.alias("ca"), F.col(column).alias("sa"), F.col("size").alias("na"))
    two = sets.select(digest.alias("cb"), F.col(column).alias("sb"), F.col("size").alias("nb"))
    both = pairs.select("a", "b", "ca", "cb").join(two, "cb").join(one, "ca").select("a", "b", "ca", "cb", "sa", "sb", "na", "nb")
    kept = "struct<c1: long, c2: long>"
    return both.mapInArrow(similar, f"a long, b long, ca {kept}, cb {kept}, spare long")


def coarse(points: np.ndarray) -> np.ndarray:
    """Points over a few groups, each the sum of several; the largest value where a count is cut off."""
    parts = points.reshape(len(points), COARSE, -1)
    out = parts.sum(2, dtype=np.uint16)
    out[(parts == 255).any(2)] = 65535
    return out


class RTree:
    """Classes packed by size and then by their strongest group into leaves, under boxes.

    A box has the least and greatest size below it, the upper corner of the coarse points, and
    the component if all below it share one (else -1)."""

    def __init__(self, nodes, comps, sizes, rest, points):
        rough = coarse(points)
        o = np.lexsort((rough.argmax(1), sizes))
        self.nodes, self.comps, self.sizes, self.rest, self.points, self.rough = (
            x[o] for x in (nodes, comps, sizes, rest, points, rough))
        self.levels = []  # (number below, boxes), from the leaves up to one root
        low, high, corner, first, last, step = self.sizes, self.sizes, self.rough, self.comps, self.comps, LEAF
        while True:
            at = np.arange(0, len(low), step)
            below = len(low)
            low, high, corner = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at, axis=0)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((step, below, low, high, corner, np.where(first == last, first, -1)))
            if len(low) == 1:
                break
            step = FAN

    def join(self, other: "RTree", percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in self, in other) of pairs of different components that may be similar, by going
        down both trees together; each pair once if ``other`` is the tree itself."""
        same = other is self
        height = max(len(self.levels), len(other.levels))
        mine, yours = (t.levels + [(1, 1, *t.levels[-1][2:])] * (height - len(t.levels)) for t in (self, other))
        todo = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64))]  # boxes whose contents are still to compare
        while todo:
            level, a, b = todo.pop()
            if level < height:  # to what is below, one part at a time
                (wa, na, *_), (wb, nb, *_) = mine[level], yours[level]
                x = np.repeat((a[:, None] * wa + np.arange(wa)), wb, axis=1).ravel()
                y = np.tile(b[:, None] * wb + np.arange(wb), (1, wa)).ravel()
                ok = (x < na) & (y < nb)
                if same:
                    ok &= (x < y) if level == 0 else (x <= y)
                a, b = x[ok], y[ok]
            level -= 1
            if level >= 0:
                (wa, _, la, ha, ca, oa), (wb, _, lb, hb, cb, ob) = mine[level], yours[level]
                ok = (100 * ha[a] >= percent * lb[b]) & (100 * hb[b] >= percent * la[a]) & ~((oa[a] >= 0) & (oa[a] == ob[b]))
                a, b = a[ok], b[ok]
                ok = _reaches(ca[a], cb[b], la[a] + lb[b], 65535, percent)
                a, b = a[ok], b[ok]
                part = max(1, PAIRS // (wa * wb))
                todo += [(level, a[k:k + part], b[k:k + part]) for k in range(0, len(a), part)]
            else:
                ok = (self.comps[a] != other.comps[b])
                a, b = a[ok], b[ok]
                na, nb = self.sizes[a], other.sizes[b]
                ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                ok &= (100 + percent) * np.minimum(self.rest[a], other.rest[b]) >= percent * (na + nb)  # see _dealt_out
                for mine_, yours_, full in ((self.rough, other.rough, 65535), (self.points, other.points, 255)):
                    a, b = a[ok], b[ok]
                    ok = _reaches(mine_[a], yours_[b], self.sizes[a] + other.sizes[b], full, percent)
                if ok.any():
                    yield a[ok], b[ok]


def _reaches(p: np.ndarray, q: np.ndarray, sizes: np.ndarray, full: int, percent: int) -> np.ndarray:
    return (100 + percent) * np.minimum(overlap_bound(p, q, full), 1 << 40) >= percent * sizes


def _rank(order_by: tuple, *group: np.ndarray) -> np.ndarray:
    """Place of every element within its group, by ``order_by`` (last key first, as in lexsort)."""
    o = np.lexsort((*order_by, *group))
    new = np.zeros(len(o), bool)
    new[:1] = True
    for g in group:
        new[1:] |= g[o][1:] != g[o][:-1]
    at = np.flatnonzero(new)
    rank = np.empty(len(o), np.int64)
    rank[o] = np.arange(len(o)) - np.repeat(at, np.diff(np.append(at, len(o))))
    return rank


def _best(found: list[tuple], limit: int) -> tuple[tuple, bool]:
    """The pairs with the highest bounds: ``limit`` per pair of components, of these 2 x ``limit`` per
    class; whether others were held back."""
    a, b, ca, cb, ratio = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = _rank((b, a, -ratio), cb, ca) < limit
    rest = tuple(x[keep] for x in (a, b, ca, cb, ratio))
    a, b, _, _, ratio = rest
    near = (_rank((b, -ratio), a) < 2 * limit) | (_rank((a, -ratio), b) < 2 * limit)
    return tuple(x[near] for x in rest), not (keep.all() and near.all())


def tree_pairs(left: RTree, right: RTree, percent: int, limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Candidate pairs (a < b) of nodes, all or the best by ``limit``; with the pairs, whether any was held back."""
    found, size, held = [], 0, False
    for x, y in left.join(right, percent):
        a, b, ca, cb = left.nodes[x], right.nodes[y], left.comps[x], right.comps[y]
        a, b, ca, cb = np.minimum(a, b), np.maximum(a, b), np.minimum(ca, cb), np.maximum(ca, cb)
        if limit is None:
            yield a, b, False
            continue
        found.append((a, b, ca, cb, overlap_bound(left.points[x], right.points[y]) / (left.sizes[x] + right.sizes[y])))
        size += len(a)
        if size > HELD:
            best, more = _best(found, limit)
            found, size, held = [best], len(best[0]) // 2, held or more
    if found:
        (a, b, *_), more = _best(found, limit)
        yield a, b, held or more


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return start, np.append(start[1:], len(key))


def _placed(hashed: str, place: str):
    """A hash without its last bits, and its place in the prefix in them (the largest that fits, at most).

    Hashes that become equal make candidates that are verified like all others."""
    most = (1 << PLACE_BITS) - 1
    return F.col(hashed).bitwiseAND(F.lit(~most)).bitwiseOR(F.least(F.col(place), F.lit(most)).cast("long"))


def _key_of(at: str):
    return F.shiftright(at, PLACE_BITS)


def _several(rows: DataFrame, columns: str, differ: str) -> DataFrame:
    """Rows whose key is shared by rows with different values of ``differ``; one shuffle, one sort."""
    dealt = rows.repartition(_key_of("at")).withColumn("key", _key_of("at")).sortWithinPartitions("key", differ)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, ["key"]):
            start, end = _groups(t.column("key").to_numpy())
            c = t.column(differ).to_numpy()
            keep = np.repeat(c[start] != c[end - 1], end - start)
            if keep.any():
                yield from t.filter(pa.array(keep)).select(names).combine_chunks().to_batches()

    return dealt.mapInArrow(run, columns)


def _dealt_out(rows: DataFrame, percent: int) -> DataFrame:
    """What hashes shared by classes of different components call for, in one shuffle and one sort.

    A hash of at most FEW classes gives its pairs (a, b) that may be similar by their sizes and places in the
    prefix; one of more gives its rows (key, node, place) with their number c, for the R-trees."""
    place = F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    dealt = (rows.repartition(_key_of("at")).select(_key_of("at").alias("key"), place.alias("place"), "node", "comp", "n")
             .sortWithinPartitions("key", "comp", "node"))
    names = ["key", "node", "place", "c", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, ["key"]):
            key, node, comp, n, place = (t.column(c).to_numpy() for c in ("key", "node", "comp", "n", "place"))
            start, end = _groups(key)
            size = np.repeat(end - start, end - start)
            shared = np.repeat(comp[start] != comp[end - 1], end - start)
            many = shared & (size > FEW)
            if many.any():
                none = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(node[many]), pa.array(place[many]), pa.array(size[many]), none, none], names=names)
            left = np.repeat(end, end - start) - np.arange(len(key)) - 1  # rows of the key behind each
            fits = shared & (size <= FEW)
            for d in range(1, FEW):
                a = np.flatnonzero(fits & (left >= d))
                b = a + d
                rest = np.minimum(n[a] - place[a], n[b] - place[b])
                ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                ok &= (100 + percent) * rest >= percent * (n[a] + n[b])  # unless an earlier hash is shared too, which has its own rows
                if ok.any():
                    one, two = node[a[ok]], node[b[ok]]
                    pair = np.unique(np.stack((np.minimum(one, two), np.maximum(one, two))), axis=1)
                    none, nil = pa.nulls(pair.shape[1], pa.int64()), pa.nulls(pair.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([none, none, nil, none, pa.array(pair[0]), pa.array(pair[1])], names=names)

    return dealt.mapInArrow(run, "key long, node long, place int, c long, a long, b long")


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, ratio) of the pairs whose points allow the similarity."""
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    rows = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "pa", "pb", (F.col("na") + F.col("nb")).alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p, q = unpacked(b.column(2)), unpacked(b.column(3))
            size, bound = b.column(4).to_numpy(), np.minimum(overlap_bound(p, q), 1 << 40)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bound / size)], names=["a", "b", "ratio"])
            yield out.filter(pa.array((100 + percent) * bound >= percent * size))

    return rows.mapInArrow(run, "a long, b long, ratio double")


def _pair_batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"])


def _tree_round(shards: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, limit: int | None, shard: int) -> DataFrame:
    """Candidate pairs of one round, distinct; a row with null nodes names a hash that held some back."""
    comp = F.coalesce("label", "node").alias("comp")
    members = shards.join(classes.join(labels, "node", "left").select("node", comp, "n", "point"), "node")
    members = members.withColumn("rest", F.col("n") - F.col("place")).withColumn("blocks", F.ceil(F.col("c") / shard).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) as i, greatest(own, o) as j))")
    members = members.withColumn("own", own).withColumn("cell", F.explode(cells))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, ["key", "i", "j"]):
            nodes, comps, sizes, rest, own, key, i, j = (t.column(c).to_numpy() for c in ("node", "comp", "n", "rest", "own", "key", "i", "j"))
            points = unpacked(t.column("point"))
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            pairs: list[np.ndarray] = []
            held_keys = []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(nodes)], strict=True):
                if (comps[s:e] != comps[s]).any():
                    sides = [np.flatnonzero(own[s:e] == x) + s for x in ((i[s],) if i[s] == j[s] else (i[s], j[s]))]
                    if all(len(x) for x in sides):
                        trees = [RTree(nodes[x], comps[x], sizes[x], rest[x], points[x]) for x in sides]
                        for x, y, held in tree_pairs(trees[0], trees[-1], percent, limit):
                            pairs.append(np.stack((x, y)))
                            if held:
                                held_keys.append(key[s])
                if sum(x.shape[1] for x in pairs) > HELD:
                    yield _pair_batch(pairs)
                    pairs = []
            if pairs:
                yield _pair_batch(pairs)
            if held_keys:
                none = pa.nulls(len(held_keys), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(held_keys, pa.int64()), none, none], names=["key", "a", "b"])

    cell = members.select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "own", "node", "comp", "n", "rest", "point")
    dealt = cell.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(join, "key long, a long, b long").distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first row of every component, and all rows without words, with the columns of ``docs``.

    The rows are written once with a number, as their places in two scans of the input may differ.
    They and the numbers of those that go are all that stays on disk."""
    rows = written(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("row_id")), "jaccard-rows")
    known = rows.select(F.col("_row")[key].alias(key), F.col("_row")[text].alias(text), F.col("row_id").alias("_place"))
    with passing(docs.sparkSession):
        found = near_duplicates(known, width, percent, text, key, place="_place")
        gone = written(found.where((F.col("n_shingles") > 0) & ~F.col("is_first")).select("row_id"), "jaccard-gone", stays=True)
    # only rows that may go are shuffled with their texts
    sure, unsure = parted(rows, gone, "row_id")
    return sure.unionByName(unsure.join(gone, "row_id", "left_anti")).select("_row.*")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id",
                    shard: int = 20_000, place: str | None = None) -> DataFrame:
    """Per row: key, n_shingles, and component_id, the smallest key reachable by links.

    Two rows link when their shingle sets have a Jaccard similarity of at least ``percent`` / 100.
    A row's links within its class are not listed; classes are."""
    feats = features(docs, width, percent, text, key, place)
    classes = (feats.where("n > 0").groupBy("c1", "c2", "n")
               .agg(F.min("row_id").alias("node"), F.min(key).alias("doc"), F.first("point", ignorenulls=True).alias("point")))
    classes = written(classes, "jaccard-classes")
    heads = feats.where("hashes is not null")  # at most one row of a class from each task
    node = written(heads.select("row_id", "c1", "c2", "n").join(classes.select("c1", "c2", "node"), ["c1", "c2"])
                   .select("row_id", "node", "n"), "jaccard-heads")

    first = (heads.select("row_id", F.explode("first").alias("key")).join(node, "row_id")
             .where("row_id = node").select("node", "n", "key"))
    # two rulers of size bands, so that sizes within 7 % of each other share a band of one of them
    band = F.log(F.col("n")) / float(np.log(1.15))
    rulers = F.array(*[F.struct(F.lit(k).alias("ruler"), F.floor(band + k / 2).alias("band")) for k in (0, 1)])
    first = first.select("node", "n", "key", F.inline(rulers))
    pick = F.min_by(F.struct("n", "node"), F.xxhash64("node", "key")).alias("hub")  # each hash its own hub, any of its classes
    hubs = first.groupBy("key", "ruler", "band").agg(pick, F.count(F.lit(1)).alias("c")).where("c > 1")
    stars = (first.join(hubs.select("key", "ruler", "band", F.col("hub.n").alias("hn"), F.col("hub.node").alias("hub")), ["key", "ruler", "band"])
             .where(f"node <> hub and 100 * least(hn, n) >= {percent} * greatest(hn, n)")
             .select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    best = Window.partitionBy("b").orderBy(F.desc("ratio"), "a")  # at most 2 x FIRST hubs of one class
    stars = _bounded(stars, classes, percent).withColumn("r", F.row_number().over(best)).where(F.col("r") <= HUBS)
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = written(stars, "jaccard-stars")
    links = verify(stars, classes, docs, width, percent, text, key, "jaccard-links-0")
    labels = components(links)

    rows = heads.select("row_id", F.posexplode("hashes").alias("place", "key")).select(_placed("key", "place").alias("at"), "row_id")
    shared = written(_several(rows, "at long, row_id long", "row_id"), "jaccard-shared")
    sizes = written(feats.select(key, "row_id", "n", "c1", "c2"), "jaccard-sizes")
    discard(docs.sparkSession, feats, stars)   # prefix hashes and points are not read from there again
    comp = F.coalesce("label", "node").alias("comp")
    whose = node.where("row_id = node").join(labels, "node", "left").select("row_id", "node", "n", comp)
    shards = written(_dealt_out(shared.join(whose, "row_id").select("at", "node", "comp", "n"), percent), "jaccard-shards")
    discard(docs.sparkSession, node, shared)
    few = shards.where("a IS NOT NULL").select("a", "b").distinct()
    small = written(_bounded(few, classes, percent).select("a", "b"), "jaccard-few")
    if small.limit(1).count():
        links = links.union(verify(small, classes, docs, width, percent, text, key, "jaccard-links-few"))
        labels = components(links, "components-few")

    large = shards.where("key IS NOT NULL").select("key", "node", "place", "c")
    done = small
    for k, limit in enumerate(ROUNDS):
        found = written(_tree_round(large, classes, labels, percent, limit, shard), f"jaccard-pairs-{k}")
        held = found.where("a is null").select("key")
        new = written(found.where("a is not null").join(done, ["a", "b"], "left_anti"), f"jaccard-new-{k}")
        if new.limit(1).count():
            links = links.union(verify(new, classes, docs, width, percent, text, key, f"jaccard-links-{k + 1}", screen=True))
            labels = components(links, f"components-{k + 1}")
        if not held.limit(1).count():
            break
        large = large.join(held.distinct(), "key", "left_semi")
        done = done.union(found.where("a is not null").select("a", "b"))

    named = classes.join(labels, "node", "left").select("c1", "c2", "doc", F.coalesce("label", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "comp").select("c1", "c2", "comp", "component_id")
    return (sizes.join(named, ["c1", "c2"], "left")
            .select(key, F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"), "row_id",
                    F.coalesce(F.col("row_id") == F.col("comp"), F.lit(False)).alias("is_first")))
