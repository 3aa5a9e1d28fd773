"""Moments of all pairs of columns, in tiles (V4).

A task holds the pairwise-complete moments of its rows: for every pair the rows with both present, their
means, centred sums of squares and products, and extremes. It sends them as one row per pair of column
tiles. Where no column of two tiles has a gap, which is the rule, the products alone depend on the pair
and the rest is kept once per column: one number a pair instead of ten. Rows of the same tiles are merged
by the parallel formula in two steps, first of ``GROUP`` tasks each, then of the groups, one row after
another, so no task holds more than a few tiles.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Columns of a tile, and tasks merged in the first step.
TILE, GROUP = 64, 64
PAIR = ("n", "mx", "my", "sxx", "syy", "sxy", "lox", "hix", "loy", "hiy")
TILES = "p int, q int, task long, tile binary"
Moments = dict[str, np.ndarray]


def block_moments(x: np.ndarray) -> Moments:
    """Pairwise-complete moments of the columns of one block of rows, as k x k arrays (of i, then of j)."""
    k = x.shape[1]
    m = ~np.isnan(x)
    out = {c: np.zeros((k, k), np.longdouble if c in ("mx", "my") else float) for c in PAIR}
    full = m.all(axis=0)
    if full.any() and len(x):   # columns without a gap: one centring serves all their pairs
        at = np.flatnonzero(full)
        v = x[:, at]
        d = v - v.mean(axis=0)
        ones = np.ones(len(at))
        own = {"mx": _finer(v.mean(axis=0), d.mean(axis=0)), "sxx": (d * d).sum(axis=0), "lox": v.min(axis=0), "hix": v.max(axis=0)}
        ij = np.ix_(at, at)
        out["n"][ij] = float(len(x))
        out["sxy"][ij] = d.T @ d
        for name, a in own.items():
            out[name][ij] = np.outer(a, ones)
            out[_OTHER[name]][ij] = np.outer(ones, a)
    for j in np.flatnonzero(~full):   # j has gaps: centre every column on the rows it shares with j
        both = m[:, [j]] & m
        n = both.sum(axis=0).astype(float)
        some = n > 0
        xi, yj = np.where(both, x, 0.0), np.where(both, x[:, [j]], 0.0)
        mx, my = xi.sum(axis=0) / np.maximum(n, 1), yj.sum(axis=0) / np.maximum(n, 1)
        dx, dy = np.where(both, x - mx, 0.0), np.where(both, x[:, [j]] - my, 0.0)
        mx, my = (_finer(a, b.sum(axis=0) / np.maximum(n, 1)) for a, b in ((mx, dx), (my, dy)))
        part = {"n": n, "mx": mx, "my": my, "sxx": (dx * dx).sum(axis=0), "syy": (dy * dy).sum(axis=0), "sxy": (dx * dy).sum(axis=0),
                "lox": np.where(both, x, np.inf).min(axis=0, initial=np.inf), "hix": np.where(both, x, -np.inf).max(axis=0, initial=-np.inf),
                "loy": np.where(both, x[:, [j]], np.inf).min(axis=0, initial=np.inf),
                "hiy": np.where(both, x[:, [j]], -np.inf).max(axis=0, initial=-np.inf)}
        for name, a in part.items():
            a = np.where(some, a, 0.0)
            out[name][:, j] = a
            out[_OTHER.get(name, name)][j, :] = a
    return out


_OTHER = {"mx": "my", "my": "mx", "sxx": "syy", "syy": "sxx", "lox": "loy", "loy": "lox", "hix": "hiy", "hiy": "hix"}


def _finer(mean: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A mean with the mean of what is left about it: differences of means far from zero lose digits in doubles."""
    return mean.astype(np.longdouble) + np.where(np.isfinite(left), left, 0.0)


def merge(a: Moments, b: Moments) -> Moments:
    """Moments of two sets of rows together (parallel formula)."""
    n = a["n"] + b["n"]
    w = a["n"] * b["n"] / np.maximum(n, 1)
    dx, dy = ((b[c] - a[c]).astype(float) for c in ("mx", "my"))
    share = b["n"] / np.maximum(n, 1)
    has_a, has_b = a["n"] > 0, b["n"] > 0

    def pick(f, c):
        return np.where(has_a & has_b, f(a[c], b[c]), np.where(has_a, a[c], b[c]))
    return {"n": n, "mx": pick(lambda p, q: p + (q - p) * share, "mx"), "my": pick(lambda p, q: p + (q - p) * share, "my"),
            "sxx": a["sxx"] + b["sxx"] + w * dx * dx, "syy": a["syy"] + b["syy"] + w * dy * dy,
            "sxy": a["sxy"] + b["sxy"] + w * dx * dy, "lox": pick(np.minimum, "lox"), "hix": pick(np.maximum, "hix"),
            "loy": pick(np.minimum, "loy"), "hiy": pick(np.maximum, "hiy")}


def pack(t: Moments) -> bytes:
    """A tile as bytes; the products and one number a column if every pair has the same rows."""
    if (t["n"] == t["n"][0, 0]).all() and all((t[c] == t[c][:, :1]).all() for c in ("mx", "sxx", "lox", "hix")) \
            and all((t[c] == t[c][:1]).all() for c in ("my", "syy", "loy", "hiy")):
        return pickle.dumps((float(t["n"][0, 0]), t["sxy"], [t[c][:, 0].copy() for c in ("mx", "sxx", "lox", "hix")],
                             [t[c][0].copy() for c in ("my", "syy", "loy", "hiy")]))
    return pickle.dumps([t[c] for c in PAIR])


def unpack(data: bytes) -> Moments:
    got = pickle.loads(data)
    if isinstance(got, list):
        return dict(zip(PAIR, got))
    n, sxy, rows, cols = got
    out = {"n": np.full(sxy.shape, n), "sxy": sxy}
    out |= {c: np.repeat(a[:, None], sxy.shape[1], axis=1) for c, a in zip(("mx", "sxx", "lox", "hix"), rows)}
    return out | {c: np.repeat(a[None], sxy.shape[0], axis=0) for c, a in zip(("my", "syy", "loy", "hiy"), cols)}


def _tiles(k: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        with np.errstate(invalid="ignore", over="ignore"):
            for b in batches:
                if b.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
                    part = block_moments(x)
                    total = part if total is None else merge(total, part)
        if total is None:
            return
        task = TaskContext.get().partitionId()
        for p in range(0, k, size):
            rows = [(p // size, q // size, task, pack({c: a[p:p + size, q:q + size] for c, a in total.items()})) for q in range(p, k, size)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                             names=["p", "q", "task", "tile"])
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, Moments]]:
    """Sorted tile rows, one after another, to one of each (p, q, task)."""
    at, total = None, None
    for b in batches:
        for p, q, task, tile in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
            t = unpack(tile.as_py())
            if (p, q, task) == at:
                with np.errstate(invalid="ignore", over="ignore"):
                    total = merge(total, t)
                continue
            if at:
                yield *at, total
            at, total = (p, q, task), t
    if at:
        yield *at, total


def _merge_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, q, task, t in _merged(batches):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), pa.array([task], pa.int64()), pa.array([pack(t)], pa.binary())],
                                         names=["p", "q", "task", "tile"])


def _merge_all(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q, _, t in _merged(batches):
            i, j = (x.ravel() for x in np.indices(t["n"].shape))
            i, j = i + p * size, j + q * size
            keep = (i <= j) & (t["n"].ravel() > 0)
            cols = [pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), *[pa.array(t[c].ravel()[keep].astype(float)) for c in PAIR]]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "j", *PAIR])
    return run


def pair_moments(values: DataFrame, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(i, j, n, …): the moments of the double columns of ``values`` (NULL: missing), for every pair of places i <= j with a common row."""
    ship(values.sparkSession)
    tiles = values.mapInArrow(_tiles(len(values.columns), tile), TILES)
    steps = [(F.floor(F.col("task") / group).cast("long"), _merge_some, TILES),
             (F.lit(0).cast("long"), _merge_all(tile), "i int, j int, " + ", ".join(f"{c} double" for c in PAIR))]
    for task, fn, schema in steps:
        tiles = tiles.withColumn("task", task).repartition("p", "q", "task").sortWithinPartitions("p", "q", "task").mapInArrow(fn, schema)
    return tiles
