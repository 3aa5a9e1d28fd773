"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors of unit length are centred, turned to their principal axes and rotated so that the
signs lose least (alternating least squares, as many bits as dimensions); axes and rotation are
learnt from a bounded sample. Index: every vector's code is split into byte-wide substrings, and a
table per substring lists the vectors by its value. Search: if two codes differ in at most ``r``
bits, then at least one of ``m`` substrings differs in at most ``floor(r / m)``; probing those
values in every table and checking the whole code retrieves exactly the codes within ``r``. They
are reranked by the cosine of the original vectors in double precision.

The radius is learnt on the sample: the smallest that holds ``cover`` of the sample's true nearest
neighbours among itself (neighbours in the whole table are nearer, so recall there is higher). A
query that finds fewer than ``k`` vectors in a shard widens its radius there until it has them.

How the work is spread: vectors are dealt at random into shards of bounded size, each with its own
index; queries go in blocks of bounded size to every shard; a shard returns its ``k`` best per
query, and these are merged. A common vector is spread over the shards like any others.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do those whose number of components is not the table's most frequent (the smaller of
equals); rows with the query's vec_id count as the query's own; repeated rows with one vec_id are
candidates each; equal query rows are asked once, unequal ones with one vec_id share its ranks; rows
with a null vec_id take no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import complete_groups, hashed_sample, ship, written

#: Rows of the sample that axes, rotation and radius are learnt from.
SAMPLE = 8192
#: Sampled rows whose neighbours set the radius.
SAMPLE_QUERIES = 512


def learn_rotation(x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) of unit vectors."""
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    p = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(p.T @ np.where(p @ turn > 0, 1.0, -1.0))
        turn = u @ vt
    return mean, axes @ turn


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Packed sign codes, one row of bytes per vector."""
    return np.packbits((x - mean) @ projection > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def learn_radius(x: np.ndarray, codes: np.ndarray, k: int, cover: float) -> int:
    q = np.arange(min(SAMPLE_QUERIES, len(x)))
    found = []
    for i in q:
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(s) - 1) - 1)[:k] if len(s) > 1 else []
        found.append(distances(codes[near], codes[i]) if len(near) else np.empty(0, np.int64))
    d = np.sort(np.concatenate(found)) if found else np.empty(0)
    return int(d[min(len(d) - 1, int(np.ceil(cover * len(d))) - 1)]) if len(d) else 8 * codes.shape[1]


def flips(bits: int) -> list[int]:
    """Byte patterns with exactly ``bits`` bits set."""
    return [sum(1 << i for i in c) for c in combinations(range(8), bits)]


class MultiIndex:
    """One table per byte of the code: vectors in order of the byte's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        values = np.arange(257)
        self.start = np.stack([np.searchsorted(np.sort(c), values) for c in codes.T])
        self.probes = [np.array([f for b in range(r + 1) for f in flips(b)], np.int64) for r in range(9)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes that differ from ``code`` in at most ``radius`` bits."""
        tables = self.codes.shape[1]
        hit = np.zeros(len(self.codes), bool)
        for j in range(tables):
            values = self.probes[min(8, radius // tables)] ^ int(code[j])
            for a, b in zip(self.start[j, values], self.start[j, values + 1], strict=True):
                if a < b:
                    hit[self.order[a:b, j]] = True
        at = np.flatnonzero(hit)
        return at[distances(self.codes[at], code) <= radius]


def usable(vectors: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """(id, asks, v) rows that take part, as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0))


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in col.chunks] or [np.empty(0)]).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            cover: float = 0.97, shard: int = 8192, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``is_query`` selects."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors, is_query, key, vector)
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, total = dims["d"], dims["n"]
    good = good.where(F.size("v") == dim)
    rows = hashed_sample(good.select("id", "v"), SAMPLE, "id", "v")
    x = np.array([r["v"] for r in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    mean, projection = learn_rotation(x)
    radius = learn_radius(x, codes_of(x, mean, projection), k, cover)
    model = spark.sparkContext.broadcast((mean, projection, radius))

    shards = max(1, -(-total // shard))
    index = good.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    asked = written(good.where("asks").select("id", "v").distinct(), "ann-queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    sides = (index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("asks"), "id", "v")
             .union(asked.select(every, "block", F.lit(1).alias("asks"), "id", "v")))
    dealt = sides.repartition("shard", "block").sortWithinPartitions("shard", "block", "asks", "id")

    def search(batches):
        mean, projection, radius = model.value
        for t in complete_groups(batches, ["shard", "block"]):
            both = t.column("shard").to_numpy().astype(np.int64) << 32 | t.column("block").to_numpy()
            start = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(both)], strict=True):
                yield from _search_group(t.slice(s, e - s), dim, k, mean, projection, radius)

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _search_group(t: pa.Table, dim: int, k: int, mean: np.ndarray, projection: np.ndarray, radius: int):
    ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy() == 1
    v = _matrix(t.column("v"), dim)
    norm = np.sqrt((v * v).sum(1))
    codes = codes_of(v / norm[:, None], mean, projection)
    at = np.flatnonzero(~asks)
    if not len(at) or asks.all() or not asks.any():
        return
    own_ids, own, own_norm, index = ids[at], v[at], norm[at], MultiIndex(codes[at])
    q_out, v_out, s_out = [], [], []
    for i in np.flatnonzero(asks):
        r = radius
        while True:
            c = index.within(codes[i], r)
            c = c[own_ids[c] != ids[i]]
            if len(c) >= k or r >= 8 * codes.shape[1]:
                break
            r += max(2, r // 8)
        score = (own[c] * v[i]).sum(1) / (own_norm[c] * norm[i])
        best = np.lexsort((own_ids[c], -score))[:k]
        q_out.append(np.full(len(best), ids[i]))
        v_out.append(own_ids[c[best]])
        s_out.append(score[best])
    if q_out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (q_out, v_out, s_out)], names=["query_id", "vec_id", "score"])
