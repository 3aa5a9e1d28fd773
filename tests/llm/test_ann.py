import math

import numpy as np
from pyspark.sql import functions as F

from tablecare.llm import ann


def brute(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            s = sorted((-float((v * w).sum() / (math.sqrt((w * w).sum()) * math.sqrt((v * v).sum()))), j) for j, w in good if j != i)
            out[i] = s[:k]
    return out


def test_recall_order_and_edges(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=16)]) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]
    bad = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [None] + [1.0] * 15), (5200, [float("nan")] * 16),
           (5250, [float("inf")] + [0.0] * 15), (5300, [1.0] * 15), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows + bad]
    want = brute(rows32)
    got = {}
    for q in ann.nearest(table, F.col("vec_id") % 50 == 0, shard=256, block=16).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == set(want)
    hits = total = 0
    for i, s in want.items():
        mine = sorted(got[i])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {j for _, j in s})
        total += len(s)
    assert hits / total >= 0.9
    assert [m[1] for m in sorted(got[0])] == [2000, 2001, 2002, 2003, 2004]


def test_few_rows_and_none(spark):
    some = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(some, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(a, b, c) for a, b, c, _ in got] == [(0, 1, 1), (0, 2, 2)] and abs(got[0][3] - math.sqrt(0.5)) < 1e-15
    assert ann.nearest(some.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(some.where("vec_id = 0"), F.lit(True)).count() == 0


def test_probing_retrieves_the_whole_ball():
    r = np.random.default_rng(3)
    codes = r.integers(0, 256, (3000, 4), dtype=np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 7, 9, 14, 32):
        want = np.flatnonzero(ann.distances(codes, codes[5]) <= radius)
        assert (index.within(codes[5], radius) == want).all()
