import numpy as np

from tablecare.llm.graph import by_joins, components


def test_both_ways_find_the_same_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(1040, 7)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for solve in (components, by_joins):
        assert {r["node"]: r["label"] for r in solve(edges).collect()} == want
        assert solve(edges.limit(0)).count() == 0
