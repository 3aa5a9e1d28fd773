import random

import numpy as np
import pyarrow as pa

from tablecare.llm import jaccard

from .helpers import EDGES, LOWER, SMALL, WORD, documents


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b, o = sets[j], len(a & sets[j])
            if o and 100 * o >= 75 * (len(a) + len(b) - o):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((str(k), len(s), str(least.get(root(i)))) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def check(frame, **kw):
    got = jaccard.near_duplicates(frame, **kw).select("doc_id", "n_shingles", "component_id").collect()
    want = plain([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    assert sorted((str(a), b, str(c)) for a, b, c in got) == want


def test_whole_table(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))


def family(r, n, size, start):
    base = [f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(max(1, size // 25))):
            w[r.randrange(size)] = f"new{r.randrange(10 ** 6)}"
        out.append((start + i, " ".join(w), "s"))
    return out


def test_families_chains_and_edges(spark, tmp_path):
    r = random.Random(5)
    rows = [*EDGES]
    for f in range(12):
        rows += family(r, r.randrange(2, 12), r.randrange(5, 200), 1000 * (f + 1))
    shared = " ".join(f"common{i}" for i in range(40))
    rows += [(50_000 + i, shared + " " + " ".join(f"u{i}x{j}" for j in range(r.randrange(5, 60))), "s") for i in range(60)]
    r.shuffle(rows)
    docs = documents(spark, rows, tmp_path)
    check(docs)
    check(docs, shard=16)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    comps = {(c, n) for _, n, c in plain([(x[0], x[1]) for x in rows]) if n}
    assert kept.where("text is not null and trim(text) not in ('', '\\n')").count() == len(comps)


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_finds_all_similar_points():
    r = np.random.default_rng(1)
    base = r.poisson(2.0, (40, jaccard.GROUPS))
    points = np.concatenate([np.maximum(0, base + r.integers(-1, 2, base.shape) * (r.random(base.shape) < 0.02)) for _ in range(6)])
    points = np.minimum(points, 255).astype(np.uint8)
    sizes = points.sum(1, dtype=np.int64)
    ids = np.arange(len(points))
    trees = [jaccard.RTree(ids[x], ids[x], sizes[x], sizes[x], points[x]) for x in (slice(0, 130), slice(130, None), slice(None))]
    both = np.minimum(points[:, None], points).sum(2, dtype=np.int64)
    total = sizes[:, None] + sizes
    want = (175 * both >= 75 * total) & (100 * np.minimum(sizes[:, None], sizes) >= 75 * np.maximum(sizes[:, None], sizes))
    pairs = {(i, j) for i, j in zip(*np.nonzero(want)) if i < j}

    def found(x, y, limit=None):
        return {(int(a), int(b)) for xs, ys, _ in jaccard.tree_pairs(x, y, 75, limit) for a, b in zip(xs, ys)}
    assert found(trees[2], trees[2]) == found(trees[2], trees[2], 1000) == pairs
    assert found(trees[0], trees[1]) == {(i, j) for i, j in pairs if i < 130 <= j}
    few = list(jaccard.tree_pairs(trees[2], trees[2], 75, 1))
    assert few[0][2] and len(few[0][0]) < len(pairs)
    assert pairs and len(pairs) < len(points) ** 2 / 4


def test_rows_are_known_though_the_scans_differ(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(60)), "s") for i in range(200)]  # every text twice
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(path)
    docs, before = spark.read.parquet(path), jaccard.near_duplicates

    def then_other_splits(*args, **more):
        found = before(*args, **more)
        found = spark.createDataFrame(found.toPandas(), found.schema)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")  # as if executors were lost between the scans
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        return found

    monkeypatch.setattr(jaccard, "near_duplicates", then_other_splits)
    try:
        got = {r["doc_id"]: r["text"] for r in jaccard.keep_one(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 100 and len(set(got.values())) == 100


def test_points_and_places_are_sent_small():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 40, 480, 6000, 200_000)]
    sets.append(np.arange(900, dtype=np.uint64) * np.uint64(jaccard.GROUPS))   # one group, cut off
    points = [jaccard.point_of(s) for s in sets]
    stored = [jaccard.packed(p) for p in points]
    assert jaccard.unpacked(pa.array(stored, pa.binary())).tobytes() == b"".join(points)
    assert max(len(x) for x in stored[:3]) < jaccard.GROUPS // 3


def test_screen_drops_no_similar_pair(spark, tmp_path, monkeypatch):
    """Long documents round the limit, compared on a part of their sets first: the links are those of the whole sets."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 10**9, 1500)]
    rows = []
    for k in range(24):
        words = list(base)
        for at in rng.choice(len(words), 8 * k, replace=False):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    sets = [set(tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)) for _, t in rows]
    want = {(a, b) for a in range(24) for b in range(a + 1, 24) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert 0 < len(want) < 276
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    feats = jaccard.features(docs, 5, 75, "text", "doc_id").where("n > 0")
    classes = jaccard.written(feats.selectExpr("c1", "c2", "n", "doc_id as node", "doc_id as doc"), "test-classes")
    pairs = spark.createDataFrame([(a, b) for a in range(24) for b in range(a + 1, 24)], "a long, b long")
    sent = []
    whole = jaccard._overlapping

    def spy(pairs, sets, column, *more):
        sent.append((column, pairs.count()))
        return whole(pairs, sets, column, *more)

    monkeypatch.setattr(jaccard, "_overlapping", spy)
    got = {(r["a"], r["b"]) for r in jaccard.verify(pairs, classes, docs, 5, 75, "text", "doc_id", "test-links", screen=True).collect()}
    assert got == want
    assert sent[0] == ("low", 276) and sent[1][0] == "shingles" and len(want) <= sent[1][1] < 276


def test_a_common_passage_calls_for_no_large_trees(spark, tmp_path, monkeypatch):
    r = random.Random(11)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(60))} {passage} {' '.join(f'v{i}x{j}' for j in range(60))}", "s") for i in range(400)]
    rows += family(r, 6, 120, 1000)
    rows += [(2000 + i, passage + f" end{i}" * (i % 3), "s") for i in range(9)]   # little beside the passage
    docs = documents(spark, rows, tmp_path)
    put, large = jaccard.written, []

    def held(df, name, **kw):
        out = put(df, name, **kw)
        if name == "jaccard-shards":
            large.extend(out.where("key is not null").select("c").collect())
        return out

    monkeypatch.setattr(jaccard, "written", held)
    check(docs)
    assert max((x["c"] for x in large), default=0) < 50   # 400 in order of the hashes alone


def test_prefix_order_holds_for_all_sets():
    r = np.random.default_rng(2)
    levels = np.zeros(1 << jaccard.CELL_BITS, np.uint8)
    pool = np.unique(r.integers(0, 1 << 64, 300, dtype=np.uint64))
    levels[jaccard._cells(pool)] = r.integers(0, 4, len(pool))
    order = sorted(pool.tolist(), key=lambda x: (levels[x >> (64 - jaccard.CELL_BITS)], x))
    for n in (1, 2, 7, 40, len(pool)):
        s = np.sort(r.choice(pool, n, replace=False))
        mine = set(s.tolist())
        assert jaccard.prefix(s, 75, levels).tolist() == [x for x in order if x in mine][:jaccard.prefix_length(n, 75)]
