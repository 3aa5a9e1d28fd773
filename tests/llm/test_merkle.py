import hashlib
import zlib

from tablecare.llm import merkle
from .helpers import DOCS, EDGES, LOWER, documents

LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """All levels of a tree over the digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """rows: dicts of the LEAF columns."""
    made = []
    for r in rows:
        leaf = digest(*[enc(r[c]) for c in LEAF])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        low = {**r, "text": r["text"].translate(LOWER) if r["text"] is not None else None}
        made.append((r, leaf, digest(*[enc(low[c]) for c in LEAF]) if hit else leaf))
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted([m for m in made if m[0]["lang"] == g], key=lambda m: (m[0]["doc_id"] is not None, m[0]["doc_id"] or 0, m[1])) for g in langs}
    levels = {g: climb([m[1] for m in t]) for g, t in trees.items()}
    top = climb([levels[g][-1][0] for g in langs])
    out = []
    for gi, g in enumerate(langs):
        for i, (r, leaf, now) in enumerate(trees[g]):
            proof = ""
            for tree, at in ((levels[g], i), (top, gi)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8: at // 8 * 8 + 8]
                    left, right = run[:at % 8], run[at % 8 + 1:]
                    proof += "".join(left + right)
                    now = digest(*left, now, *right)
                    at //= 8
            out.append((r["doc_id"], leaf, levels[g][-1][0], top[-1][0], digest(proof), now, now == top[-1][0]))
    return out


def same(df, rows):
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(brute(rows), key=key)


def test_edges_repeats_and_null_groups(spark, tmp_path):
    docs = documents(spark, EDGES, tmp_path)
    rows = [{"doc_id": i, "source": s, "lang": "en", "n_chars": None if t is None else len(t), "text": t} for i, t, s in EDGES]
    same(merkle.verify(docs, LEAF), rows)


def test_many_groups_of_uneven_size(spark, tmp_path):
    sizes = {None: 1, "": 9, "de": 64, "en": 600, "és": 1, **{f"x{i}": 1 + i % 3 for i in range(20)}}
    rows, n = [], 0
    for g, size in sizes.items():
        for _ in range(size):
            rows.append({"doc_id": n, "source": f"s{n % 4}", "lang": g, "n_chars": n, "text": f"Text {n} ÄB" if n % 5 else f"text {n}"})
            n += 1
    path = str(tmp_path / "docs")
    spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "a", "b", "c") for r in rows], DOCS) \
        .repartition(5).write.parquet(path)
    same(merkle.verify(spark.read.parquet(path), LEAF), rows)


def test_lone_row_and_empty_table(spark, tmp_path):
    one = {"doc_id": 6, "source": None, "lang": None, "n_chars": None, "text": None}
    df = spark.createDataFrame([(6, None, None, None, None, "a", "b", "c")], DOCS)
    same(merkle.verify(df, LEAF), [one])
    assert merkle.verify(df, LEAF).first()["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle.verify(df.limit(0), LEAF).collect() == []


def test_tampering_is_found_exactly_where_the_text_changes(spark, tmp_path):
    rows = [(i, "UPPER" if i % 2 else "lower", "s") for i in range(200)]
    got = {r["doc_id"]: r["verified"] for r in merkle.verify(documents(spark, rows, tmp_path), LEAF).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i, _, _ in rows}
    assert not all(got.values())
