import math
import random
import re
from collections import Counter

from tablecare.llm import lexical
from .helpers import EDGES, LOWER, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t, *_ in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (d, c) in enumerate(counts):
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, (d is not None, d or 0), at, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def asked(spark, items):
    return spark.createDataFrame([(*i, "a", "b") for i in items], "item_id long, text string, m string, score string")


def key(t):
    return tuple((x is not None, x) for x in t)


def check(spark, docs, items, tmp_path, k=50):
    got = lexical.search(documents(spark, docs, tmp_path), asked(spark, items), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(docs, items, k), key=key)


def test_edges(spark, tmp_path):
    items = [(1, "ONE document, two words"), (1, "one"), (None, "null id"), (2, None), (3, ""), (4, "w1x1 w5x5 字 Ünïcode 中文"), (5, "unseen")]
    check(spark, EDGES, items, tmp_path)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 12, 12, 12, 40, 200]))), f"s{i % 3}") for i in range(n)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([1, 5, 20])))) for j in range(25)]
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = corpus(900, 1)
    check(spark, docs, items, tmp_path, k=7)


def test_ties_and_one_hot_stratum_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "FIRST", 1)
    docs = [(1000 - i, "same words in every copy", "a") for i in range(300)] + [(2000 + i, f"other words {i}", "b") for i in range(200)]
    check(spark, docs, [(1, "same words"), (2, "other copy"), (3, "words")], tmp_path, k=9)


def test_items_in_several_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 40)
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    docs, items = corpus(300, 2)
    check(spark, docs, items, tmp_path, k=5)


def test_whole_index_finds_the_same(spark, tmp_path):
    docs, items = corpus(300, 3)
    index = lexical.Index(documents(spark, docs, tmp_path))
    got = sorted(tuple(r) for r in index.search(asked(spark, items), k=5).collect())
    assert got == sorted(brute(docs, items, 5))
    kept = {t for r in index.blocks.select("terms").collect() for t in r[0]}
    assert kept == {t for _, text, _ in docs for t in terms(text)}


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [(1, "a b", "s")], tmp_path)
    some = asked(spark, [(1, "a")])
    assert lexical.search(docs.limit(0), some).collect() == []
    assert lexical.search(docs.where("text is null"), some).collect() == []
    assert lexical.search(docs, some.limit(0)).collect() == []
    assert lexical.search(docs, asked(spark, [(1, None)])).collect() == []
