import math

import numpy as np
import pytest

from tablecare.llm import quality

from .helpers import EDGES, SMALL, WORD, documents

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    where = {}
    for i, x in enumerate(windows):
        where.setdefault(x, []).append(i)
    hit = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_counts_match_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for frame in (docs, documents(spark, EDGES, tmp_path)):
        got = quality.quality_counts(frame, keep=["doc_id", "text"]).toPandas()
        assert [tuple(r) for r in got[FIELDS].itertuples(index=False)] == [plain(t) for t in got["text"]]
        assert got["base_failed"].tolist() == [a < 10 or 100 * b > 20 * a for a, b in zip(got["n_words"], got["n_repeat_words"])]


@pytest.mark.parametrize("k,n,delta", [(0, 100, 0.05), (3, 250, 0.01), (40, 400, 0.001)])
def test_bound_is_exact(k, n, delta):
    p = quality.upper_bound(k, n, delta)
    assert math.isclose(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)), delta, rel_tol=1e-6)
    assert quality.upper_bound(n, n, delta) == 1.0 and quality.upper_bound(0, 0, delta) == 1.0


def test_choice_takes_the_best_admissible_cutoff():
    grid = [0.9, 0.5, 0.1]
    good, bad = np.array([9000, 4, 0, 0]), np.array([100, 50, 30, 20])  # 4 good and 50 bad over 0.1 alone, 20 bad over all three
    assert quality.choose(good, bad, grid, 0.01, 0.01, 5.0) == 0.1
    assert quality.choose(good, bad, grid, 0.01, 0.01, 20.0) == 0.5
    assert quality.choose(good // 100, bad, grid, 0.01, 0.01, 5.0) is None
    assert quality.choose(np.array([9000, 0, 0, 200]), bad, grid, 0.01, 0.01, 0.0) is None


def test_cutoffs_limit_false_rejections(spark):
    rows = [(i, "en" if i % 2 else "de", 100, 600, 300 if i % 10 == 0 else (i % 7), 0, 0, 5, 3) for i in range(20_000)]
    counts = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    counts = counts.selectExpr("*", "false as base_failed")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(0, 20_000)] + [(3, None), (None, 1), (3, 1)],
                                   "doc_id long, quality int")
    cut = quality.fit_cutoffs(counts, labels)
    got = quality.apply_cutoffs(counts, cut).toPandas()
    bad = got["doc_id"] % 10 == 0
    assert not got.loc[bad & (got["lang"] == "de"), "kept"].any()
    assert got.loc[~bad].groupby("lang")["kept"].mean().min() > 0.95


def test_without_labels_only_the_base_rule_holds(spark, tmp_path):
    docs = documents(spark, EDGES, tmp_path)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, none).toPandas()
    assert (got["kept"] == ~got["base_failed"]).all() and len(got) == len(EDGES)
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [7, 9]
    assert quality.judge(docs.limit(0), none).count() == 0
