from collections import Counter

import numpy as np

from tablecare.llm import common, mixing

from .helpers import EDGES, SMALL, WORD, documents


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def check(docs, labels):
    got = mixing.mix(docs, labels).toPandas()
    text = {}
    for r in docs.collect():
        text.setdefault(r["source"], []).append(len(WORD.findall(r["text"] or "")))
    targets = plain_targets({s: sum(v) for s, v in text.items()})
    got["source"] = got["source"].where(got["source"].notna(), None)
    assert len(got) == sum(map(len, text.values()))
    for s, sizes in text.items():
        mine = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert sorted(mine["size"]) == sorted(sizes) and set(mine["source_size"]) == {sum(sizes)}
        assert abs(mine["target"] - targets[s]).max() < 1e-6 * max(1.0, targets[s])
        assert abs(mine["taken"].sum() - targets[s]) <= max(sizes) / 2 + 1
        assert (mine["taken"] <= 3 * mine["size"]).all()
    return got


def test_taken_words_come_near_the_targets(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    one, two = check(docs, labels), check(docs, labels)
    assert one.sort_values("doc_id")["taken"].tolist() == two.sort_values("doc_id")["taken"].tolist()


def test_edges_and_hot_equal_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    same = [(100, "the very same words", "a")] * 300 + [(k, "some words " * (k % 9), "b") for k in range(200, 260)]
    docs = documents(spark, [r for r in EDGES if r[0] != 7] + same, tmp_path)
    check(docs, labels)
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns and rows.count() > 0
    assert mixing.mix(docs.limit(0), labels).count() == 0 and mixing.mix_rows(docs.limit(0)).count() == 0


def test_heavier_rows_come_first(spark):
    docs = spark.createDataFrame([(i, "ten words are in this text as you can see", "s" if i < 400 else "t") for i in range(800)],
                                 "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, quality int")
    got = mixing.mix(docs, labels).where("source = 's'").toPandas()
    taken = got["taken"] > 0
    good = got["doc_id"] % 2 == 1
    assert taken[good].mean() > taken[~good].mean() + 0.2


def test_the_pipeline_draws_good_rows_more_often(spark, tmp_path):
    import corpus_pipeline
    rows = [(i, f"ten words are in this text as you can {'see' if i % 3 else 'hear'}", "s" if i < 400 else "t") for i in range(800)]
    docs = documents(spark, rows + [(None, "no key", "t")], tmp_path)
    labels = [(i, i % 2) for i in range(800)] + [(1, 1), (None, 1), (2, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    taken = {r["doc_id"] for r in got.where("source = 's'").collect()}
    good, bad = (sum(i % 2 == k for i in taken) / 200 for k in (1, 0))
    assert good > bad + 0.2
    assert all(r["text"] == dict((i, t) for i, t, _ in rows).get(r["doc_id"], "no key") for r in got.limit(20).collect())


def test_few_texts_move_whatever_the_number_of_labels(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} has " + "many words " * (i % 7), "st"[i % 2]) for i in range(600)]
    docs = documents(spark, rows, tmp_path)
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(600)], "doc_id long, quality int")
    (tmp_path / "kept").mkdir()
    monkeypatch.setattr(common, "ensure_checkpoint_dir", lambda _: str(tmp_path / "kept"))
    monkeypatch.setattr(mixing, "small", lambda df: df)   # as with more labels than may be broadcast
    got = Counter(r["doc_id"] for r in mixing.mix_rows(docs, labels=labels).collect())
    folders = {p.name.rsplit("-", 1)[0]: p for p in (tmp_path / "kept").iterdir()}
    assert set(folders) == {"mix-rows", "mix-plan", "mix-other"}
    full, plan, other = (spark.read.parquet(str(folders[n])).toPandas() for n in ("mix-rows", "mix-plan", "mix-other"))
    assert 0 < len(other) < len(rows) / 3
    full["doc_id"] = [r["doc_id"] for r in full["_row"]]
    weight = np.where(full["doc_id"] // 2 % 2, 2.0, 0.5)
    high = np.floor(-np.expm1(np.log((full["_u"] + 1) / 2.0 ** 53) / weight) * 2.0 ** 31).astype(np.int64)
    full["place"] = high * 2 ** 31 + full["code"] % 2 ** 31
    for p in plan.to_dict("records"):
        mine = full[full["source"] == p["source"]].sort_values("place")
        copies = mine["doc_id"].map(lambda i: got[i])
        more = copies > p["epochs"]
        assert set(copies) <= {p["epochs"], p["epochs"] + 1} and more.is_monotonic_decreasing
        assert abs((copies * mine["size"]).sum() - p["target"]) <= mine["size"].max() / 2 + 1
