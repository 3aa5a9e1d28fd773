import random

import numpy as np

from tablecare.llm import chunks

from .helpers import EDGES, documents


def words(r, n):
    return " ".join("".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randrange(2, 10))) for _ in range(n))


def test_boundaries_depend_on_near_bytes_only():
    r = random.Random(1)
    tail = words(r, 400).encode()
    a, b = (np.frombuffer(words(r, n).encode() + b" " + tail, np.uint8) for n in (50, 73))
    ends = [{len(x) - e for e in chunks.boundaries(x, 12, 4, 256).tolist() if e > len(x) - len(tail) + 64} for x in (a, b)]
    assert ends[0] == ends[1] and len(ends[0]) > 20
    text = "äöü 中文字 " * 500
    data = text.encode()
    ends = chunks.boundaries(np.frombuffer(data, np.uint8), 12, 4, 256).tolist()
    assert "".join(data[x:y].decode() for x, y in zip([0, *ends], ends)) == text and ends[-1] == len(data)


def test_repeated_passages_are_found_and_clean_texts_left(spark, tmp_path):
    r = random.Random(2)
    passages = [words(r, r.randrange(51, 70)) for _ in range(30)]
    rows, holds = [], set()
    for i in range(300):
        body = words(r, r.randrange(30, 200))
        if i % 5 == 0:
            body = f"{words(r, 7)} {passages[(i // 5) % 30]} {body}"
            holds.add(i)
        rows.append((i, body, "s"))
    docs = documents(spark, rows, tmp_path)
    got = chunks.repeated_passages(docs).toPandas()
    assert set(got["doc_id"]) == holds
    rest = {x["doc_id"]: x["text"] for x in chunks.without_repeats(docs).collect()}
    text = {i: t for i, t, _ in rows}
    assert all(rest[i] == text[i] for i in text if i not in holds)
    cut = [i for i in holds if rest[i] != text[i]]
    assert len(cut) == 30 and all(len(rest[i]) < len(text[i]) - 120 for i in cut)


def test_edges_and_copies(spark, tmp_path):
    r = random.Random(3)
    t = words(r, 100)
    docs = documents(spark, EDGES + [(20, t, "a"), (21, t, "b"), (21, t, "b"), (22, t + " " + t, "c")], tmp_path)
    got = chunks.repeated_passages(docs).toPandas()
    assert sorted(set(got["doc_id"])) == [20, 21, 22] and (got["n_rows"] == 4).all()
    kept = chunks.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert chunks.repeated_passages(docs.limit(0)).count() == 0


def test_first_of_copies_loses_the_passage_seen_before(spark, tmp_path):
    r = random.Random(5)
    shared, body = words(r, 60), words(r, 80) + " "
    copy = body + shared + " " + words(r, 80)
    rows = [(0, words(r, 30) + " " + shared + " " + words(r, 30), "s"), (1, copy, "s"), (2, copy, "s"), (3, words(r, 50), "s")]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = chunks.repeated_passages(docs).where("doc_id = 1").orderBy("start").toPandas()
    assert got["removable"].tolist() == [False, True, False]
    assert (got["start"][1:].to_numpy() == (got["start"] + got["length"])[:-1].to_numpy()).all()
    rest = {x["doc_id"]: x["text"] for x in chunks.without_repeats(docs).collect()}
    assert rest[0] == rows[0][1] and rest[3] == rows[3][1] and len(rest[2]) < 60
    assert rest[1].startswith(body) and len(copy) - len(shared) <= len(rest[1]) <= len(copy) - len(shared) + 160
    row = np.array([0, 12, 24, 300, 500])
    at, last, removable = chunks._parts(np.array([0, 4]), row, np.array([12, 24, 300, 400, 900]), np.array([False, True, False, True, True]), 120)
    assert at.tolist() == [0, 4] and last.tolist() == [3, 4] and removable.tolist() == [False, True]


def test_rows_are_known_though_the_scans_differ(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    texts = [words(r, 80) for _ in range(100)]
    rows = [(i, texts[i // 2], "s") for i in range(200)]  # every text twice
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(path)
    docs, before = spark.read.parquet(path), chunks.repeated_passages

    def then_other_splits(*args, **more):
        found = before(*args, **more)
        found = spark.createDataFrame(found.toPandas(), found.schema)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")  # as if executors were lost between the scans
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        return found

    monkeypatch.setattr(chunks, "repeated_passages", then_other_splits)
    try:
        got = {r["doc_id"]: r["text"] for r in chunks.without_repeats(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 200 and all(sorted((got[i] == texts[i // 2], got[i + 1] == texts[i // 2])) == [False, True] for i in range(0, 200, 2))
