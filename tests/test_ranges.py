"""One file read by many tasks: the result is that of a single reader."""

import csv
import json
import random

import pytest

from tablecare.sources import ranges
from tablecare.sources.files import csv_dropped_rows, read_csv, read_json


@pytest.fixture
def split(spark):
    """Sets the size of a byte range."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "1")
    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def cells(rng):
    kinds = ['x\ny, "q" ' + "z" * rng.randint(0, 40), 'a"b', "", "\n\n\"\n", '"', ",", "\n" * rng.randint(1, 5), 'end"', "é\U0001f600"]
    return rng.choice(kinds) if rng.random() < 0.6 else f"plain{rng.randint(0, 999)}"


def test_csv_ranges_equal_one_reader(spark, split, tmp_path):
    rng = random.Random(7)
    path = str(tmp_path / "a.csv")
    rows = [[str(i), cells(rng), cells(rng)] for i in range(700)] + [["700", "long " + "line\n" * 400, "after"]]
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "Rev. (USD)", "two\nlines"])
        w.writerows(rows)
    with open(path, newline="") as f:
        want = sorted(tuple(r) for r in list(csv.reader(f))[1:])
    for size in ("64m", "8k", "200b"):    # one range; several; records over several and ranges within one line
        split(size)
        df = read_csv(spark, path, flatten=False)
        assert df.columns == ["id", "Rev. (USD)", "two\nlines"]
        assert sorted(tuple(x or "" for x in r) for r in df.collect()) == want


def test_csv_of_several_files_and_line_ends(spark, split, tmp_path):
    for k, end in enumerate(("\n", "\r\n")):
        with open(tmp_path / f"f{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["a", "b"])
            w.writerows([[f"{k}-{i}", f"x{end}y,{i}"] for i in range(50)])
    (tmp_path / "blank.csv").write_text("\n\na,b\n\n2-0,\n\n")
    for size in ("64m", "64b"):
        split(size)
        got = sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect())
        assert got == sorted([(f"{k}-{i}", f"x y,{i}") for k in range(2) for i in range(50)] + [("2-0", None)])


def test_an_open_quote_and_text_after_a_closed_one(spark, split, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"p"q,\n2,x"y\n3,"never\nclosed,\n4,5\n')
    for size in ("64m", "7b"):
        split(size)
        got = sorted(str(r["a"]) for r in read_csv(spark, str(tmp_path / "x.csv"), flatten=False).collect())
        assert got == ["2", "3"]         # 1 has three fields; the last record runs to the end of the file
        assert csv_dropped_rows(spark, str(tmp_path / "x.csv")) == 1


def value(rng, deep=0):
    k = rng.random()
    if k < 0.4:
        return rng.choice(['br{a}ce [x] "q" \\ \n }', "}{", '"', "\\", "é\U0001f600}", ""]) + "z" * rng.randint(0, 30)
    if k < 0.6 and deep < 3:
        return {"k": value(rng, deep + 1), "l": [value(rng, deep + 1), {}]}
    return None if k < 0.7 else rng.randint(0, 99)


def test_json_ranges_equal_one_reader(spark, split, tmp_path):
    rng = random.Random(5)
    records = [{"id": i, "v": json.dumps(value(rng)), "raw": {"s": value(random.Random(i), 3), "t": [{"u": "}"}]}} for i in range(400)]
    for r in records:
        r["raw"]["s"] = str(r["raw"]["s"])
    for indent, sizes in ((None, ("64m", "150b")), (3, ("6k",))):
        path = str(tmp_path / f"j{indent}.json")
        with open(path, "w") as f:
            json.dump(records, f, indent=indent)
        for size in sizes:
            split(size)
            got = sorted((r["id"], r["v"], r["raw"]["s"], r["raw"]["t"][0]["u"]) for r in read_json(spark, path, flatten=False).collect())
            assert got == [(r["id"], r["v"], r["raw"]["s"], "}") for r in records]


def test_json_documents_that_are_not_arrays_of_records(spark, split, tmp_path):
    good = {"one": '{"a": 1}', "lines": '{"a":1}\n{"a":2}\n', "spaced": ' \n[ {"a":1} ,\n {"a":2} ] \n', "empty": "[]"}
    bad = {"number": '[{"a":1}, 5]', "open": '[{"a":1},{"a":2}', "cut": '[{"a":1},{"a":2', "nested": '[[{"a":1}]]', "word": '[{"a":1}] x'}
    split("5b")
    for name, text in {**good, **bad}.items():
        p = tmp_path / f"{name}.json"
        p.write_text(text)
        if name in bad or name == "empty":
            with pytest.raises(Exception):
                read_json(spark, str(p)).collect()
        else:
            assert sorted(r["a"] for r in read_json(spark, str(p)).collect()) == list(range(1, text.count("a") + 1))
    assert [r["a"] for r in read_json(spark, str(tmp_path / "number.json"), mode="DROPMALFORMED").collect()] == [1]


def test_states_compose(spark, split, tmp_path):
    """The window over ranges finds the state that reading from the start finds."""
    rng = random.Random(1)
    text = "".join(rng.choice(['"', ",", "\n", "a", '",', ',"']) for _ in range(3000))
    (tmp_path / "q.csv").write_text(text)
    split("40b")
    rules = ranges.Quotes(",")
    known = ranges.states(ranges.pieces_of(spark, str(tmp_path / "q.csv"), "\n"), rules).collect()
    offsets, at, inside = {}, 0, False
    for line in text.split("\n"):
        offsets[at] = inside
        inside = rules.after(line, inside)[0]
        at += len(line) + 1
    assert len(known) > 50
    for r in known:
        start = min(o for o in offsets if o > r["block"] or r["block"] == 0)     # a line that begins at a range's end is the range's
        assert r["inside"] == offsets[start], r
