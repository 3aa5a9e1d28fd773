"""CSV / JSON sources and the cleaned-table sink."""

import os
import tempfile

from tablecare.sources.files import load_summary, preview, read_csv, read_json, write_table


def test_csv_drops_long_rows_pads_short_rows_flattens_newlines(spark):
    d = tempfile.mkdtemp(prefix="tablecare-csv-")
    p = os.path.join(d, "mini.csv")
    with open(p, "w") as f:
        f.write('a,b,c\n1,"x\ny",3\n4,5,6,7\n8,9\n')
    df = read_csv(spark, p)
    assert df.columns == ["a", "b", "c"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("1", "x y", "3"), ("8", "9", None)]


def test_csv_header_repair(spark):
    d = tempfile.mkdtemp(prefix="tablecare-csv-")
    p = os.path.join(d, "h.csv")
    with open(p, "w") as f:
        f.write("x,x,,y\n1,2,3,4\n")
    assert read_csv(spark, p).columns == ["x", "x_2", "unnamed_3", "y"]


def test_json_records_and_sink(spark):
    d = tempfile.mkdtemp(prefix="tablecare-json-")
    p = os.path.join(d, "r.json")
    with open(p, "w") as f:
        f.write('[{"a": 1, "b": "p\\nq "}, {"a": 2, "b": null}]')
    df = read_json(spark, p)
    assert sorted(tuple(r) for r in df.select("a", "b").collect()) == [(1, "p q"), (2, None)]
    s = load_summary(df).first()
    assert s["n_rows"] == 2 and s["n_cols"] == 2
    assert [tuple(r) for r in preview(df, 1, ["a"]).collect()] == [("1", "p q")]
    out = os.path.join(d, "out")
    write_table(df, out, "csv")
    assert spark.read.option("header", True).csv(out).count() == 2


def test_rows_with_extra_fields_are_dropped_and_counted(spark, tmp_path):
    from tablecare.sources.files import csv_dropped_rows
    (tmp_path / "x.csv").write_text('a,b\n5,6\n1,2,\n3,4,,x\n7,8,9\n1\n"q,1","two\nlines"\n"q,1","x",\n,\n')
    df = read_csv(spark, str(tmp_path / "x.csv"))
    assert sorted(((r["a"] or ""), (r["b"] or "")) for r in df.collect()) == [("", ""), ("1", ""), ("5", "6"), ("q,1", "two lines")]
    assert csv_dropped_rows(spark, str(tmp_path / "x.csv")) == 4


def test_malformed_json_and_empty_tables_are_errors(spark, tmp_path):
    import pytest
    (tmp_path / "bad.json").write_text('{"a":1}\n{"a":2\n{"a":3}\n')
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path / "bad.json"), lines=True).count()
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "empty.csv"))
    assert read_csv(spark, str(tmp_path / "empty.csv"), reject_empty=False).count() == 0


def test_rename_follows_column_order(spark):
    from tablecare.operators.clean import rename_map, rename_map_df
    names = ["A", "a", "a_1", "A ", "b", "B_1", "b"]
    want = ["a", "a_1", "a_1_1", "a_2", "b", "b_1", "b_2"]
    assert [n for _, n in rename_map(names)] == want
    rows = spark.createDataFrame([(t, i, n) for t in (1, 2) for i, n in enumerate(names)], "table_key int, pos int, original string")
    got = {(r["table_key"], r["pos"]): r["cleaned"] for r in rename_map_df(rows).collect()}
    assert got == {(t, i): n for t in (1, 2) for i, n in enumerate(want)}
