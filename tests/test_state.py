"""Stored profile states: files are read once, and the parts add up to the whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tablecare.operators import state
from tablecare.operators.profile import profile


@pytest.fixture(scope="module")
def lots(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(50, 20) if rng.random() < 0.9 else None, rng.choice(["a", "b", "c", None]), f"id{i}", f"2024-02-{i % 28 + 1:02d}", i % 7 == 0,
             [i % 3]) for i in range(12_000)]
    df = spark.createDataFrame(rows, "`n.1` long, x double, cat string, name string, day string, flag boolean, list array<int>")
    return [df.where(F.col("`n.1`") % 3 == k) for k in range(3)], df


EXACT = ("name", "dtype", "column_type", "missing_count", "missing_pct", "min", "max", "mean", "std")


def facts(p):
    return [tuple(c[k] for k in EXACT) for c in p.columns]


def test_parts_add_up(spark, lots, tmp_path):
    parts, whole = lots
    table, one, states, at_once = (str(tmp_path / x) for x in ("t", "one", "s", "s1"))
    read = []
    for part in parts:
        part.repartition(2).write.mode("append").parquet(table)
        read.append(state.update(spark, table, states))
    assert [len(r) for r in read] == [2, 2, 2] and state.update(spark, table, states) == []
    whole.repartition(4).write.parquet(one)
    state.update(spark, one, at_once)
    a = state.merged_profile(state.current_states(spark, table, states))
    b = state.merged_profile(state.current_states(spark, one, at_once))
    full = profile(whole)
    assert facts(a) == facts(b) == facts(full) and a.n_rows == full.n_rows == 12_000
    for x, y, f in zip(a.columns, b.columns, full.columns):
        assert x["exact"] == (x["name"] not in ("n.1", "name", "x"))
        if x["exact"]:
            assert x["unique_count"] == y["unique_count"] == f["unique_count"]
            assert x["top_values"] == y["top_values"] == f["top_values"]
        else:
            assert abs(x["unique_count"] - f["unique_count"]) <= 0.06 * f["unique_count"]
        if f["outlier_pct"] is not None:
            assert x["outlier_pct"] == y["outlier_pct"] and abs(x["outlier_pct"] - f["outlier_pct"]) < 0.3


def test_only_new_files_are_read(spark, lots, tmp_path):
    parts, _ = lots
    table, states = str(tmp_path / "t"), str(tmp_path / "s")
    parts[0].coalesce(1).write.parquet(table)
    [first] = state.update(spark, table, states)
    name = first.split(":", 1)[1]
    at, size = os.stat(name), os.path.getsize(name)
    with open(name, "r+b") as f:       # a reader of the old file would fail
        f.write(b"\0" * size)
    os.utime(name, ns=(at.st_atime_ns, at.st_mtime_ns))
    crc = os.path.join(os.path.dirname(name), "." + os.path.basename(name) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    parts[1].coalesce(1).write.mode("append").parquet(table)
    assert len(state.update(spark, table, states)) == 1
    assert state.merged_profile(state.current_states(spark, table, states)).n_rows == parts[0].count() + parts[1].count()


def test_files_that_went_or_changed_count_no_more(spark, lots, tmp_path):
    parts, _ = lots
    table, states = str(tmp_path / "t"), str(tmp_path / "s")
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(table)
    files = state.update(spark, table, states)
    os.remove(files[0].split(":", 1)[1])
    left = spark.read.parquet(table)
    assert facts(state.merged_profile(state.current_states(spark, table, states))) == facts(profile(left))


def test_empty_files_and_all_null_columns(spark, tmp_path):
    table, states = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame([(None, None)] * 5, "a double, b string").coalesce(1).write.parquet(table)
    spark.createDataFrame([], "a double, b string").coalesce(1).write.mode("append").parquet(table)
    state.update(spark, table, states)
    p = state.merged_profile(state.current_states(spark, table, states))
    assert [(c["missing_count"], c["unique_count"], c["min"], c["outlier_pct"]) for c in p.columns] == [(5, 0, None, 0.0), (5, 0, None, None)]
