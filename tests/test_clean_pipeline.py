"""The registered cleaning pipeline on rows that clipping makes equal."""

from collections import Counter

import duckdb

from tablecare.plans.registry import ORACLE, QUERIES, load_all


def test_rows_made_equal_by_clipping_stay(spark, tmp_path):
    load_all()
    rows = [(i, 5, "O", 100.0 + i % 3, "1-URGENT") for i in range(0, 990)]
    rows += [(k, 5, "O", 100.0, "1-URGENT") for k in (100003, 100019, 100043, 100049, 100057, 100069, 100103, 100109)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string") \
        .selectExpr("*", "timestamp_ntz'1996-03-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = QUERIES["clean_pipeline"](spark, str(tmp_path))
    cols = sorted(got.columns)
    want = Counter(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE['clean_pipeline']})").fetchall())
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == want
    assert max(want.values()) > 1     # equal rows, kept and counted
