"""Driver tables (parquet) and the shared "dirty" views.

The dirty views are SQL text with ``{table}`` placeholders: Spark binds the
DataFrames through ``spark.sql(text, name=df)`` (no global temp views) and
the DuckDB oracle gets the same text with plain table names.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DIRTY_ORDERS_SQL = """
WITH b AS (
 SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 11 = 0 THEN ' N/A ' WHEN o_orderkey % 13 = 0 THEN concat('  ', o_orderpriority, ' ')
       WHEN o_orderkey % 401 = 0 THEN 'RARE' ELSE o_orderpriority END AS order_priority,
  CASE WHEN o_orderkey % 7 = 0 THEN '--' WHEN o_orderkey % 97 = 0 THEN 'abc'
       ELSE CAST(CAST(round(o_totalprice * 100, 0) AS BIGINT) AS VARCHAR(30)) END AS total_cents,
  CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 101 = 0 THEN 'not a date'
       ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(30)) END AS order_date,
  CASE WHEN o_orderkey % 19 = 0 THEN 'null' ELSE o_orderstatus END AS order_status
 FROM {orders})
SELECT * FROM b UNION ALL SELECT * FROM b WHERE o_orderkey % 50 = 0
"""

DIRTY_EVENTS_SQL = """
SELECT event_id, ts, user_id,
 CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 211 = 0 THEN 'rare_kind' ELSE event_type END AS event_type,
 CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 250 = 1 THEN value * 100 ELSE value END AS value
FROM {events}
"""


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with padded text, missing tokens, unparsable numbers/dates and
    2 % duplicated rows (derived from the whole orders table)."""
    return spark.sql(DIRTY_ORDERS_SQL, orders=load_table(spark, sf_dir, "orders"))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with NULL event types / values and a few extreme values."""
    return spark.sql(DIRTY_EVENTS_SQL, events=load_table(spark, sf_dir, "events"))


def duck_sql(text: str) -> str:
    """Spark-bound SQL text → DuckDB text over the pre-registered views."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
