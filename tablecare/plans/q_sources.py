"""Registered queries: whole documents through CSV and JSON files, and tables with awkward headers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import rnd_sql, safe_corr_sql
from ..operators.explore import correlation_matrix, missing_by_column
from ..operators.heavy import frequent
from ..operators.profile import profile_columns_df
from ..operators.state import current_states, merged_profile, update
from ..session import ensure_checkpoint_dir
from ..sources.files import read_csv, read_json, write_table
from ..sources.tables import dirty_events, load_table
from .registry import query
from .sqlgen import q, trim_sql, with_dirty


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablecare-io/{uuid.uuid4().hex}"


def _flat(c: str) -> str:
    return trim_sql(f"replace({c}, chr(10), chr(32))")


@query("csv_documents", "I1, I9 (texts with quotes and line breaks, many tasks a file)",
       f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif({_flat('text')}, '') AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def q_csv_documents(spark, sf):
    """Write the documents as CSV, their line breaks inside quotes, and read them back by byte ranges."""
    path = _scratch(spark)
    write_table(load_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path, "csv")
    back = read_csv(spark, path)
    return back.withColumn("text", F.nullif("text", F.lit("")))


@query("json_array", "I2 (array documents of records over several lines, many tasks a file)",
       f"SELECT doc_id, {_flat('text')} AS text, {_flat('lang')} AS lang, {_flat('source')} AS source, n_chars FROM documents")
def q_json_array(spark, sf):
    """Write the documents as array documents of pretty-printed records and read them back by byte ranges."""
    import pandas as pd

    path = _scratch(spark)
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    records = docs.select(F.to_json(F.struct(*docs.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))

    def as_array(batches):
        yield pd.DataFrame({"value": ["["]})
        first = True
        for b in batches:
            sep = pd.Series([","] * len(b), index=b.index)
            if first and len(b):
                sep.iloc[0], first = " ", False
            yield pd.DataFrame({"value": sep + b["value"]})
        yield pd.DataFrame({"value": ["]"]})
    records.mapInPandas(as_array, "value string").write.text(path)
    return read_json(spark, path)


# ---- headers with dots, spaces, back-ticks and names that differ only in case --------------------

_NAMED = [("l_quantity", "Rev. (USD)"), ("l_extendedprice", "rev. (usd)"), ("l_discount", "dis`count"), ("l_tax", "a.b c"), ("l_returnflag", "Return.Flag")]
_EVENTS = [("event_id", "event.id"), ("user_id", "User id"), ("event_type", "user ID"), ("value", "val`ue.x")]


def _named_sql() -> str:
    row = "SELECT {} AS part, {} AS a, {} AS b, CAST({} AS DOUBLE) AS v FROM {}"
    parts = [row.format("'missing'", q(n), "NULL", f"count_if({c} IS NULL)", "dirty_events") for c, n in _EVENTS if c in ("event_type", "value")]
    parts += [row.format("'distinct'", q(n), "NULL", f"count(DISTINCT {c})", "lineitem") for c, n in _NAMED]
    parts += [row.format("'mean'", q(n), "NULL", rnd_sql(f"avg({c})"), "lineitem") for c, n in _NAMED[:4]]
    for c, n in _NAMED[:4]:
        for d, m in _NAMED[:4]:
            if c != d:
                parts.append(row.format("'r'", q(n), q(m), rnd_sql(safe_corr_sql(f"CAST({c} AS DOUBLE)", f"CAST({d} AS DOUBLE)")), "lineitem"))
    parts.append("SELECT 'top' AS part, 'Return.Flag' AS a, l_returnflag AS b, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY l_returnflag")
    return with_dirty("\nUNION ALL\n".join(parts))


@query("dotted_names", "P2, P3, P7, P9, V1, V4 on headers with dots, back-ticks and names that differ in case", _named_sql())
def q_dotted_names(spark, sf):
    """The columns keep their data but get headers that no plain reference resolves."""
    li = load_table(spark, sf, "lineitem").select(*[c for c, _ in _NAMED]).toDF(*[n for _, n in _NAMED])
    ev = dirty_events(spark, sf).select(*[c for c, _ in _EVENTS]).toDF(*[n for _, n in _EVENTS])
    none = F.lit(None).cast("string").alias("b")
    prof = profile_columns_df(li, "lineitem")
    out = missing_by_column(ev).select(F.lit("missing").alias("part"), F.col("name").alias("a"), none, F.col("missing").cast("double").alias("v"))
    out = out.unionByName(prof.select(F.lit("distinct").alias("part"), F.col("name").alias("a"), none, F.col("unique_count").cast("double").alias("v")))
    out = out.unionByName(prof.where("mean IS NOT NULL").select(F.lit("mean").alias("part"), F.col("name").alias("a"), none, F.col("mean").alias("v")))
    r = correlation_matrix(li).where("x <> y").select(F.lit("r").alias("part"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("r").alias("v"))
    top = frequent(li, ["Return.Flag"]).top(10).select(F.lit("top").alias("part"), F.col("name").alias("a"), F.col("value").alias("b"),
                                                        F.col("n").cast("double").alias("v"))
    return out.unionByName(r).unionByName(top)


# ---- a profile kept up to date file by file -------------------------------------------------------

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _state_sql() -> str:
    few = "CASE WHEN count(DISTINCT {0}) <= 1024 THEN count(DISTINCT {0}) END"
    parts = []
    for i, c in enumerate(_ORDERS):
        num = c in ("o_orderkey", "o_custkey", "o_totalprice")
        top = (f"(SELECT string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL "
               f"GROUP BY {c} ORDER BY n DESC, v LIMIT 5))") if c in ("o_orderstatus", "o_orderpriority") else "NULL"
        parts.append(f"SELECT CAST({i} AS INTEGER) AS pos, {q(c)} AS name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if({c} IS NULL) AS BIGINT) AS missing_count, "
                     f"CAST({few.format(c)} AS BIGINT) AS unique_count, "
                     + ", ".join(f"{f if num else 'CAST(NULL AS DOUBLE)'} AS {a}" for f, a in (
                         (f"CAST(min({c}) AS DOUBLE)", "min"), (f"CAST(max({c}) AS DOUBLE)", "max"), (rnd_sql(f"avg({c})"), "mean"), (rnd_sql(f"stddev_samp({c})"), "std")))
                     + f", CAST({top} AS VARCHAR) AS top_values FROM orders")
    return "\nUNION ALL\n".join(parts)


@query("profile_from_states", "P14, R6 (files that come one after another are read once each)", _state_sql())
def q_profile_from_states(spark, sf):
    """Orders arrive as three lots of files; after each the states are brought up to date, and the last profile is put together
    from them."""
    table, states = _scratch(spark), _scratch(spark)
    orders = load_table(spark, sf, "orders")
    for lot in range(3):
        orders.where(F.col("o_orderkey") % 3 == lot).write.mode("append").parquet(table)
        update(spark, table, states)
    p = merged_profile(current_states(spark, table, states), "orders")
    rows = [(c["pos"], c["name"], p.n_rows, c["missing_count"], c["unique_count"] if c["unique_count"] <= 1024 else None, c["min"], c["max"], c["mean"], c["std"],
             ", ".join(f"{v}={n}" for v, n in c["top_values"]) if c["top_values"] else None) for c in p.columns]
    return spark.createDataFrame(rows, "pos int, name string, n_rows long, missing_count long, unique_count long, min double, max double, mean double, "
                                       "std double, top_values string")
