"""Registered queries: sources and profiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_sql
from ..functions.quantiles import quantiles
from ..functions.sentences import SUMMARY, as_sql
from ..operators.heavy import frequent
from ..operators.profile import duplicate_rows, frequency_table, load_overview, profile, profile_columns_df
from ..sources.files import flatten_text
from ..sources.tables import dirty_events, dirty_orders, load_table
from .registry import query
from .sqlgen import parse_datetime_sql, profile_columns_sql, q, trim_sql, with_dirty


# ---- P1-P4, P7, P10 ---------------------------------------------------------------------

@query("profile_lineitem", "P1-P4, P7, P10", profile_columns_sql("lineitem"))
def profile_lineitem(spark, sf):
    return profile_columns_df(load_table(spark, sf, "lineitem"), "lineitem")


@query("profile_orders", "P1-P4, P7, P10", profile_columns_sql("orders"))
def profile_orders(spark, sf):
    return profile_columns_df(load_table(spark, sf, "orders"), "orders")


@query("profile_dirty_events", "P1-P4, P7, P10 (with NULLs)",
       with_dirty(profile_columns_sql("dirty_events")))
def profile_dirty_events(spark, sf):
    return profile_columns_df(dirty_events(spark, sf), "dirty_events")


# ---- I10 ---------------------------------------------------------------------------------

_OVERVIEW_SQL = with_dirty("""
SELECT CAST(count(*) AS BIGINT) AS rows, 6 AS columns,
  CAST(sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (order_priority IS NULL)::INT
   + (total_cents IS NULL)::INT + (order_date IS NULL)::INT + (order_status IS NULL)::INT) AS BIGINT) AS missing_total,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS BIGINT) AS duplicates
FROM dirty_orders""")


@query("load_overview", "I10, P11", _OVERVIEW_SQL)
def q_load_overview(spark, sf):
    return load_overview(dirty_orders(spark, sf))


# ---- P8 ----------------------------------------------------------------------------------

def _outlier_rows(spark, df, table, cols):
    qs = quantiles(df, cols, [0.25, 0.75])
    structs = []
    for c in cols:
        q1, q3 = qs[c]
        v = F.col(c).cast("double")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        structs.append(F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("name"),
                                rnd(F.lit(q1)).alias("q1"), rnd(F.lit(q3)).alias("q3"),
                                rnd(F.lit(100.0) * F.count_if((v < lo) | (v > hi)) / F.count(v), 2)
                                .alias("outlier_pct")))
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a"))


def _outlier_sql(table, cols, src=None):
    parts = []
    for c in cols:
        parts.append(f"""SELECT {q(table)} AS table_name, {q(c)} AS name, {rnd_sql('q1')} AS q1, {rnd_sql('q3')} AS q3,
  {rnd_sql(f'100.0 * (SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM {src or table}) / n', 2)} AS outlier_pct
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM {src or table})""")
    return "\nUNION ALL\n".join(parts)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("outlier_pct", "P8", with_dirty(_outlier_sql("lineitem", _LI_NUM) + "\nUNION ALL\n"
                                       + _outlier_sql("dirty_events", ["value"])))
def q_outlier_pct(spark, sf):
    a = _outlier_rows(spark, load_table(spark, sf, "lineitem"), "lineitem", _LI_NUM)
    b = _outlier_rows(spark, dirty_events(spark, sf), "dirty_events", ["value"])
    return a.unionByName(b)


# ---- P9 ----------------------------------------------------------------------------------

def _top_values_sql(table, cols):
    parts = [f"SELECT {q(table)} AS table_name, {q(c)} AS name, CAST({c} AS VARCHAR) AS value FROM {table} "
             f"WHERE {c} IS NOT NULL" for c in cols]
    return f"""SELECT table_name, name, value, n, rank FROM (
  SELECT table_name, name, value, n,
    CAST(row_number() OVER (PARTITION BY table_name, name ORDER BY n DESC, value ASC) AS INTEGER) AS rank
  FROM (SELECT table_name, name, value, CAST(count(*) AS BIGINT) AS n FROM ({' UNION ALL '.join(parts)})
        GROUP BY table_name, name, value)) WHERE rank <= 5"""


def _top_values(spark, df, table, cols):
    t = frequent(df, cols).top(5)
    return t.select(F.lit(table).alias("table_name"), "name", "value", F.col("n").cast("bigint"),
                    F.col("rank").cast("int"))


@query("top_values", "P9", _top_values_sql("orders", ["o_orderstatus", "o_orderpriority"])
       + "\nUNION ALL\n" + _top_values_sql("part", ["p_name", "p_brand", "p_type"]))
def q_top_values(spark, sf):
    return (_top_values(spark, load_table(spark, sf, "orders"), "orders", ["o_orderstatus", "o_orderpriority"])
            .unionByName(_top_values(spark, load_table(spark, sf, "part"), "part", ["p_name", "p_brand", "p_type"])))


# ---- P11 ---------------------------------------------------------------------------------

@query("duplicate_rows", "P11", with_dirty(
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM "
    "(SELECT count(*) AS n FROM dirty_orders GROUP BY ALL_COLUMNS_PLACEHOLDER)"
    .replace("ALL_COLUMNS_PLACEHOLDER", "o_orderkey, o_custkey, order_priority, total_cents, order_date, order_status")))
def q_duplicate_rows(spark, sf):
    return duplicate_rows(dirty_orders(spark, sf))


# ---- P12 ---------------------------------------------------------------------------------

def _flags_sql(table):
    return f"""SELECT table_name, name, flag FROM (
  SELECT table_name, name, 'high_missing' AS flag FROM ({profile_columns_sql(table)}) WHERE missing_pct > 10
  UNION ALL
  SELECT table_name, name, 'constant' AS flag FROM ({profile_columns_sql(table)}) WHERE is_constant)"""


def _flags(df, table):
    p = profile_columns_df(df, table)
    return (p.where(F.col("missing_pct") > 10).select("table_name", "name", F.lit("high_missing").alias("flag"))
            .unionByName(p.where("is_constant").select("table_name", "name", F.lit("constant").alias("flag"))))


@query("quality_flags", "P12", with_dirty(_flags_sql("dirty_events")))
def q_quality_flags(spark, sf):
    return _flags(dirty_events(spark, sf), "dirty_events")


# ---- P13 ---------------------------------------------------------------------------------

def _summary_sql():
    # dirty_orders: order_date is text whose values do not all parse → categorical
    vote = f"(SELECT count({parse_datetime_sql('order_date')}) = count(order_date) FROM dirty_orders)"
    do = f"""SELECT 'dirty_orders' AS table_name,
  {as_sql(SUMMARY['size'], rows='n', cols=6)} || ' '
  || {as_sql(SUMMARY['types'], numeric=2, categorical=f'CASE WHEN {vote} THEN 3 ELSE 4 END', datetime=f'CASE WHEN {vote} THEN 1 ELSE 0 END')}
  || CASE WHEN d > 0 THEN ' ' || {as_sql(SUMMARY['duplicates'], duplicates='d')} ELSE '' END AS summary_text
FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS d
      FROM dirty_orders)"""
    cols = ["event_id", "ts", "user_id", "event_type", "value"]
    hm = " || ".join(
        f"CASE WHEN 100.0 * count_if({c} IS NULL) / count(*) > 10 THEN {q(c)} || ',' ELSE '' END" for c in cols)
    some = f"""array_to_string(list_slice(string_split(rtrim({hm}, ','), ','), 1, 3), ', ')
     || CASE WHEN len(string_split(rtrim({hm}, ','), ',')) > 3 THEN '...' ELSE '' END"""
    ev = f"""SELECT 'dirty_events' AS table_name,
  {as_sql(SUMMARY['size'], rows='count(*)', cols=5)} || ' ' || {as_sql(SUMMARY['types'], numeric=3, categorical=1, datetime=1)}
  || CASE WHEN ({hm}) <> '' THEN ' ' || {as_sql(SUMMARY['missing'], missing=some)} ELSE '' END AS summary_text
FROM dirty_events"""
    return with_dirty(do + "\nUNION ALL\n" + ev)


@query("profile_summary", "P5, P6, P13, P14", _summary_sql())
def q_profile_summary(spark, sf):
    rows = []
    for name, df in (("dirty_orders", dirty_orders(spark, sf)), ("dirty_events", dirty_events(spark, sf))):
        rows.append((name, profile(df, name).summary_text))
    return spark.createDataFrame(rows, "table_name string, summary_text string")


# ---- P16 ---------------------------------------------------------------------------------

def schema_hints(df, table):
    """≤ 5 example values (smallest first) for categoricals with ≤ 10
    distinct values; 'min to max' (1 dp) for numerics."""
    p = profile_columns_df(df, table)
    freq = frequency_table(df)
    ex = (freq.join(p.select(F.col("pos").alias("k"), "column_type", "unique_count"), "k")
          .where((F.col("column_type") == "categorical") & (F.col("unique_count") <= 10)))
    w = F.row_number().over(Window.partitionBy("k").orderBy("value"))
    ex = (ex.withColumn("r", w).where(F.col("r") <= 5).groupBy("k")
          .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("examples")))
    rng = F.concat(F.format_string("%.1f", F.bround("min", 1)), F.lit(" to "), F.format_string("%.1f", F.bround("max", 1)))
    return (p.join(ex, p.pos == ex.k, "left")
            .select("table_name", "name", "column_type", "unique_count",
                    F.when(F.col("column_type") == "numeric", F.concat(F.lit("range: "), rng))
                    .when(F.col("examples").isNotNull(), F.concat(F.lit("examples: "), F.col("examples")))
                    .alias("hint")))


def _hints_sql(table):
    from .schemas import TABLE_SCHEMAS, type_family
    parts = []
    for c, t in TABLE_SCHEMAS[table]:
        fam = type_family(t)
        ctype = {"numeric": "numeric", "datetime": "datetime"}.get(fam, "categorical")
        if ctype == "numeric":
            hint = (f"'range: ' || printf('%.1f', round_even(CAST(min({c}) AS DOUBLE), 1)) || ' to ' "
                    f"|| printf('%.1f', round_even(CAST(max({c}) AS DOUBLE), 1))")
        elif ctype == "categorical":
            hint = (f"CASE WHEN count(DISTINCT {c}) <= 10 THEN 'examples: ' || array_to_string("
                    f"list_slice(list_sort(list_distinct(list(CAST({c} AS VARCHAR)))), 1, 5), ', ') END")
        else:
            hint = "NULL::VARCHAR"
        parts.append(f"SELECT {q(table)} AS table_name, {q(c)} AS name, {q(ctype)} AS column_type, "
                     f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, {hint} AS hint FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("schema_hints", "P16", _hints_sql("orders"))
def q_schema_hints(spark, sf):
    return schema_hints(load_table(spark, sf, "orders"), "orders")


# ---- I6 ----------------------------------------------------------------------------------

@query("flatten_trim_documents", "I6",
       f"SELECT doc_id, {trim_sql('replace(text, chr(10), chr(32))')} AS text, lang, source, n_chars FROM documents")
def q_flatten(spark, sf):
    return flatten_text(load_table(spark, sf, "documents"))



# ---- I1, I5, I6, I9 (CSV sink + source round trip) ---------------------------------------

@query("csv_roundtrip", "I1, I3, I5, I6, I9", with_dirty(
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    f"{trim_sql('order_priority')} AS order_priority, total_cents, order_date, order_status FROM dirty_orders"))
def q_csv_roundtrip(spark, sf):
    """Write dirty_orders as CSV into the shared checkpoint folder, read it
    back with the header-repairing, row-length-checking CSV reader."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.files import read_csv, write_table
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tablecare-io/{uuid.uuid4().hex}"
    write_table(dirty_orders(spark, sf), path, "csv")
    return read_csv(spark, path)


_CSV_LINES = '''SELECT CASE o_orderkey % 6
 WHEN 0 THEN concat(CAST(o_orderkey AS STRING), ',', o_orderstatus, ',', CAST(o_custkey AS STRING), ',')
 WHEN 1 THEN concat(CAST(o_orderkey AS STRING), ',', o_orderstatus, ',', CAST(o_custkey AS STRING), ',,extra')
 WHEN 2 THEN concat(CAST(o_orderkey AS STRING), ',', o_orderstatus)
 WHEN 3 THEN concat(CAST(o_orderkey AS STRING), ',"', o_orderstatus, ', two', chr(10), 'lines ""x""",', CAST(o_custkey AS STRING))
 WHEN 4 THEN concat(CAST(o_orderkey AS STRING), ',"', o_orderpriority, '",', CAST(o_custkey AS STRING), ',"quoted, extra"')
 ELSE concat(CAST(o_orderkey AS STRING), ',', o_orderstatus, ',', CAST(o_custkey AS STRING)) END AS value FROM {orders}'''


@query("csv_dirty", "I1, I3, I5, I6, D23 (over-long, short, quoted and repaired rows)", """SELECT CAST(o_orderkey AS VARCHAR) AS key,
  CASE WHEN o_orderkey % 6 = 3 THEN o_orderstatus || ', two lines "x"' ELSE o_orderstatus END AS key_2,
  CASE WHEN o_orderkey % 6 = 2 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS unnamed_3 FROM orders WHERE o_orderkey % 6 IN (2, 3, 5)""")
def q_csv_dirty(spark, sf):
    """Write every order as a CSV record, a third of them with too many
    fields, under a header with a repeated and a blank name; read them back."""
    import uuid

    import pandas as pd

    from ..session import ensure_checkpoint_dir
    from ..sources.files import read_csv
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablecare-io/{uuid.uuid4().hex}"

    def with_header(batches):
        yield pd.DataFrame({"value": ["key,key,"]})
        yield from batches
    spark.sql(_CSV_LINES, orders=load_table(spark, sf, "orders")).mapInPandas(with_header, "value string").write.text(path)
    return read_csv(spark, path)


# ---- I7 / I8 -----------------------------------------------------------------------------

@query("preview", "I7", """SELECT coalesce(CAST(o_orderkey AS VARCHAR), '') AS o_orderkey,
  coalesce(CAST(o_custkey AS VARCHAR), '') AS o_custkey, coalesce(o_orderstatus, '') AS o_orderstatus,
  coalesce(CAST(o_totalprice AS VARCHAR), '') AS o_totalprice, coalesce(CAST(o_orderdate AS VARCHAR), '') AS o_orderdate,
  coalesce(o_orderpriority, '') AS o_orderpriority
FROM (SELECT * FROM orders ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
      o_orderpriority LIMIT 10)""")
def q_preview(spark, sf):
    from ..sources.files import preview
    return preview(load_table(spark, sf, "orders"), 10)


@query("load_summary", "I8", """SELECT CAST(count(*) AS BIGINT) AS n_rows, 11 AS n_cols,
  'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,'
  || 'l_linestatus,l_shipdate' AS columns FROM lineitem""")
def q_load_summary(spark, sf):
    from ..sources.files import load_summary
    s = load_summary(load_table(spark, sf, "lineitem"))
    return s.select("n_rows", "n_cols", F.array_join("columns", ",").alias("columns"))


# ---- P14 assembled (with P5, P6, P8, P9) -------------------------------------------------

def _top_string(top):
    return "|".join(f"{v}:{n}" for v, n in top) if top is not None else None


@query("profile_full", "P1-P14 assembled (P5, P6, P8, P9 included)", with_dirty(f"""
WITH p AS ({profile_columns_sql('dirty_events')}),
o AS (SELECT name, outlier_pct FROM ({_outlier_sql('dirty_events', ['event_id', 'user_id', 'value'])})),
t AS (SELECT name, string_agg(value || ':' || n, '|' ORDER BY rank) AS top_values
      FROM ({_top_values_sql('dirty_events', ['event_type'])}) GROUP BY name)
SELECT p.*, o.outlier_pct, t.top_values FROM p LEFT JOIN o USING (name) LEFT JOIN t USING (name)"""))
def q_profile_full(spark, sf):
    p = profile(dirty_events(spark, sf), "dirty_events")
    rows = [(p.table_name, c["pos"], c["name"], c["dtype"], c["column_type"], c["missing_count"], c["missing_pct"],
             c["unique_count"], c["is_constant"], c["min"], c["max"], c["mean"], c["std"], c["high_cardinality"],
             c["outlier_pct"], _top_string(c["top_values"])) for c in p.columns]
    return spark.createDataFrame(rows, "table_name string, pos int, name string, dtype string, column_type string, "
                                       "missing_count bigint, missing_pct double, unique_count bigint, "
                                       "is_constant boolean, min double, max double, mean double, std double, "
                                       "high_cardinality boolean, outlier_pct double, top_values string")


# ---- I2 (JSON sink + source round trip) ---------------------------------------------------

@query("json_roundtrip", "I2, I6", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate, o_orderpriority FROM orders""")
def q_json_roundtrip(spark, sf):
    """Write orders as JSON lines into the shared checkpoint folder and read
    them back with the JSON source (schema inferred, text flattened)."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.files import read_json
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tablecare-io/{uuid.uuid4().hex}"
    load_table(spark, sf, "orders").write.json(path)
    return read_json(spark, path, lines=True)
