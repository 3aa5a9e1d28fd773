"""Registered queries: safe cleaning (C1-C9, Q2), recommended cleaning
(R1-R5) and the before/after comparison (Q1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import snake_case
from ..functions.sentences import DETAILS, as_sql
from ..operators.clean import null_missing_tokens, rename_map_df, safe_clean, trim_text, vote_table
from ..operators.profile import duplicate_rows, profile
from ..operators.recommend import group_rare, median_impute, mode_impute, quality_diff, recommended_clean, winsorize
from ..sources.tables import dirty_events, dirty_orders, load_table
from .registry import query
from .sqlgen import (NAME_VARIANTS, guarded_double_sql, parse_datetime_sql, q, snake_sql, tokens_sql, trim_sql,
                     with_dirty)

_DO_TEXT = ["order_priority", "total_cents", "order_date", "order_status"]


def _variants(spark, sf):
    part = load_table(spark, sf, "part")
    return part.select("p_partkey", F.posexplode(F.array(*[F.expr(v) for v in NAME_VARIANTS])).alias("pos", "original"))


_VARIANTS_SQL = ("SELECT p_partkey, CAST(pos - 1 AS INTEGER) AS pos, original FROM (SELECT p_partkey, "
                 "unnest(generate_series(1, " + str(len(NAME_VARIANTS)) + ")) AS pos, unnest(["
                 + ", ".join(NAME_VARIANTS) + "]) AS original FROM part)")


# ---- C1 ----------------------------------------------------------------------------------

@query("snake_case_names", "C1",
       f"SELECT DISTINCT original, {snake_sql('original')} AS cleaned FROM ({_VARIANTS_SQL})")
def q_snake(spark, sf):
    v = _variants(spark, sf)
    return v.select("original", snake_case(F.col("original")).alias("cleaned")).distinct()


# ---- C2 / Q2 -----------------------------------------------------------------------------

# Columns whose generated name meets another column's own name.
_COLLIDING = [*NAME_VARIANTS, "replace(p_name, ' ', '_')", "concat(replace(p_name, ' ', '_'), '_1')", "concat(p_name, ' 1')"]
_COLLIDING_SQL = ("SELECT p_partkey AS table_key, CAST(pos - 1 AS INTEGER) AS pos, original FROM (SELECT p_partkey, "
                  f"unnest(generate_series(1, {len(_COLLIDING)})) AS pos, unnest([" + ", ".join(_COLLIDING)
                  + "]) AS original FROM part)")
_RENAME_SQL = f"""SELECT n.table_key, n.pos, n.original, f.taken[n.pos + 1] AS cleaned
FROM ({_COLLIDING_SQL}) n JOIN (
  WITH RECURSIVE names AS (SELECT table_key, pos, {snake_sql('original')} AS base FROM ({_COLLIDING_SQL})),
  fold(table_key, pos, taken) AS (
    SELECT table_key, pos, [base] FROM names WHERE pos = 0
    UNION ALL
    SELECT f.table_key, n.pos, list_append(f.taken, list_filter(
        list_transform(range(0, len(f.taken) + 1), lambda i: CASE WHEN i = 0 THEN n.base ELSE n.base || '_' || i END),
        lambda x: NOT list_contains(f.taken, x))[1])
    FROM fold f JOIN names n ON n.table_key = f.table_key AND n.pos = f.pos + 1)
  SELECT table_key, taken FROM fold WHERE pos = {len(_COLLIDING) - 1}) f USING (table_key)"""


def _name_lists(spark, sf):
    part = load_table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("table_key"),
                       F.posexplode(F.array(*[F.expr(v) for v in _COLLIDING])).alias("pos", "original"))


@query("rename_map", "C2", _RENAME_SQL)
def q_rename_map(spark, sf):
    return rename_map_df(_name_lists(spark, sf))


@query("renamed_columns", "Q2", f"SELECT table_key, original, cleaned FROM ({_RENAME_SQL}) WHERE original <> cleaned")
def q_renamed(spark, sf):
    m = rename_map_df(_name_lists(spark, sf))
    return m.where(F.col("original") != F.col("cleaned")).select("table_key", "original", "cleaned")


# ---- C3 / C4 -----------------------------------------------------------------------------

def _do_select(expr_of):
    cols = ["o_orderkey", "o_custkey"] + [f"{expr_of(c)} AS {c}" for c in _DO_TEXT]
    return with_dirty(f"SELECT {', '.join(cols)} FROM dirty_orders")


@query("trim_text", "C3", _do_select(trim_sql))
def q_trim(spark, sf):
    return trim_text(dirty_orders(spark, sf))


@query("missing_tokens", "C4", _do_select(lambda c: tokens_sql(trim_sql(c))))
def q_tokens(spark, sf):
    return null_missing_tokens(trim_text(dirty_orders(spark, sf)))


# ---- C5 / C6 -----------------------------------------------------------------------------

def _vote_sql():
    parts = []
    for c in _DO_TEXT:
        tok = tokens_sql(trim_sql(c))
        parts.append(f"""SELECT {q(c)} AS name, CAST(count({tok}) AS BIGINT) AS non_null,
  CAST(count({guarded_double_sql(tok)}) AS BIGINT) AS numeric_ok,
  CAST(count({parse_datetime_sql(tok)}) AS BIGINT) AS datetime_ok FROM dirty_orders""")
    body = "\nUNION ALL\n".join(parts)
    return with_dirty(f"""SELECT name, non_null, numeric_ok, datetime_ok,
  numeric_ok >= non_null * 0.8 AND numeric_ok > 0 AS to_numeric,
  NOT (numeric_ok >= non_null * 0.8 AND numeric_ok > 0) AND datetime_ok >= non_null * 0.8 AND datetime_ok > 0
    AS to_datetime
FROM ({body})""")


@query("coercion_vote", "C5, C6", _vote_sql())
def q_vote(spark, sf):
    return vote_table(dirty_orders(spark, sf))


# ---- C7 / C9 -----------------------------------------------------------------------------

@query("dedup_rows", "C7", with_dirty("SELECT DISTINCT * FROM dirty_orders"))
def q_dedup(spark, sf):
    from ..operators.profile import drop_duplicate_rows
    return drop_duplicate_rows(dirty_orders(spark, sf))


def _clean_orders_sql():
    def tok(c):
        return tokens_sql(trim_sql(c))
    return (f"SELECT DISTINCT o_orderkey, o_custkey, {tok('order_priority')} AS order_priority, "
            f"{guarded_double_sql(tok('total_cents'))} AS total_cents, "
            f"{parse_datetime_sql(tok('order_date'))} AS order_date, {tok('order_status')} AS order_status "
            f"FROM dirty_orders")


@query("safe_clean", "C3-C7, C9", with_dirty(_clean_orders_sql()))
def q_safe_clean(spark, sf):
    return safe_clean(dirty_orders(spark, sf)).df


# ---- C8 ----------------------------------------------------------------------------------

def _log_sql():
    def tok(c):
        return tokens_sql(trim_sql(c))
    trimmed = " + ".join(f"(count_if({c} <> {trim_sql(c)}) > 0)::INT" for c in _DO_TEXT)
    nulls = " + ".join(f"count_if({trim_sql(c)} IS NOT NULL AND {tok(c)} IS NULL)" for c in _DO_TEXT)
    return with_dirty(f"""
WITH s AS (SELECT count(*) AS n, {trimmed} AS trimmed, {nulls} AS new_nulls FROM dirty_orders),
a AS (SELECT count(*) AS after FROM ({_clean_orders_sql()})),
acts AS (
  SELECT 1 AS ord, 'trim_whitespace' AS action, {as_sql(DETAILS['trim_whitespace'], n='trimmed')} AS details,
         CAST(trimmed AS BIGINT) AS n, trimmed > 0 AS keep FROM s
  UNION ALL SELECT 2, 'normalize_missing_tokens', {as_sql(DETAILS['normalize_missing_tokens'], n='new_nulls')},
         CAST(new_nulls AS BIGINT), new_nulls > 0 FROM s
  UNION ALL SELECT 3, 'type_coercion', {as_sql(DETAILS['type_coercion'], n=2, items="'total_cents -> numeric, order_date -> datetime'")},
         CAST(2 AS BIGINT), true
  UNION ALL SELECT 4, 'remove_duplicates', {as_sql(DETAILS['remove_duplicates'], n='n - after')}, CAST(n - after AS BIGINT),
         n - after > 0 FROM s, a
  UNION ALL SELECT 5, 'safe_cleaning_complete', {as_sql(DETAILS['safe_cleaning_complete'], before='n', n='after')},
         CAST(after AS BIGINT), true FROM s, a)
SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS step, action, details, n FROM acts WHERE keep""")


LOG_SQL = _log_sql()


@query("cleaning_log", "C8", LOG_SQL)
def q_log(spark, sf):
    return safe_clean(dirty_orders(spark, sf)).log


# ---- Q1 ----------------------------------------------------------------------------------

def _diff_sql():
    def side(name, src, cols):
        miss = " + ".join(f"count_if({c} IS NULL)" for c in cols)
        return (f"SELECT {q(name)} AS side, CAST(count(*) AS BIGINT) AS rows, CAST({len(cols)} AS INTEGER) AS columns, "
                f"CAST({miss} AS BIGINT) AS missing_total, "
                f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS duplicates "
                f"FROM {src}")
    cols = ["o_orderkey", "o_custkey"] + _DO_TEXT
    return with_dirty(f"""WITH cleaned AS ({_clean_orders_sql()}),
b AS ({side('before', 'dirty_orders', cols)}), a AS ({side('after', 'cleaned', cols)})
SELECT * FROM b UNION ALL SELECT * FROM a
UNION ALL SELECT 'change', b.rows - a.rows, CAST(b.columns - a.columns AS INTEGER), b.missing_total - a.missing_total,
  b.duplicates - a.duplicates FROM b, a""")


@query("quality_diff", "Q1", _diff_sql())
def q_diff(spark, sf):
    before = dirty_orders(spark, sf)
    return quality_diff(before, safe_clean(before).df)


# ---- R1-R5 -------------------------------------------------------------------------------

_EV = ["event_id", "ts", "user_id", "event_type", "value"]


@query("median_impute", "R1", with_dirty(
    "SELECT event_id, ts, user_id, event_type, coalesce(CAST(value AS DOUBLE), "
    "(SELECT quantile_cont(value, 0.5) FROM dirty_events)) AS value FROM dirty_events"))
def q_median(spark, sf):
    df = dirty_events(spark, sf)
    return median_impute(df, profile(df, "dirty_events", light=True))[0]


_MODE_SQL = ("(SELECT event_type FROM dirty_events WHERE event_type IS NOT NULL GROUP BY event_type "
             "ORDER BY count(*) DESC, event_type ASC LIMIT 1)")


@query("mode_impute", "R2", with_dirty(
    f"SELECT event_id, ts, user_id, coalesce(event_type, {_MODE_SQL}) AS event_type, value FROM dirty_events"))
def q_mode(spark, sf):
    df = dirty_events(spark, sf)
    return mode_impute(df, profile(df, "dirty_events", light=True))[0]


def _winsor_sql(src, cols, numeric):
    qs = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in numeric)
    outs = ", ".join(f"count_if({c} < lo_{c} OR {c} > hi_{c}) AS o_{c}" for c in numeric)
    sel = []
    for c in cols:
        if c in numeric:
            sel.append(f"CASE WHEN o_{c} > 0 THEN CASE WHEN {c} IS NULL THEN NULL ELSE "
                       f"greatest(least(CAST({c} AS DOUBLE), hi_{c}), lo_{c}) END ELSE {c} END AS {c}")
        else:
            sel.append(c)
    return (f"SELECT {', '.join(sel)} FROM {src}, (SELECT {qs} FROM {src}) q, "
            f"(SELECT {outs} FROM {src}, (SELECT {qs} FROM {src})) o")


@query("winsorize", "R3", with_dirty(_winsor_sql("dirty_events", _EV, ["event_id", "user_id", "value"])))
def q_winsor(spark, sf):
    return winsorize(dirty_events(spark, sf))[0]


def _rare_sql(src, cols, text, tag="f"):
    """(cte, select) pair: frequency CTE named ``tag`` and the projection."""
    freq = " UNION ALL ".join(
        f"SELECT {q(c)} AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n, "
        f"sum(count(*)) OVER () AS total FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}" for c in text)
    sel = []
    for c in cols:
        if c in text:
            sel.append(f"""CASE WHEN {c} IS NULL THEN NULL
  WHEN NOT EXISTS (SELECT 1 FROM {tag} WHERE name = {q(c)} AND n / total < 0.01) THEN {c}
  WHEN EXISTS (SELECT 1 FROM {tag} WHERE name = {q(c)} AND value = {c} AND n / total >= 0.01) THEN {c}
  ELSE 'Other' END AS {c}""")
        else:
            sel.append(c)
    return f"{tag} AS ({freq})", f"SELECT {', '.join(sel)} FROM {src}"


_RARE_CTE, _RARE_SEL = _rare_sql("dirty_orders", ["o_orderkey", "o_custkey"] + _DO_TEXT, _DO_TEXT)


@query("group_rare", "R4", with_dirty(f"WITH {_RARE_CTE} {_RARE_SEL}"))
def q_rare(spark, sf):
    return group_rare(dirty_orders(spark, sf))[0]


def _recommended_sql():
    s1 = (f"SELECT event_id, ts, user_id, coalesce(event_type, {_MODE_SQL}) AS event_type, "
          "coalesce(CAST(value AS DOUBLE), (SELECT quantile_cont(value, 0.5) FROM dirty_events)) AS value "
          "FROM dirty_events")
    s2 = _winsor_sql("s1", _EV, ["event_id", "user_id", "value"])
    cte, sel = _rare_sql("s2", _EV, ["event_type"])
    return with_dirty(f"WITH s1 AS ({s1}), s2 AS ({s2}), {cte} {sel}")


@query("recommended_clean", "R1-R5", _recommended_sql())
def q_recommended(spark, sf):
    df = dirty_events(spark, sf)
    return recommended_clean(df, profile(df, "dirty_events", light=True))[0]


def _recommended_log_sql():
    s1 = (f"SELECT event_id, ts, user_id, coalesce(event_type, {_MODE_SQL}) AS event_type, "
          "coalesce(CAST(value AS DOUBLE), (SELECT quantile_cont(value, 0.5) FROM dirty_events)) AS value "
          "FROM dirty_events")
    num = ["event_id", "user_id", "value"]
    clipped = " + ".join(
        f"(SELECT (count_if({c} < quantile_cont_lo OR {c} > quantile_cont_hi) > 0)::INT FROM s1, "
        f"(SELECT quantile_cont({c}, 0.01) AS quantile_cont_lo, quantile_cont({c}, 0.99) AS quantile_cont_hi FROM s1))"
        for c in num)
    return with_dirty(f"""WITH s1 AS ({s1}),
k AS (SELECT ({clipped}) AS clipped,
  (SELECT count(*) FROM (SELECT event_type FROM s1 WHERE event_type IS NOT NULL GROUP BY 1
     HAVING count(*) / (SELECT count(event_type) FROM s1) < 0.01)) > 0 AS has_rare,
  (SELECT count_if(value IS NULL) FROM dirty_events) > 0 AS med,
  (SELECT count_if(event_type IS NULL) FROM dirty_events) > 0 AS mode,
  (SELECT count(*) FROM s1) AS n),
acts AS (
  SELECT 1 AS ord, 'median_imputation' AS action, {as_sql(DETAILS['median_imputation'], n=1, items="'value'")} AS details,
         CAST(1 AS BIGINT) AS n, med AS keep FROM k
  UNION ALL SELECT 2, 'mode_imputation', {as_sql(DETAILS['mode_imputation'], n=1, items="'event_type'")}, 1, mode FROM k
  UNION ALL SELECT 3, 'winsorize_outliers', {as_sql(DETAILS['winsorize_outliers'], n='clipped')}, clipped, clipped > 0 FROM k
  UNION ALL SELECT 4, 'group_rare_categories', {as_sql(DETAILS['group_rare_categories'], n=1)}, 1, has_rare FROM k
  UNION ALL SELECT 5, 'recommended_cleaning_complete', {as_sql(DETAILS['recommended_cleaning_complete'], n='n')}, n, true FROM k)
SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS step, action, details, CAST(n AS BIGINT) AS n
FROM acts WHERE keep""")


@query("recommended_log", "R5 log", _recommended_log_sql())
def q_recommended_log(spark, sf):
    df = dirty_events(spark, sf)
    return recommended_clean(df, profile(df, "dirty_events", light=True))[1]



# ---- R6 ----------------------------------------------------------------------------------

def _pipeline_sql():
    cols = ["o_orderkey", "o_custkey"] + _DO_TEXT
    text = ["order_priority", "order_status"]

    def mode(c):
        return f"(SELECT {c} FROM c0 WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)"
    s1 = ("SELECT o_orderkey, o_custkey, " + ", ".join(f"coalesce({c}, {mode(c)}) AS {c}" for c in text)
          + ", order_date, coalesce(total_cents, (SELECT quantile_cont(total_cents, 0.5) FROM c0)) AS total_cents FROM c0")
    s2 = _winsor_sql("s1", cols, ["o_orderkey", "o_custkey", "total_cents"])
    cte, sel = _rare_sql("s2", cols, text)
    return with_dirty(f"WITH c0 AS ({_clean_orders_sql()}), s1 AS ({s1}), s2 AS ({s2}), {cte} {sel}")


@query("clean_pipeline", "R6 (C9 → profile → R5 → re-profile, written)", _pipeline_sql())
def q_clean_pipeline(spark, sf):
    """Padded tokens, unparsable numbers and repeated rows through the whole
    pipeline; the rows are those of the written table. Clipping may make rows
    equal again: they stay, and the profile must count them."""
    import uuid

    from ..operators.recommend import clean
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablecare-io/{uuid.uuid4().hex}"
    _, _, after, _ = clean(dirty_orders(spark, sf), recommended=True, output_path=path)
    out = spark.read.parquet(path)
    if after.n_rows != out.count() or after.duplicates_count != duplicate_rows(out).first()[0]:
        raise AssertionError("the profile after cleaning does not describe the written table")
    return out
