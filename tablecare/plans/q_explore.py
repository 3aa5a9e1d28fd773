"""Registered queries: exploration results (V1-V10, V13) and wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_sql, safe_corr_sql
from ..functions.quantiles import quantiles
from ..functions.text import OUTCOME_KEYWORDS, QUALITY_KEYWORDS, TEMPORAL_KEYWORDS
from ..operators import explore as X
from ..operators.profile import profile
from ..sources.tables import dirty_events, load_table
from .pack import default_plan, pack_results, plan_df
from .registry import query
from .sqlgen import q, with_dirty

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax"]
_EV = ["event_id", "ts", "user_id", "event_type", "value"]


# ---- V1 ----------------------------------------------------------------------------------

_MISSING_SQL = with_dirty("SELECT name, missing FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, {q(c)} AS name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM dirty_events"
    for i, c in enumerate(_EV)) + ") WHERE missing > 0")


@query("missing_by_column", "V1", _MISSING_SQL)
def q_missing(spark, sf):
    return X.missing_by_column(dirty_events(spark, sf))


@query("missing_summary", "V1 totals", f"""SELECT CAST(coalesce(sum(missing), 0) AS BIGINT) AS total_missing,
  CAST(count(*) AS BIGINT) AS cols_with_missing FROM ({_MISSING_SQL})""")
def q_missing_summary(spark, sf):
    return X.missing_summary(dirty_events(spark, sf))


# ---- V2 ----------------------------------------------------------------------------------

def _hist_sql(table, c, bins=30):
    w = f"((mx - mn) / {float(bins)})"
    return f"""WITH v AS (SELECT CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL),
mm AS (SELECT min(v) AS mn, max(v) AS mx FROM v),
b AS (SELECT CASE WHEN mx > mn THEN least(floor((v - mn) / {w}), {bins - 1}) ELSE 0 END AS bin FROM v, mm),
c AS (SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(s.bin AS INTEGER) AS bin, {rnd_sql(f'mn + s.bin * {w}')} AS lo, {rnd_sql(f'mn + (s.bin + 1) * {w}')} AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT unnest(generate_series(0, {bins - 1})) AS bin) s CROSS JOIN mm LEFT JOIN c ON c.bin = s.bin
WHERE mn IS NOT NULL"""


@query("histogram", "V2, D28", _hist_sql("lineitem", "l_extendedprice"))
def q_hist(spark, sf):
    return X.histogram(load_table(spark, sf, "lineitem"), "l_extendedprice")


@query("distribution_stats", "V2 stats, D7, D8", f"""SELECT {rnd_sql('avg(l_extendedprice)')} AS mean,
  {rnd_sql('quantile_cont(l_extendedprice, 0.5)')} AS median, {rnd_sql('stddev_samp(l_extendedprice)')} AS std,
  {rnd_sql('skewness(l_extendedprice)')} AS skewness, CAST(count(l_extendedprice) AS BIGINT) AS n FROM lineitem""")
def q_dist(spark, sf):
    return X.distribution_stats(load_table(spark, sf, "lineitem"), "l_extendedprice")


# ---- V3 ----------------------------------------------------------------------------------

@query("category_frequency", "V3", """SELECT CAST(p_type AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n
FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 10""")
def q_catfreq(spark, sf):
    return X.category_frequency(load_table(spark, sf, "part"), "p_type")


# ---- V4 / X2 -----------------------------------------------------------------------------

def _corr_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(f"SELECT {q(c)} AS x, {q(c)} AS y, CASE WHEN stddev_pop({c}) > 0 THEN 1.0 END AS r FROM {table}")
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            r = rnd_sql(safe_corr_sql(f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"))
            parts.append(f"SELECT {q(a)} AS x, {q(b)} AS y, {r} AS r FROM {table}")
            parts.append(f"SELECT {q(b)} AS x, {q(a)} AS y, {r} AS r FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("correlation_matrix", "V4, D11", _corr_sql("lineitem", _LI_NUM))
def q_corr(spark, sf):
    return X.correlation_matrix(load_table(spark, sf, "lineitem"))


@query("correlation_summary", "V4 summary, D12", f"""SELECT max(CASE WHEN x <> y THEN abs(r) END) AS max_correlation,
  CAST(count(DISTINCT x) AS BIGINT) AS num_features FROM ({_corr_sql('lineitem', _LI_NUM)})""")
def q_corr_summary(spark, sf):
    return X.correlation_summary(X.correlation_matrix(load_table(spark, sf, "lineitem")))


@query("corr_labels", "X2", f"""SELECT x, y, r,
  CASE WHEN r IS NULL THEN NULL WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END
    AS strength,
  CASE WHEN r IS NULL THEN NULL WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({_corr_sql('lineitem', _LI_NUM)})""")
def q_corr_labels(spark, sf):
    return X.correlation_labels(X.correlation_matrix(load_table(spark, sf, "lineitem")))


_GAPS = """SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS u,
 value, CASE WHEN event_id % 5 = 0 THEN NULL WHEN value IS NULL THEN 4e12 ELSE 1e8 + event_id % 10 END AS far,
 CASE WHEN value IS NOT NULL THEN 0.1 ELSE CAST(event_id AS DOUBLE) END AS flat FROM {events}"""


def _corr_gaps_sql():
    cols, parts = ["u", "value", "far", "flat"], []
    for a in cols:
        for b in cols:
            some = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            varies = f"min({a}) {some} < max({a}) {some} AND min({b}) {some} < max({b}) {some}"
            r = "1.0" if a == b else rnd_sql(f"corr({a}, {b}) {some}")
            parts.append(f"SELECT {q(a)} AS x, {q(b)} AS y, CASE WHEN {varies} THEN CAST({r} AS DOUBLE) END AS r FROM gaps")
    return with_dirty(f"WITH gaps AS ({_GAPS.format(events='dirty_events')}) " + " UNION ALL ".join(parts))


@query("correlation_nulls", "V4 (pairwise-complete with NULLs on both sides, far values beside a pair, a constant pair)", _corr_gaps_sql())
def q_corr_nulls(spark, sf):
    return X.correlation_matrix(spark.sql(_GAPS, events=dirty_events(spark, sf)))


# ---- V5 ----------------------------------------------------------------------------------

@query("scatter_stats", "V5", with_dirty(f"""SELECT CASE WHEN count(*) > 1 THEN
  {rnd_sql(safe_corr_sql('x', 'y'))} END AS correlation, CAST(count(*) AS BIGINT) AS n_points
FROM (SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM dirty_events WHERE user_id IS NOT NULL AND value IS NOT NULL)"""))
def q_scatter(spark, sf):
    return X.scatter_stats(dirty_events(spark, sf), "user_id", "value")


# ---- V6 ----------------------------------------------------------------------------------

def _box_sql(table, cols):
    parts = []
    for c in cols:
        lo = "(q1 - 1.5 * (q3 - q1))"
        hi = "(q3 + 1.5 * (q3 - q1))"
        parts.append(f"""SELECT {q(c)} AS name, {rnd_sql('q1')} AS q1, {rnd_sql('med')} AS median, {rnd_sql('q3')} AS q3,
  {rnd_sql(f'(SELECT min({c}) FROM {table} WHERE {c} >= {lo})')} AS whisker_lo,
  {rnd_sql(f'(SELECT max({c}) FROM {table} WHERE {c} <= {hi})')} AS whisker_hi,
  (SELECT CAST(count_if({c} < {lo} OR {c} > {hi}) AS BIGINT) FROM {table}) AS n_outliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3
      FROM {table})""")
    return "\nUNION ALL\n".join(parts)


@query("box_stats", "V6", _box_sql("lineitem", _LI_NUM[:6]))
def q_box(spark, sf):
    return X.box_stats(load_table(spark, sf, "lineitem"))


_WIDE = """SELECT CASE WHEN event_id % 1000 = 7 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 1000 = 8 THEN CAST('-Infinity' AS DOUBLE)
  WHEN event_id % 1000 = 9 THEN 1.7e308 WHEN event_id % 1000 = 10 THEN -1.7e308 ELSE value END AS ends,
 value * pow(CAST(2 AS DOUBLE), CAST(event_id % 1201 - 600 AS DOUBLE)) AS decades FROM {events}"""


@query("quantiles_wide", "V6, P8, R1, R3 (quartiles with infinities, both ends of the double range and 360 decades)",
       f"WITH w AS ({_WIDE.format(events='events')}) " + " UNION ALL ".join(
           f"SELECT {q(c)} AS name, " + ", ".join(f"{rnd_sql(f'quantile_cont({c}, {p})')} AS {n}" for n, p in
                                                 (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM w" for c in ("ends", "decades")))
def q_quantiles_wide(spark, sf):
    got = quantiles(spark.sql(_WIDE, events=load_table(spark, sf, "events")), ["ends", "decades"], [0.25, 0.5, 0.75])
    out = spark.createDataFrame([(c, *v) for c, v in got.items()], "name string, a double, b double, c double")
    return out.select("name", rnd(F.col("a")).alias("q1"), rnd(F.col("b")).alias("median"), rnd(F.col("c")).alias("q3"))


# ---- V7 ----------------------------------------------------------------------------------

@query("time_trend", "V7", "SELECT ts, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL")
def q_trend(spark, sf):
    return X.time_trend(load_table(spark, sf, "events"), "ts", "value")


@query("time_trend_summary", "V7 summary", """SELECT CAST(count(*) AS BIGINT) AS n_points,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') || ' to ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS date_range
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL""")
def q_trend_summary(spark, sf):
    t = X.time_trend(load_table(spark, sf, "events"), "ts", "value")
    return t.agg(F.count(F.lit(1)).cast("bigint").alias("n_points"),
                 F.concat_ws(" to ", F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                             F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("date_range"))


@query("time_trend_buckets", "V7 buckets", f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket,
  CAST(count(*) AS BIGINT) AS n, {rnd_sql('avg(value)')} AS mean
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1""")
def q_trend_buckets(spark, sf):
    return X.time_trend_buckets(load_table(spark, sf, "events"), "ts", "value", "day")


# ---- V8 ----------------------------------------------------------------------------------

@query("grouped_agg", "V8", f"""SELECT CAST(l_suppkey AS VARCHAR) AS grp, {rnd_sql('avg(l_extendedprice)')} AS value
FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY value DESC NULLS LAST, grp ASC LIMIT 10""")
def q_grouped(spark, sf):
    return X.grouped_agg(load_table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "mean")


@query("grouped_agg_nunique", "V8 (nunique)", """SELECT CAST(o_orderpriority AS VARCHAR) AS grp,
  CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1
ORDER BY value DESC NULLS LAST, grp ASC LIMIT 10""")
def q_grouped_nunique(spark, sf):
    return X.grouped_agg(load_table(spark, sf, "orders"), "o_orderpriority", "o_custkey", "nunique")


_AGG_SQL = {"mean": "avg({v})", "sum": "sum({v})", "count": "CAST(count({v}) AS DOUBLE)", "min": "min({v})", "max": "max({v})",
            "median": "median({v})", "std": "stddev_samp({v})", "nunique": "CAST(count(DISTINCT {v}) AS DOUBLE)"}


@query("grouped_agg_all", "V8 (all eight aggregations)", with_dirty(" UNION ALL ".join(
    f"SELECT * FROM (SELECT {q(a)} AS aggregation, CAST(user_id AS VARCHAR) AS grp, {rnd_sql(e.format(v='value'))} AS value "
    f"FROM dirty_events WHERE user_id IS NOT NULL GROUP BY 2 ORDER BY value DESC NULLS LAST, grp ASC LIMIT 10)"
    for a, e in _AGG_SQL.items())))
def q_grouped_all(spark, sf):
    ev = dirty_events(spark, sf)
    parts = [X.grouped_agg(ev, "user_id", "value", a).select(F.lit(a).alias("aggregation"), "grp", "value") for a in _AGG_SQL]
    return reduce(DataFrame.unionByName, parts)


# ---- V9 ----------------------------------------------------------------------------------

def _pack_sql(table: str) -> str:
    """Oracle for the default pack: column classes from the catalog plus the
    datetime vote on text columns, then the fixed plan rule with lists."""
    from .schemas import TABLE_SCHEMAS, type_family
    from .sqlgen import parse_datetime_sql

    text = [c for c, t in TABLE_SCHEMAS[table] if type_family(t) == "text"]
    vote = " UNION ALL ".join(
        f"SELECT {q(c)} AS name, count({c}) > 0 AND count({parse_datetime_sql(c)}) = count({c}) AS is_dt FROM {table}"
        for c in text) or "SELECT NULL::VARCHAR AS name, false AS is_dt"

    def spec(kind, column="NULL", x="NULL", y="NULL", cols="NULL::VARCHAR[]", agg="NULL"):
        return (f"{{'type': '{kind}', 'column': CAST({column} AS VARCHAR), 'x': CAST({x} AS VARCHAR), "
                f"'y': CAST({y} AS VARCHAR), 'cols': CAST({cols} AS VARCHAR[]), 'agg': CAST({agg} AS VARCHAR)}}")
    base = (f"list_concat([{spec('missing_values_bar')}], "
            f"CASE WHEN len(num) > 0 THEN [{spec('numeric_distribution', 'num[1]')}] ELSE [] END, "
            f"CASE WHEN len(cat) > 0 THEN [{spec('categorical_frequency', 'cat[1]')}] ELSE [] END, "
            f"CASE WHEN len(num) >= 2 THEN [{spec('correlation_heatmap')}, "
            f"{spec('scatter', x='num[1]', y='num[2]')}] ELSE [] END, "
            f"CASE WHEN len(num) > 0 THEN [{spec('boxplot_outliers', cols='list_slice(num, 1, 6)')}] ELSE [] END, "
            f"CASE WHEN len(dt) > 0 AND len(num) > 0 THEN [{spec('time_trend', 'dt[1]', y='num[1]')}] "
            f"WHEN len(cat) > 0 AND len(num) > 0 THEN [{spec('grouped_bar', 'cat[1]', y='num[1]', agg=q('mean'))}] "
            f"ELSE [] END, "
            f"list_transform(list_slice(num, 2, len(num)), lambda c: {spec('numeric_distribution', 'c')}), "
            f"list_transform(list_slice(cat, 2, len(cat)), lambda c: {spec('categorical_frequency', 'c')}), "
            f"list_transform(range(7), lambda i: {spec('missing_values_bar')}))")
    return f"""WITH cols AS (
  SELECT column_name AS name, data_type AS t, ordinal_position AS pos FROM information_schema.columns
  WHERE table_name = {q(table)}),
vote AS ({vote}),
typed AS (
  SELECT c.name, c.pos, CASE
    WHEN c.t LIKE 'TIMESTAMP%' OR c.t = 'DATE' OR coalesce(v.is_dt, false) THEN 'datetime'
    WHEN c.t IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE', 'BOOLEAN') OR c.t LIKE 'DECIMAL%'
      THEN 'numeric'
    ELSE 'categorical' END AS ctype
  FROM cols c LEFT JOIN vote v USING (name)),
l AS (
  SELECT coalesce(list(name ORDER BY pos) FILTER (WHERE ctype = 'numeric'), []) AS num,
         coalesce(list(name ORDER BY pos) FILTER (WHERE ctype = 'categorical'), []) AS cat,
         coalesce(list(name ORDER BY pos) FILTER (WHERE ctype = 'datetime'), []) AS dt FROM typed),
p AS (SELECT list_slice({base}, 1, 7) AS plan FROM l),
u AS (SELECT unnest(range(len(plan))) AS i, unnest(plan) AS s FROM p)
SELECT CAST(i AS INTEGER) AS chart_index, s.type AS chart_type, s.column AS "column", s.x AS x_column,
  s.y AS y_column, array_to_string(s.cols, ',') AS columns, s.agg AS aggregation,
  s.type || '|' || array_to_string(list_sort(list_distinct(list_filter(
    list_concat([s.column, s.x, s.y], coalesce(s.cols, [])), lambda z: z IS NOT NULL))), '_') || '|'
    || coalesce(s.agg, '') AS signature
FROM u"""


@query("exploration_pack", "V9, V10 (spec signatures)", _pack_sql("orders"))
def q_pack(spark, sf):
    orders = load_table(spark, sf, "orders")
    return plan_df(spark, default_plan(profile(orders, "orders", light=True)))


def _pack_results_sql():
    num = ["o_orderkey", "o_custkey", "o_totalprice"]
    cols = [*num, "o_orderstatus", "o_orderdate", "o_orderpriority"]
    box = [f"SELECT name || '.{m}' AS item, CAST({m} AS DOUBLE) AS value FROM ({_box_sql('orders', num)})"
           for m in ("q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")]
    r = rnd_sql(safe_corr_sql("CAST(o_orderkey AS DOUBLE)", "CAST(o_custkey AS DOUBLE)"))
    parts = [
        ("missing_values_bar", " UNION ALL ".join(
            f"SELECT {q(c)} AS item, CAST(count_if({c} IS NULL) AS DOUBLE) AS value FROM orders HAVING count_if({c} IS NULL) > 0" for c in cols)),
        ("numeric_distribution", f"SELECT CAST(bin AS VARCHAR) AS item, CAST(n AS DOUBLE) AS value FROM ({_hist_sql('orders', 'o_orderkey')})"),
        ("categorical_frequency", "SELECT o_orderstatus AS item, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderstatus IS NOT NULL "
                                  "GROUP BY 1 ORDER BY value DESC, item LIMIT 10"),
        ("correlation_heatmap", f"SELECT x || ' ~ ' || y AS item, CAST(r AS DOUBLE) AS value FROM ({_corr_sql('orders', num)})"),
        ("scatter", f"SELECT 'correlation' AS item, {r} AS value FROM orders UNION ALL SELECT 'n_points', CAST(count(*) AS DOUBLE) "
                    "FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL"),
        ("boxplot_outliers", " UNION ALL ".join(box)),
        ("time_trend", f"SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS item, {rnd_sql('avg(o_orderkey)')} AS value FROM orders "
                       "WHERE o_orderdate IS NOT NULL AND o_orderkey IS NOT NULL GROUP BY 1"),
    ]
    return "\nUNION ALL\n".join(f"SELECT CAST({i} AS INTEGER) AS chart_index, {q(kind)} AS chart_type, item, value FROM ({sql})"
                                for i, (kind, sql) in enumerate(parts))


@query("exploration_results", "V9 (the seven results of the default pack)", _pack_results_sql())
def q_pack_results(spark, sf):
    orders = load_table(spark, sf, "orders")
    return pack_results(orders, profile(orders, "orders", light=True))


# ---- V10 ---------------------------------------------------------------------------------

_MEMBERS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a_b' WHEN 2 THEN 'a' ELSE event_type END AS p,
 CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'b_c' WHEN 2 THEN 'a' WHEN 3 THEN 'c' ELSE event_type END AS q FROM {events}"""


@query("unordered_dedup_nulls", "V10 (NULL members, separators inside values)", with_dirty(
    f"""SELECT event_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY
  CASE WHEN p IS NULL OR q IS NULL THEN true ELSE false END, coalesce(least(p, q), p, q), coalesce(greatest(p, q), p, q) ORDER BY event_id) AS rn
FROM ({_MEMBERS.format(events='dirty_events')})) WHERE rn = 1"""))
def q_unordered_nulls(spark, sf):
    return X.unordered_dedup(spark.sql(_MEMBERS, events=dirty_events(spark, sf)), ["p", "q"], ["event_id"])


@query("unordered_dedup", "V10", """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)),
                                            greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))
                               ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def q_unordered(spark, sf):
    return X.unordered_dedup(load_table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"],
                             ["l_orderkey", "l_linenumber"])


# ---- X1 / V13 ----------------------------------------------------------------------------

def _any_sql(words):
    return "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in words) + ")"


@query("intent_flags", "X1", f"""SELECT conv_id, turn, role, text, {_any_sql(OUTCOME_KEYWORDS)} AS is_outcome,
  {_any_sql(TEMPORAL_KEYWORDS)} AS is_temporal, {_any_sql(QUALITY_KEYWORDS)} AS is_quality FROM conversations""")
def q_intent(spark, sf):
    return X.intent_flags(load_table(spark, sf, "conversations"), "text")


def _relevance_sql():
    types = ", ".join(q(t) for t in X.RELEVANCE)
    o, t, ql = _any_sql(OUTCOME_KEYWORDS), _any_sql(TEMPORAL_KEYWORDS), _any_sql(QUALITY_KEYWORDS)
    flags = {"is_outcome": "iso", "is_temporal": "ist", "is_quality": "isq"}

    def case(part: int) -> str:
        whens = "".join(
            f" WHEN chart_type = {q(kind)} THEN " + (q(if_not[part]) if flag is None else
                                                     f"CASE WHEN {flags[flag]} THEN {q(if_set[part])} ELSE {q(if_not[part])} END")
            for kind, (flag, if_set, if_not) in X.RELEVANCE.items())
        return f"CASE{whens} ELSE {q(X.OTHER_RELEVANCE[part])} END"
    rel, why = case(0), case(1)
    return f"""SELECT conv_id, turn, chart_type, {rel} AS relevance, {why} AS reason FROM (
  SELECT conv_id, turn, {o} AS iso, {t} AS ist, {ql} AS isq, unnest([{types}]) AS chart_type FROM conversations)"""


@query("result_relevance", "V13", _relevance_sql())
def q_relevance(spark, sf):
    return X.result_relevance(load_table(spark, sf, "conversations"), "text", ["conv_id", "turn"])


# ---- V5 / V7 for display -----------------------------------------------------------------

_CELLS = "CAST(CASE WHEN {hi} > {lo} THEN least(floor(({v} - {lo}) / (({hi} - {lo}) / 32.0)), 31) ELSE 0 END AS INTEGER)"


@query("scatter_sample", "V5 (bounded display sample)", with_dirty(f"""p AS (SELECT CAST(user_id AS DOUBLE) AS x, value AS y, CAST(event_id AS VARCHAR) AS key
  FROM dirty_events WHERE user_id IS NOT NULL AND value IS NOT NULL),
e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
c AS (SELECT p.*, {_CELLS.format(v='x', lo='x0', hi='x1')} AS cell_x, {_CELLS.format(v='y', lo='y0', hi='y1')} AS cell_y FROM p, e)
SELECT x, y, cell_x, cell_y, n FROM (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY md5(key), x, y) AS r,
  count(*) OVER (PARTITION BY cell_x, cell_y) AS n FROM c) WHERE r <= 4""".replace("p AS", "WITH p AS", 1)))
def q_scatter_sample(spark, sf):
    return X.scatter_sample(dirty_events(spark, sf), "user_id", "value", ["event_id"])


@query("time_line", "V7 (the points a drawn line needs)", with_dirty("""WITH p AS (SELECT ts, value FROM dirty_events WHERE ts IS NOT NULL AND value IS NOT NULL),
e AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM p),
c AS (SELECT CAST(((epoch_us(ts) - a) * 800) // (b - a + 1) AS INTEGER) AS pixel, ts, value FROM p, e)
SELECT DISTINCT pixel, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY ts, value) AS r1,
  row_number() OVER (PARTITION BY pixel ORDER BY ts DESC, value DESC) AS r2, row_number() OVER (PARTITION BY pixel ORDER BY value, ts) AS r3,
  row_number() OVER (PARTITION BY pixel ORDER BY value DESC, ts DESC) AS r4 FROM c) WHERE 1 IN (r1, r2, r3, r4)"""))
def q_time_line(spark, sf):
    return X.time_line(dirty_events(spark, sf), "ts", "value")
