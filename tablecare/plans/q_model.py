"""Registered queries: baseline modelling and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_bucket_sql, rnd, rnd_sql
from ..functions.text import LEAKAGE_FEATURE_TERMS_EXPLAIN, LEAKAGE_FEATURE_TERMS_SUMMARY
from ..operators import metrics as M
from ..operators import model as ML
from ..operators.profile import profile
from ..session import stored
from ..sources.tables import dirty_orders, load_table
from .pack import PACK_SIZE
from .q_clean import LOG_SQL
from .registry import query
from .sqlgen import q as _q
from .sqlgen import with_dirty

# Rule-based predictions, identical text in both engines.
ORDER_RULE = ("CASE WHEN o_totalprice > 200000 THEN 'O' WHEN o_orderdate < TIMESTAMP '1997-01-01 00:00:00' "
              "THEN 'F' ELSE 'P' END")
LINE_RULE = "l_quantity * 2100.0"


def _orders_pred(spark, sf):
    return load_table(spark, sf, "orders").select(F.col("o_orderstatus").alias("actual"),
                                                 F.expr(ORDER_RULE).alias("predicted"))


def _line_pred(spark, sf):
    return load_table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("actual"),
                                                   F.expr(LINE_RULE).alias("predicted"))


_OP = f"(SELECT o_orderstatus AS actual, {ORDER_RULE} AS predicted FROM orders)"
_LP = f"(SELECT l_extendedprice AS actual, {LINE_RULE} AS predicted FROM lineitem)"


# ---- M2 / M3 / M4 / M6 / M8 --------------------------------------------------------------

@query("hash_split", "M2", f"SELECT o_orderkey, {hash_bucket_sql('o_orderkey')} < 2000 AS is_test FROM orders")
def q_split(spark, sf):
    return ML.hash_split(load_table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


_STD_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("standardize", "M3", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{rnd_sql(f'({c} - (SELECT avg({c}) FROM lineitem)) / coalesce(NULLIF((SELECT stddev_pop({c}) FROM lineitem), 0), 1)')} AS {c}"
    for c in _STD_COLS) + " FROM lineitem")
def q_standardize(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_STD_COLS)
    s = ML.standardize(li, _STD_COLS)
    return s.select("l_orderkey", "l_linenumber", *[rnd(F.col(c)).alias(c) for c in _STD_COLS])


@query("class_weights", "M6", f"""WITH c AS (SELECT CAST(l_linenumber AS VARCHAR) AS label, count(*) AS n_c
  FROM lineitem GROUP BY 1), t AS (SELECT sum(n_c) AS n, count(*) AS k, max(n_c) AS mx, min(n_c) AS mn FROM c)
SELECT label, CAST(n_c AS BIGINT) AS n_c, {rnd_sql('CASE WHEN mx / mn > 2 THEN n / (k * n_c) ELSE 1.0 END')} AS weight
FROM c, t""")
def q_weights(spark, sf):
    w = ML.class_weights(load_table(spark, sf, "lineitem"), "l_linenumber")
    return w.select("label", "n_c", rnd(F.col("weight")).alias("weight"))


@query("one_hot", "M4, M5", f"""SELECT o_orderkey, 'cat__o_orderpriority_' || o_orderpriority AS feature, 1.0 AS value
FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE NOT ({hash_bucket_sql('o_orderkey')} < 2000))""")
def q_onehot(spark, sf):
    from pyspark.ml import Pipeline
    o = ML.hash_split(load_table(spark, sf, "orders"), ["o_orderkey"])
    col = ["o_orderpriority"]
    index = ML.category_index(o.where(~F.col("is_test")), col)
    coded = ML.encode(o, index, col, ML.index_sizes(index))
    enc = Pipeline(stages=[ML.one_hot(col)]).fit(coded.where(~F.col("is_test"))).transform(coded)
    v = enc.select("o_orderkey", F.posexplode(vector_to_array("__oh_o_orderpriority")).alias("j", "value")).where(F.col("value") != 0)
    names = index.select(F.col("idx").cast("int").alias("j"), F.concat(F.lit("cat__o_orderpriority_"), "value").alias("feature"))
    return v.join(names, "j").select("o_orderkey", "feature", "value")


@query("ridge_one_feature", "M8", f"""SELECT {rnd_sql('sxy / (sxx + 1.0)')} AS coefficient,
  {rnd_sql('my - sxy / (sxx + 1.0) * mx')} AS intercept
FROM (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) AS sxy, sum((l_quantity - mx) * (l_quantity - mx)) AS sxx,
        any_value(mx) AS mx, any_value(my) AS my
      FROM lineitem, (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem))""")
def q_ridge(spark, sf):
    coef, icpt = ML.ridge_fit(load_table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", 1.0)
    return spark.range(1).select(rnd(F.lit(coef[0])).alias("coefficient"), rnd(F.lit(icpt)).alias("intercept"))


# ---- M10-M14, M17 ------------------------------------------------------------------------

@query("confusion", "M12, D25", f"""SELECT CAST(actual AS VARCHAR) AS actual, CAST(predicted AS VARCHAR) AS predicted,
  CAST(count(*) AS BIGINT) AS n FROM {_OP} GROUP BY 1, 2""")
def q_confusion(spark, sf):
    return M.confusion(_orders_pred(spark, sf))


@query("accuracy", "M10", f"SELECT {rnd_sql('avg(CAST(actual = predicted AS DOUBLE))')} AS accuracy FROM {_OP}")
def q_accuracy(spark, sf):
    return M.accuracy(_orders_pred(spark, sf))


@query("macro_f1", "M11", f"""WITH cm AS (SELECT actual, predicted, count(*) AS n FROM {_OP} GROUP BY 1, 2),
labels AS (SELECT actual AS label FROM cm UNION SELECT predicted FROM cm),
per AS (SELECT l.label,
  coalesce((SELECT sum(n) FROM cm WHERE actual = l.label AND predicted = l.label), 0) AS tp,
  coalesce((SELECT sum(n) FROM cm WHERE predicted = l.label AND actual <> l.label), 0) AS fp,
  coalesce((SELECT sum(n) FROM cm WHERE actual = l.label AND predicted <> l.label), 0) AS fn FROM labels l)
SELECT {rnd_sql('avg(coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0))')} AS macro_f1 FROM per""")
def q_f1(spark, sf):
    return M.macro_f1(_orders_pred(spark, sf))


@query("regression_metrics", "M13", f"""SELECT {rnd_sql('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse,
  {rnd_sql('avg(abs(actual - predicted))')} AS mae,
  {rnd_sql('1 - sum((actual - predicted) * (actual - predicted)) / NULLIF(var_pop(actual) * count(*), 0)')} AS r2
FROM {_LP}""")
def q_regm(spark, sf):
    return M.regression_metrics(_line_pred(spark, sf))


@query("residuals", "M14", f"SELECT CAST(predicted AS DOUBLE) AS predicted, CAST(actual - predicted AS DOUBLE) AS residual FROM {_LP}")
def q_resid(spark, sf):
    return M.residuals(_line_pred(spark, sf))


@query("quality_band", "M17", f"""SELECT 'classification' AS task_type,
  CASE WHEN a >= 0.75 THEN 'Good' WHEN a >= 0.5 THEN 'Medium' ELSE 'Weak' END AS band
FROM (SELECT avg(CAST(actual = predicted AS DOUBLE)) AS a FROM {_OP})
UNION ALL SELECT 'regression', CASE WHEN r2 >= 0.5 THEN 'Good' WHEN r2 >= 0.2 THEN 'Medium' ELSE 'Weak' END
FROM (SELECT 1 - sum((actual - predicted) * (actual - predicted)) / NULLIF(var_pop(actual) * count(*), 0) AS r2 FROM {_LP})""")
def q_band(spark, sf):
    a = M.accuracy(_orders_pred(spark, sf)).select(F.lit("classification").alias("task_type"),
                                                  F.col("accuracy").alias("acc"), F.lit(None).cast("double").alias("r2"))
    r = M.regression_metrics(_line_pred(spark, sf)).select(F.lit("regression").alias("task_type"),
                                                          F.lit(None).cast("double").alias("acc"), "r2")
    u = a.unionByName(r)
    return u.select("task_type", M.quality_band(F.col("task_type"), F.col("acc"), F.col("r2")).alias("band"))


# ---- M1, M5, M7, M9, M15, M16, M18-M20 (fitted models: rows-only) -----------------------

def _classifier(spark, sf):
    orders = load_table(spark, sf, "orders")
    cust = load_table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    df = orders.join(cust, orders.o_custkey == cust.c_custkey, "left").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "c_mktsegment", "c_acctbal")
    df = stored(df, "orders-customer")   # many passes read it
    prof = profile(df, "orders_customer", light=True)
    prof.columns = [c for c in prof.columns if c["name"] != "o_orderkey"]
    return ML.train_baseline(df, "o_orderstatus", prof, ["o_orderkey"], run_id="orders_status")


def _regressor(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
                                                  "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    prof = profile(li, "lineitem", light=True)
    prof.columns = [c for c in prof.columns if c["name"] not in ("l_orderkey", "l_linenumber")]
    return ML.train_baseline(li, "l_extendedprice", prof, ["l_orderkey", "l_linenumber"], run_id="line_price")


@query("train_classifier", "M1, M4-M7, M9")
def q_train_cls(spark, sf):
    return _classifier(spark, sf).predictions


@query("train_regressor", "M1, M3, M5, M8, M9")
def q_train_reg(spark, sf):
    return _regressor(spark, sf).predictions


# A fit whose every step has a closed form: rows without a target go, the split, medians and scaling of the training rows,
# two penalised coefficients, the scores of the test rows.
_GAPPY = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS amount,
 CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS discount, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price FROM {lineitem}"""
_TRAIN = "FILTER (NOT test)"
_RIDGE_SQL = f"""WITH v AS ({_GAPPY.format(lineitem='lineitem')}),
s AS (SELECT amount, discount, price, {hash_bucket_sql("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))")} < 2000 AS test
  FROM v WHERE price IS NOT NULL),
m AS (SELECT quantile_cont(amount, 0.5) {_TRAIN} AS ma, quantile_cont(discount, 0.5) {_TRAIN} AS md FROM s),
f AS (SELECT test, price, coalesce(amount, ma) AS a, coalesce(discount, md) AS d FROM s, m),
t AS (SELECT avg(a) {_TRAIN} AS a0, stddev_pop(a) {_TRAIN} AS a1, avg(d) {_TRAIN} AS d0, stddev_pop(d) {_TRAIN} AS d1, avg(price) {_TRAIN} AS p0 FROM f),
z AS (SELECT test, price, (a - a0) / a1 AS a, (d - d0) / d1 AS d, p0 FROM f, t),
g AS (SELECT sum(a * a) + 1 AS aa, sum(d * d) + 1 AS dd, sum(a * d) AS ad, sum(a * (price - p0)) AS ap, sum(d * (price - p0)) AS dp FROM z WHERE NOT test),
b AS (SELECT (dd * ap - ad * dp) / (aa * dd - ad * ad) AS ca, (aa * dp - ad * ap) / (aa * dd - ad * ad) AS cd FROM g),
r AS (SELECT price, price - (p0 + ca * a + cd * d) AS e FROM z, b WHERE test)
SELECT CAST((SELECT count(*) FROM s WHERE NOT test) AS BIGINT) AS train_rows, CAST(count(*) AS BIGINT) AS test_rows,
 (SELECT {rnd_sql('ca', 2)} FROM b) AS coef_amount, (SELECT {rnd_sql('cd', 2)} FROM b) AS coef_discount,
 {rnd_sql(rnd_sql('sqrt(avg(e * e))'), 2)} AS rmse, {rnd_sql(rnd_sql('avg(abs(e))'), 2)} AS mae, {rnd_sql('1 - sum(e * e) / (var_pop(price) * count(*))')} AS r2 FROM r"""


@query("ridge_whole_path", "M1-M3, M5, M8, M9, M13, M15 (closed form)", _RIDGE_SQL)
def q_ridge_path(spark, sf):
    df = spark.sql(_GAPPY, lineitem=load_table(spark, sf, "lineitem"))
    res = ML.train_baseline(df, "price", profile(df.drop("l_orderkey", "l_linenumber"), light=True), ["l_orderkey", "l_linenumber"])
    coef = {r["feature"]: r["coefficient"] for r in res.importance.collect()}   # two rows
    m = M.regression_metrics(res.predictions)
    return m.select(F.lit(res.train_rows).cast("long").alias("train_rows"), F.lit(res.test_rows).cast("long").alias("test_rows"),
                    rnd(F.lit(coef["num__amount"]), 2).alias("coef_amount"), rnd(F.lit(coef["num__discount"]), 2).alias("coef_discount"),
                    rnd(F.col("rmse"), 2).alias("rmse"), rnd(F.col("mae"), 2).alias("mae"), rnd(F.col("r2")).alias("r2"))


# Coefficient tables of many runs, derived from the whole part table: a run per brand, classes for brands of odd length.
_COEFS = f"""SELECT p_brand AS run_id, concat('cat__', p_type, CASE p_size % 8 WHEN 0 THEN '_score' WHEN 1 THEN '_Label' WHEN 2 THEN '_win' ELSE '' END)
  AS feature, CASE WHEN length(p_type) % 2 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS INT) END AS class_index,
 {rnd_sql('avg(p_retailprice * (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END))')} AS coefficient FROM {{part}} GROUP BY 1, 2, 3"""
_RANK_SQL = f"""SELECT run_id, feature, coefficient, signed_coefficient, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(coefficient) DESC, feature) AS rank FROM (
    SELECT run_id, feature, CASE WHEN count(class_index) > 0 THEN avg(abs(coefficient)) ELSE max(coefficient) END AS coefficient,
      CASE WHEN count(class_index) <= 1 THEN max(coefficient) END AS signed_coefficient FROM ({_COEFS.format(part='part')}) GROUP BY 1, 2)) WHERE rank <= 20"""


def _ranking(spark, sf):
    return M.rank_coefficients(spark.sql(_COEFS, part=load_table(spark, sf, "part")))


@query("coef_ranking", "M15, D24", f"SELECT run_id, feature, {rnd_sql('coefficient')} AS coefficient, "
       f"{rnd_sql('signed_coefficient')} AS signed_coefficient, rank FROM ({_RANK_SQL})")
def q_coef(spark, sf):
    return _ranking(spark, sf).withColumns({c: rnd(F.col(c)) for c in ("coefficient", "signed_coefficient")})


def _leak_sql(terms, top):
    low = "lower(feature)"
    cond = " OR ".join(f"contains({low}, {_q(t)})" for t in terms)
    return f"SELECT run_id, feature, rank FROM ({_RANK_SQL}) WHERE rank <= {top} AND ({cond} OR contains({low}, lower('Price')))"


@query("leakage_features", "M16, D27 (both term lists)",
       f"SELECT 'explain' AS variant, * FROM ({_leak_sql(LEAKAGE_FEATURE_TERMS_EXPLAIN, 10)}) "
       f"UNION ALL SELECT 'summary', * FROM ({_leak_sql(LEAKAGE_FEATURE_TERMS_SUMMARY, 5)})")
def q_leakage(spark, sf):
    r, target = _ranking(spark, sf), F.lit("Price")
    parts = (("explain", M.leakage_suspects(r, target, top_n=10)), ("summary", M.leakage_summary(r, target)))
    return reduce(DataFrame.unionByName, [d.select(F.lit(v).alias("variant"), "run_id", "feature", "rank") for v, d in parts])


@query("key_drivers", "M18", f"""SELECT run_id, feature, rank, CASE WHEN coefficient > 0 THEN 'positive' ELSE 'negative' END AS effect,
  CASE WHEN signed_coefficient > 0 THEN 'positive' WHEN signed_coefficient IS NOT NULL THEN 'negative' END AS signed_effect,
  {rnd_sql('abs(coefficient)')} AS magnitude FROM ({_RANK_SQL}) WHERE rank <= 5""")
def q_drivers(spark, sf):
    return M.key_drivers(_ranking(spark, sf)).withColumn("magnitude", rnd(F.col("magnitude")))


# Predictions of many runs: a run per order priority (rule-based classes) and per line number (rule-based prices).
_RUNS = (f"SELECT o_orderpriority AS run_id, 'classification' AS task_type, o_orderstatus AS actual, {ORDER_RULE} AS predicted FROM {{orders}} "
         f"UNION ALL SELECT concat('line ', CAST(l_linenumber AS VARCHAR(9))), 'regression', CAST(l_extendedprice AS VARCHAR(40)), "
         f"CAST({LINE_RULE} AS VARCHAR(40)) FROM {{lineitem}}")


def _report_sql():
    runs = _RUNS.format(orders="orders", lineitem="lineitem")
    a, p = "CAST(actual AS DOUBLE)", "CAST(predicted AS DOUBLE)"
    return f"""WITH runs AS ({runs}),
cls AS (SELECT * FROM runs WHERE task_type = 'classification'),
cm AS (SELECT run_id, actual, predicted, count(*) AS n FROM cls GROUP BY 1, 2, 3),
labels AS (SELECT run_id, actual AS label FROM cm UNION SELECT run_id, predicted FROM cm),
per AS (SELECT l.run_id, l.label,
  coalesce((SELECT sum(n) FROM cm WHERE run_id = l.run_id AND actual = l.label AND predicted = l.label), 0) AS tp,
  coalesce((SELECT sum(n) FROM cm WHERE run_id = l.run_id AND predicted = l.label AND actual <> l.label), 0) AS fp,
  coalesce((SELECT sum(n) FROM cm WHERE run_id = l.run_id AND actual = l.label AND predicted <> l.label), 0) AS fn FROM labels l),
f1 AS (SELECT run_id, {rnd_sql('avg(coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0))')} AS macro_f1 FROM per GROUP BY 1),
acc AS (SELECT run_id, {rnd_sql('avg(CAST(actual = predicted AS DOUBLE))')} AS accuracy FROM cls GROUP BY 1),
reg AS (SELECT run_id, {rnd_sql(f'sqrt(avg(({a} - {p}) * ({a} - {p})))')} AS rmse, {rnd_sql(f'avg(abs({a} - {p}))')} AS mae,
  {rnd_sql(f'1 - sum(({a} - {p}) * ({a} - {p})) / NULLIF(var_pop({a}) * count(*), 0)')} AS r2 FROM runs WHERE task_type = 'regression' GROUP BY 1)
SELECT run_id, task_type, CAST(count(*) AS BIGINT) AS test_rows, any_value(accuracy) AS accuracy, any_value(macro_f1) AS macro_f1,
  any_value(rmse) AS rmse, any_value(mae) AS mae, any_value(r2) AS r2
FROM runs LEFT JOIN acc USING (run_id) LEFT JOIN f1 USING (run_id) LEFT JOIN reg USING (run_id) GROUP BY 1, 2"""


def _report(spark, sf):
    return M.report_rows(spark.sql(_RUNS, orders=load_table(spark, sf, "orders"), lineitem=load_table(spark, sf, "lineitem")))


@query("model_report", "M19 (many runs)", _report_sql())
def q_report(spark, sf):
    return _report(spark, sf)


@query("model_fit_report", "M1-M9, M19 (a fitted classifier)")
def q_fit_report(spark, sf):
    return ML.model_report(_classifier(spark, sf))


@query("fitted_importance", "M15, M18 (a fitted regression)")
def q_fit_importance(spark, sf):
    return _regressor(spark, sf).importance


@query("analysis_facts", "M20", with_dirty(f"""SELECT run_id, (SELECT CAST(count(*) AS BIGINT) FROM dirty_orders) AS n_rows, 6 AS n_cols, 2 AS numeric_columns,
  4 AS categorical_columns, CAST((SELECT count(*) FROM ({LOG_SQL})) AS BIGINT) AS cleaning_actions, {PACK_SIZE} AS results,
  (SELECT count(*) FROM dirty_orders) < 100 AS small_sample, task_type, accuracy, macro_f1, rmse, r2,
  CAST(floor(accuracy * 10) AS INTEGER) AS accuracy_out_of_ten, CAST(floor(r2 * 100) AS INTEGER) AS r2_percent FROM ({_report_sql()})"""))
def q_facts(spark, sf):
    from ..operators.clean import safe_clean
    from ..operators.profile import profile_columns_df
    dirty = dirty_orders(spark, sf)
    prof = profile_columns_df(dirty, "dirty_orders", with_rows=True)
    return M.analysis_facts(prof, safe_clean(dirty).log, _report(spark, sf), PACK_SIZE)
