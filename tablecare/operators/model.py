"""Baseline models (M1-M9, M15, M19) with pyspark.ml.

Preprocessing is plain Column arithmetic fitted on the training rows:
median imputation + population standardisation for numerics, most-frequent
imputation + one-hot for categoricals. Category and class indexes are tables
joined to the rows (a text column may have as many categories as rows), and
unseen categories map to all zeros. Regularisation is set so Spark's optimum equals an L2
logistic regression with C = 1 and a ridge with α = 1:

* logistic: ``regParam = 1 / Σw`` (Σw = rows, or the sum of class weights);
* ridge: ``regParam = α·σ_y / n`` with σ_y the population std of the
  label, because Spark's normal-equation solver scales the penalty by it
  (checked against the closed form to 1e-15).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_position, field_type, with_values
from ..functions.numeric import as_double, family_of, hash_bucket, is_floating
from ..functions.quantiles import quantiles
from ..functions.ranks import dense_ranks
from ..session import cut_lineage, stored
from .profile import Profile

MIN_ROWS = 10
#: An index of at most so many categories goes to every task.
BROADCAST_ROWS = 100_000


def hash_split(df: DataFrame, key_cols: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """M2: deterministic split; adds ``is_test`` from md5(seed-key)."""
    p, col = by_position(df)
    key = F.concat_ws("|", *[col(c).cast("string") for c in key_cols])
    return p.withColumn("is_test", hash_bucket(key, seed) < int(round(10000 * test_size))).toDF(*df.columns, "is_test")


def standardize(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """M3 scaler: (x − mean) / population std of the fitting rows; a zero std
    scales by 1."""
    p, col = by_position(df if fit_on is None else fit_on)
    row = p.agg(*[F.avg(as_double(col(c))).alias(f"m{i}") for i, c in enumerate(columns)],
                *[F.stddev_pop(as_double(col(c))).alias(f"s{i}") for i, c in enumerate(columns)]).first()

    def scaled(m: float | None, s: float | None):
        return lambda x: (as_double(x) - F.lit(m)) / F.lit(s or 1.0)
    return with_values(df, {c: scaled(row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)})


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """M6: balanced weights n/(k·n_c) when the largest class is more than
    twice the smallest, else 1. One row per class; the four totals come from
    one small aggregate and enter as literals."""
    p, col = by_position(train)
    counts = p.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"),
                     F.max("n_c").alias("mx"), F.min("n_c").alias("mn")).first()
    n, k, mx, mn = (tot["n"] or 0), tot["k"], (tot["mx"] or 0), (tot["mn"] or 1)
    w = (F.lit(float(n)) / (F.lit(float(k)) * F.col("n_c"))) if mx / mn > 2 else F.lit(1.0)
    return counts.select(F.col("label").cast("string").alias("label"), F.col("n_c").cast("bigint"),
                         w.alias("weight"))


@dataclass
class ModelResult:
    run_id: str
    task_type: str
    target: str
    model: object
    predictions: DataFrame          # (actual, predicted, is_test rows only)
    importance: DataFrame           # (run_id, feature, coefficient, signed_coefficient, rank)
    train_rows: int
    test_rows: int
    n_features: int


def resolve_task_type(df: DataFrame, target: str, requested: str | None = None) -> tuple[str, int, int]:
    """T7 for one target column (one aggregate)."""
    fam = family_of(field_type(df, target))
    p, col = by_position(df)
    row = p.agg(F.count(col(target)).alias("n"), F.count_distinct(col(target)).alias("u")).first()
    n, u = int(row["n"]), int(row["u"])
    if fam not in ("numeric", "boolean"):
        return "classification", u, n
    ratio = u / n if n else 0
    if u <= 10:
        return "classification", u, n
    if ratio > 0.5 or u > 20:
        return "regression", u, n
    return (requested if requested in ("classification", "regression") else "classification"), u, n


def category_index(train: DataFrame, columns: list[str]) -> DataFrame:
    """(c, value, idx): the distinct training values of every column in order,
    as a table. It is joined, never gathered on the driver, and no task sorts
    the values of a whole column."""
    p, col = by_position(train)
    long = p.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), col(c).cast("string").alias("value"))
                                       for i, c in enumerate(columns)]))).where(F.col("value").isNotNull()).distinct()
    return dense_ranks(long, "c", "value").withColumn("idx", F.col("idx").cast("double"))


def _to_all(table: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has few rows; else left to the planner."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def encode(df: DataFrame, index: DataFrame, columns: list[str], sizes: dict[int, int]) -> DataFrame:
    """Adds ``__idx_<column>``: the value's index; a value unseen in training
    gets the number of categories, which the encoder turns into all zeros.
    ``columns`` are names that need no quotes; an index of few values goes to
    every task."""
    for i, c in enumerate(columns):
        mine = index.where(F.col("c") == i).select(F.col("value").alias("__v"), F.col("idx").alias(f"__idx_{c}"))
        mine = _to_all(mine, sizes.get(i, 0))
        df = (df.join(mine, F.col(c).cast("string") == F.col("__v"), "left").drop("__v")
              .withColumn(f"__idx_{c}", F.coalesce(f"__idx_{c}", F.lit(float(sizes.get(i, 0))))))
    return df


def one_hot(columns: list[str]) -> OneHotEncoder:
    """``keep`` with ``dropLast``: unseen values are all zeros, every known one keeps its place."""
    return OneHotEncoder(inputCols=[f"__idx_{c}" for c in columns], outputCols=[f"__oh_{c}" for c in columns],
                         dropLast=True, handleInvalid="keep")


def index_sizes(index: DataFrame) -> dict[int, int]:
    """Number of categories per column (one number per column)."""
    return {r["c"]: int(r["n"]) for r in index.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}


def train_baseline(df: DataFrame, target: str, prof: Profile, key_cols: list[str], *,
                   test_size: float = 0.2, seed: int = 42, task_type: str | None = None,
                   run_id: str = "run", max_iter: int = 1000) -> ModelResult:
    """M1-M9 + M15: fit a baseline on the train split, score the test split.

    Rows without a target (NULL or NaN) are left out; numeric features without
    any training value, and categorical ones likewise, are dropped."""
    spark: SparkSession = df.sparkSession
    # columns are named by position from here on; only names in the result are the caller's
    names = {f"f{i}": n for i, n in reversed(list(enumerate(df.columns)))}
    at = {n: c for c, n in names.items()}
    own_target, target, df = target, at[target], by_position(df, "f")[0]
    key_cols = [at[c] for c in key_cols]
    has_target = F.col(target).isNotNull()
    if is_floating(df.schema[target].dataType):
        has_target = has_target & ~F.isnan(target)
    data = df.where(has_target)
    num = [at[c] for c in prof.numeric_cols if c in at and at[c] != target]
    cat = [at[c] for c in prof.categorical_cols if c in at and at[c] != target]
    if not num and not cat:
        raise ValueError("No valid feature columns found for modeling")
    task, _, n = resolve_task_type(data, target, task_type)
    if n < MIN_ROWS:
        raise ValueError(f"Insufficient data after dropping missing targets ({n} rows)")

    # joined, filtered and hashed once: every pass below reads the columns it needs from files
    split = hash_split(data, key_cols, test_size, seed)
    split = stored(split.select(*[F.col(c).cast("string").alias(c) if c in cat else F.col(c)
                                  for c in split.columns if c in (*num, *cat, target, "is_test")]), "model-split")
    train = split.where(~F.col("is_test"))
    # numeric: median (train) → standardise (train, after imputation)
    med = quantiles(train, num, [0.5]) if num else {}
    num = [c for c in num if med[c][0] is not None]
    imputed = split.select(*[F.coalesce(as_double(F.col(c)), F.lit(med[c][0])).alias(c) if c in num
                             else F.col(c) for c in split.columns])
    imputed = standardize(imputed, num, fit_on=imputed.where(~F.col("is_test"))) if num else imputed
    # categorical: mode (train) → one-hot through a joined index table
    from .recommend import column_modes
    modes = column_modes(train.select(*[F.col(c).cast("string").alias(c) for c in cat]), cat) if cat else {}
    cat = [c for c in cat if c in modes]
    if not num and not cat:
        raise ValueError("No feature column has a training value")
    prepared = imputed.select(*[F.coalesce(F.col(c).cast("string"), F.lit(modes[c])).alias(c) if c in cat
                                else F.col(c) for c in imputed.columns])
    index, sizes = None, {}
    if cat:
        index = cut_lineage(category_index(prepared.where(~F.col("is_test")), cat))
        sizes = index_sizes(index)
        prepared = encode(prepared, index, cat, sizes)
    classes = None
    if task == "classification":
        # classes seen in training, in order; a test label unseen there has no index and is never predicted
        prepared = prepared.withColumn("__y", F.col(target).cast("string"))
        classes = cut_lineage(category_index(prepared.where(~F.col("is_test")), ["__y"]).select("value", "idx"))
        n_classes = classes.count()
        prepared = prepared.join(_to_all(classes, n_classes).select(F.col("value").alias("__y"), F.col("idx").alias("__label")), "__y", "left")
    else:
        prepared = prepared.withColumn("__label", as_double(F.col(target)))
    stages = ([one_hot(cat)] if cat else []) + [
        VectorAssembler(inputCols=num + [f"__oh_{c}" for c in cat], outputCol="features")]
    pre = Pipeline(stages=stages).fit(prepared.where(~F.col("is_test")))
    assembled = pre.transform(prepared)
    tr = assembled.where(~F.col("is_test")).select("features", "__label", *(["__y"] if classes is not None else [])).persist()
    te = assembled.where(F.col("is_test"))
    try:
        if classes is not None:
            w = cut_lineage(class_weights(train, target))
            # one row per class: a shuffle by class would leave the fit as many tasks as there are classes
            trw = tr.join(_to_all(w, n_classes).select(F.col("label").alias("__y"), "weight"), "__y")
            got = trw.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
            train_rows = int(got["n"])
            est = LogisticRegression(featuresCol="features", labelCol="__label", weightCol="weight",
                                     regParam=1.0 / got["w"], elasticNetParam=0.0, standardization=False,
                                     maxIter=max_iter, tol=1e-9,
                                     family="multinomial" if n_classes > 2 else "binomial")
            model = est.fit(trw)
            mat = model.coefficientMatrix.toArray()
            coefs = [float(abs(mat[:, j]).mean()) for j in range(mat.shape[1])]
            signed = [float(v) for v in mat[0]] if mat.shape[0] == 1 else [None] * len(coefs)
            of = _to_all(classes, n_classes).select(F.col("idx").alias("prediction"), F.col("value").alias("predicted"))
            pred = model.transform(te).select(F.col("__y").alias("actual"), "prediction").join(of, "prediction", "left").select(
                "actual", "predicted")
        else:
            got = tr.agg(F.stddev_pop("__label").alias("s"), F.count(F.lit(1)).alias("n")).first()
            train_rows = int(got["n"])
            est = LinearRegression(featuresCol="features", labelCol="__label", solver="normal",
                                   regParam=(got["s"] or 1.0) / train_rows, elasticNetParam=0.0, standardization=False)
            model = est.fit(tr)
            coefs = [float(v) for v in model.coefficients.toArray()]
            signed = coefs
            pred = model.transform(te).select(F.col("__label").alias("actual"), F.col("prediction").alias("predicted"))
    finally:
        tr.unpersist()
    pred = cut_lineage(pred)      # scored once, however many metrics read it
    test_rows = pred.count()
    imp = _importance(spark, run_id, coefs, signed, [names[c] for c in num], [names[c] for c in cat], index, sizes)
    return ModelResult(run_id, task, own_target, model, pred, imp, train_rows, test_rows, len(coefs))


def _importance(spark, run_id, coefs, signed, num, cat, index, sizes, top: int = 20) -> DataFrame:
    """The ``top`` features by |coefficient|. Only their names are looked up in the index table."""
    at = []   # first place of every categorical column's block
    offset = len(num)
    for i in range(len(cat)):
        at.append(offset)
        offset += sizes[i]
    # all places within the smallest of the top values, so that ties go by name
    order = sorted(range(len(coefs)), key=lambda j: -abs(coefs[j]))
    least = abs(coefs[order[min(top, len(order)) - 1]])
    named: dict[int, str] = {}
    wanted = []
    for j in (j for j in order if abs(coefs[j]) >= least):
        if j < len(num):
            named[j] = f"num__{num[j]}"
        else:
            i = max(k for k, first in enumerate(at) if first <= j)
            wanted.append((j, i, float(j - at[i])))
    if wanted:
        rows = spark.createDataFrame(wanted, "j int, c int, idx double").join(index, ["c", "idx"]).select("j", "c", "value").collect()
        named |= {r["j"]: f"cat__{cat[r['c']]}_{r['value']}" for r in rows}
    best = sorted(named, key=lambda j: (-abs(coefs[j]), named[j]))[:top]
    return spark.createDataFrame([(run_id, named[j], coefs[j], signed[j], k + 1) for k, j in enumerate(best)],
                                 "run_id string, feature string, coefficient double, signed_coefficient double, rank int")


def ridge_fit(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> tuple[list[float], float]:
    """Ridge (unpenalised intercept) on raw numeric features; returns
    (coefficients, intercept)."""
    p, col = by_position(df)
    data = p.select(*[as_double(col(c)).alias(f"x{i}") for i, c in enumerate(features)], as_double(col(label)).alias("__y")).dropna()
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(data)
    row = data.agg(F.stddev_pop("__y").alias("s"), F.count(F.lit(1)).alias("n")).first()
    est = LinearRegression(featuresCol="features", labelCol="__y", solver="normal", elasticNetParam=0.0,
                           regParam=alpha * (row["s"] or 1.0) / row["n"], standardization=False)
    m = est.fit(data)
    return [float(x) for x in m.coefficients.toArray()], float(m.intercept)


REPORT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("task_type", T.StringType()), T.StructField("model_type", T.StringType()),
    T.StructField("train_rows", T.LongType()), T.StructField("test_rows", T.LongType()),
    T.StructField("n_features_encoded", T.IntegerType()),
])


def model_report(res: ModelResult) -> DataFrame:
    """One row per run with its metrics (the metrics are one-row
    aggregates; their values are collected and the row is built from them)."""
    from .metrics import accuracy, macro_f1, regression_metrics
    spark = res.predictions.sparkSession
    if res.task_type == "classification":
        acc = accuracy(res.predictions).first()[0]
        f1 = macro_f1(res.predictions).first()[0]
        rmse = mae = r2 = None
    else:
        m = regression_metrics(res.predictions).first()
        acc = f1 = None
        rmse, mae, r2 = m["rmse"], m["mae"], m["r2"]
    row = (res.run_id, res.target, res.task_type,
           "LogisticRegression" if res.task_type == "classification" else "Ridge",
           res.train_rows, res.test_rows, res.n_features, acc, f1, rmse, mae, r2)
    schema = T.StructType(REPORT_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in
                                                  ("accuracy", "macro_f1", "rmse", "mae", "r2")])
    return spark.createDataFrame([row], schema)
