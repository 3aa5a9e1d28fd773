"""Name reconciliation, target candidates and baseline models."""

import numpy as np
from pyspark.sql import functions as F

from tablecare.operators import metrics as M
from tablecare.operators import model as ML
from tablecare.operators import targets as TG
from tablecare.operators.names import reconcile_names
from tablecare.operators.profile import profile, profile_columns_df


# requested, matched, step — worked by hand over KNOWN (in this order of names)
KNOWN = ["amount", "customer_name", "net_total_price", "order date", "ship_mode_code", "unit-price", "zzyyxxwwvv"]
BY_HAND = [
    ("amount", "amount", 2), ("order date", "order date", 2), ("Customer Name", "customer_name", 3), ("customerName", "customer_name", 3),
    ("AMOUNT", "amount", 3), ("ORDER-DATE", "order date", 6), ("UnitPrice", "unit-price", 6), ("ship mode code!!", "ship_mode_code", 3),
    ("total amount", "amount", 7), ("name", "customer_name", 7), ("dat", "dat", 10), ("net_price_total_x", "net_total_price", 8),
    ("mode ship", "ship_mode_code", 8), ("vvwwxxyyzz", "zzyyxxwwvv", 9), ("something else", "something else", 10),
]


def test_reconcile_worked_by_hand(spark):
    req = spark.createDataFrame([(r,) for r, _, _ in BY_HAND] + [(None,)], "requested string")
    known = spark.createDataFrame([(k,) for k in KNOWN], "name string")
    got = {r["requested"]: (r["matched"], r["tier"]) for r in reconcile_names(req, known).collect()}
    assert got == {r: (m, t) for r, m, t in BY_HAND}


def test_fuzzy_steps_over_many_names(spark):
    """20,000 known names: the candidates that are compared stay near the matches found."""
    import random

    from tablecare.operators import names as N
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    vocabulary = [word() for _ in range(3000)]
    known = sorted({"_".join(rng.sample(vocabulary, rng.randint(2, 4))) for _ in range(20_500)})
    req = [" ".join(rng.sample(k.split("_"), len(k.split("_")))) for k in rng.sample(known, 150)]
    rf = spark.createDataFrame([(r,) for r in set(req)], "requested string")
    kf = spark.createDataFrame([(k, k) for k in known], "name string, kord string")
    assert len(known) >= 20_000
    got = {r["requested"]: r for r in N.word_overlap_candidates(rf, kf).collect()}
    sets = [(k, frozenset(k.split("_"))) for k in known]
    for r in set(req):
        w = frozenset(r.split(" "))
        score, name = min((-len(w & s) / max(len(w), len(s)), k) for k, s in sets)
        assert (got[r]["matched"], got[r]["score"]) == (name, -score)
    r = rf.select(F.array_sort(N.words(F.col("requested"))).alias("rid"))
    k = kf.select(F.array_sort(N.words(F.col("name"))).alias("kid"))
    least = lambda a, b: F.floor(F.greatest(a, b) * F.lit(0.5)) + 1
    pairs = N._set_pairs(r.withColumn("toks", F.col("rid")).distinct(), k.withColumn("toks", F.col("kid")).distinct(), least, 0.5).count()
    assert pairs <= 40 * len(set(req))


def test_letter_sets_meet_in_the_trie(spark):
    """20,000 distinct letter sets: exactly the similar pairs, and few others looked at."""
    import random

    from tablecare.operators import names as N
    rng = random.Random(8)
    weights = [1 / (i + 1) ** 0.7 for i in range(36)]

    def mask():
        out = 0
        for i in rng.choices(range(36), weights, k=rng.randint(8, 22)):
            out |= 1 << i
        return out
    known = np.array(sorted({mask() for _ in range(30_000)})[:20_000], np.uint64)
    asked = np.array(sorted({mask() for _ in range(60)} | {int(known[17])}), np.uint64)
    both = np.bitwise_count(asked[:, None] & known).astype(int) * 10 > 7 * np.bitwise_count(asked[:, None] | known).astype(int)
    want = {(int(asked[i]), int(known[j])) for i, j in zip(*np.nonzero(both), strict=True)}
    assert len(known) == 20_000 and len(want) > 100
    a, k = (spark.createDataFrame([(int(x),) for x in m], "mask long") for m in (asked, known))
    got = N._mask_pairs(a, k).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert N._mask_pairs(a, k.limit(0)).collect() == [] and N._mask_pairs(a.limit(0), k).collect() == []
    trie = N.LetterTrie(asked)
    assert sum(len(x) for x, _ in trie.similar(N.LetterTrie(known))) == len(want) and trie.compared <= 3 * len(want)


def test_reconcile_mapping_tiers(spark):
    mapping = spark.createDataFrame([("Customer Name", "customer_name", 0)], "original string, cleaned string, pos int")
    known = spark.createDataFrame([("customer_name",)], "name string")
    req = spark.createDataFrame([("Customer Name",), ("customer name ",), ("Unknown Col",)], "requested string")
    got = {r["requested"]: (r["matched"], r["tier"]) for r in reconcile_names(req, known, mapping).collect()}
    assert got["Customer Name"] == ("customer_name", 1)
    assert got["Unknown Col"] == ("unknown_col", 10)


def test_target_candidates_and_task_type(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7), "x" if i % 2 else "y", "k") for i in range(40)],
                               "row_id long, grade int, score double, label string, konst string")
    prof = profile_columns_df(df, "t", with_rows=True)
    cands = {r["column"]: r for r in TG.candidate_list(prof).collect()}
    assert "row_id" not in cands and "konst" not in cands
    assert cands["score"]["is_leakage_risk"] and cands["label"]["is_leakage_risk"]
    tt = {r["column"]: r["task_type"] for r in TG.task_type(prof).collect()}
    assert tt["grade"] == "classification" and tt["label"] == "classification"
    sup = TG.supplement(TG.validate_suggestions(
        spark.createDataFrame([("t", "grade", 0.9, "s", 1)], "table_name string, column string, confidence double, "
                              "reason string, rank int"), prof), prof).orderBy("rank").collect()
    assert [r["column"] for r in sup] == ["grade", "score", "label"]
    assert sup[1]["reason"] == "Numeric column (range: 0 to 6)"


def test_metrics_macro_f1_and_regression(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, predicted string")
    f1 = M.macro_f1(df).first()[0]
    # per label: a: 2/3, b: 2*1/(2+2)=0.5, c: 0 → mean 0.3889
    assert f1 == 0.3889
    assert M.accuracy(df).first()[0] == 0.5
    r = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "actual double, predicted double")
    m = M.regression_metrics(r).first()
    assert m["mae"] == 0.3333 and m["r2"] == 0.75


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [1.5, -2.0] + 0.7 + rng.normal(size=80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    coef, icpt = ML.ridge_fit(df, ["a", "b"], "y", alpha=1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert np.allclose(coef, w, atol=1e-9)
    assert abs(icpt - (y.mean() - x.mean(0) @ w)) < 1e-9


def test_train_classifier_end_to_end(spark):
    rows = [(i, "hi" if (i % 10) > 4 else "lo", float(i % 10), "g" + str(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y string, x double, g string")
    prof = profile(df.drop("id"))
    res = ML.train_baseline(df, "y", prof, ["id"], run_id="t")
    assert res.task_type == "classification"
    assert res.train_rows + res.test_rows == 300
    acc = M.accuracy(res.predictions).first()[0]
    assert acc > 0.9
    names = [r["feature"] for r in res.importance.orderBy("rank").collect()]
    assert names[0] == "num__x" and "cat__g_g0" in names
    rep = ML.model_report(res).first()
    assert rep["model_type"] == "LogisticRegression" and rep["n_features_encoded"] == 4
    assert M.key_drivers(res.importance).count() <= 5
    assert res.predictions.where(F.col("predicted").isNull()).count() == 0


def test_training_drops_what_cannot_be_used(spark):
    rows = [(i, float(i % 7) + i / 100, None, float("nan") if i % 9 == 0 else i * 2.0, None, f"c{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, empty double, y double, blank string, wide string")
    prof = profile(df.drop("id"))
    res = ML.train_baseline(df, "y", prof, ["id"], task_type="regression", run_id="t")
    assert res.task_type == "regression" and res.train_rows + res.test_rows == sum(i % 9 != 0 for i in range(120))
    assert res.predictions.where("predicted is null or isnan(predicted)").count() == 0
    assert res.n_features == 1 + res.train_rows   # every training value of the wide column is a category
    assert res.importance.count() == 20


def _newton(x, y, w, k, steps=60):
    """Softmax (or logistic) regression with an L2 penalty of 1/2 |b|^2, intercepts free."""
    import numpy as np
    n, d = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    m = 1 if k == 2 else k
    b = np.zeros((m, d + 1))
    pen = np.ones(d + 1)
    pen[-1] = 0
    for _ in range(steps):
        s = z @ b.T
        if k == 2:
            p = 1 / (1 + np.exp(-s))
            g = ((p - (y[:, None] == 1)) * w[:, None]).T @ z + b * pen
            h = (z * (w[:, None] * p * (1 - p))).T @ z + np.diag(pen)
            b = b - np.linalg.solve(h + 1e-12 * np.eye(d + 1), g[0])[None]
        else:
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            t = np.eye(k)[y]
            g = ((p - t) * w[:, None]).T @ z + b * pen
            h = np.zeros((k * (d + 1),) * 2)
            for i in range(k):
                for j in range(k):
                    r = w * p[:, i] * ((i == j) - p[:, j])
                    h[i * (d + 1):(i + 1) * (d + 1), j * (d + 1):(j + 1) * (d + 1)] = (z * r[:, None]).T @ z + np.diag(pen) * (i == j)
            b = b - np.linalg.lstsq(h, g.ravel(), rcond=None)[0].reshape(k, d + 1)
    return b


def test_logistic_optimum_matches_newton(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    for k, skew in ((2, False), (2, True), (3, False), (3, True)):
        n = 400
        x = rng.normal(size=(n, 2)) * [1.0, 3.0] + [0.0, 5.0]
        edges = {2: [0.0], 3: [-0.7, 0.7]}[k] if not skew else {2: [1.2], 3: [-1.8, 0.8]}[k]
        y = np.digitize(x[:, 0] + 0.3 * rng.normal(size=n), edges)
        df = spark.createDataFrame([(i, f"k{int(c)}", float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x))],
                                   "id long, y string, a double, b double")
        res = ML.train_baseline(df, "y", profile(df.drop("id"), light=True), ["id"], run_id="t")
        test = {r["id"] for r in ML.hash_split(df, ["id"]).where("is_test").collect()}
        tr = np.array([i not in test for i in range(n)])
        xs = (x[tr] - x[tr].mean(0)) / x[tr].std(0)
        counts = np.bincount(y[tr], minlength=k)
        w = len(xs) / (k * counts[y[tr]]) if counts.max() / counts.min() > 2 else np.ones(len(xs))
        b = _newton(xs, y[tr], w, k)
        mat = res.model.coefficientMatrix.toArray()
        assert np.allclose(mat, b[:, :2], atol=2e-3), (k, skew)
        got = {r["feature"]: r for r in res.importance.collect()}
        for j, c in enumerate("ab"):
            assert abs(got[f"num__{c}"]["coefficient"] - np.abs(b[:, j]).mean()) < 2e-3
            assert (got[f"num__{c}"]["signed_coefficient"] is None) == (k > 2)
