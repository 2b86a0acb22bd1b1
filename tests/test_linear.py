"""Ridge, its cross-validation, group choices, medians and modes against brute force; template values that hold places."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions.exprs import param_filters
from tidemill.operators import experiments as EX
from tidemill.operators import linear, ml
from tidemill.operators import metrics as M


def test_ridge_and_cross_validation(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 3)) * [1, 5, 0.1] + [1e6, -3, 0]
    y = x @ [2.0, -1.0, 30.0] + r.standard_normal(600)
    fold = np.arange(600) % 4
    df = spark.createDataFrame([(*map(float, a), float(b), int(f)) for a, b, f in zip(x, y, fold)], "a double, b double, c double, y double, f int").repartition(5)
    df = df.union(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1), (1.0, 1.0, 1.0, None, 2)], df.schema))

    def closed(x, y, alpha):
        m = x.mean(0)
        w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(3), (x - m).T @ (y - y.mean()))
        return w, y.mean() - m @ w

    line = linear.ridge(df, ["a", "b", "c"], "y", 2.5)
    w, c = closed(x, y, 2.5)
    assert np.allclose(line.weights, w) and math.isclose(line.intercept, c, rel_tol=1e-6)
    got = {(g.alpha, g.fold): g for g in linear.cross_validate(df, ["a", "b", "c"], "y", "f", [0.1, 50.0]).collect()}
    assert len(got) == 8
    for (alpha, f), g in got.items():
        w, c = closed(x[fold != f], y[fold != f], alpha)
        e = y[fold == f] - x[fold == f] @ w - c
        assert g.n == 150 and math.isclose(g.rmse, math.sqrt((e**2).mean()), rel_tol=1e-6)
        assert math.isclose(g.r2, 1 - (e**2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum(), rel_tol=1e-6)
    # The trained pipeline's alpha means the same.
    model = ml.train(df.na.drop(), {"model": "ridge", "features": ["b", "c"], "target": "y", "params": {"alpha": 40.0}}).stages[-1]
    own = linear.ridge(df.na.drop(), ["b", "c"], "y", 40.0)
    assert np.allclose(model.coefficients.toArray(), own.weights, rtol=1e-5) and math.isclose(model.intercept, own.intercept, rel_tol=1e-5)
    with pytest.raises(ValueError):
        linear.ridge(df.limit(0), ["a"], "y", 1.0)


@pytest.fixture(scope="module")
def choices(spark):
    """Groups whose winner depends on differences inside the group, while a level of the group's own hides them."""
    r = np.random.default_rng(2)
    rows = []
    for g in range(800):
        n, level = int(r.integers(2, 9)), float(r.normal(0, 30))
        x = np.stack((level + r.standard_normal(n), r.standard_normal(n), np.full(n, level)), 1)
        s = 1.5 * x[:, 0] - 0.7 * x[:, 1]
        won = int(r.choice(n, p=np.exp(s - s.max()) / np.exp(s - s.max()).sum()))
        rows += [(g, i, *map(float, x[i]), int(i == won)) for i in range(n)]
    rows += [(9000, 0, 1.0, 2.0, 3.0, 0), (9000, 1, 1.0, 2.0, 3.0, 0), (9001, 0, 1.0, 0.0, 0.0, 1), (9001, 1, 5.0, 0.0, 0.0, 1)]  # no winner, two winners
    return spark.createDataFrame(rows, "g bigint, i int, a double, b double, level double, won int").cache(), rows


def test_gradient_and_hessian_of_group_choices(spark, choices):
    df, rows = choices
    own, groups, scale = linear.choice_rows(df, "g", "won", ["a", "b"])
    assert groups == 800
    by = {}
    for g, _, a, b, _, y in rows:
        if g < 9000:
            by.setdefault(g, []).append((a / scale[0], b / scale[1], y))

    def value(w):
        out = 0.0
        for x in by.values():
            s = np.array([w[0] * a + w[1] * b for a, b, _ in x])
            out += sum(v for v, (_, _, y) in zip(s, x) if y) - (s.max() + math.log(np.exp(s - s.max()).sum()))
        return out

    w, e = np.array([3.0, -0.4]), 1e-4
    ll, grad, hess = linear.choice_sums(own, 2, w)
    assert math.isclose(ll, value(w), rel_tol=1e-9)
    for i, d in enumerate(np.eye(2) * e):
        assert math.isclose(grad[i], (value(w + d) - value(w - d)) / (2 * e), rel_tol=1e-4, abs_tol=1e-3)
        for j, d2 in enumerate(np.eye(2) * e):
            second = (value(w + d + d2) - value(w + d - d2) - value(w - d + d2) + value(w - d - d2)) / (4 * e * e)
            assert math.isclose(hess[i, j], second, rel_tol=2e-2, abs_tol=0.5)


def test_group_choice_beats_regression_and_softmax(spark, choices):
    df, _ = choices
    m = linear.group_choice(df, "g", "won", ["a", "b", "level"])
    assert abs(m.weights[0] - 1.5) < 0.25 and abs(m.weights[1] + 0.7) < 0.2 and m.weights[2] == pytest.approx(0, abs=1e-6)
    shares = m.scored(df, "g", ["g", "i", "won"])
    assert shares.groupBy("g").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    own = linear.group_log_loss(shares, "g", "won")
    assert own == pytest.approx(m.log_loss, rel=1e-6)
    config = {"model": "ridge", "features": ["a", "b", "level"], "target": "won", "params": {"alpha": 0.1}}
    plain = EX.group_scores(ml.train(df, config), df, config, "g", ["i", "won"])
    assert own < 0.8 * linear.group_log_loss(plain, "g", "won")


def test_medians_and_modes_of_many_columns(spark, monkeypatch):
    r = np.random.default_rng(3)
    n = 5001
    data = {"a": r.standard_normal(n).tolist(), "b": r.integers(0, 3, n).astype(float).tolist(), "c": [7.0] * n, "d": (r.standard_cauchy(n) * 1e6).tolist(), "e": [None] * n, "g": [float(i) if i % 2 else None for i in range(n)], "h": [math.nan, 1.0, 4.0] * (n // 3)}
    df = spark.createDataFrame(list(zip(*data.values(), [["x", "y", None][i % 3] if i else "y" for i in range(n)], [i % 2 == 0 for i in range(n)])), ", ".join(f"{c} double" for c in data) + ", s string, t boolean").repartition(3)
    want = {c: statistics.median(x for x in v if x is not None and not math.isnan(x)) if any(x is not None for x in v) else None for c, v in data.items()}
    for bars, few in ((1024, 2048), (4, 3)):
        monkeypatch.setattr(M, "BARS", bars)
        monkeypatch.setattr(M, "FEW_VALUES", few)
        assert M.medians(df, list(data)) == pytest.approx(want)
    assert M.medians(df.limit(0), ["a"]) == {"a": None} and M.medians(spark.createDataFrame([(1.0,), (2.0,)], "a double"), ["a"]) == {"a": 1.5}
    assert M.modes(df, ["s", "t"]) == {"s": "x", "t": True} or M.modes(df, ["s", "t"]) == {"s": "y", "t": True}
    assert M.impute_stats(df, ["s", "b"])["b"] == want["b"]


def test_values_that_hold_places_stay_values(spark):
    df = spark.createDataFrame([("{b}", "p"), ("q", "r")], "x string, y string")
    value, used = param_filters([], {"a": "{b}", "b": " or true or x="}, where="x = {a} and y = {b}")
    assert df.where(value).count() == 0 and set(used) == {"a", "b"}
    value, _ = param_filters([], {"a": "{b}", "b": "p", "ab": "no"}, where="x = {a} and y = {b}")
    assert df.where(value).collect()[0].y == "p" and df.where(value).count() == 1


def test_time_splits_cut_at_whole_shares(spark):
    """90 * (1 - 0.3) is 63, though doubles make it 62.99..."""
    df = spark.range(90).selectExpr("id as g", "timestamp_seconds(id) as t")
    for out in (M.split_group_time(df, "g", "t", 0.3), M.split_time(df, "t", test_size=0.3, tiebreak=["g"])):
        assert out.where("not is_test").count() == 63


def test_tasks_of_a_fit_stay_small(spark, monkeypatch):
    """A fit's rows are dealt to more tasks where there are more of them; the model is the same."""
    rows, seen, fit = spark.range(3000).selectExpr("cast(id % 10 as double) as x", "cast(id % 10 * 2 as double) as y").coalesce(1), [], ml.R.GBTRegressor.fit
    monkeypatch.setattr(ml.R.GBTRegressor, "fit", lambda self, df: (seen.extend(df.rdd.glom().map(len).collect()), fit(self, df))[1])
    model = ml.train(rows, {"model": "gradient_boosting_regressor", "features": ["x"], "target": "y", "params": {"n_estimators": 2}}, rows_a_task=300)
    assert max(seen) <= 330 and sum(seen) == 3000
    out = ml.predictions(model, rows, {"features": ["x"], "target": "y"}, [])
    assert out.where("abs(y_actual - y_pred) > 1").count() == 0


def test_groups_and_their_loss_in_one_pass(spark, choices):
    df, rows = choices
    m = linear.group_choice(df, "g", "won", ["a", "b"])
    assert linear.group_losses(m.scored(df, "g", ["g", "won"]), "g", "won") == (800, pytest.approx(m.log_loss, rel=1e-6))
