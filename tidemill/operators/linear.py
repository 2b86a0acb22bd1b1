"""Linear models from sums over rows: ridge and its cross-validation from one pass, and choice models inside groups.

What goes to the driver are sums whose number depends on the features only: a matrix of products for each fold, a
gradient and a Hessian for each step.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.scratch import stored


def product_sums(df: DataFrame, features: list[str], target: str, by: str | None = None) -> tuple[dict[object, np.ndarray], np.ndarray]:
    """By value of `by`, the sums of all products of two of (1, features, target) as a matrix, in one aggregation; and the point that the columns are measured from.

    Rows without a target or with a missing feature don't count. Columns are measured from a row's values, so that
    large offsets don't eat up the digits.
    """
    columns = [F.col(c).cast("double") for c in (*features, target)]
    rows = df.select(*([F.col(by).alias("__by")] if by else [F.lit(0).alias("__by")]), *[c.alias(f"__{i}") for i, c in enumerate(columns)]).na.drop(subset=[f"__{i}" for i in range(len(columns))])
    first = rows.first()
    if first is None:
        return {}, np.zeros(len(columns))
    origin = np.array([first[f"__{i}"] for i in range(len(columns))])
    v = [F.lit(1.0), *[F.col(f"__{i}") - F.lit(float(o)) for i, o in enumerate(origin)]]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    found = rows.groupBy("__by").agg(*[F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i, j in pairs])
    out = {}
    for r in found.collect():  # a row for each fold
        m = np.empty((len(v), len(v)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r["__by"]] = m
    return out, origin


@dataclass(frozen=True)
class Line:
    """An intercept and weights."""

    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]

    def predicted(self) -> Column:
        out = F.lit(self.intercept)
        for f, w in zip(self.features, self.weights, strict=True):
            out += F.col(f).cast("double") * F.lit(w)
        return out


def ridge_of(sums: np.ndarray, origin: np.ndarray, features: Iterable[str], alpha: float) -> Line:
    """The line that minimises the squared errors plus alpha times the squared weights; the intercept is free."""
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    centred = sums[1:, 1:] - n * np.outer(mean, mean)
    w = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(len(mean) - 1), centred[:-1, -1])
    at = mean + origin
    return Line(tuple(features), float(at[-1] - at[:-1] @ w), tuple(map(float, w)))


def errors_of(line: Line, sums: np.ndarray, origin: np.ndarray) -> dict[str, float]:
    """n, rmse and R squared of a line over the rows of some sums."""
    w = np.array(line.weights)
    c = np.concatenate(([origin[-1] - line.intercept - origin[:-1] @ w], -w, [1.0]))
    n, sse = sums[0, 0], max(float(c @ sums @ c), 0.0)
    spread = sums[-1, -1] - sums[0, -1] ** 2 / n
    return {"n": int(n), "rmse": float(np.sqrt(sse / n)), "r2": float(1 - sse / spread) if spread > 0 else float("nan")}


def ridge(df: DataFrame, features: list[str], target: str, alpha: float) -> Line:
    sums, origin = product_sums(df, features, target)
    if not sums:
        raise ValueError("no row has a target and all features")
    return ridge_of(sums[0], origin, features, alpha)


def cross_validate(df: DataFrame, features: list[str], target: str, fold: str, alphas: Iterable[float]) -> DataFrame:
    """alpha, fold, n (rows tested), rmse, r2, intercept and weights of each alpha and fold, from one pass over df: a fold's fit is that of all sums but its own."""
    sums, origin = product_sums(df, features, target, fold)
    whole = sum(sums.values())
    rows = []
    for alpha in alphas:
        for f, own in sorted(sums.items(), key=lambda p: str(p[0])):
            line = ridge_of(whole - own, origin, features, alpha)
            e = errors_of(line, own, origin)
            rows.append((float(alpha), f, e["n"], e["rmse"], e["r2"], line.intercept, list(line.weights)))
    kind = dict(df.dtypes)[fold]
    return df.sparkSession.createDataFrame(rows, f"alpha double, fold {kind}, n bigint, rmse double, r2 double, intercept double, weights array<double>")


@dataclass(frozen=True)
class GroupChoice:
    """Weights of features that say which row of a group wins; scores compare rows of a group only, so there is no intercept."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    log_loss: float
    groups: int

    def scored(self, df: DataFrame, group: str, keep: list[str]) -> DataFrame:
        """keep, score and share, the scores' softmax inside each group; missing features count as 0, as at the fit."""
        s = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(w) for f, w in zip(self.features, self.weights, strict=True)), F.lit(0.0))
        rows = df.select(F.col(group).alias("__g"), *keep, s.alias("score"))
        sums = rows.groupBy(F.col("__g").alias("__h")).agg(F.max("score").alias("__top"))
        met = rows.join(sums, F.col("__g").eqNullSafe(F.col("__h"))).withColumn("__e", F.exp(F.col("score") - F.col("__top")))
        total = met.groupBy(F.col("__g").alias("__i")).agg(F.sum("__e").alias("__sum"))
        return met.join(total, F.col("__g").eqNullSafe(F.col("__i"))).select(*keep, "score", (F.col("__e") / F.col("__sum")).alias("share"))


def choice_sums(rows: DataFrame, p: int, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian of a choice model over rows (g, top, y, x0 ... of groups with one winner).

    A group's sums are a partial aggregation, and so are those of all groups, so no task holds a group.
    """
    s = sum((F.col(f"x{i}") * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))
    reach = F.lit(float(np.abs(weights).sum()))  # |x| <= top, so no exponent is above 0, nor below -2 * top * reach
    e = F.exp(s - F.col("top") * reach)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    one = rows.groupBy("g", "top").agg(
        F.sum(e).alias("z"), *[F.sum(e * F.col(f"x{i}")).alias(f"m{i}") for i in range(p)], *[F.sum(e * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs],
    )
    # What the winners add needs no groups, so it isn't shuffled with them.
    won = rows.where("y = 1").agg(F.sum(s), *[F.sum(f"x{i}") for i in range(p)]).first()
    mean = lambda i: F.col(f"m{i}") / F.col("z")
    r = one.agg(
        F.sum(-F.log("z") - F.col("top") * reach).alias("ll"), *[F.sum(-mean(i)).alias(f"g{i}") for i in range(p)],
        *[F.sum(F.col(f"q{i}_{j}") / F.col("z") - mean(i) * mean(j)).alias(f"h{i}_{j}") for i, j in pairs],
    ).first()
    h = np.empty((p, p))
    for i, j in pairs:
        h[i, j] = h[j, i] = -r[f"h{i}_{j}"]
    return won[0] + r["ll"], np.array([won[i + 1] + r[f"g{i}"] for i in range(p)]), h


def choice_rows(df: DataFrame, group: str, label: str, features: list[str]) -> tuple[DataFrame, int, np.ndarray]:
    """Rows (g, top, y, x0 ...) of the groups with exactly one winner, features in deviations; the number of groups, and the deviations.

    top: the largest of the group's features, by absolute value; missing features count as 0.
    """
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    scale = df.agg(*[F.stddev_pop(c) for c in x]).first()
    scale = np.array([v if v else 1.0 for v in scale])
    rows = df.select(F.col(group).alias("g"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), *[(c / F.lit(float(d))).alias(f"x{i}") for i, (c, d) in enumerate(zip(x, scale, strict=True))])
    top = F.max(F.greatest(*[F.abs(F.col(f"x{i}")) for i in range(len(x))], F.lit(0.0)))
    good = rows.groupBy(F.col("g").alias("h")).agg(F.sum("y").alias("won"), top.alias("top")).where("won = 1").select("h", "top")
    rows = stored(rows.join(good, F.col("g").eqNullSafe(F.col("h"))).drop("h"), "choice-rows")
    return rows, rows.where("y = 1").count(), scale


def group_choice(df: DataFrame, group: str, label: str, features: list[str], ridge: float = 0.0, steps: int = 30, tolerance: float = 1e-10) -> GroupChoice:
    """The model under which a group's winner wins with its score's share of the group's softmax, fitted inside groups by Newton steps.

    Groups count that have exactly one row of label 1. A step that lowers the likelihood is halved. ridge penalises the
    weights of the features in deviations.
    """
    rows, groups, scale = choice_rows(df, group, label, features)
    if not groups:
        raise ValueError("no group has exactly one winner")
    p = len(features)
    w = np.zeros(p)
    value = lambda ll, w: ll - ridge / 2 * float(w @ w)
    ll, g, h = choice_sums(rows, p, w)
    for _ in range(steps):
        # A direction in which nothing differs inside groups has no curvature, and keeps weight 0.
        step = np.linalg.lstsq(h - ridge * np.eye(p), g - ridge * w, rcond=1e-12)[0]
        if float(np.abs(step).max()) < tolerance:
            break
        for _ in range(20):
            new = choice_sums(rows, p, w - step)
            if value(new[0], w - step) >= value(ll, w) - 1e-9 * abs(value(ll, w)):
                break
            step = step / 2
        w, (ll, g, h) = w - step, new
    return GroupChoice(tuple(features), tuple(map(float, w / scale)), -ll / groups, groups)


def group_losses(shares: DataFrame, group: str, label: str) -> tuple[int, float]:
    """The number of groups with exactly one winner, and the mean of -log(share) of these winners."""
    won = shares.groupBy(group).agg(F.sum(F.col(label).cast("double")).alias("n"), F.sum(F.when(F.col(label) == 1, -F.log("share"))).alias("loss")).where("n = 1")
    return tuple(won.agg(F.count(F.lit(1)), F.avg("loss")).first())


def group_log_loss(shares: DataFrame, group: str, label: str) -> float:
    """The mean of -log(share) of the winners of groups with exactly one."""
    return group_losses(shares, group, label)[1]


def ridge_penalty(df: DataFrame, config: Mapping) -> float:
    """The penalty that gives Spark's linear regression, without standardisation, the ridge of `alpha`: it divides errors by rows and by the target's deviation."""
    t = F.col(config["target"]).cast("double")
    n, deviation = df.agg(F.count(t), F.stddev_pop(t)).first()
    return float(config.get("params", {}).get("alpha", 1.0)) * (deviation or 0.0) / max(n, 1)
