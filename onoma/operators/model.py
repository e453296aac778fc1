"""The learned combiner: logistic regression over pair features.

``fit_groups`` fits many small models side by side, one grouped task each, by the published descent.
``fit_newton`` minimises the same objective for many models at once where rows stay distributed;
``fit_at_scale`` does it for one with MLlib.
"""

from __future__ import annotations

import json
import math
import os
import warnings
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from onoma.functions.native import sigmoid
from onoma.operators.features import FEATURES

# The published fit's settings.
RATE, STEPS, RIDGE, FOLDS = 0.35, 1200, 0.02, 5
#: Rows that a single grouped fit takes (the published protocol, for evaluation sets); larger inputs belong to fit_newton.
MOST_GROUP_ROWS = 2_000_000
LOSS_EDGE = 1e-12
#: Newton rounds at most, and the step at which they end.
NEWTON_ROUNDS, NEWTON_EDGE = 30, 1e-10


@dataclass
class LogisticModel:
    """A fitted model: weights of standardised features, and what standardises them."""

    weights: list[float]
    bias: float
    means: list[float]
    stds: list[float]
    feature_names: list[str]
    learning_rate: float = RATE
    iterations: int = STEPS
    l2: float = RIDGE
    n_train: int = 0
    final_loss: float | None = None

    @classmethod
    def unfitted(cls) -> LogisticModel:
        return cls([], 0.0, [], [], [])

    def probability(self, columns: list[Column]) -> Column:
        """P(match) of a row as a native expression; 0.5, with a warning, for an unfitted model.

        A row with a feature that is null, NaN or infinite ends the query with an error.
        """
        if not self.weights:
            warnings.warn("the model is not fitted: every pair gets 0.5", RuntimeWarning, stacklevel=2)
            return F.lit(0.5)
        if len(columns) != len(self.weights):
            raise ValueError(f"{len(columns)} features for a model of {len(self.weights)}: a stale model or another feature order")
        finite = reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns))
        columns = [F.when(finite, c).otherwise(F.raise_error(F.lit("features must be finite")).cast("double")) if k == 0 else c for k, c in enumerate(columns)]
        terms = ((c - m) / s * w for c, m, s, w in zip(columns, self.means, self.stds, self.weights, strict=True))
        return sigmoid(reduce(lambda a, b: a + b, terms, F.lit(0.0)) + F.lit(self.bias))

    def coefficients(self) -> list[tuple[str, float]]:
        """(feature, weight), the largest first."""
        names = self.feature_names or [f"f{k}" for k in range(len(self.weights))]
        return sorted(zip(names, self.weights, strict=True), key=lambda x: -abs(x[1]))

    def save(self, path: str) -> str:
        """Strict JSON with sorted keys; an undefined loss becomes null."""
        if folder := os.path.dirname(path):
            os.makedirs(folder, exist_ok=True)
        body = asdict(self)
        if body["final_loss"] is not None and math.isnan(body["final_loss"]):
            body["final_loss"] = None
        with open(path, "w", encoding="utf-8", newline="\n") as f:
            f.write(json.dumps(body, indent=2, sort_keys=True, allow_nan=False) + "\n")
        return path

    @classmethod
    def load(cls, path: str, expected: list[str] | None = None) -> LogisticModel:
        """Read and check a model; ``expected`` is the feature order that it must have."""
        with open(path, encoding="utf-8") as f:
            body = json.load(f)

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(f"corrupt model {path}: {what}")

        need(isinstance(body, dict), "not an object")
        fields = list(cls.__dataclass_fields__)
        need(all(k in body for k in fields), "fields are missing")
        lists = ("weights", "means", "stds", "feature_names")
        need(all(isinstance(body[k], list) for k in lists), "weights, means, stds and feature_names must be lists")
        width = len(body["weights"])
        need(len(body["means"]) == width == len(body["stds"]) and len(body["feature_names"]) in (0, width), "lengths differ")
        need(all(isinstance(x, str) for x in body["feature_names"]), "feature names must be strings")
        numbers = [body["bias"], body["learning_rate"], body["l2"], *body["weights"], *body["means"], *body["stds"]]
        need(all(isinstance(x, int | float) and math.isfinite(x) for x in numbers), "numbers must be finite")
        need(all(x > 0 for x in body["stds"]), "standard deviations must be positive")
        if expected is not None and body["feature_names"] != list(expected):
            raise ValueError(f"model {path} was fitted on other features or another order; fit it again")
        return cls(**{k: body[k] for k in fields})


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns with mean 0 and population deviation 1; a constant column keeps deviation 1."""
    means, var = x.mean(0), x.var(0)
    stds = np.where(var <= 1e-12, 1.0, np.sqrt(var))
    return (x - means) / stds, means, stds


def fit_arrays(x: np.ndarray, y: np.ndarray, names: list[str] = (), rate: float = RATE, steps: int = STEPS, ridge: float = RIDGE) -> LogisticModel:
    """Full-batch gradient descent from zero on mean cross-entropy plus a ridge on the weights, not the bias."""
    x, y = np.asarray(x, float), np.asarray(y)
    if not x.size:
        raise ValueError("no rows to fit")
    if x.ndim != 2 or len(x) != len(y):
        raise ValueError("rows and labels differ in number, or rows in width")
    if not np.isfinite(x).all():
        raise ValueError("features must be finite")
    if not np.isin(y, (0, 1)).all():
        raise ValueError("labels must be 0 or 1")
    if len(names) and len(names) != x.shape[1]:
        raise ValueError("feature names and columns differ in number")
    z, means, stds = standardised(x)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        off = _logistic(z @ w + b) - y
        w, b = w - rate * (z.T @ off / len(y) + ridge * w), b - rate * off.mean()
    p = np.clip(_logistic(z @ w + b), LOSS_EDGE, 1 - LOSS_EDGE)
    loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    return LogisticModel(w.tolist(), float(b), means.tolist(), stds.tolist(), list(names), rate, steps, ridge, len(y), loss)


def _logistic(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def violations(df: DataFrame, features: list[str], label: str) -> dict[str, int]:
    """Counts of what a fit refuses, in one pass: no rows, non-finite features, labels other than 0 and 1."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in features])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("non_finite"),
        F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("bad_labels"),
    ).first().asDict()


MODELS = "weights array<double>, bias double, means array<double>, stds array<double>, names array<string>, n_train long, final_loss double"


def fit_groups(rows: DataFrame, keys: dict[str, str], features: list[str], label: str = "label") -> DataFrame:
    """(keys, model) with a model fitted for every group; keys: name -> type. A ``mask`` key leaves that feature out."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_GROUP_ROWS:
            raise ValueError("too many rows for one grouped fit; use fit_newton")
        at = dict(zip(keys, key, strict=True))
        own = [f for f in features if f != at.get("mask")]
        pdf = pdf.sort_values("ord") if "ord" in pdf else pdf
        m = fit_arrays(pdf[own].to_numpy(float), pdf[label].to_numpy(), own)
        return pd.DataFrame([[*key, m.weights, m.bias, m.means, m.stds, own, m.n_train, m.final_loss]])

    ddl = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", " + MODELS
    return rows.groupBy(*keys).applyInPandas(run, ddl)


def numbered(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add ``ord``, the row's place by ``order``, counted from 0; null orders first, ties in any order.

    The order column alone is range-partitioned to find where ``ranges`` ranges (the session's shuffle
    partitions) begin and how many rows each has: one row per range reaches the driver. A row's place
    is the rows before its range, and its number in its range.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(order).alias("k")).repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("r"))
    found = keys.agg(F.min("k").alias("low"), F.count("k").alias("n"), F.count_if(F.col("k").isNull()).alias("nulls")).orderBy("low").collect()
    lows = [(r["low"], r["n"]) for r in found if r["n"]]
    before = np.cumsum([0, sum(r["nulls"] for r in found), *(n for _, n in lows)]).tolist()
    kind = df.schema[order].dataType
    starts = F.array(*[F.lit(low).cast(kind) for low, _ in lows]) if lows else F.array().cast(f"array<{kind.simpleString()}>")
    placed = df.withColumn("__r", F.size(F.filter(starts, lambda low: low <= F.col(order))))
    inside = F.row_number().over(W.partitionBy("__r").orderBy(order))
    return placed.withColumn("ord", F.get(F.array(*map(F.lit, before)), F.col("__r")) + inside - 1).drop("__r")


def with_folds(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Add ``fold`` = ord mod folds."""
    n = df.count()
    if not 2 <= folds <= n:
        raise ValueError("cross-validation needs 2 <= folds <= rows")
    return df.withColumn("fold", F.pmod(F.col("ord"), F.lit(folds)).cast("int"))


def _training_rows(df: DataFrame, folds: int) -> DataFrame:
    """Every row once for each fold that trains on it."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold")).cast("array<int>")
    return df.withColumn("fold", F.explode(others))


def _predicted(features: list[Column]) -> Column:
    """Probability from the model columns of the same row."""
    x = F.array(*features)
    z = F.zip_with(x, F.arrays_zip(F.col("means"), F.col("stds"), F.col("weights")), lambda v, m: (v - m["means"]) / m["stds"] * m["weights"])
    return sigmoid(F.aggregate(z, F.lit(0.0), lambda s, v: s + v) + F.col("bias"))


def fold_models(df: DataFrame, features: list[str], folds: int = FOLDS) -> DataFrame:
    """One model per fold, trained on the other folds' rows. df: with_folds."""
    return fit_groups(_training_rows(df, folds), {"fold": "int"}, features)


def cross_validated(df: DataFrame, features: list[str], folds: int = FOLDS) -> DataFrame:
    """All columns of ``df`` (with_folds) plus ``learned``: each row's probability by a model that never saw it."""
    models = fold_models(df, features, folds)
    # one row per fold
    return df.join(F.broadcast(models), "fold").withColumn("learned", _predicted([F.col(f) for f in features])).select(*df.columns, "learned")


def log_loss(p: Column, label: Column) -> Column:
    """Mean cross-entropy as an aggregate; probabilities are kept off 0 and 1."""
    q = F.least(F.greatest(p, F.lit(LOSS_EDGE)), F.lit(1 - LOSS_EDGE))
    return F.avg(-(label * F.log(q) + (1 - label) * F.log(1 - q)))


def standardisation(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std): population deviation, 1 for a constant feature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("r")).select("r.*")
    agg = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    return agg.select("feature", "mean", F.when(F.col("var") <= 1e-12, 1.0).otherwise(F.sqrt("var")).alias("std"))


def fit(df: DataFrame, features: list[str], label: str = "label") -> LogisticModel:
    """Fit all rows of an evaluation-sized set as one group."""
    bad = violations(df, features, label)
    if not bad["rows"] or bad["non_finite"] or bad["bad_labels"]:
        raise ValueError(f"cannot fit: {bad}")
    r = fit_groups(df.withColumn("g", F.lit(0)), {"g": "int"}, features, label).first()
    return LogisticModel(r["weights"], r["bias"], r["means"], r["stds"], r["names"], n_train=r["n_train"], final_loss=r["final_loss"])


def _scaled(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 for a constant) of all rows, in one pass."""
    r = df.agg(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.var_pop(f).alias(f"v{k}") for k, f in enumerate(features)]).first()
    var = np.array([r[f"v{k}"] or 0.0 for k in range(len(features))])
    return np.array([r[f"m{k}"] or 0.0 for k in range(len(features))]), np.where(var <= 1e-12, 1.0, np.sqrt(var))


@dataclass
class Plan:
    """A model to fit: the fold whose rows it does not see (-1: none) and the feature it does without ('': none)."""

    fold: int = -1
    mask: str = ""


def fit_newton(
    df: DataFrame, features: list[str], plans: list[Plan] | None = None, *, ridge: float = RIDGE, rounds: int = NEWTON_ROUNDS
) -> list[LogisticModel]:
    """Models of rows that stay where they are: (features, label and, for plans that name one, ``fold``).

    The objective is fit_arrays' own. Every Newton round is one pass: a task adds up gradients and
    curvatures of all plans over its rows, sums meet in a shuffle of one row per plan and cell, and the
    driver solves one small system per plan. Works alike at any number of rows.
    """
    plans = plans or [Plan()]
    m0, s0 = _scaled(df, features)
    folded = any(p.fold >= 0 for p in plans)
    rows = df.select(*[F.col(f).cast("double") for f in features], F.col("label").cast("double"), *(["fold"] if folded else []))
    d = len(features)
    used = [np.array([f != p.mask for f in features]) for p in plans]

    def sums(cells):
        def run(batches):
            total = None
            for b in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                x = (np.stack(cols[:d], axis=1) - m0) / s0
                fold = cols[d + 1] if folded else np.full(len(x), -2)
                part = np.stack([cells(k, x[fold != p.fold], cols[d][fold != p.fold]) for k, p in enumerate(plans)])
                total = part if total is None else total + part
            if total is not None:
                at, cell = np.indices(total.shape)
                yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (at, cell, total)], ["plan", "cell", "v"])

        found = rows.mapInArrow(run, "plan long, cell long, v double").groupBy("plan", "cell").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((len(plans), 1 + max((r["cell"] for r in found), default=0)))
        for r in found:
            out[r["plan"], r["cell"]] = r["v"]
        return out

    # every plan is standardised by its own rows: first moments of the commonly scaled features
    moments = sums(lambda _, x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n = moments[:, 0]
    if (n == 0).any():
        raise ValueError("no rows to fit")
    mean = moments[:, 1 : d + 1] / n[:, None]
    var = moments[:, d + 1 :] / n[:, None] - mean**2
    std = np.where(var * s0**2 <= 1e-12, 1.0 / s0, np.sqrt(np.maximum(var, 1e-300)))
    w = np.zeros((len(plans), d + 1))
    upper = np.triu_indices(d + 1)

    def newton_cells(w):
        def cells(k, x, y):
            z = np.column_stack([(x - mean[k]) / std[k] * used[k], np.ones(len(x))])
            p = _logistic(z @ w[k])
            q = np.clip(p, LOSS_EDGE, 1 - LOSS_EDGE)
            loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()
            return np.concatenate([[loss], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z)[upper]])

        return cells

    penalty = np.append(np.full(d, ridge), 0.0)
    for _ in range(rounds):
        got = sums(newton_cells(w)) / n[:, None]
        gradient = got[:, 1 : d + 2] + penalty * w
        step = np.zeros_like(w)
        for k in range(len(plans)):
            curve = np.zeros((d + 1, d + 1))
            curve[upper] = got[k, d + 2 :]
            curve = curve + np.triu(curve, 1).T + np.diag(penalty + 1e-12)
            step[k] = np.linalg.solve(curve, gradient[k])
        w = w - step
        if np.abs(step).max() < NEWTON_EDGE:
            break
    loss = sums(newton_cells(w))[:, 0] / n
    out = []
    for k, p in enumerate(plans):
        own = [f for f in features if f != p.mask]
        means, stds = m0 + mean[k] * s0, std[k] * s0
        out.append(LogisticModel(w[k, :d][used[k]].tolist(), float(w[k, d]), means[used[k]].tolist(), stds[used[k]].tolist(), own, l2=ridge, iterations=rounds, n_train=int(n[k]), final_loss=float(loss[k])))
    return out


def _models_table(df: DataFrame, plans: list[Plan], models: list[LogisticModel]) -> DataFrame:
    """One row per plan: fold, mask and the columns of MODELS."""
    rows = [(p.fold, p.mask, m.weights, m.bias, m.means, m.stds, m.feature_names, m.n_train, m.final_loss) for p, m in zip(plans, models, strict=True)]
    return df.sparkSession.createDataFrame(rows, f"fold int, mask string, {MODELS}")


def cross_validated_at_scale(df: DataFrame, features: list[str], folds: int = FOLDS) -> DataFrame:
    """cross_validated with models from fit_newton: any number of rows."""
    plans = [Plan(k) for k in range(folds)]
    models = _models_table(df, plans, fit_newton(df, features, plans))
    # one row per fold
    return df.join(F.broadcast(models), "fold").withColumn("learned", _predicted([F.col(f) for f in features])).select(*df.columns, "learned")


def ablation_at_scale(df: DataFrame, features: list[str] = FEATURES, folds: int = FOLDS) -> DataFrame:
    """ablation_scores with models from fit_newton: any number of rows."""
    plans = [Plan(k, f) for f in ["", *features] for k in range(folds)]
    return _masked_scores(df, features, _models_table(df, plans, fit_newton(df, features, plans)))


def fit_at_scale(df: DataFrame, features: list[str], label: str = "label", ridge: float = RIDGE) -> LogisticModel:
    """The same objective minimised by MLlib over distributed rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scale = {r["feature"]: (r["mean"], r["std"]) for r in standardisation(df, features).collect()}
    scaled = df.select(*[((F.col(f) - scale[f][0]) / scale[f][1]).alias(f) for f in features], F.col(label).cast("double").alias("label"))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(scaled)
    m = LogisticRegression(regParam=ridge, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(data)
    loss = scaled.select(log_loss(LogisticModel(list(m.coefficients), m.intercept, [0.0] * len(features), [1.0] * len(features), features).probability([F.col(f) for f in features]), F.col("label")).alias("x")).first()["x"]
    return LogisticModel(
        [float(x) for x in m.coefficients], float(m.intercept), [scale[f][0] for f in features], [scale[f][1] for f in features],
        list(features), l2=ridge, n_train=df.count(), final_loss=loss,
    )


def ablation_scores(df: DataFrame, features: list[str] = FEATURES, folds: int = FOLDS) -> DataFrame:
    """(mask, ord, label, score): out-of-fold probabilities with no feature left out (mask '') and with each.

    A model for every mask and fold, fitted as independent groups.
    """
    masks = F.explode(F.array(*map(F.lit, ["", *features])))
    train = _training_rows(df, folds).withColumn("mask", masks)
    models = fit_groups(train, {"mask": "string", "fold": "int"}, features)
    return _masked_scores(df, features, models)


def _masked_scores(df: DataFrame, features: list[str], models: DataFrame) -> DataFrame:
    wide = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f))])
    rows = df.select("ord", "label", "fold", wide.alias("x"))
    # masks x folds rows
    joined = rows.join(F.broadcast(models), "fold")
    values = F.transform("names", lambda f: F.element_at(F.col("x"), f))
    z = F.zip_with(values, F.arrays_zip(F.col("means"), F.col("stds"), F.col("weights")), lambda v, m: (v - m["means"]) / m["stds"] * m["weights"])
    score = sigmoid(F.aggregate(z, F.lit(0.0), lambda s, v: s + v) + F.col("bias"))
    return joined.select("mask", "ord", "label", score.alias("score"))
