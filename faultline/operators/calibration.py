"""Calibrators of scores: Platt, temperature, isotonic, beta, and the choice between them.

A fit sees ``p, y, n`` (distinct scores, their label and how often they occur),
so it grows with distinct scores, not with rows.  Logistic fits are Newton
steps, each one aggregate of a few sums; nothing but these sums reaches the
driver.  A population without both classes gets the identity.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.maths import clipped, logit, sigmoid

METHODS = ("platt", "temperature", "isotonic", "beta")
#: The temperatures that are tried.
GRID = tuple(0.5 + i * 0.05 for i in range(91))
#: Edges of the ten bins of the calibration error.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def distinct_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """``p, y, n`` of the rows with a score and a label."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    return rows.groupBy(F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n"))


def _newton(scores: DataFrame, features: list[Column], steps: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression with a penalty of half the squared weights (none on the intercept)."""
    x = [*features, F.lit(1.0)]
    k = len(x)
    w = np.zeros(k)
    for _ in range(steps):
        q = sigmoid(sum((F.lit(float(a)) * c for a, c in zip(w, x, strict=True)), F.lit(0.0)))
        n = F.col("n")
        sums = [F.sum(n * (q - F.col("y")) * c) for c in x] + [F.sum(n * q * (1 - q) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
        row = scores.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        gradient, hessian = np.array(row[:k], float), np.zeros((k, k))
        hessian[np.triu_indices(k)] = row[k:]
        hessian = hessian + np.triu(hessian, 1).T
        penalty = np.array([1.0] * (k - 1) + [0.0])
        step = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(scores: DataFrame, method: str) -> dict:
    """``{"method", "parameters"}`` of one of :data:`METHODS` or of ``identity``."""
    if method == "identity":
        return {"method": method, "parameters": {}}
    if method not in METHODS:
        raise ValueError(f"unknown calibration method: {method}")
    scores = scores.select(clipped(F.col("p")).alias("p"), "y", "n")
    both = scores.agg(F.countDistinct("y")).first()[0] == 2
    if method == "platt":
        w = _newton(scores, [logit(F.col("p"))]) if both else (1.0, 0.0)
        parameters = {"coef": float(w[0]), "intercept": float(w[1])}
    elif method == "beta":
        w = _newton(scores, [F.ln("p"), F.log1p(-F.col("p"))]) if both else (1.0, 0.0, 0.0)
        parameters = {"coef_pos": float(w[0]), "coef_neg": float(w[1]), "intercept": float(w[2])}
    elif method == "temperature":
        parameters = {"temperature": _temperature(scores) if both else 1.0}
    elif both:
        model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="n").fit(VectorAssembler(inputCols=["p"], outputCol="x").transform(scores.withColumns({"y": F.col("y").cast("double"), "n": F.col("n").cast("double")})))
        parameters = {"thresholds": model.boundaries.toArray().tolist(), "values": model.predictions.toArray().tolist()}
    else:
        parameters = {"thresholds": [0.0, 1.0], "values": [0.0, 1.0]}
    return {"method": method, "parameters": parameters}


def _temperature(scores: DataFrame) -> float:
    grid = F.explode(F.array(*(F.lit(t) for t in GRID)))
    rows = scores.withColumn("t", grid)
    q = clipped(sigmoid(logit(F.col("p")) / F.col("t")))
    loss = rows.groupBy("t").agg(F.round(-F.sum(F.col("n") * (F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))) / F.sum("n"), 12).alias("nll"))
    return loss.agg(F.min_by("t", F.struct("nll", "t"))).first()[0]


def apply(p: Column, calibrator: dict) -> Column:
    """The calibrated probability of a score; nulls stay null."""
    method, of = calibrator["method"], calibrator["parameters"]
    if method == "identity":
        return p
    if method == "platt":
        return sigmoid(of["coef"] * logit(p) + of["intercept"])
    if method == "temperature":
        return sigmoid(logit(p) / max(of["temperature"], 1e-6))
    if method == "beta":
        return sigmoid(of["coef_pos"] * F.ln(clipped(p)) + of["coef_neg"] * F.log1p(-clipped(p)) + of["intercept"])
    if method != "isotonic":
        raise ValueError(f"unknown calibration method: {method}")
    xs, ys = of["thresholds"], of["values"]
    if not xs:
        return clipped(p)
    knots = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zip(xs, ys, strict=True)))

    def between(s: Column) -> Column:
        a, b, q = s["a"], s["b"], s["q"]
        slope = F.coalesce(F.try_divide(b["y"] - a["y"], b["x"] - a["x"]), F.lit(0.0))
        return F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + slope * (q - a["x"]))

    # the last knot at or below the score, and the next one
    made = F.transform(F.array(clipped(p)), lambda q: F.transform(F.array(F.size(F.filter(knots, lambda k: k["x"] <= q))), lambda i: F.struct(F.get(knots, i - 1).alias("a"), F.get(knots, i).alias("b"), q.alias("q"))))
    return F.when(p.isNotNull(), between(F.get(F.get(made, 0), 0)))


def quality(scores: DataFrame, calibrated: Column) -> dict[str, float]:
    """Log loss, calibration error over ten bins and Brier score of calibrated scores; all 0 for an empty population."""
    q = clipped(F.col("q"))
    b = F.lit(9)
    for i in range(8, -1, -1):
        b = F.when(F.col("q") < EDGES[i + 1], i).otherwise(b)
    rows = scores.withColumn("q", calibrated)
    n, y = F.col("n"), F.col("y")
    bins = rows.groupBy(b.alias("bin")).agg(F.sum("n").alias("m"), F.sum(n * F.col("q")).alias("mq"), F.sum(n * y).alias("my"), F.sum(-n * (y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("nll"), F.sum(n * F.pow(F.col("q") - y, 2)).alias("brier"))
    r = bins.agg(F.sum("nll") / F.sum("m"), F.sum(F.abs(F.col("mq") - F.col("my"))) / F.sum("m"), F.sum("brier") / F.sum("m")).first()
    return dict(zip(("nll", "ece", "brier"), (float(x or 0.0) for x in r), strict=True))


def choose(scores: DataFrame, method: str = "auto") -> dict:
    """The calibrator asked for, or for ``auto`` the one of the least (log loss, calibration error, Brier score), the first of equal ones."""
    scores = scores.persist()
    try:
        if method != "auto":
            return fit(scores, method)
        tried = [fit(scores, m) for m in METHODS]
        for c in tried:
            c["metrics"] = quality(scores, apply(F.col("p"), c))
        best = min(tried, key=lambda c: tuple(c["metrics"][m] for m in ("nll", "ece", "brier")))
        return best | {"candidate_metrics": {c["method"]: c["metrics"] for c in tried}}
    finally:
        scores.unpersist()


def mcnemar_p(n01: int, n10: int) -> float:
    """Two-sided exact p-value of ``n01`` against ``n10`` discordant pairs; 1 without any."""
    n, k = n01 + n10, min(n01, n10)
    if not n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(k + 1)))


