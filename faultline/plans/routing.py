"""Queries over calibration, thresholds under a budget, and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.maths import ratio
from faultline.operators import calibration
from faultline.plans.scores import _LATEST, _SCORED, latest, scored, steps
from faultline.workspace import materialize

#: The cuts that are tried.
LOW = tuple(round(0.02 * (i + 1), 6) for i in range(15))
HIGH = tuple(round(0.45 + 0.025 * i, 6) for i in range(19))
#: Pairs of (least recall, largest share of calls) that the search is run for.
LIMITS = (("strict", 0.995, 0.15), ("loose", 0.8, 0.6))


def q_threshold_precision(spark, d, target: float = 0.7, minimum: float = 0.2):
    """The first score above ``minimum`` whose rows have the target precision; if none, the one of the best F0.5, or ``minimum`` + 0.05."""
    rows = steps(scored(spark, d)).where((F.col("p") > minimum) & F.col("cand"))
    precision, recall = ratio(F.col("tp"), F.col("n_up")), ratio(F.col("tp"), F.col("all_pos"))
    half = F.round(ratio(1.25 * precision * recall, 0.25 * precision + recall), 9)
    best = rows.groupBy("dataset").agg(F.min(F.when(precision >= target, F.col("p"))).alias("first"), F.max(F.struct(half.alias("f"), (-F.col("p")).alias("m"))).alias("b"))
    every = scored(spark, d).select("dataset").distinct()
    best = every.join(best, "dataset", "left")
    return best.select("dataset", F.coalesce("first", -F.col("b.m"), F.lit(minimum + 0.05)).alias("tau_high"), F.when(F.col("first").isNotNull(), "target_precision").otherwise("f0_5_fallback").alias("strategy"))


def _cells(rows: DataFrame) -> DataFrame:
    """Rows and positives by how many low cuts a score lies above, how many high cuts it reaches, and its side of 0.5: what the whole grid needs, in a few hundred rows."""
    above = F.aggregate(F.array(*(F.lit(t) for t in LOW)), F.lit(0), lambda a, t: a + (F.col("p") > t).cast("int"))
    reached = F.aggregate(F.array(*(F.lit(t) for t in HIGH)), F.lit(0), lambda a, t: a + (F.col("p") >= t).cast("int"))
    return rows.groupBy("dataset", above.alias("above"), reached.alias("reached"), (F.col("p") >= 0.5).alias("half")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def q_routing_grid(spark, d):
    """For each limit the pair of cuts with the best (F1, precision, accuracy, fewest calls) among those within it, the first of equal ones; none if none is."""
    cells = _cells(scored(spark, d))
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(x).alias("tau_low"), F.lit(b).alias("j"), F.lit(y).alias("tau_high")) for a, x in enumerate(LOW) for b, y in enumerate(HIGH) if y > x)))
    rows = cells.withColumn("g", grid)
    skip, high = F.col("above") <= F.col("g.i"), F.col("reached") > F.col("g.j")
    yes = ~skip & (high | F.col("half"))
    total = lambda on, what: F.sum(F.when(on, F.col(what)).otherwise(0))
    sums = rows.groupBy("dataset", "g").agg(total(yes, "pos").alias("tp"), total(yes, "n").alias("pp"), F.sum("pos").alias("p"), F.sum("n").alias("n"), total(~skip & ~high, "n").alias("asked"))
    tp, pp, p, n = (F.col(c) for c in ("tp", "pp", "p", "n"))
    rows = sums.select("dataset", "g.tau_low", "g.tau_high", F.round(ratio(2 * tp, pp + p), 9).alias("f1"), F.round(ratio(tp, pp), 9).alias("precision"), F.round(ratio(tp, p), 9).alias("recall"), F.round(ratio(n - pp - p + 2 * tp, n), 9).alias("accuracy"), F.round(ratio(F.col("asked"), n), 9).alias("call_rate"))
    limit = F.explode(F.array(*(F.struct(F.lit(name).alias("limits"), F.lit(r).alias("floor"), F.lit(c).alias("budget")) for name, r, c in LIMITS)))
    rows = rows.withColumn("l", limit).where((F.col("recall") >= F.col("l.floor")) & (F.col("call_rate") <= F.col("l.budget")))
    order = F.struct("f1", "precision", "accuracy", -F.col("call_rate"), -F.col("tau_low"), -F.col("tau_high"))
    best = rows.groupBy("dataset", "l.limits").agg(F.max_by(F.struct("tau_low", "tau_high", "f1", "precision", "recall", "accuracy", "call_rate"), order).alias("b"))
    return best.select("dataset", "limits", "b.*")


def route(p: Column, low: Column | float, high: Column | float, proxy: str = "probability") -> tuple[Column, Column]:
    """Risk band and prediction of a score without a call: skip tells 0, high 1, and inspect what ``proxy`` (positive, negative or probability) says."""
    inspect = {"positive": F.lit(1), "negative": F.lit(0), "probability": (p >= 0.5).cast("int")}[proxy]
    band = F.when(p <= low, "skip").when(p >= high, "high").otherwise("inspect")
    return band, F.when(p <= low, 0).when(p >= high, 1).otherwise(inspect)


def q_routing_stats(spark, d, low: float = 0.1, high: float = 0.6):
    """Shares of each way and quality of the predictions made without a call, for every proxy."""
    rows = scored(spark, d)
    parts = []
    for proxy in ("positive", "negative", "probability"):
        band, said = route(F.col("p"), low, high, proxy)
        r = rows.select("dataset", "y", band.alias("band"), said.alias("z"))
        parts.append(
            r.groupBy("dataset").agg(
                F.lit(proxy).alias("proxy"),
                F.round(F.avg((F.col("band") == "inspect").cast("double")), 6).alias("call_rate"),
                F.round(F.avg((F.col("band") == "high").cast("double")), 6).alias("auto_positive_rate"),
                F.round(F.avg((F.col("band") == "skip").cast("double")), 6).alias("auto_negative_rate"),
                F.round(F.avg((F.col("y") == F.col("z")).cast("double")), 6).alias("accuracy"),
                F.round(ratio(F.sum(F.col("y") * F.col("z")), F.sum("y")), 6).alias("recall"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_branch_means(spark, d, low: float = 0.1, high: float = 0.6):
    """Mean scores of the branches and the shares that would be kept, inspected and taken as high."""
    p = F.col("calibrated_probability")
    share = lambda on, name: F.round(F.avg(on.cast("double")), 6).alias(name)
    means = (F.round(F.avg(F.nullif(f"prefilter_{b}_score", F.lit(float("nan")))), 6).alias(f"{b}_mean") for b in ("fusion", "semantic", "graph"))
    return latest(spark, d).groupBy("dataset").agg(*means, share(p > low, "keep_ratio"), share(p >= high, "high_ratio"), share((p > low) & (p < high), "inspect_ratio"))


def q_routing_counts(spark, d):
    """Records by risk band and by decision source, with 0 for the names that don't occur."""
    rows = latest(spark, d)
    names = spark.createDataFrame([("risk_band", x) for x in ("skip", "inspect", "high")] + [("decision_source", x) for x in ("prefilter", "llm")], "field string, value string")
    counts = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("risk_band", "decision_source")))).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    return names.join(counts.where("value is not null"), ["field", "value"], "full").select("field", "value", F.coalesce("n", F.lit(0)).alias("n"))


def q_class_weight(spark, d):
    """Weight of the positive class: negatives to positives, at least 1."""
    rows = scored(spark, d).groupBy("dataset").agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"))
    return rows.withColumn("positive_weight", F.round(F.greatest(F.lit(1.0), F.col("negative") / F.greatest("positive", F.lit(1))), 6))


def q_hard_negatives(spark, d, quantile: float = 0.8, weight: float = 2.0):
    """Cut at a quantile (within 0.5 and 0.99, by linear interpolation) of the negatives' scores; negatives from it on are hard and weigh more."""
    quantile = min(0.99, max(0.5, quantile))
    rows = scored(spark, d)
    cuts = rows.where("y = 0").groupBy("dataset").agg(F.percentile("p", quantile).alias("cut"))
    rows = rows.join(cuts, "dataset", "left").withColumn("hard", (F.col("y") == 0) & (F.col("p") >= F.col("cut")))
    return rows.groupBy("dataset").agg(F.round(F.first("cut", True), 6).alias("cut"), F.count_if("hard").alias("n_hard"), F.round(F.sum(F.when(F.col("hard"), weight).otherwise(1.0)), 6).alias("weight_sum"))


def _per_dataset(spark, d):
    """Name and distinct scores of every dataset; scores are written once, as fits read them again and again."""
    rows = materialize(scored(spark, d).groupBy("dataset", "p", "y").agg(F.count("*").alias("n")))
    for (name,) in rows.select("dataset").distinct().orderBy("dataset").collect():  # the few names of datasets
        yield name, rows.where(F.col("dataset").eqNullSafe(F.lit(name))).select("p", "y", "n")


def q_platt(spark, d):
    """Slope and intercept of the logistic calibration of every dataset."""
    out = [(n, *(round(calibration.fit(s, "platt")["parameters"][k], 6) for k in ("coef", "intercept"))) for n, s in _per_dataset(spark, d)]
    return spark.createDataFrame(out, "dataset string, coef double, intercept double")


def q_beta(spark, d):
    out = [(n, *(round(calibration.fit(s, "beta")["parameters"][k], 6) for k in ("coef_pos", "coef_neg", "intercept"))) for n, s in _per_dataset(spark, d)]
    return spark.createDataFrame(out, "dataset string, coef_pos double, coef_neg double, intercept double")


def q_isotonic(spark, d):
    """Knots of the isotonic calibration of every dataset."""
    out = []
    for name, s in _per_dataset(spark, d):
        of = calibration.fit(s, "isotonic")["parameters"]
        out += [(name, round(x, 6), round(y, 6)) for x, y in zip(of["thresholds"], of["values"], strict=True)]
    return spark.createDataFrame(out, "dataset string, threshold double, value double")


def q_calibrator_auto(spark, d):
    """Log loss, calibration error and Brier score of every calibrator, and which is chosen."""
    out = []
    for name, s in _per_dataset(spark, d):
        best = calibration.choose(s)
        out += [(name, m, *(round(q[k], 6) for k in ("nll", "ece", "brier")), m == best["method"]) for m, q in best["candidate_metrics"].items()]
    return spark.createDataFrame(out, "dataset string, method string, nll double, ece double, brier double, chosen boolean")


def q_calibration_stage(spark, d, target: float = 0.995, minimum: float = 0.2):
    """Calibrator, both thresholds on calibrated scores and the resulting routing of every dataset."""
    out = []
    for name, s in _per_dataset(spark, d):
        best = calibration.choose(s)
        rows = s.withColumn("p", calibration.apply(F.col("p"), best)).withColumns({"dataset": F.lit(name), "copies": F.sequence(F.lit(1), F.col("n"))}).select("dataset", "p", "y", F.explode("copies").alias("c"))
        curve = steps(rows).where("cand").persist()
        low = curve.agg(F.coalesce(F.max(F.when(ratio(F.col("tp") - F.col("pos"), F.col("all_pos")) >= target, F.col("p"))), F.lit(0.0))).first()[0]
        floor = max(low, minimum)
        f1 = F.round(ratio(2 * F.col("tp"), F.col("n_up") + F.col("all_pos")), 9)
        top = curve.where(F.col("p") >= floor).agg(F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("m")))).first()[0]
        curve.unpersist()
        high = -top.m if top else floor
        shares = rows.agg(*(F.round(F.avg(x.cast("double")), 6) for x in (F.col("p") > low, F.col("p") >= high, (F.col("p") > low) & (F.col("p") < high)))).first()
        out.append((name, best["method"], low, high, *shares))
    return spark.createDataFrame(out, "dataset string, method string, tau_low double, tau_high double, keep_ratio double, high_ratio double, inspect_ratio double")


QUERIES = {
    f.__name__: f
    for f in (q_threshold_precision, q_routing_grid, q_routing_stats, q_branch_means, q_routing_counts, q_class_weight, q_hard_negatives, q_platt, q_beta, q_isotonic, q_calibrator_auto, q_calibration_stage)
}

_LIST = lambda xs: ", ".join(f"{x!r}::DOUBLE" for x in xs)
ORACLES = {
    "q_threshold_precision": _SCORED + """, g AS (SELECT DISTINCT dataset, round(p, 6) AS t FROM s), r AS (SELECT g.dataset, g.t, sum(y) FILTER (s.p >= g.t)::DOUBLE AS tp, count(*) FILTER (s.p >= g.t) AS up, sum(y) AS pos FROM g JOIN s USING (dataset) WHERE g.t > 0.2::DOUBLE GROUP BY ALL),
q AS (SELECT *, coalesce(tp / nullif(up, 0), 0) AS pr, coalesce(tp / nullif(pos, 0), 0) AS re FROM r), f AS (SELECT *, round(coalesce(1.25::DOUBLE * pr * re / nullif(0.25::DOUBLE * pr + re, 0), 0), 9) AS half FROM q),
b AS (SELECT dataset, min(t) FILTER (pr >= 0.7::DOUBLE) AS first, arg_max(t, (half, -t)) AS best FROM f GROUP BY dataset)
SELECT dataset, coalesce(first, best, 0.25::DOUBLE) AS tau_high, CASE WHEN first IS NOT NULL THEN 'target_precision' ELSE 'f0_5_fallback' END AS strategy FROM (SELECT DISTINCT dataset FROM s) LEFT JOIN b USING (dataset)""",
    "q_routing_grid": _SCORED + f""", a AS (SELECT unnest([{_LIST(LOW)}]) AS tau_low), h AS (SELECT unnest([{_LIST(HIGH)}]) AS tau_high), k AS (SELECT * FROM (VALUES ('strict', 0.995::DOUBLE, 0.15::DOUBLE), ('loose', 0.8::DOUBLE, 0.6::DOUBLE)) v(limits, floor_, budget)),
x AS (SELECT dataset, tau_low, tau_high, y, p > tau_low AND p < tau_high AS asked, CASE WHEN p <= tau_low THEN 0 WHEN p >= tau_high THEN 1 WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END AS z FROM s, a, h WHERE tau_high > tau_low),
m AS (SELECT dataset, tau_low, tau_high, round(coalesce(2 * sum(y * z)::DOUBLE / nullif(sum(y) + sum(z), 0), 0), 9) AS f1, round(coalesce(sum(y * z)::DOUBLE / nullif(sum(z), 0), 0), 9) AS precision, round(coalesce(sum(y * z)::DOUBLE / nullif(sum(y), 0), 0), 9) AS recall,
  round(avg(CASE WHEN y = z THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, round(avg(CASE WHEN asked THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS call_rate FROM x GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset, limits ORDER BY f1 DESC, precision DESC, accuracy DESC, call_rate, tau_low, tau_high) AS nth FROM m, k WHERE recall >= floor_ AND call_rate <= budget)
SELECT dataset, limits, tau_low, tau_high, f1, precision, recall, accuracy, call_rate FROM n WHERE nth = 1""",
    "q_routing_stats": _SCORED + """, x AS (SELECT dataset, y, p, proxy, CASE WHEN p <= 0.1::DOUBLE THEN 0 WHEN p >= 0.6::DOUBLE THEN 1 WHEN proxy = 'positive' THEN 1 WHEN proxy = 'negative' THEN 0 WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END AS z FROM s, (VALUES ('positive'), ('negative'), ('probability')) v(proxy))
SELECT dataset, proxy, round(avg((p > 0.1::DOUBLE AND p < 0.6::DOUBLE)::INT), 6) AS call_rate, round(avg((p >= 0.6::DOUBLE)::INT), 6) AS auto_positive_rate, round(avg((p <= 0.1::DOUBLE)::INT), 6) AS auto_negative_rate, round(avg((y = z)::INT), 6) AS accuracy,
  round(coalesce(sum(y * z)::DOUBLE / nullif(sum(y), 0), 0), 6) AS recall FROM x GROUP BY ALL""",
    "q_branch_means": _LATEST + " SELECT dataset, " + ", ".join(f"round(avg(prefilter_{b}_score) FILTER (CAST(prefilter_{b}_score AS VARCHAR) <> 'nan'), 6) AS {b}_mean" for b in ("fusion", "semantic", "graph")) + """, round(avg((calibrated_probability > 0.1::DOUBLE)::INT), 6) AS keep_ratio, round(avg((calibrated_probability >= 0.6::DOUBLE)::INT), 6) AS high_ratio,
  round(avg((calibrated_probability > 0.1::DOUBLE AND calibrated_probability < 0.6::DOUBLE)::INT), 6) AS inspect_ratio FROM l GROUP BY dataset""",
    "q_routing_counts": _LATEST + """, k AS (SELECT * FROM (VALUES ('risk_band', 'skip'), ('risk_band', 'inspect'), ('risk_band', 'high'), ('decision_source', 'prefilter'), ('decision_source', 'llm')) v(field, value)),
c AS (SELECT 'risk_band' AS field, risk_band AS value, count(*) AS n FROM l WHERE risk_band IS NOT NULL GROUP BY ALL UNION ALL SELECT 'decision_source', decision_source, count(*) FROM l WHERE decision_source IS NOT NULL GROUP BY ALL)
SELECT field, value, coalesce(n, 0) AS n FROM k FULL JOIN c USING (field, value)""",
    "q_class_weight": _SCORED + " SELECT dataset, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative, round(greatest(1.0::DOUBLE, count(*) FILTER (y = 0)::DOUBLE / greatest(count(*) FILTER (y = 1), 1)), 6) AS positive_weight FROM s GROUP BY dataset",
    "q_hard_negatives": _SCORED + """, c AS (SELECT dataset, quantile_cont(p, 0.8) AS cut FROM s WHERE y = 0 GROUP BY dataset)
SELECT dataset, round(any_value(cut), 6) AS cut, count(*) FILTER (y = 0 AND p >= cut) AS n_hard, round(sum(CASE WHEN y = 0 AND p >= cut THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS weight_sum FROM s LEFT JOIN c USING (dataset) GROUP BY dataset""",
}
