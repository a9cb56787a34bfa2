"""Queries over scores, predictions and datasets: metrics, thresholds, routing and reports.

Every query takes each record's last attempt.  Metrics are one pass of
aggregates over whole scores; only candidates for thresholds are rounded.
Running sums over scores are built in two levels, so that no task holds all
scores of a dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.workspace import table

EPS = 1e-6
#: Parts of [0, 1] in which scores are put in order by themselves.
PARTS = 4096


def latest(spark: SparkSession, d: str) -> DataFrame:
    """The last attempt of every record by time, then by probability (NaN counting as none); combined before the shuffle, so no record's rows are gathered."""
    rows = table(spark, d, "predictions").where("record_id is not null")
    p = F.nullif("calibrated_probability", F.lit(float("nan")))
    order = F.struct("recorded_at", F.coalesce(p, F.lit(-1.0)))
    columns = [c for c in rows.columns if c != "record_id"]
    return rows.groupBy("record_id").agg(F.max_by(F.struct(*columns), order).alias("r")).select("record_id", "r.*").withColumn("calibrated_probability", p)


_LATEST = """WITH l AS (SELECT * EXCLUDE (calibrated_probability, nth), CASE WHEN CAST(calibrated_probability AS VARCHAR) <> 'nan' THEN calibrated_probability END AS calibrated_probability FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY recorded_at DESC NULLS LAST,
  CASE WHEN CAST(calibrated_probability AS VARCHAR) <> 'nan' THEN calibrated_probability ELSE -1 END DESC) AS nth FROM predictions WHERE record_id IS NOT NULL) WHERE nth = 1)"""  # casts to text, as isnan is dropped where the file's statistics know no NaN


def scored(spark: SparkSession, d: str) -> DataFrame:
    """``record_id, dataset, y, p`` of the last attempts with a label and a probability."""
    rows = latest(spark, d).where("ground_truth is not null and calibrated_probability is not null")
    return rows.select("record_id", "dataset", F.col("ground_truth").alias("y"), F.col("calibrated_probability").alias("p"))


_SCORED = _LATEST + ", s AS (SELECT record_id, dataset, ground_truth AS y, calibrated_probability AS p FROM l WHERE ground_truth IS NOT NULL AND calibrated_probability IS NOT NULL)"


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def q_confusion_metrics(spark, d):
    """Confusion counts, accuracy, precision, recall and F1 of the stored predictions, per dataset."""
    c = lambda y, z, name: F.count_if((F.col("y") == y) & (F.col("prediction") == z)).alias(name)
    rows = latest(spark, d).where("prediction is not null and ground_truth is not null").withColumn("y", F.col("ground_truth")).groupBy("dataset").agg(c(1, 1, "tp"), c(0, 0, "tn"), c(0, 1, "fp"), c(1, 0, "fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return rows.select("dataset", "tp", "tn", "fp", "fn", F.round(_ratio(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"), F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def steps(rows: DataFrame) -> DataFrame:
    """Rows and positives of each distinct score, with running sums from the highest score down; ``cand`` marks scores of six decimals that some row rounds to."""
    points = rows.select("dataset", "p", "y", F.lit(1).alias("one"), F.lit(0).alias("c"))
    cuts = rows.select("dataset", F.round("p", 6).alias("p"), F.lit(0).alias("y"), F.lit(0).alias("one"), F.lit(1).alias("c"))
    by = points.unionByName(cuts).groupBy("dataset", "p").agg(F.sum("one").alias("n"), F.sum("y").alias("pos"), (F.max("c") == 1).alias("cand")).withColumn("part", F.floor(F.col("p") * PARTS))
    # at most PARTS + 1 rows a dataset
    parts = by.groupBy("dataset", "part").agg(F.sum("n").alias("pn"), F.sum("pos").alias("pp"))
    above = Window.partitionBy("dataset").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("dataset")
    zero = F.lit(0).cast("long")
    parts = parts.select("dataset", "part", F.coalesce(F.sum("pn").over(above), zero).alias("an"), F.coalesce(F.sum("pp").over(above), zero).alias("ap"), F.sum("pn").over(whole).alias("all"), F.sum("pp").over(whole).alias("all_pos"))
    down = Window.partitionBy("dataset", "part").orderBy(F.desc("p"))
    b, q = by.alias("b"), parts.alias("q")
    rows = b.join(q, F.col("b.dataset").eqNullSafe(F.col("q.dataset")) & (F.col("b.part") == F.col("q.part"))).select("b.*", "an", "ap", "all", "all_pos")
    return rows.withColumns({"n_up": F.col("an") + F.sum("n").over(down), "tp": F.col("ap") + F.sum("pos").over(down)}).drop("an", "ap", "part")


_STEPS = _SCORED + """, b AS (SELECT dataset, p, count(*) AS n, sum(y)::BIGINT AS pos FROM s GROUP BY dataset, p),
t AS (SELECT *, (sum(n) OVER (PARTITION BY dataset ORDER BY p DESC))::BIGINT AS n_up, (sum(pos) OVER (PARTITION BY dataset ORDER BY p DESC))::BIGINT AS tp, (sum(n) OVER (PARTITION BY dataset))::BIGINT AS every, (sum(pos) OVER (PARTITION BY dataset))::BIGINT AS all_pos FROM b)
"""


def q_roc_auc(spark, d):
    """Area under the ROC curve by ranks, ties at their average; null if one class is missing."""
    rows = steps(scored(spark, d)).where("n > 0")
    # of the negatives, those below a score count once and those at it half
    neg, all_neg = F.col("n") - F.col("pos"), F.col("all") - F.col("all_pos")
    below = all_neg - (F.col("n_up") - F.col("tp"))
    rows = rows.groupBy("dataset").agg(F.sum(F.col("pos") * (below + neg / 2)).alias("won"), F.max(F.col("all_pos") * all_neg).alias("pairs"))
    return rows.select("dataset", F.round(F.try_divide("won", F.col("pairs").cast("double")), 6).alias("roc_auc"))


def q_pr_auc(spark, d):
    """Average precision over distinct scores."""
    rows = steps(scored(spark, d)).where("n > 0")
    return rows.groupBy("dataset").agg(F.round(F.sum(_ratio(F.col("pos"), F.col("all_pos")) * F.col("tp") / F.col("n_up")), 6).alias("pr_auc"))


def q_brier_nll(spark, d):
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("p")))
    y = F.col("y")
    return scored(spark, d).groupBy("dataset").agg(F.round(F.avg(F.pow(F.col("p") - y, 2)), 6).alias("brier"), F.round(-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p)), 6).alias("nll"))


#: The edges of the ten calibration bins.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def q_ece(spark, d):
    """Expected calibration error over ten bins, the last one closed."""
    b = F.lit(9)
    for i in range(8, -1, -1):
        b = F.when(F.col("p") < EDGES[i + 1], i).otherwise(b)
    bins = scored(spark, d).groupBy("dataset", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return bins.groupBy("dataset").agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


def q_threshold_low(spark, d, target: float = 0.995):
    """The largest score t at which the rows above t still hold the target recall; 0 if none."""
    above = F.col("tp") - F.col("pos")
    good = steps(scored(spark, d)).where("cand").groupBy("dataset").agg(F.coalesce(F.max(F.when(_ratio(above, F.col("all_pos")) >= target, F.col("p"))), F.lit(0.0)).alias("tau_low"))
    return good


def q_threshold_high_f1(spark, d, minimum: float = 0.2):
    """The score above ``minimum`` of the best F1, the smallest of equal ones; max(minimum + 0.05, 0.5) with the F1 at 0.5 if none."""
    rows = steps(scored(spark, d))
    return _best_f1(rows, F.col("p") > minimum, max(minimum + 0.05, 0.5), 0.5)


def q_threshold_best_f1(spark, d, minimum: float = 0.3):
    """The score of ``minimum`` or more of the best F1, the smallest of equal ones; ``minimum`` if none."""
    rows = steps(scored(spark, d))
    return _best_f1(rows, F.col("p") >= minimum, minimum, minimum)


def _best_f1(rows: DataFrame, allowed, fallback: float, at: float) -> DataFrame:
    f1 = F.round(_ratio(2 * F.col("tp"), F.col("n_up") + F.col("all_pos")), 9)
    rows = rows.withColumns({"f1": f1, "ok": F.col("cand") & allowed})
    # the F1 at a fixed cut is that of the least score from it on
    best = rows.groupBy("dataset").agg(F.max(F.when(F.col("ok"), F.struct("f1", (-F.col("p")).alias("m")))).alias("b"), F.min(F.when(F.col("p") >= at, F.struct("p", "f1"))).alias("z"))
    return best.select("dataset", F.when(F.col("b").isNull(), fallback).otherwise(-F.col("b.m")).alias("tau_high"), F.round(F.coalesce("b.f1", "z.f1", F.lit(0.0)), 6).alias("f1"))


def q_temperature_grid(spark, d):
    """The temperature of 0.5 to 5 in steps of 0.05 of the least log loss, the smallest of equal ones; one pass over the rows."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(90)), lambda i: i))
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("p")))
    q = 1 / (1 + F.exp(-F.ln(p / (1 - p)) / (0.5 + F.col("i") * 0.05)))
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), q))
    # rows of one score and label are one row, with a weight
    few = scored(spark, d).groupBy("dataset", "p", "y").agg(F.count("*").alias("n")).withColumn("i", grid)
    loss = few.groupBy("dataset", "i").agg(F.round(-F.sum(F.col("n") * (F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))) / F.sum("n"), 9).alias("nll"))
    best = loss.groupBy("dataset").agg(F.min(F.struct("nll", "i")).alias("b"))
    return best.select("dataset", F.round(0.5 + F.col("b.i") * 0.05, 2).alias("temperature"), F.round("b.nll", 6).alias("nll"))


def q_risk_bands(spark, d, low: float = 0.1, high: float = 0.6):
    """Rows, positives and mean probability of each risk band."""
    band = F.when(F.col("p") <= low, "skip").when(F.col("p") >= high, "high").otherwise("inspect")
    return scored(spark, d).groupBy("dataset", band.alias("band")).agg(F.count("*").alias("n_rows"), F.sum("y").alias("n_positive"), F.round(F.avg("p"), 6).alias("mean_p"))


def q_prob_histogram(spark, d):
    """Twenty equal bins on [0, 1] by label, the last one closed."""
    b = F.least(F.lit(19), F.floor(F.col("p") * 20)).cast("int")
    return scored(spark, d).groupBy("y", b.alias("bin")).agg(F.count("*").alias("n_rows"))


def q_focal_loss(spark, d):
    """Mean focal loss with gamma 2."""
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("p")))
    pt = F.when(F.col("y") == 1, p).otherwise(1 - p)
    return scored(spark, d).groupBy("dataset").agg(F.round(F.avg(-F.pow(1 - pt, 2) * F.ln(pt)), 6).alias("focal_loss"))


def q_dataset_stats(spark, d):
    rows = table(spark, d, "function_records").groupBy("dataset").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    return rows.withColumn("positive_ratio", F.round(F.col("positive") / F.greatest("n_rows", F.lit(1)), 6))


def q_top_projects(spark, d):
    name = F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown"))
    return table(spark, d, "function_records").groupBy(name.alias("project")).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "project").limit(10)


def q_latest_predictions(spark, d):
    """Each record's last attempt by time, then by probability; combined before the shuffle, so no record's rows are gathered."""
    attempts = table(spark, d, "predictions").where("record_id is not null").groupBy("record_id").agg(F.count("*").alias("attempts"))
    return latest(spark, d).join(attempts, "record_id").select("record_id", "attempts", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("last_us"), "prediction", "decision_source", F.round("calibrated_probability", 6).alias("p"))


_F1_AT = """, g AS (SELECT DISTINCT dataset, round(p, 6) AS t FROM s), r AS (SELECT g.dataset, g.t, round(coalesce(2 * sum(CASE WHEN s.p >= g.t THEN y ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (s.p >= g.t) + sum(y), 0), 0), 9) AS f1 FROM g JOIN s ON g.dataset = s.dataset GROUP BY ALL)"""
_CLIP = "greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p))"
QUERIES = {f.__name__: f for f in (q_confusion_metrics, q_roc_auc, q_pr_auc, q_brier_nll, q_ece, q_threshold_low, q_threshold_high_f1, q_threshold_best_f1, q_temperature_grid, q_risk_bands, q_prob_histogram, q_focal_loss, q_dataset_stats, q_top_projects, q_latest_predictions)}
ORACLES = {
    "q_confusion_metrics": _LATEST + """, s AS (SELECT *, ground_truth AS y FROM l WHERE ground_truth IS NOT NULL), c AS (SELECT dataset, count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (y = 0 AND prediction = 0) AS tn, count(*) FILTER (y = 0 AND prediction = 1) AS fp, count(*) FILTER (y = 1 AND prediction = 0) AS fn
  FROM s WHERE prediction IS NOT NULL GROUP BY dataset)
SELECT *, round(coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "q_roc_auc": _SCORED + """ SELECT a.dataset, round(avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS roc_auc FROM s a JOIN s b ON a.dataset = b.dataset AND a.y = 1 AND b.y = 0 GROUP BY a.dataset""",
    "q_pr_auc": _STEPS + "SELECT dataset, round(sum(coalesce(pos::DOUBLE / nullif(all_pos, 0), 0) * tp / n_up), 6) AS pr_auc FROM t GROUP BY dataset",
    "q_brier_nll": _SCORED + f" SELECT dataset, round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP})), 6) AS nll FROM s GROUP BY dataset",
    "q_ece": _SCORED + ", e AS (SELECT dataset, CASE " + " ".join(f"WHEN p < {EDGES[i + 1]!r}::DOUBLE THEN {i}" for i in range(9)) + " ELSE 9 END AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY ALL) SELECT dataset, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM e GROUP BY dataset",
    "q_threshold_low": _SCORED + ", g AS (SELECT DISTINCT dataset, round(p, 6) AS t FROM s), r AS (SELECT g.dataset, g.t, sum(CASE WHEN s.p > g.t THEN y ELSE 0 END)::DOUBLE / nullif(sum(y), 0) AS recall FROM g JOIN s USING (dataset) GROUP BY ALL) SELECT dataset, coalesce(max(t) FILTER (recall >= 0.995::DOUBLE), 0) AS tau_low FROM r GROUP BY dataset",
    "q_threshold_high_f1": _SCORED + _F1_AT + """, m AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN t > 0.2::DOUBLE THEN 0 ELSE 1 END, f1 DESC, t) AS nth FROM r)
SELECT dataset, CASE WHEN t > 0.2::DOUBLE THEN t ELSE 0.5::DOUBLE END AS tau_high, round(CASE WHEN t > 0.2::DOUBLE THEN f1 ELSE (SELECT coalesce(2 * sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (p >= 0.5) + sum(y), 0), 0) FROM s WHERE s.dataset = m.dataset) END, 6) AS f1 FROM m WHERE nth = 1""",
    "q_threshold_best_f1": _SCORED + _F1_AT + """, m AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN t >= 0.3::DOUBLE THEN 0 ELSE 1 END, f1 DESC, t) AS nth FROM r)
SELECT dataset, CASE WHEN t >= 0.3::DOUBLE THEN t ELSE 0.3::DOUBLE END AS tau_high, round(CASE WHEN t >= 0.3::DOUBLE THEN f1 ELSE 0 END, 6) AS f1 FROM m WHERE nth = 1""",
    "q_temperature_grid": _SCORED + f""", g AS (SELECT dataset, y, i, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 1 / (1 + exp(-ln({_CLIP} / (1 - {_CLIP})) / (0.5::DOUBLE + i * 0.05::DOUBLE))))) AS q FROM s, range(91) r(i)),
o AS (SELECT dataset, i, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 9) AS nll FROM g GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY nll, i) AS nth FROM o) SELECT dataset, round(0.5::DOUBLE + i * 0.05::DOUBLE, 2) AS temperature, round(nll, 6) AS nll FROM m WHERE nth = 1""",
    "q_risk_bands": _SCORED + " SELECT dataset, CASE WHEN p <= 0.1::DOUBLE THEN 'skip' WHEN p >= 0.6::DOUBLE THEN 'high' ELSE 'inspect' END AS band, count(*) AS n_rows, sum(y)::BIGINT AS n_positive, round(avg(p), 6) AS mean_p FROM s GROUP BY ALL",
    "q_prob_histogram": _SCORED + " SELECT y, least(19, floor(p * 20))::INTEGER AS bin, count(*) AS n_rows FROM s GROUP BY ALL",
    "q_focal_loss": _SCORED + f", q AS (SELECT dataset, CASE WHEN y = 1 THEN {_CLIP} ELSE 1 - {_CLIP} END AS pt FROM s) SELECT dataset, round(avg(-power(1 - pt, 2) * ln(pt)), 6) AS focal_loss FROM q GROUP BY dataset",
    "q_dataset_stats": "SELECT dataset, count(*) AS n_rows, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, round(count(*) FILTER (label = 1)::DOUBLE / count(*), 6) AS positive_ratio FROM function_records GROUP BY dataset",
    "q_top_projects": "SELECT coalesce(nullif(project, ''), 'unknown') AS project, count(*) AS n_rows FROM function_records GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "q_latest_predictions": _LATEST + " SELECT record_id, attempts, epoch_us(recorded_at) AS last_us, prediction, decision_source, round(calibrated_probability, 6) AS p FROM l JOIN (SELECT record_id, count(*) AS attempts FROM predictions GROUP BY record_id) USING (record_id)",
}
