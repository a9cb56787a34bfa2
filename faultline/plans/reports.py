"""Reports over predictions, runs and datasets: resume, chunks, validation, comparison, projects, latencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.maths import ratio
from faultline.operators import runs
from faultline.operators.calibration import mcnemar_p
from faultline.plans.scores import _LATEST, latest
from faultline.workspace import table

UNKNOWN = "unknown"
#: Rows and columns of the error report, in their order.
ERRORS = ("Correct", "False Positive", "False Negative")
BANDS = ("skip", "inspect", "high")


def mean_ms(c: str) -> Column:
    """Mean of milliseconds; the sum is rounded first, as its last digits depend on the order of rows."""
    return F.round(F.round(F.sum(c), 3) / F.count(c), 4)


def judged(spark, d):
    """Last attempts with a label and a prediction, with ``error_type``, ``is_correct``, ``project`` of the record (missing: unknown) and latencies, 0 where missing."""
    rows = latest(spark, d).where("ground_truth is not null and prediction is not null")
    error = F.when(F.col("ground_truth") == F.col("prediction"), "Correct").when(F.col("prediction") == 1, "False Positive").otherwise("False Negative")
    projects = table(spark, d, "function_records").where("record_id is not null").groupBy("record_id").agg(F.min_by("project", "row_id").alias("project"))
    parts = [F.coalesce(F.nullif(c, F.lit(float("nan"))), F.lit(0.0)).alias(c) for c in ("graph_latency_ms", "retrieval_latency_ms", "llm_latency_ms")]
    rows = rows.select("record_id", "dataset", "ground_truth", "prediction", "decision_source", "risk_band", F.coalesce("llm_called", F.lit(False)).alias("llm_called"), F.coalesce("llm_cache_hit", F.lit(False)).alias("llm_cache_hit"), "llm_confidence", "calibrated_probability", *parts, error.alias("error_type"))
    rows = rows.withColumns({"is_correct": F.col("error_type") == "Correct", "runtime_ms": F.col("graph_latency_ms") + F.col("retrieval_latency_ms") + F.col("llm_latency_ms")})
    return rows.join(projects, "record_id", "left").withColumn("project", F.coalesce(F.nullif("project", F.lit("")), F.lit(UNKNOWN)))


_JUDGED = _LATEST + """, pr AS (SELECT record_id, arg_min(coalesce(project, chr(0)), row_id) AS project FROM function_records WHERE record_id IS NOT NULL GROUP BY record_id),
j AS (SELECT record_id, dataset, ground_truth, prediction, decision_source, risk_band, coalesce(llm_called, false) AS llm_called, coalesce(llm_cache_hit, false) AS llm_cache_hit, llm_confidence, calibrated_probability,
  coalesce(nullif(nullif(project, ''), chr(0)), 'unknown') AS project, CASE WHEN ground_truth = prediction THEN 'Correct' WHEN prediction = 1 THEN 'False Positive' ELSE 'False Negative' END AS error_type, ground_truth = prediction AS is_correct,
  coalesce(graph_latency_ms, 0) AS graph_latency_ms, coalesce(retrieval_latency_ms, 0) AS retrieval_latency_ms, coalesce(llm_latency_ms, 0) AS llm_latency_ms, coalesce(graph_latency_ms, 0) + coalesce(retrieval_latency_ms, 0) + coalesce(llm_latency_ms, 0) AS runtime_ms
  FROM l LEFT JOIN pr USING (record_id) WHERE ground_truth IS NOT NULL AND prediction IS NOT NULL)"""


def q_project_report(spark, d):
    """Size, accuracy, share of calls, mean runtime and errors of every project."""
    return (
        judged(spark, d)
        .groupBy("project")
        .agg(
            F.count("*").alias("samples"),
            F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("accuracy"),
            F.round(F.avg(F.col("llm_called").cast("double")), 6).alias("call_rate"),
            mean_ms("runtime_ms").alias("mean_runtime_ms"),
            F.count_if(F.col("error_type") == "False Positive").alias("false_positives"),
            F.count_if(F.col("error_type") == "False Negative").alias("false_negatives"),
            F.count_if(~F.col("is_correct")).alias("errors"),
        )
    )


def q_projects_by_errors(spark, d):
    """The ten projects of the most errors."""
    return q_project_report(spark, d).orderBy(F.desc("errors"), F.desc("samples"), "project").limit(10).select("project", "errors", "samples")


def q_error_mix_pivot(spark, d):
    """Records by risk band and kind of error, with 0 for what doesn't occur, totals and accuracy."""
    names = spark.createDataFrame([(b,) for b in BANDS], "risk_band string")
    mix = judged(spark, d).groupBy("risk_band").pivot("error_type", list(ERRORS)).count()
    mix = names.join(mix, "risk_band", "left").select("risk_band", *(F.coalesce(F.col(f"`{e}`"), F.lit(0)).alias(e.lower().replace(" ", "_")) for e in ERRORS))
    total = F.col("correct") + F.col("false_positive") + F.col("false_negative")
    return mix.withColumns({"total": total, "accuracy": F.round(ratio(F.col("correct"), total), 6)})


def q_source_mix_pivot(spark, d):
    """The same by decision source."""
    mix = judged(spark, d).groupBy("decision_source").pivot("error_type", list(ERRORS)).count()
    return mix.select("decision_source", *(F.coalesce(F.col(f"`{e}`"), F.lit(0)).alias(e.lower().replace(" ", "_")) for e in ERRORS))


def q_latency_p95(spark, d):
    """Totals, means and 95th percentiles of every stage's latency, over records that were sent out."""
    rows = judged(spark, d).where("llm_called")
    stages = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(c).alias("ms")) for s, c in (("graph", "graph_latency_ms"), ("retrieval", "retrieval_latency_ms"), ("llm", "llm_latency_ms"), ("record", "runtime_ms")))))
    rows = rows.select("dataset", stages.alias("s")).select("dataset", "s.*")
    return rows.groupBy("dataset", "stage").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 3).alias("total_ms"), mean_ms("ms").alias("mean_ms"), F.round(F.percentile("ms", 0.95), 4).alias("p95_ms"))


def q_error_histogram(spark, d):
    """Twenty equal bins of probability by kind of error."""
    rows = judged(spark, d).where("calibrated_probability is not null")
    return rows.groupBy("error_type", F.least(F.lit(19), F.floor(F.col("calibrated_probability") * 20)).cast("int").alias("bin")).agg(F.count("*").alias("n_rows"))


def q_top_errors(spark, d, n: int = 20):
    """The ``n`` most confident false positives and least confident false negatives, the slower first where equal."""
    confidence = F.coalesce("llm_confidence", "calibrated_probability")
    rows = judged(spark, d).withColumn("confidence", confidence)
    out = []
    for kind, sign in (("False Positive", F.desc_nulls_last("confidence")), ("False Negative", F.asc_nulls_last("confidence"))):
        best = rows.where(F.col("error_type") == kind).orderBy(sign, F.desc("runtime_ms"), "record_id").limit(n)
        out.append(best.withColumn("rank", F.row_number().over(Window.orderBy(sign, F.desc("runtime_ms"), "record_id"))))  # at most n rows
    return out[0].unionByName(out[1]).select("error_type", "rank", "record_id", F.round("confidence", 6).alias("confidence"), F.round("runtime_ms", 4).alias("runtime_ms"))


def q_run_state(spark, d):
    """Resolved records, calls, cache hits and mean latencies of every dataset's run, and whether it is complete: as many records as its validation and test splits hold."""
    mean = lambda c: mean_ms(c).alias(c.replace("_ms", "_mean_ms"))
    done = judged(spark, d).groupBy("dataset").agg(F.count("*").alias("resolved"), F.count_if("llm_called").alias("llm_calls"), F.count_if("llm_cache_hit").alias("llm_cache_hits"), mean("graph_latency_ms"), mean("retrieval_latency_ms"), mean("llm_latency_ms"), mean("runtime_ms"))
    goal = runs.targets(table(spark, d, "function_records")).groupBy("dataset").agg(F.count("*").alias("target"))
    rows = goal.join(done, "dataset", "full").fillna(0, ["resolved", "target", "llm_calls", "llm_cache_hits"])
    return rows.withColumns({"llm_call_ratio": F.round(ratio(F.col("llm_calls"), F.greatest("resolved", F.lit(1))), 6), "complete": F.col("resolved") == F.col("target")})


def q_resume_pending(spark, d):
    """Records of the evaluation splits that have no resolved prediction of the current version yet."""
    return runs.pending(runs.targets(table(spark, d, "function_records")), runs.resolved(table(spark, d, "predictions"))).select("record_id", "dataset")


def q_chunk_plan(spark, d, size: int = 64):
    """Chunks of ``size`` records in the order of their rows, and those that are not yet resolved in each."""
    goal = runs.chunks(runs.targets(table(spark, d, "function_records")), ["dataset"], "row_id", size)
    done = runs.resolved(table(spark, d, "predictions")).select("record_id", F.lit(True).alias("done"))
    rows = goal.join(done, "record_id", "left")
    return rows.groupBy("dataset", "chunk").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end"), F.count_if(F.col("done").isNull()).alias("unresolved"))


def q_validation_report(spark, d):
    """What is wrong with the predictions, counted: rows of another version, unresolved, without a needed value, repeated ids."""
    return runs.validation(table(spark, d, "predictions"))


def q_mcnemar(spark, d):
    """Exact test of the stored predictions against the prefilter's own (fusion score of 0.5 or more), on records that have both."""
    rows = latest(spark, d).where("ground_truth is not null and prediction is not null and prefilter_fusion_score is not null and not isnan(prefilter_fusion_score)")
    a, b = (F.col("prefilter_fusion_score") >= 0.5).cast("int") == F.col("ground_truth"), F.col("prediction") == F.col("ground_truth")
    counts = rows.groupBy("dataset").agg(F.count_if(a & ~b).alias("n01"), F.count_if(~a & b).alias("n10"))
    p = F.udf(lambda x, y: round(mcnemar_p(x, y), 6), "double")  # a row for each dataset
    return counts.withColumn("p_value", p("n01", "n10"))


def q_bootstrap_f1(spark, d, rounds: int = 500, seed: str = "bootstrap"):
    """Mean and 2.5 and 97.5 % points of F1 over ``rounds`` samples of as many records, each drawn as often as a Poisson variable of mean 1 says.

    A round needs the sums of three kinds of records only; they are added within each task, so rows are never copied to another.
    """
    rows = latest(spark, d).where("ground_truth is not null and prediction is not null")
    kind = F.when((F.col("ground_truth") == 1) & (F.col("prediction") == 1), "tp").when(F.col("prediction") == 1, "fp").when(F.col("ground_truth") == 1, "fn")
    rows = rows.select("record_id", "dataset", kind.alias("kind")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "record_id", "round"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    # the Poisson distribution's sums for 0, 1, ...: a record's draws are the sums its number lies above
    sums, term, total = [], 0.36787944117144233, 0.0
    for i in range(12):
        total += term
        sums.append(total)
        term /= i + 1
    draws = F.aggregate(F.array(*(F.lit(s) for s in sums)), F.lit(0), lambda a, s: a + (u > s).cast("int"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, draws).otherwise(0))
    f1 = rows.groupBy("dataset", "round").agg(ratio(2 * of("tp"), 2 * of("tp") + of("fp") + of("fn")).alias("f1"))
    return f1.groupBy("dataset").agg(F.round(F.avg("f1"), 6).alias("mean"), F.round(F.percentile("f1", 0.025), 6).alias("low"), F.round(F.percentile("f1", 0.975), 6).alias("high"))


def q_legacy_three_class(spark, d):
    """Accuracy, precision, recall and F1 where what can't be read as a label is a third class, which counts against accuracy only."""
    text = F.lower(F.trim("llm_label"))
    said = F.when(text == "1", 1).when(text == "0", 0).otherwise(2)
    rows = latest(spark, d).where("ground_truth is not null and llm_called").select("dataset", F.col("ground_truth").alias("y"), said.alias("z"))
    c = lambda y, z: F.count_if((F.col("y") == y) & (F.col("z") == z))
    sums = rows.groupBy("dataset").agg(F.count("*").alias("n"), c(1, 1).alias("tp"), c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return sums.select("dataset", "n", F.round(ratio(tp + tn, F.col("n")), 6).alias("accuracy"), F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def q_consolidated_macro(spark, d):
    """State and quality of every dataset's run, and the mean over those evaluated, of what is known."""
    names = table(spark, d, "function_records").where("dataset is not null").select("dataset").distinct()
    state = q_run_state(spark, d).select("dataset", "resolved", "target")
    q = judged(spark, d).groupBy("dataset").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.try_divide(F.count_if(F.col("is_correct") & (F.col("prediction") == 1)).cast("double"), F.count_if(F.col("ground_truth") == 1).cast("double")).alias("recall"))
    rows = names.join(state, "dataset", "left").join(q, "dataset", "left")
    status = F.when(F.coalesce("resolved", F.lit(0)) == 0, "not_started").when(F.col("resolved") < F.col("target"), "incomplete").otherwise("evaluated")
    rows = rows.select("dataset", status.alias("status"), "accuracy", "recall")
    macro = rows.where("status <> 'not_started'").agg(F.lit("macro average").alias("dataset"), F.lit("summary").alias("status"), F.avg("accuracy").alias("accuracy"), F.avg("recall").alias("recall"))
    return rows.unionByName(macro).select("dataset", "status", F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"))


def q_label_counts(spark, d):
    """Records by a field, what is missing or empty as unknown: source format, CWE and graph backend of the last attempts."""
    rows = latest(spark, d)
    field = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(f, F.lit("")), F.lit(UNKNOWN)).alias("value")) for f in ("decision_source", "graph_backend_used", "resolution_status"))))
    return rows.select(field.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def q_bank_counts(spark, d):
    """Demonstrations by label and graph backend, missing as unknown."""
    rows = table(spark, d, "demo_bank").groupBy(F.coalesce("graph_backend", F.lit(UNKNOWN)).alias("graph_backend"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"))


def q_backends_by_split(spark, d):
    """The graph backends that each split's features come from, in order."""
    splits = runs.with_split(table(spark, d, "function_records").where("record_id is not null")).groupBy("record_id").agg(F.min_by("split_name", "row_id").alias("split_name"))
    rows = table(spark, d, "feature_store").join(splits, "record_id")
    return rows.where("graph_backend is not null").groupBy("split_name").agg(F.array_join(F.array_sort(F.collect_set("graph_backend")), ",").alias("backends"))


QUERIES = {
    f.__name__: f
    for f in (
        q_project_report, q_projects_by_errors, q_error_mix_pivot, q_source_mix_pivot, q_latency_p95, q_error_histogram, q_top_errors, q_run_state, q_resume_pending, q_chunk_plan,
        q_validation_report, q_mcnemar, q_bootstrap_f1, q_legacy_three_class, q_consolidated_macro, q_label_counts, q_bank_counts, q_backends_by_split,
    )
}

_SPLIT = r"lower(regexp_replace(split, '^[\s\x0b\x1c-\x1f\x{85}\pZ]+|[\s\x0b\x1c-\x1f\x{85}\pZ]+$', '', 'g'))"
_NAME = f"CASE WHEN {_SPLIT} = 'train' THEN 'train' WHEN {_SPLIT} IN ('val', 'valid', 'validation') THEN 'val' WHEN {_SPLIT} = 'test' THEN 'test' END"
_TARGETS = f"tg AS (SELECT record_id, arg_min(dataset, row_id) AS dataset, min(row_id) AS row_id, arg_min(coalesce({_NAME}, ''), row_id) AS split_name FROM function_records WHERE record_id IS NOT NULL GROUP BY record_id HAVING split_name IN ('val', 'test'))"
_RESOLVED = "rs AS (SELECT DISTINCT record_id FROM predictions WHERE schema_version = 1 AND resolution_status = 'resolved' AND record_id IS NOT NULL)"
_REPORT = """pj AS (SELECT project, count(*) AS samples, round(avg(is_correct::INT), 6) AS accuracy, round(avg(llm_called::INT), 6) AS call_rate, round(CAST(CAST(round(sum(runtime_ms), 3) / count(runtime_ms) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS mean_runtime_ms,
  count(*) FILTER (error_type = 'False Positive') AS false_positives, count(*) FILTER (error_type = 'False Negative') AS false_negatives, count(*) FILTER (NOT is_correct) AS errors FROM j GROUP BY project)"""
_STATE = f"""{_TARGETS}, dn AS (SELECT dataset, count(*) AS resolved, count(*) FILTER (llm_called) AS llm_calls, count(*) FILTER (llm_cache_hit) AS llm_cache_hits, round(CAST(CAST(round(sum(graph_latency_ms), 3) / count(graph_latency_ms) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS graph_latency_mean_ms, round(CAST(CAST(round(sum(retrieval_latency_ms), 3) / count(retrieval_latency_ms) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS retrieval_latency_mean_ms,
  round(CAST(CAST(round(sum(llm_latency_ms), 3) / count(llm_latency_ms) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS llm_latency_mean_ms, round(CAST(CAST(round(sum(runtime_ms), 3) / count(runtime_ms) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS runtime_mean_ms FROM j GROUP BY dataset), gl AS (SELECT dataset, count(*) AS target FROM tg GROUP BY dataset),
rn AS (SELECT dataset, coalesce(target, 0) AS target, coalesce(resolved, 0) AS resolved, coalesce(llm_calls, 0) AS llm_calls, coalesce(llm_cache_hits, 0) AS llm_cache_hits, graph_latency_mean_ms, retrieval_latency_mean_ms, llm_latency_mean_ms, runtime_mean_ms,
  round(coalesce(llm_calls, 0)::DOUBLE / greatest(coalesce(resolved, 0), 1), 6) AS llm_call_ratio, coalesce(resolved, 0) = coalesce(target, 0) AS complete FROM gl FULL JOIN dn USING (dataset))"""
ORACLES = {
    "q_project_report": _JUDGED + ", " + _REPORT + " SELECT * FROM pj",
    "q_projects_by_errors": _JUDGED + ", " + _REPORT + " SELECT project, errors, samples FROM pj ORDER BY errors DESC, samples DESC, project LIMIT 10",
    "q_error_mix_pivot": _JUDGED + """, b AS (SELECT * FROM (VALUES ('skip'), ('inspect'), ('high')) v(risk_band)),
c AS (SELECT b.risk_band, count(*) FILTER (error_type = 'Correct') AS correct, count(*) FILTER (error_type = 'False Positive') AS false_positive, count(*) FILTER (error_type = 'False Negative') AS false_negative FROM b LEFT JOIN j ON b.risk_band = j.risk_band GROUP BY b.risk_band)
SELECT *, correct + false_positive + false_negative AS total, round(coalesce(correct::DOUBLE / nullif(correct + false_positive + false_negative, 0), 0), 6) AS accuracy FROM c""",
    "q_source_mix_pivot": _JUDGED + " SELECT decision_source, count(*) FILTER (error_type = 'Correct') AS correct, count(*) FILTER (error_type = 'False Positive') AS false_positive, count(*) FILTER (error_type = 'False Negative') AS false_negative FROM j GROUP BY decision_source",
    "q_latency_p95": _JUDGED + """, st AS (SELECT dataset, unnest(['graph', 'retrieval', 'llm', 'record']) AS stage, unnest([graph_latency_ms, retrieval_latency_ms, llm_latency_ms, runtime_ms]) AS ms FROM j WHERE llm_called)
SELECT dataset, stage, count(*) AS n, round(sum(ms), 3) AS total_ms, round(CAST(CAST(round(sum(ms), 3) / count(ms) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS mean_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM st GROUP BY ALL""",
    "q_error_histogram": _JUDGED + " SELECT error_type, least(19, floor(calibrated_probability * 20))::INTEGER AS bin, count(*) AS n_rows FROM j WHERE calibrated_probability IS NOT NULL GROUP BY ALL",
    "q_top_errors": _JUDGED + """, c AS (SELECT *, coalesce(llm_confidence, calibrated_probability) AS confidence FROM j WHERE NOT is_correct),
n AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'False Positive' THEN -confidence ELSE confidence END NULLS LAST, runtime_ms DESC, record_id)::INTEGER AS rank FROM c)
SELECT error_type, rank, record_id, round(confidence, 6) AS confidence, round(runtime_ms, 4) AS runtime_ms FROM n WHERE rank <= 20""",
    "q_run_state": _JUDGED + ", " + _STATE + " SELECT * FROM rn",
    "q_resume_pending": f"WITH {_TARGETS}, {_RESOLVED} SELECT record_id, dataset FROM tg WHERE record_id NOT IN (SELECT record_id FROM rs)",
    "q_chunk_plan": f"""WITH {_TARGETS}, {_RESOLVED}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1 AS position FROM tg)
SELECT dataset, position // 64 AS chunk, min(position) AS start, max(position) + 1 AS "end", count(*) FILTER (record_id NOT IN (SELECT record_id FROM rs)) AS unresolved FROM p GROUP BY ALL""",
    "q_validation_report": """WITH f AS (SELECT count(*) AS n_rows, count(*) FILTER (schema_version IS DISTINCT FROM 1) AS other_version, count(*) FILTER (resolution_status IS DISTINCT FROM 'resolved') AS unresolved,
  count(*) FILTER (record_id IS NULL OR dataset IS NULL OR ground_truth IS NULL OR prediction IS NULL OR decision_source IS NULL OR risk_band IS NULL OR calibrated_probability IS NULL OR CAST(calibrated_probability AS VARCHAR) = 'nan') AS incomplete FROM predictions),
r AS (SELECT count(*) AS repeated_ids FROM (SELECT record_id FROM predictions WHERE record_id IS NOT NULL GROUP BY record_id HAVING count(*) > 1)) SELECT *, other_version = 0 AND unresolved = 0 AND incomplete = 0 AND repeated_ids = 0 AS valid FROM f, r""",
    "q_mcnemar": _LATEST + """, c AS (SELECT dataset, count(*) FILTER (((prefilter_fusion_score >= 0.5)::INT = ground_truth) AND prediction <> ground_truth) AS n01, count(*) FILTER (((prefilter_fusion_score >= 0.5)::INT <> ground_truth) AND prediction = ground_truth) AS n10
  FROM l WHERE ground_truth IS NOT NULL AND prediction IS NOT NULL AND CAST(prefilter_fusion_score AS VARCHAR) <> 'nan' GROUP BY dataset)
SELECT *, CASE WHEN n01 + n10 = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(n01, n10) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2.0::DOUBLE))))), 6) END AS p_value FROM c""",
    "q_legacy_three_class": _LATEST + """, x AS (SELECT dataset, ground_truth AS y, CASE lower(trim(llm_label)) WHEN '1' THEN 1 WHEN '0' THEN 0 ELSE 2 END AS z FROM l WHERE ground_truth IS NOT NULL AND llm_called),
c AS (SELECT dataset, count(*) AS n, count(*) FILTER (y = 1 AND z = 1) AS tp, count(*) FILTER (y = 0 AND z = 0) AS tn, count(*) FILTER (y = 0 AND z = 1) AS fp, count(*) FILTER (y = 1 AND z = 0) AS fn FROM x GROUP BY dataset)
SELECT dataset, n, round(coalesce((tp + tn)::DOUBLE / nullif(n, 0), 0), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "q_consolidated_macro": _JUDGED + ", " + _STATE + """, qa AS (SELECT dataset, avg(is_correct::INT) AS accuracy, count(*) FILTER (is_correct AND prediction = 1)::DOUBLE / nullif(count(*) FILTER (ground_truth = 1), 0) AS recall FROM j GROUP BY dataset),
al AS (SELECT dataset, CASE WHEN coalesce(resolved, 0) = 0 THEN 'not_started' WHEN resolved < target THEN 'incomplete' ELSE 'evaluated' END AS status, accuracy, recall FROM (SELECT DISTINCT dataset FROM function_records WHERE dataset IS NOT NULL) LEFT JOIN rn USING (dataset) LEFT JOIN qa USING (dataset))
SELECT dataset, status, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall FROM al UNION ALL SELECT 'macro average', 'summary', round(avg(accuracy), 6), round(avg(recall), 6) FROM al WHERE status <> 'not_started'""",
    "q_label_counts": _LATEST + """, x AS (SELECT unnest(['decision_source', 'graph_backend_used', 'resolution_status']) AS field, unnest([coalesce(nullif(decision_source, ''), 'unknown'), coalesce(nullif(graph_backend_used, ''), 'unknown'), coalesce(nullif(resolution_status, ''), 'unknown')]) AS value FROM l)
SELECT field, value, count(*) AS n FROM x GROUP BY ALL""",
    "q_bank_counts": "SELECT coalesce(graph_backend, 'unknown') AS graph_backend, count(*) AS total, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives FROM demo_bank GROUP BY 1",
    "q_backends_by_split": f"""WITH sp AS (SELECT record_id, nullif(arg_min(coalesce({_NAME}, ''), row_id), '') AS split_name FROM function_records WHERE record_id IS NOT NULL GROUP BY record_id)
SELECT split_name, array_to_string(list_sort(list(DISTINCT graph_backend)), ',') AS backends FROM feature_store JOIN sp USING (record_id) WHERE graph_backend IS NOT NULL GROUP BY split_name""",
}
