"""Queries over the feature table: the prefilter's scores and the features of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import features, prefilter, runs
from faultline.plans.code import GRAPH, _code, graph_features
from faultline.workspace import table


def _features(spark, d):
    splits = runs.with_split(table(spark, d, "function_records").where("record_id is not null")).groupBy("record_id").agg(F.min_by("split_name", "row_id").alias("split_name"))
    rows = table(spark, d, "feature_store").where("record_id is not null").join(splits, "record_id")
    return prefilter.usable(rows, "numeric_features", "semantic_embeddings", (24, 64))


def q_prefilter_scores(spark, d):
    """Scores of the validation and test records by a prefilter fitted on the training records."""
    rows = _features(spark, d)
    models = prefilter.fit(rows.where("split_name = 'train'"), "record_id", "label")
    scored = prefilter.score(rows.where("split_name in ('val', 'test')"), models)
    return scored.select("record_id", "split_name", "label", *(F.round(c, 6).alias(c) for c in ("semantic_score", "graph_score", "fusion_score")))


def q_feature_vector(spark, d):
    """All 24 numeric features of every function, in their order, written with four decimals."""
    rows = graph_features(features.lexical_features(_code(spark, d), "code"), "code")
    values = F.array(*(F.format_string("%.4f", c) for c in (*features.LEXICAL, *GRAPH)))
    return rows.select("row_id", F.array_join(values, " ").alias("features"))


QUERIES = {f.__name__: f for f in (q_prefilter_scores, q_feature_vector)}
ORACLES: dict[str, str] = {}
