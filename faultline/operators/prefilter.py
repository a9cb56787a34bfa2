"""Training and scoring of a prefilter with three branches, from a feature table.

A branch for the meaning (embedding) and one for structure (numeric features)
are logistic models; a third one fuses their scores with the numeric features.
Classes and hard negatives are weighed; of several penalties the one with the
best average precision on held-out rows is kept.  Tables may be of any size:
fits are distributed, and all that is kept is weights.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.maths import logit
from faultline.workspace import materialize

PENALTIES = (0.01, 0.1)
#: Share of the training rows that choose the penalty.
HELD_OUT = 0.2


def usable(df: DataFrame, numeric: str, embedding: str, dims: tuple[int, int]) -> DataFrame:
    """``df`` with ``_numeric`` and ``_embedding`` as vectors; missing, odd or NaN parts count as 0, so every row can be scored."""

    def clean(c: str, size: int) -> Column:
        x = F.coalesce(F.when(F.size(c) == size, F.col(c)), F.array_repeat(F.lit(0.0), size)).cast("array<double>")
        return array_to_vector(F.transform(x, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))))

    return df.withColumns({"_numeric": clean(numeric, dims[0]), "_embedding": clean(embedding, dims[1])})


def class_weight(df: DataFrame, label: str) -> Column:
    """Weight of a row: positives count as much more as they are fewer, but no less than 1."""
    pos, neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    return F.when(F.col(label) == 1, max(1.0, neg / max(pos, 1))).otherwise(1.0)


def _branch(df: DataFrame, held: DataFrame, features: str, out: str) -> PipelineModel:
    best = None
    for penalty in PENALTIES:
        model = LogisticRegression(featuresCol=f"_{out}_scaled", labelCol="_label", weightCol="_weight", regParam=penalty, maxIter=30, probabilityCol=f"_{out}_probability", rawPredictionCol=f"_{out}_raw", predictionCol=f"_{out}_prediction")
        pipeline = Pipeline(stages=[StandardScaler(inputCol=features, outputCol=f"_{out}_scaled", withMean=True), model]).fit(df)
        found = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol=f"_{out}_raw", metricName="areaUnderPR").evaluate(pipeline.transform(held)) if held is not None else 0.0
        if best is None or found > best[0]:
            best = (found, pipeline)
    return best[1]


def _scored(df: DataFrame, model: PipelineModel, out: str) -> DataFrame:
    rows = model.transform(df).withColumn(f"{out}_score", vector_to_array(f"_{out}_probability")[1])
    return rows.drop(f"_{out}_scaled", f"_{out}_probability", f"_{out}_raw", f"_{out}_prediction")


def _fused(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["_semantic_logit", "_graph_logit", "_numeric"], outputCol="_fused").transform(df.withColumns({f"_{b}_logit": logit(F.col(f"{b}_score")) for b in ("semantic", "graph")}))


def fit(df: DataFrame, record_id: str, label: str, hard: float = 0.8, hard_weight: float = 2.0) -> dict[str, PipelineModel]:
    """The branches ``semantic``, ``graph`` and ``fusion`` fitted on the labelled rows of ``df`` (of :func:`usable`).

    After a first fit, negatives whose fused score lies in the top part of all
    negatives' (from the quantile ``hard`` on) weigh more in a second one.
    """
    rows = materialize(df.where(F.col(label).isin(0, 1)).select(record_id, label, "_numeric", "_embedding").withColumn("_label", F.col(label).cast("double")))
    if rows.select("_label").distinct().count() < 2:
        raise ValueError("both classes are needed")
    rows = rows.withColumn("_weight", class_weight(rows, label))
    u = F.pmod(F.xxhash64(F.lit("held"), record_id), F.lit(1000)) / 1000
    models: dict[str, PipelineModel] = {}
    for last in (False, True):
        train, held = rows.where(u >= HELD_OUT), rows.where(u < HELD_OUT)
        for out, features in (("semantic", "_embedding"), ("graph", "_numeric")):
            models[out] = _branch(train, held, features, out)
        scored = materialize(_fused(_scored(_scored(rows, models["semantic"], "semantic"), models["graph"], "graph")))
        models["fusion"] = _branch(scored.where(u >= HELD_OUT), scored.where(u < HELD_OUT), "_fused", "fusion")
        if not last:
            first = _scored(scored, models["fusion"], "fusion")
            cut = first.where("_label = 0").agg(F.percentile("fusion_score", min(0.99, max(0.5, hard)))).first()[0]
            is_hard = (F.col("_label") == 0) & (F.col("fusion_score") >= cut)
            rows = first.withColumn("_weight", F.when(is_hard, F.col("_weight") * hard_weight).otherwise(F.col("_weight"))).select(*rows.columns)
    return models


def score(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """``df`` (of :func:`usable`) with ``semantic_score``, ``graph_score`` and ``fusion_score``."""
    rows = _fused(_scored(_scored(df, models["semantic"], "semantic"), models["graph"], "graph"))
    return _scored(rows, models["fusion"], "fusion").drop("_semantic_logit", "_graph_logit", "_fused", "_numeric", "_embedding")


def save(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load(path: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{path}/{name}") for name in ("semantic", "graph", "fusion")}
