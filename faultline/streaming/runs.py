"""A run over records as a stream: files that arrive are routed and appended once, and a restart goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline.plans.routing import route


def decided(df: DataFrame, low: float, high: float, proxy: str = "probability") -> DataFrame:
    """``df`` (with ``p``) with ``risk_band``, ``needs_call`` and the ``prediction`` made without one; a null score is inspected and told 0."""
    band, said = route(F.col("p"), low, high, proxy)
    return df.withColumns({"risk_band": F.when(F.col("p").isNull(), "inspect").otherwise(band), "prediction": F.coalesce(F.when(F.col("p").isNull(), 0).otherwise(said), F.lit(0))}).withColumn("needs_call", F.col("risk_band") == "inspect")


def run(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame], files: int = 64) -> None:
    """Takes all files of ``source`` that no earlier run has taken, ``files`` at a time, and appends what ``decide`` makes of them to the folder ``target``.

    The checkpoint tells what has been taken.  A batch that is taken again after
    a failure overwrites its own part of the target, so no row is doubled; of
    records delivered twice within a batch the last is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_of(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The row of the last batch for every key."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select(key, "_r.*")
