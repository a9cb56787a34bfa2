"""Shared storage for intermediate tables, and joins without a hot task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing and the master is local (tests) is a
    temporary folder used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="faultline-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage; the copy survives the loss of executors and is columnar,
    so later stages read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/faultline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


#: A group that holds at least one of so many rows is heavy; there are at most as many.
HEAVY = 1024


def join_groups(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, of which each has one row and its number of ``rows`` in the column ``size``.

    Groups of a thousandth of the ``total`` rows or more are at most
    :data:`HEAVY`, whatever the data: they are broadcast, and their rows stay
    where they are.  All other groups are joined by a shuffle, in which no key
    holds more than a thousandth.  ``how`` is inner or left.  Null keys meet nothing.
    ``groups`` is counted first, so it should be a written table or a small one.
    """
    keys = [on] if isinstance(on, str) else on
    more = [c for c in groups.columns if c not in keys]
    is_heavy = F.col(size) * HEAVY >= total
    n_heavy, n_light = groups.agg(F.count_if(is_heavy), F.count_if(~is_heavy)).first()
    if n_heavy + n_light <= HEAVY:
        return rows.join(F.broadcast(groups), keys, how).select(*rows.columns, *more)
    if not n_heavy and how == "inner":
        return rows.join(groups, keys).select(*rows.columns, *more)
    heavy, light = groups.where(is_heavy), groups.where(~is_heavy)
    told = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left")
    first = told.where("_heavy").select(*rows.columns, *more)
    rest = told.where("_heavy is null").select(*rows.columns)
    if how == "left":  # a null key would be gathered in one task
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        none = rest.where(~known).withColumns({c: F.lit(None).cast(groups.schema[c].dataType) for c in more})
        return first.unionByName(none).unionByName(rest.where(known).join(light, keys, "left").select(*rows.columns, *more))
    return first.unionByName(rest.join(light, keys).select(*rows.columns, *more))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its few small files would leave most of them idle during heavy work on each row.

    Asks the plan's scans alone: to count the partitions of the plan would run its shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    tasks = max(leaves.apply(i).execute().getNumPartitions() for i in range(leaves.size()))
    return df if tasks >= cores else df.repartition(2 * cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
