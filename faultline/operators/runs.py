"""State of a run over records: what is to be done, what is done, chunks, and what is wrong with the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the version of prediction rows that counts.
VERSION = 1
#: What a prediction row must have.
NEEDED = ("record_id", "dataset", "ground_truth", "prediction", "decision_source", "risk_band", "calibrated_probability")
#: Rows of one key are numbered in parts of so many values of the order column.
PART = 1 << 20


def split_name(split: Column) -> Column:
    """``train``, ``val`` or ``test`` of a name in any case with blanks around it (valid and validation are val), else null."""
    name = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return F.when(name == "train", "train").when(name.isin("val", "valid", "validation"), "val").when(name == "test", "test")


def with_split(records: DataFrame) -> DataFrame:
    return records.withColumn("split_name", split_name(F.col("split")))


def targets(records: DataFrame) -> DataFrame:
    """``record_id, dataset, row_id, split_name`` of the records of the evaluation splits; a record that was delivered again stands at its first row."""
    rows = with_split(records.where("record_id is not null"))
    first = rows.groupBy("record_id").agg(F.min_by(F.struct("dataset", "row_id", "split_name"), "row_id").alias("r")).select("record_id", "r.*")
    return first.where("split_name in ('val', 'test')")


def resolved(predictions: DataFrame, version: int = VERSION) -> DataFrame:
    """Ids that have a resolved row of the version asked for; rows of other versions count as not there."""
    return predictions.where((F.col("schema_version") == version) & (F.col("resolution_status") == "resolved") & F.col("record_id").isNotNull()).select("record_id").distinct()


def pending(goal: DataFrame, done: DataFrame) -> DataFrame:
    return goal.join(done.select("record_id"), "record_id", "left_anti")


def chunks(df: DataFrame, by: Sequence[str], order: str, size: int) -> DataFrame:
    """``df`` with ``position`` (from 0, by the integer ``order`` within the columns ``by``) and ``chunk``.

    Positions are built in two levels, from the counts of ranges of ``order``
    and the places within them, so that no task holds all rows of a key.
    """
    if size < 1:
        raise ValueError("a chunk has at least one row")
    rows = df.withColumn("_part", F.floor(F.col(order) / PART))
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    r, c = rows.alias("r"), counts.alias("c")
    same = F.col("r._part") == F.col("c._part")
    for name in by:
        same = same & F.col(f"r.{name}").eqNullSafe(F.col(f"c.{name}"))
    place = F.row_number().over(Window.partitionBy(*(F.col(f"r.{n}") for n in by), F.col("r._part")).orderBy(F.col(f"r.{order}")))
    rows = r.join(c, same).select("r.*", (F.col("c._before") + place - 1).alias("position")).drop("_part")
    return rows.withColumn("chunk", F.floor(F.col("position") / size))


def chunk_bounds(total: int, index: int, size: int) -> tuple[int, int]:
    if size < 1 or index < 0:
        raise ValueError("a chunk has a size above 0 and an index of 0 or more")
    return index * size, min(total, (index + 1) * size)


def compatible(version: int = VERSION) -> Column:
    """Whether a prediction row is resolved, of the version and has all it needs."""
    ok = (F.col("schema_version") == version) & (F.col("resolution_status") == "resolved") & ~F.isnan("calibrated_probability")
    for name in NEEDED:
        ok = ok & F.col(name).isNotNull()
    return F.coalesce(ok, F.lit(False))


def validation(predictions: DataFrame, version: int = VERSION) -> DataFrame:
    """One row: how many rows are of another version, unresolved or incomplete, how many ids are repeated, and whether all is well."""
    other = ~F.coalesce(F.col("schema_version") == version, F.lit(False))
    open_ = ~F.coalesce(F.col("resolution_status") == "resolved", F.lit(False))
    gap = F.isnan("calibrated_probability")
    for name in NEEDED:
        gap = gap | F.col(name).isNull()
    # ids first, so that they are counted once
    by = predictions.groupBy("record_id").agg(F.count("*").alias("n"), F.count_if(other).alias("o"), F.count_if(open_).alias("u"), F.count_if(F.coalesce(gap, F.lit(True))).alias("g"))
    sums = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "n_rows"), ("o", "other_version"), ("u", "unresolved"), ("g", "incomplete"))), F.count_if(F.col("record_id").isNotNull() & (F.col("n") > 1)).alias("repeated_ids"))
    return sums.withColumn("valid", (F.col("other_version") == 0) & (F.col("unresolved") == 0) & (F.col("incomplete") == 0) & (F.col("repeated_ids") == 0))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the largest ``order`` of every key; combined before the shuffle."""
    columns = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def cached(prompts: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``prompts`` whose key the cache holds, with what it holds (one entry for a key), and all others."""
    known = cache.where(F.col(key).isNotNull()).dropDuplicates([key])
    return prompts.join(known, key), prompts.join(known.select(key), key, "left_anti")
