"""Queries over unevenly spread keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.hot_keys import per_key_results
from faultline.workspace import table

#: A project is hot from this share of all rows on.
HOT_SHARE = 0.04


def _projects(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "function_records").withColumn("code_length", F.char_length("code"))
    return per_key_results(records, "project", "label", "code_hash", "code_length")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The stored project values that each hold at least 4 % of all rows."""
    return _projects(spark, d).where("project <> ''").where(F.col("n_rows") >= HOT_SHARE * F.col("total_rows")).select("project")


def p2_projects(spark: SparkSession, d: str) -> DataFrame:
    """Rows, positive labels, distinct hashes and exact quantiles of the code's length for every project."""
    q = F.col("quantiles")
    return _projects(spark, d).select("project", "n_rows", "n_positive", "n_distinct", "n_values", F.get(q, 0).alias("length_p50"), F.get(q, 1).alias("length_p90"), F.get(q, 2).alias("length_p99"))


QUERIES = {"p2_found": p2_found, "p2_projects": p2_projects}
ORACLES = {
    "p2_found": "SELECT project FROM function_records WHERE project <> '' GROUP BY project HAVING count(*) >= 0.04 * (SELECT count(*) FROM function_records)",
    "p2_projects": """
WITH v AS (SELECT project, length(code) AS n, row_number() OVER (PARTITION BY project ORDER BY length(code)) AS nth, count(*) OVER (PARTITION BY project) AS size FROM function_records WHERE code IS NOT NULL),
q AS (SELECT project, max(size) AS n_values,
  min(n) FILTER (nth >= greatest(1, ceil(0.5::DOUBLE * size))) AS length_p50, min(n) FILTER (nth >= greatest(1, ceil(0.9::DOUBLE * size))) AS length_p90, min(n) FILTER (nth >= greatest(1, ceil(0.99::DOUBLE * size))) AS length_p99
  FROM v GROUP BY project),
r AS (SELECT project, count(*) AS n_rows, count(*) FILTER (label = 1) AS n_positive, count(DISTINCT code_hash) AS n_distinct FROM function_records GROUP BY project)
SELECT r.project, n_rows, n_positive, n_distinct, coalesce(n_values, 0) AS n_values, length_p50, length_p90, length_p99 FROM r LEFT JOIN q ON r.project IS NOT DISTINCT FROM q.project""",
}
