"""Lexical features of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as X


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def lexical_features(df: DataFrame, code: str) -> DataFrame:
    """``df`` with the twelve lexical features of ``code``. Everything is computed in place; null code counts as empty."""
    rows = df.withColumn("_text", X.normalize_code(F.col(code))).withColumns({"_tokens": X.tokens_of(F.col("_text")), "_calls": X.calls(F.col("_text"))})
    n = F.greatest(F.size("_tokens"), F.lit(1))
    line_count, call_count = F.size(X.lines(F.col("_text"))), F.size("_calls")
    risky = F.size(F.filter("_calls", lambda c: F.lower(c).isin(*X.RISKY)))
    rows = rows.withColumns({"_n": n, "_l": line_count, "_c": call_count, "_r": risky})
    t, some_lines = F.col("_tokens"), F.greatest(F.col("_l"), F.lit(1))
    return rows.withColumns(
        {
            "log_token_count": F.log1p("_n"),
            "unique_token_ratio": _div(F.size(F.array_distinct(t)), F.col("_n")),
            "log_line_count": F.log1p("_l"),
            "parameter_count": X.head_parameters(F.col("_text")).cast("double"),
            "log_call_count": F.log1p("_c"),
            "risky_call_count": F.col("_r").cast("double"),
            "risky_call_ratio": _div(F.col("_r"), F.greatest(F.col("_c"), F.lit(1))),
            "control_density": _div(X.count_in(t, X.CONTROL), F.col("_n")),
            "pointer_density": _div(X.pointer_marks(F.col("_text")), some_lines),
            "array_access_density": _div(X.occurrences(F.col("_text"), "["), some_lines),
            "numeric_literal_density": _div(X.count_in(t, ["num_lit"]), F.col("_n")),
            "memory_ops_count": X.count_in(t, X.MEMORY).cast("double"),
        }
    ).drop("_text", "_tokens", "_calls", "_n", "_l", "_c", "_r")


LEXICAL = (
    "log_token_count unique_token_ratio log_line_count parameter_count log_call_count risky_call_count risky_call_ratio control_density pointer_density array_access_density "
    "numeric_literal_density memory_ops_count"
).split()
