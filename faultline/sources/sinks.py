"""Sinks of records, splits, predictions and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.readers import required

INDEX = ["record_id", "dataset", "project", "label", "commit_id", "cwe_id", "code_hash", "source_path", "split"]


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An object a line, letters of all scripts as they are, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_index(df: DataFrame, path: str) -> None:
    """The nine columns that tell a record, as a table with a header."""
    required(df, INDEX).select(*INDEX).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split; rows without one are left out."""
    df.where(F.col(split).isNotNull()).write.mode("overwrite").partitionBy(split).option("ignoreNullFields", False).json(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """Adds the rows of a chunk; a task's rows appear at once or not at all."""
    df.write.mode("append").parquet(path)


def export_table(df: DataFrame, path: str) -> None:
    """A table for spreadsheets: with a header, its first name behind a byte order mark."""
    first, *others = df.columns
    df.coalesce(1).select(F.col(first).alias("\ufeff" + first), *others).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def report(df: DataFrame, path: str, title: str, most: int = 10_000) -> str:
    """A small report as JSON and CSV in a folder, and as a Markdown table, which is returned; larger ones are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else v if isinstance(v, str) else json.dumps(v, default=str)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows)]) + "\n"
