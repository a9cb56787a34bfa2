"""A function's heuristic graph, built inside its row: no shuffle, no window.

Node 1 is the method, then its parameters, then each of the first 40 lines,
every line followed by the calls it makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as X

LINES, EDGES, AST_TOKENS = 40, 96, 512


def node_type(line: Column) -> Column:
    """CONTROL_STRUCTURE, EXPRESSION, CALL or STATEMENT; a control keyword counts wherever a line starts with its letters."""
    low = F.lower(line)
    control = low.rlike("^(" + "|".join(X.CONTROL) + ")") | low.rlike("(" + "|".join(X.CONTROL) + r") ?\(")
    called = F.contains(line, F.lit("(")) & F.contains(line, F.lit(")"))
    return F.when(control, "CONTROL_STRUCTURE").when(called, "CALL").when(F.contains(line, F.lit("=")), "EXPRESSION").otherwise("STATEMENT")


def with_statements(df: DataFrame, code: str) -> DataFrame:
    """``df`` with ``_name``, ``_params`` and ``_stmts``: the lines with their type, calls, identifiers, definitions and node id."""
    rows = df.withColumn("_text", X.normalize_code(F.col(code)))
    rows = rows.withColumns({"_name": X.function_name(F.col("_text")), "_params": X.signature_parameters(F.col("_text")), "_lines": F.slice(X.lines(F.col("_text")), 1, LINES)})

    def parts(line: Column) -> Column:
        lowered = F.transform(F.regexp_extract_all(line, F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)), lambda x: F.lower(x))
        return F.struct(
            line.alias("line"),
            node_type(line).alias("type"),
            X.line_calls(line).alias("calls"),
            F.array_distinct(F.filter(lowered, lambda x: ~x.isin(*X.CONTROL))).alias("uses"),
            F.transform(F.regexp_extract_all(line, F.lit(r"\b([A-Za-z_]\w*)\s*="), F.lit(1)), lambda x: F.lower(x)).alias("defs"),
        )

    rows = rows.withColumn("_stmts", F.transform("_lines", parts))
    # the id of each line, and of what would follow the last one
    ids = F.aggregate("_stmts", F.array(F.col("_params") + 2), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + 1 + F.size(s["calls"]))))
    rows = rows.withColumn("_stmts", F.get(F.transform(F.array(ids), lambda n: F.transform("_stmts", lambda s, i: F.struct(F.get(n, i).alias("id"), s["line"].alias("line"), s["type"].alias("type"), s["calls"].alias("calls"), s["uses"].alias("uses"), s["defs"].alias("defs")))), 0))
    return rows.drop("_text", "_lines")


def nodes(df: DataFrame) -> DataFrame:
    """``df`` (of :func:`with_statements`) with ``nodes``: ``array<struct<id, type, code>>`` in the order of their ids."""
    node = lambda i, t, c: F.struct(i.cast("int").alias("id"), t.alias("type"), c.alias("code"))
    method = F.array(node(F.lit(1), F.lit("METHOD"), X.truncate_text(F.concat("_name", F.lit("()")), 120)))
    params = F.transform(F.when(F.col("_params") > 0, F.sequence(F.lit(1), F.col("_params"))).otherwise(F.array().cast("array<int>")), lambda k: node(k + 1, F.lit("PARAM"), F.concat(F.lit("param_"), k.cast("string"))))
    stmts = F.flatten(F.transform("_stmts", lambda s: F.concat(F.array(node(s["id"], s["type"], X.truncate_text(s["line"], 120))), F.transform(s["calls"], lambda c, k: node(s["id"] + k + 1, F.lit("CALL"), X.truncate_text(F.concat(c, F.lit("(...)")), 120))))))
    return df.withColumn("nodes", F.concat(method, params, stmts))


def edges(df: DataFrame) -> DataFrame:
    """``df`` (of :func:`with_statements`) with ``edges``: ``array<struct<source, target, type>>``, each once, ordered by ends (as numbers) and type."""
    edge = lambda a, b, t: F.struct(a.cast("int").alias("source"), b.cast("int").alias("target"), F.lit(t).alias("type"))
    params = F.transform(F.when(F.col("_params") > 0, F.sequence(F.lit(1), F.col("_params"))).otherwise(F.array().cast("array<int>")), lambda k: edge(F.lit(1), k + 1, "IS_AST_PARENT"))
    method = F.transform("_stmts", lambda s: edge(F.lit(1), s["id"], "IS_AST_PARENT"))
    called = F.flatten(F.transform("_stmts", lambda s: F.transform(s["calls"], lambda c, k: edge(s["id"], s["id"] + k + 1, "IS_AST_PARENT"))))
    flows = F.filter(F.transform("_stmts", lambda s, i: edge(s["id"], F.get(F.col("_stmts"), i + 1)["id"], "FLOWS_TO")), lambda e: e["target"].isNotNull())

    # every definition with its node; ids grow with lines, so the last earlier definition is the largest id below
    defs = F.flatten(F.transform("_stmts", lambda s: F.transform(s["defs"], lambda name: F.struct(name.alias("name"), s["id"].alias("id")))))

    def reaching_of(d: Column) -> Column:
        known = F.array_distinct(d["name"])

        def reaching(s: Column) -> Column:
            last = lambda name: F.array_max(F.transform(F.filter(d, lambda x: (x["name"] == name) & (x["id"] < s["id"])), lambda x: x["id"]))
            return F.filter(F.transform(F.array_intersect(s["uses"], known), lambda name: edge(last(name), s["id"], "REACHES")), lambda e: e["source"].isNotNull())

        return F.flatten(F.transform("_stmts", reaching))

    reaches = F.get(F.transform(F.array(defs), reaching_of), 0)
    return df.withColumn("edges", F.sort_array(F.array_distinct(F.concat(params, method, called, flows, reaches))))


def ast_sequence(df: DataFrame) -> DataFrame:
    """``df`` (of :func:`with_statements`) with ``ast_sequence``: the tree written out in brackets, its first 512 tokens."""
    leaf = lambda t: F.array(F.lit("("), t, F.lit(")"), t)
    params = F.flatten(F.transform(F.when(F.col("_params") > 0, F.sequence(F.lit(1), F.col("_params"))).otherwise(F.array().cast("array<int>")), lambda k: leaf(F.lit("PARAM"))))
    stmts = F.flatten(F.transform("_stmts", lambda s: F.concat(F.array(F.lit("("), s["type"]), F.flatten(F.transform(s["calls"], lambda c: leaf(F.lit("CALL")))), F.array(F.lit(")"), s["type"]))))
    none = F.array().cast("array<string>")
    whole = F.concat(F.array(F.lit("("), F.lit("METHOD")), F.coalesce(params, none), F.coalesce(stmts, none), F.array(F.lit(")"), F.lit("METHOD")))
    return df.withColumn("ast_sequence", F.array_join(F.slice(whole, 1, AST_TOKENS), " "))
