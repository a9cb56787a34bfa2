"""Graphs that another program has exported as DOT text: nodes, edges, merging, and walking a tree of any depth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from faultline.functions import text as X

# Forms of lines, and names of edges.
NODE = r'^\s*"?([^"\s]+)"?\s*\[\s*label\s*=\s*"(.*)"\s*\]\s*;?\s*$'
EDGE = r'^\s*"?([^"\s]+)"?\s*->\s*"?([^"\s]+)"?(?:\s*\[(.*?)\])?\s*;?\s*$'
LABEL = r'label\s*=\s*"([^"]+)"'
ALIASES = {"AST": "IS_AST_PARENT", "CFG": "FLOWS_TO", "CDG": "CONTROLS", "DDG": "REACHES", "DOMINATE": "DOM", "POST_DOMINATE": "POST_DOM", "REACHING_DEF": "REACHES"}
AST_TOKENS = 512


def node_label(label: Column) -> tuple[Column, Column]:
    """Type and code of a label ``(type,code,more)``; without code the rest stands in."""
    text = X.strip(label)
    inner = F.when(text.startswith("(") & text.endswith(")"), F.substring(text, F.lit(2), F.char_length(text) - 2)).otherwise(text)
    parts = F.split(inner, ",", 3)
    kind = F.coalesce(F.nullif(F.when(F.size(parts) > 1, X.strip(F.get(parts, 0))).otherwise(inner), F.lit("")), F.lit("UNKNOWN"))
    code = F.coalesce(F.nullif(X.strip(F.get(parts, 1)), F.lit("")), X.strip(F.get(parts, 2)), F.lit(""))
    return kind, code


def edge_type(attributes: Column, default: Column) -> Column:
    label = F.regexp_extract(attributes, LABEL, 1)
    name = F.get(F.split(F.upper(F.regexp_replace(X.strip(label), "[- ]", "_")), ":"), 0)
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.when(label == "", default).otherwise(F.coalesce(F.try_element_at(known, name), F.nullif(name, F.lit("")), default))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(graph, id, type, code)`` and ``edges(graph, source, target, type)`` of ``lines(graph, part, n, line, default_type)``.

    ``part`` is the place of the representation a line comes from, ``n`` its
    number.  A node that several tell is as the last one says; edges count once.
    """
    is_node = F.col("line").rlike(NODE)
    kind, code = node_label(F.regexp_extract("line", NODE, 2))
    nodes = lines.where(is_node).select("graph", F.regexp_extract("line", NODE, 1).alias("id"), F.struct("part", "n").alias("at"), kind.alias("type"), code.alias("code"))
    nodes = nodes.withColumn("code", X.truncate_text(F.coalesce(F.nullif("code", F.lit("")), F.col("type")), 120))
    nodes = nodes.groupBy("graph", "id").agg(F.max_by(F.struct("type", "code"), "at").alias("r")).select("graph", "id", "r.*")
    found = lines.where(~is_node & F.col("line").rlike(EDGE))
    edges = found.select("graph", F.regexp_extract("line", EDGE, 1).alias("source"), F.regexp_extract("line", EDGE, 2).alias("target"), edge_type(F.regexp_extract("line", EDGE, 3), F.col("default_type")).alias("type")).distinct()
    return nodes, edges


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    n = nodes.select("graph", "id").distinct()
    return edges.join(n.withColumnRenamed("id", "source"), ["graph", "source"], "left_semi").join(n.withColumnRenamed("id", "target"), ["graph", "target"], "left_semi")


def order_of(node_id: Column) -> tuple[Column, Column]:
    """Numbers first, by their value, then other ids."""
    return (~node_id.rlike(r"^\d+$")).cast("int"), F.when(node_id.rlike(r"^\d+$"), F.lpad(node_id, 20, "0")).otherwise(node_id)


def cut(nodes: DataFrame, most: int = 72) -> DataFrame:
    """The first ``most`` nodes of every graph, with their ``rank``."""
    w = Window.partitionBy("graph").orderBy(*order_of(F.col("id")))
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def rendered(nodes: DataFrame) -> DataFrame:
    """``graph, text``: a line for each node with id, type and code, cut."""
    line = F.concat_ws("\t", "id", "type", X.truncate_text(F.col("code"), 90))
    rows = cut(nodes).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return rows.select("graph", F.concat(F.lit("NodeID\tNodeType\tCode\n"), F.array_join("rows.line", "\n")).alias("text"))


def walk(nodes: list, edges: list) -> str:
    """The tree from the first method on (else from the first node) in brackets, its first 512 tokens; without recursion, every node once."""
    order = lambda i: (not i.isdigit(), i.zfill(20) if i.isdigit() else i)
    kinds = {n["id"]: n["type"] for n in sorted(nodes, key=lambda n: order(n["id"]))}
    if not kinds:
        return ""
    below: dict[str, set] = {}
    for e in edges:
        if e["type"] == "IS_AST_PARENT" and e["source"] in kinds and e["target"] in kinds:
            below.setdefault(e["source"], set()).add(e["target"])
    out, seen, todo = [], set(), [(next((i for i, k in kinds.items() if k == "METHOD"), next(iter(kinds))), False)]
    while todo and len(out) < AST_TOKENS:
        node, done = todo.pop()
        if done:
            out += [")", kinds[node]]
        elif node not in seen:
            seen.add(node)
            out += ["(", kinds[node]]
            todo.append((node, True))
            todo += [(c, False) for c in sorted(below.get(node, ()), key=order, reverse=True)]
    return " ".join(out[:AST_TOKENS])


@F.pandas_udf(StringType())
def _walk(nodes: pd.Series, edges: pd.Series) -> pd.Series:
    return pd.Series([walk(list(n), list(e)) for n, e in zip(nodes, edges, strict=True)])


def ast_sequences(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, ast_sequence`` of parsed graphs; a graph is one function, so it fits into a row."""
    n = nodes.groupBy("graph").agg(F.collect_list(F.struct("id", "type")).alias("nodes"))
    e = edges.groupBy("graph").agg(F.collect_list(F.struct("source", "target", "type")).alias("edges"))
    none = F.array().cast("array<struct<source:string,target:string,type:string>>")
    return n.join(e, "graph", "left").select("graph", _walk(F.col("nodes"), F.coalesce("edges", none)).alias("ast_sequence"))
