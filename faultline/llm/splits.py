"""Train, validation and test splits that keep related records together.

Related values are the components of a graph, found by contracting each
component's least edge (Borůvka's method); the contracted edges form a spanning
forest, which is kept as a table.  Roots are then dealt to the splits by size band.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.workspace import join_groups, materialize

#: A group that holds at least one of so many rows is dealt by itself; there are at most as many.
HEAD = 1024
#: The groups of a stratum are numbered in so many parts at most for each million groups.
PART_ROWS = 100_000
#: The golden ratio's fraction: its multiples fill [0, 1) evenly at every length.
GOLDEN = 0.6180339887498949


def _jump(parent: DataFrame) -> DataFrame:
    """Every node's root, by doubling the length of the pointers until none moves."""
    while True:
        p, q = parent.alias("p"), parent.alias("q")
        jumped = materialize(p.join(q, F.col("p.to") == F.col("q.at"), "left").select("p.at", F.coalesce("q.to", "p.to").alias("to"), (F.coalesce("q.to", "p.to") != F.col("p.to")).alias("moved")))
        moved = not jumped.where("moved").isEmpty()
        parent = jumped.drop("moved")
        if not moved:
            return parent


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components and a minimum spanning forest of the graph ``edges(a, b, weight)``.

    Returns ``labels(node, root)`` for every node of an edge, the root being one
    node of the component, and ``forest(a, b, weight)``.  Ties of weight are
    broken by the ends, so that the choice of edges never closes a ring.  Null
    ends and loops are no edges; repeated edges count once.  Each round at
    least halves the number of components that still have an edge.
    """
    alive = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    nodes = alive.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("root")))
    alive = alive.where("a <> b").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    # u, v: the components that an edge joins; a, b: the edge as it was given
    alive = materialize(alive.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight", "a", "b"))
    chosen = []
    while not alive.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("u").alias("at"), F.col("v").alias("to")), F.struct(F.col("v").alias("at"), F.col("u").alias("to"))))
        least = alive.select(ends.alias("e"), F.struct("weight", "a", "b").alias("w")).groupBy("e.at").agg(F.min(F.struct("w", "e.to")).alias("m"))
        least = materialize(least.select("at", "m.to", "m.w.weight", "m.w.a", "m.w.b"))
        chosen.append(least.select("a", "b", "weight"))
        # two components that chose the same edge point at each other: the smaller becomes the root
        p, q = least.select("at", "to").alias("p"), least.select("at", "to").alias("q")
        mutual = (F.col("q.to") == F.col("p.at")) & (F.col("p.at") < F.col("p.to"))
        parent = p.join(q, F.col("p.to") == F.col("q.at"), "left").select("p.at", F.when(mutual, F.col("p.at")).otherwise(F.col("p.to")).alias("to"))
        root = _jump(materialize(parent))
        labels = materialize(labels.join(root, labels.root == root["at"], "left").select("node", F.coalesce("to", "root").alias("root")))
        r = root.select(F.col("at").alias("u"), F.col("to").alias("ru"))
        s = root.select(F.col("at").alias("v"), F.col("to").alias("rv"))
        moved = alive.join(r, "u").join(s, "v").where("ru <> rv")
        edge = F.min(F.struct("weight", "a", "b")).alias("w")
        alive = materialize(moved.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(edge).select("u", "v", "w.weight", "w.a", "w.b"))
    none = edges.select(F.col("a"), F.col("b"), F.col("weight").cast("double")).limit(0)
    return labels, materialize(reduce(DataFrame.unionByName, chosen, none).distinct())


def letters_and_digits(value: Column) -> Column:
    """The letters and digits (A-Z, a-z, 0-9) of a value in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_replace(value, "[^A-Za-z0-9]+", "")), F.lit(""))


def spelling_groups(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Stored values that mean the same: ``labels(value, root)`` and the spanning forest.

    Every value is joined to the entity that its letters and digits name.  Null
    and empty values are left out.  A value without any letter or digit is its
    own entity, under its own name.
    """
    values = df.select(F.col(column).alias("a")).where("a <> ''").distinct()
    entity = F.concat(F.lit("\x00"), F.coalesce(letters_and_digits(F.col("a")), F.concat(F.lit("\x00"), F.col("a"))))
    labels, forest = spanning_forest(values.select("a", entity.alias("b"), F.lit(1.0).alias("weight")))
    return labels.where("not startswith(node, '\\u0000')").select(F.col("node").alias("value"), "root"), forest


def spelling_pairs(df: DataFrame, column: str) -> DataFrame:
    """Pairs of different stored values of one entity: ``value_a < value_b`` in byte order.  The pairs are the result asked for; values are distinct, so rows play no part in their number."""
    labels, _ = spelling_groups(df, column)
    labels = labels.where(F.col("value").rlike("[A-Za-z0-9]"))
    a, b = labels.alias("a"), labels.alias("b")
    return a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.value") < F.col("b.value"))).select(F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))


def _deal_head(head: list, targets: list[tuple[str, float]], total: float, positives: float) -> tuple[dict, dict]:
    """Deal the largest groups one by one, largest band first, each to the split whose shortage it reduces most."""
    rows = {name: 0.0 for name, _ in targets}
    ones = {name: 0.0 for name, _ in targets}
    dealt = {}
    for unit in head:

        def cost(name: str) -> float:
            out = 0.0
            for other, share in targets:
                n, p = rows[other] + (unit.n if other == name else 0), ones[other] + (unit.p if other == name else 0)
                # what lies beyond a split's share can't be mended later, what is missing can; small splits count as much as large ones
                out += max(0.0, n - share * total) / max(share * total, 1.0) * 10 + ((n / max(share * total, 1.0) - 1) ** 2) * share
                out += 4.0 * (((p - positives / max(total, 1.0) * n) / max(share * positives, 1.0)) ** 2) * share
            return out

        best = min((name for name, _ in targets), key=lambda name: (cost(name), name))
        rows[best] += unit.n
        ones[best] += unit.p
        dealt[unit.unit] = best
    return dealt, rows


def assign_splits(df: DataFrame, targets: DataFrame, entity: str, label: str, alone: Sequence[str], seed: str = "split") -> DataFrame:
    """``df`` with ``split_name``: all rows of one entity, however it is written, share a split.

    ``targets(split_name, share)`` is a small table; shares count in proportion,
    null, negative and unnamed ones not at all.  Rows whose entity is null or
    empty have no relatives but those with the same values in the columns
    ``alone`` (null being a value).  A group that holds a thousandth of all rows
    or more is dealt by itself, by size; there can be at most :data:`HEAD` of
    these.  All others are numbered within their stratum (size band and rate of
    positive labels) and dealt systematically in the shares that are left.
    ``df`` may have any other columns; one named ``split_name`` is replaced.
    An empty input gives an empty result.
    """
    spark = df.sparkSession
    shares = [(r.split_name, float(r.share)) for r in targets.where("split_name is not null and share > 0").groupBy("split_name").agg(F.sum("share").alias("share")).orderBy("split_name").collect()]  # a handful of names
    if not shares:
        raise ValueError("no split has a share")
    whole = sum(s for _, s in shares)
    shares = [(name, s / whole) for name, s in shares]
    labels, _ = spelling_groups(df, entity)
    own = F.concat(F.lit("\x01"), F.to_json(F.struct(*(F.col(c) for c in alone)), {"ignoreNullFields": "false"}))
    base = df.drop("split_name")
    sizes = df.where(F.col(entity) != "").groupBy(F.col(entity).alias("value")).agg(F.count("*").alias("_n"))
    known = materialize(labels.join(sizes, "value").select(F.col("value").alias("_value"), F.col("root").alias("_root"), "_n"))
    rows = join_groups(base.withColumn("_value", F.nullif(F.col(entity), F.lit(""))), known, "_value", "_n", df.count(), "left")
    rows = rows.withColumn("_unit", F.coalesce("_root", own)).drop("_value", "_root", "_n")
    units = materialize(rows.groupBy(F.col("_unit").alias("unit")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")))
    total, positives = units.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0))).first()
    band = F.floor(F.log2("n")).cast("int")
    head = units.where(F.col("n") * HEAD >= total)
    dealt, have = _deal_head(head.withColumn("band", band).orderBy(F.desc("n"), F.desc("p"), F.xxhash64(F.lit(seed), "unit"), "unit").collect(), shares, float(total), float(positives))
    left = [(name, max(0.0, share * total - have[name])) for name, share in shares]
    rest = sum(x for _, x in left) or 1.0
    # the rest, in order of its chance: a group's place on [0, 1) falls into the stretch of one split
    stretch, upto = F.lit(shares[-1][0]), 1.0
    for name, x in reversed(left):
        upto -= x / rest
        stretch = F.when(F.col("place") < F.lit(upto + x / rest), F.lit(name)).otherwise(stretch)
    tail = units.where(F.col("n") * HEAD < total).withColumn("band", band)
    tail = tail.withColumn("rate", F.when(F.col("p") == 0, 0).when(F.col("p") * 5 < F.col("n"), 1).when(F.col("p") * 2 < F.col("n"), 2).otherwise(3))
    tail = tail.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(max(1, total // PART_ROWS))))
    turn = F.row_number().over(Window.partitionBy("band", "rate", "part").orderBy(F.xxhash64(F.lit(seed + "/"), "unit"), "unit"))
    start = F.pmod(F.xxhash64(F.lit(seed), "band", "rate", "part"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    place = turn * F.lit(GOLDEN) + start
    tail = tail.withColumn("place", place - F.floor(place)).select("unit", stretch.alias("split_name"), "n")
    first = spark.createDataFrame([(u, s) for u, s in dealt.items()], "unit string, split_name string").join(head.select("unit", "n"), "unit")
    deal = materialize(first.unionByName(tail).select(F.col("unit").alias("_unit"), "split_name", F.col("n").alias("_n")))
    return join_groups(rows, deal, "_unit", "_n", total, "left").drop("_unit", "_n")
