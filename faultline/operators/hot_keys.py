"""Per-key results over very unevenly spread keys.

Counts, sums and distinct counts are combined before they are shuffled.  Exact
quantiles come from distributed selection: every round counts the values of a
key in a histogram whose counts simply add up, keeps the one bin that holds the
wanted rank, and refines that bin, until it holds a single value.  A round
shuffles at most ``bins`` counts for a key and task, however many rows the key
has; no value of a hot key is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.workspace import join_groups, materialize


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 0..bins-1 of ``value`` in [lo, hi], non-decreasing in ``value``; ``lo`` and ``hi`` fall into different bins."""
    v, a, b = (x.cast("double") / 2 for x in (value, lo, hi))
    wide = F.floor((v - a) / F.when(b > a, b - a) * bins).cast("long")
    narrow = (value - lo).cast("long")  # integers so close that they are the same double
    return F.least(F.lit(bins - 1).cast("long"), F.when(b > a, wide).otherwise(narrow))


def select_ranks(base: DataFrame, state: DataFrame, bins: int = 2048) -> DataFrame:
    """For each wanted rank of a key the value at which the running weight reaches it.

    ``base`` has ``k, v, w`` (key, value, weight > 0), ``state`` has ``k, i, rank, lo, hi, n``: for key ``k`` and any label
    ``i`` a running weight above 0 and at most the key's sum, the key's least
    and greatest value, and its number of rows.  Result: ``k, i, v, below, at``: the smallest value v such that the
    weights of values <= v sum up to ``rank`` or more, the sum of the weights
    of smaller values, and that of v.  The ranks asked for one key are few: they
    meet its rows as one array.
    """
    state = state.withColumn("below", F.lit(0).cast(base.schema["w"].dataType))
    total = int(state.select("k", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    solved = []
    while True:
        state = materialize(state)
        solved.append(state.where("lo = hi").select("k", "i", F.col("lo").alias("v"), "below", "n"))
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        hit = _meet(base, state, F.struct("lo", "hi"), lambda v, a: (v >= a["lo"]) & (v <= a["hi"]), total).select("k", "a.lo", "a.hi", "v", "w")
        hit = hit.withColumn("bin", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins))
        counts = hit.groupBy("k", "lo", "hi", "bin").agg(F.sum("w").alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"))
        upto = Window.partitionBy("k", "lo", "hi").orderBy("bin")  # at most `bins` rows
        counts = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("under", F.col("upto") - F.col("c")).alias("h")
        s = state.alias("s")
        same = F.col("s.k").eqNullSafe(F.col("h.k")) & (F.col("s.lo") == F.col("h.lo")) & (F.col("s.hi") == F.col("h.hi"))
        holds = (F.col("s.rank") <= F.col("h.upto")) & (F.col("s.rank") > F.col("h.under"))
        state = s.join(counts, same & holds).select("s.k", "s.i", (F.col("s.rank") - F.col("h.under")).alias("rank"), F.col("h.mn").alias("lo"), F.col("h.mx").alias("hi"), "s.n", (F.col("s.below") + F.col("h.under")).alias("below"))
    found = materialize(reduce(DataFrame.unionByName, solved))
    at = _meet(base, found, F.col("v"), lambda v, a: v == a, total).groupBy("k", "v").agg(F.sum("w").alias("at")).alias("a")
    f = found.alias("f")
    return f.join(at, F.col("f.k").eqNullSafe(F.col("a.k")) & (F.col("f.v") == F.col("a.v"))).select("f.k", "f.i", "f.v", "f.below", "a.at")


def _meet(base: DataFrame, asked: DataFrame, what: Column, holds, total: int) -> DataFrame:
    """``k, v, w, a``: the rows of ``base`` with each ``what`` asked for their key that holds for their value."""
    keys = asked.groupBy(F.struct("k").alias("_key")).agg(F.max("n").alias("_n"), F.collect_set(what).alias("_asked"))  # a struct, so that a null key meets itself
    met = join_groups(base.select(F.struct("k").alias("_key"), "v", "w"), keys, "_key", "_n", total)
    return met.select("_key.k", "v", "w", F.explode(F.filter("_asked", lambda a: holds(F.col("v"), a))).alias("a"))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float], bins: int = 2048) -> DataFrame:
    """For each key its number of rows and values and its exact lower quantiles.

    Result: ``key, n_rows, n, quantiles`` where ``quantiles[i]`` is the smallest value v
    such that at least ``ceil(probs[i] * n)`` (at least 1) of the key's ``n`` values
    are <= v.  Null and NaN values are no values; a key without any value has
    n = 0 and null quantiles.  A null key is a key of its own.  Ties and
    repeated rows count as often as they occur.  An empty input gives an empty result.
    """
    return _quantiles(df, key, value, probs, bins).drop("p")


def _quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float], bins: int = 2048, positive: Column | None = None) -> DataFrame:
    """:func:`exact_quantiles` with ``p``, the number of rows for which ``positive`` holds."""
    if not probs or bins < 2 or not all(0 <= p <= 1 for p in probs):
        raise ValueError("probs within [0, 1] and at least 2 bins are needed")
    kind = df.schema[value].dataType.simpleString()
    wide = "double" if kind in ("float", "double") else "bigint"
    rows = df.select(F.col(key).alias("k"), F.nullif(F.col(value).cast(wide), F.lit(float("nan")).cast(wide) if wide == "double" else F.lit(None).cast(wide)).alias("v"), (positive if positive is not None else F.lit(False)).alias("p"))
    # the selection's first histogram: one bin for each key, and one for its missing values
    sizes = materialize(rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if("p").alias("p")))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("long").alias("rank")) for i, p in enumerate(probs))))
    state = sizes.where("n > 0").select("k", wanted.alias("w"), "lo", "hi", "n").select("k", "w.i", "w.rank", "lo", "hi", "n")
    base = rows.where("v is not null").select("k", "v", F.lit(1).cast("long").alias("w"))
    found = select_ranks(base, state, bins).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("q"))
    s, q = sizes.alias("s"), found.alias("q")
    return s.join(q, F.col("s.k").eqNullSafe(F.col("q.k")), "left").select(F.col("s.k").alias(key), "s.n_rows", "s.n", "s.p", F.col("q.q.v").alias("quantiles"))


def per_key_results(df: DataFrame, key: str, positive: str, distinct: str, value: str, probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Rows, positive labels, distinct values and exact quantiles of ``value`` for every key.

    Result: ``key, n_rows, total_rows, n_positive, n_distinct, n_values, quantiles``.  ``n_rows``,
    ``n_positive`` and ``n_values`` are the counts of the selection's first
    histogram; ``n_positive`` counts ``positive`` = 1 (null: no); ``n_distinct`` leaves nulls out;
    ``quantiles`` is null for a key without values.  A null key is a key of its
    own.  An empty input gives an empty result.
    """
    cuts = _quantiles(df, key, value, probs, positive=F.coalesce(F.col(positive) == 1, F.lit(False))).select(F.col(key).alias("k"), "n_rows", F.col("p").alias("n_positive"), F.col("n").alias("n_values"), "quantiles")
    total = cuts.agg(F.sum("n_rows").alias("total_rows"))
    spread = df.select(F.col(key).alias("k"), F.col(distinct).alias("d")).where("d is not null").groupBy("k", "d").agg(F.lit(1).alias("one"))
    unlike = spread.groupBy("k").agg(F.count("*").alias("n_distinct"))
    u, c = unlike.alias("u"), cuts.alias("c")
    return (
        c.join(u, F.col("c.k").eqNullSafe(F.col("u.k")), "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(F.col("c.k").alias(key), "n_rows", "total_rows", "n_positive", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "n_values", "quantiles")
    )
