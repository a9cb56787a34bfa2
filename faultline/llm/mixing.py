"""Collections in which each source has its target share of the tokens.

Every source first gives all its documents as many whole times as its target
allows.  What is missing is a sample of fixed size with unequal probabilities,
by Pareto order sampling: a document's rank is its random odds divided by the
odds of its inclusion, and the smallest ranks are taken until the missing tokens
are reached.  The rank at which that happens comes from distributed selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.hot_keys import select_ranks
from faultline.workspace import join_groups, materialize

BAND = "int(floor(log2(n)))"


def allocation(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source has and what it must give.

    ``docs`` has ``source, n`` (tokens), ``targets`` has ``source,
    target_share, max_uses``.  Result, a row for every source of ``targets``:
    ``source, target_share, max_uses, available, n_docs, wanted, reachable, whole, rest``.
    ``wanted`` is target_share times the tokens of all documents of these
    sources; a source is ``reachable`` if max_uses times its tokens are no less.
    ``whole`` uses of every document are certain, ``rest`` tokens are to be
    sampled beyond (0 if out of reach).  Null shares and uses count as 0.
    Sources of documents that ``targets`` lacks play no part; a source that
    ``targets`` repeats has the sum of its shares and the largest of its uses.
    """
    goals = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_uses"), F.lit(0)).alias("max_uses"))
    have = docs.groupBy("source").agg(F.sum("n").alias("available"), F.count("*").alias("n_docs"))
    rows = goals.join(have, "source", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0))})
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("available").alias("total"))))  # one row
    rows = rows.withColumn("wanted", F.col("target_share") * F.coalesce("total", F.lit(0))).withColumn("reachable", F.col("max_uses") * F.col("available") >= F.col("wanted"))
    whole = F.least(F.col("max_uses").cast("long"), F.coalesce(F.floor(F.try_divide("wanted", "available")), F.lit(0)))
    rows = rows.withColumn("whole", whole)
    return rows.withColumn("rest", F.when(F.col("whole") < F.col("max_uses"), F.round(F.col("wanted") - F.col("whole") * F.col("available"))).otherwise(0).cast("long")).drop("total")


def _chances(bands: DataFrame) -> DataFrame:
    """``source, band, chance`` for ``source, rest, band, n``: inclusion probability proportional to the band's number + 1, at most 1, so that the expected tokens are the rest."""
    own = bands.groupBy("source", "rest").agg(F.collect_list(F.struct("band", "n")).alias("bands"))  # at most 64 a source

    def halve(range_: Column, _: Column) -> Column:  # the expected tokens grow with the factor
        mid = (range_["low"] + range_["high"]) / 2
        expected = F.aggregate("bands", F.lit(0.0), lambda a, b: a + F.least(F.lit(1.0), mid * (b["band"] + 1)) * b["n"])
        return F.when(expected < F.col("rest"), F.struct(mid.alias("low"), range_["high"].alias("high"))).otherwise(F.struct(range_["low"].alias("low"), mid.alias("high")))

    factor = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve, lambda r: r["high"])
    return own.withColumn("factor", factor).select("source", "factor", F.explode("bands").alias("b")).select("source", "b.band", F.least(F.lit(1.0), F.col("factor") * (F.col("b.band") + 1)).alias("chance"))


def mix(docs: DataFrame, targets: DataFrame, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Uses of every document and the shares that are reached.

    ``docs`` has ``doc_id, source, n`` (tokens, null counting as 0), ``targets``
    as in :func:`allocation`.
    Returns ``uses(doc_id, source, n, uses)`` of the documents that are used, and
    ``report(source, target_share, max_uses, available, reachable, n_documents,
    max_used, tokens, share_reached)``, a row for every target source.  No
    document is used more than max_uses times.  A source misses its tokens by at
    most half its document at the border, or by what is out of reach.
    Documents without tokens are never used.  A document id that is repeated
    within a source is drawn at once in all its rows.
    """
    docs = docs.select("doc_id", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n > 0 and source is not null")
    plan = materialize(allocation(docs, targets))
    total = plan.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    docs = join_groups(docs, plan.select("source", "n_docs", "whole", "rest"), "source", "n_docs", total)
    bands = docs.where("rest > 0").groupBy("source", "rest", F.expr(BAND).alias("band")).agg(F.sum("n").alias("n"), F.count("*").alias("n_band"))
    bands = materialize(bands)
    chances = _chances(bands.select("source", "rest", "band", "n")).join(bands.select("source", "band", "n_band"), ["source", "band"])
    draw = join_groups(docs.where("rest > 0").withColumn("band", F.expr(BAND)), chances, ["source", "band"], "n_band", total)
    u = (F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = u / (1 - u) * (1 - F.col("chance")) / F.col("chance")
    draw = materialize(draw.select("doc_id", "source", "n", "n_docs", "rest", (odds / (1 + odds)).alias("place")))  # in the order of the odds, within [0, 1)
    base = draw.select(F.col("source").alias("k"), F.col("place").alias("v"), F.col("n").alias("w"))
    ranks = draw.groupBy(F.col("source").alias("k"), "rest", F.col("n_docs").alias("n")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.sum(draw.n).alias("sum"))
    border = select_ranks(base, ranks.select("k", F.lit(0).alias("i"), F.least("rest", "sum").alias("rank"), "lo", "hi", "n"))
    # the document at the border is taken if that comes nearer
    border = border.join(plan.select(F.col("source").alias("k"), "rest", "n_docs"), "k").select(F.col("k").alias("source"), "n_docs", "v", (2 * (F.col("rest") - F.col("below")) >= F.col("at")).alias("closed"))
    taken = join_groups(draw.select("doc_id", "source", "place"), border, "source", "n_docs", total).where((F.col("place") < F.col("v")) | (F.col("closed") & (F.col("place") == F.col("v"))))
    taken = taken.select("doc_id", "source").distinct().withColumn("more", F.lit(1))
    d, t = docs.alias("d"), taken.alias("t")
    uses = d.join(t, F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.source") == F.col("t.source")), "left").select("d.doc_id", "d.source", "d.n", (F.col("d.whole") + F.coalesce("t.more", F.lit(0))).alias("uses")).where("uses > 0")
    got = uses.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("uses").alias("max_used"), F.sum(F.col("n") * F.col("uses")).alias("tokens"))
    got = plan.join(got, "source", "left")
    got = got.crossJoin(F.broadcast(got.agg(F.sum("tokens").alias("all"))))
    report = got.select("source", "target_share", "max_uses", "available", "reachable", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("max_used", F.lit(0)).alias("max_used"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0)), 6).alias("share_reached"))
    return uses, report
