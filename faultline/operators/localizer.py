"""Suspicious lines of a function, scored and cut into slices inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as X

# Term lists of the line score.
VALIDATION = "if while for assert check validate verify length size limit bound guard".split()
POINTERS = ["->", "*", "&", "[", "]"]
ARITHMETIC = "size len offset index".split()
BUFFERS = "ptr buf dst src data".split()
ERRORS = "error fail null nullptr invalid".split()


def _any(ts: Column, words: list[str]) -> Column:
    return F.arrays_overlap(ts, F.array(*(F.lit(w) for w in words)))


def branch_scale(semantic: Column, graph: Column, fusion: Column) -> Column:
    return F.lit(0.35) + 0.3 * semantic + 0.35 * graph + 0.2 * fusion


def line_score(line: Column) -> Column:
    """``struct<score, reasons>`` of one line, before scaling."""

    def build(text: Column, ts: Column, risky: Column) -> Column:
        has = lambda sign: F.contains(text, F.lit(sign))
        rules = (
            (F.size(risky) > 0, F.lit(3.0) + 0.4 * F.size(risky), F.concat(F.lit("risky_api="), F.array_join(F.slice(risky, 1, 3), ","))),
            (_any(ts, X.MEMORY), F.lit(1.6), F.lit("memory_op")),
            (_any(ts, POINTERS) | has("->"), F.lit(1.2), F.lit("pointer_or_array")),
            (text.rlike(r"[-+*/%]") & _any(ts, ARITHMETIC), F.lit(1.0), F.lit("index_arithmetic")),
            (_any(ts, VALIDATION), F.lit(0.8), F.lit("control_or_validation")),
            (has("=") & _any(ts, BUFFERS), F.lit(0.8), F.lit("buffer_assignment")),
            (_any(ts, ["return"]) & _any(ts, ERRORS), F.lit(0.5), F.lit("error_path")),
            ((X.occurrences(text, "(") != X.occurrences(text, ")")) | (X.occurrences(text, "{") != X.occurrences(text, "}")), F.lit(0.4), F.lit("unbalanced_structure")),
        )
        score = sum((F.when(on, value).otherwise(0.0) for on, value, _ in rules), F.lit(0.0))
        reasons = F.filter(F.array(*(F.when(on, reason) for on, _, reason in rules)), lambda r: r.isNotNull())
        return F.struct(score.alias("score"), reasons.alias("reasons"))

    text = X.normalize_code(line)
    risky = F.filter(X.calls(text), lambda c: F.lower(c).isin(*X.RISKY))
    return F.get(F.transform(F.array(F.struct(text.alias("x"), X.tokens_of(text).alias("t"), risky.alias("r"))), lambda s: build(s["x"], s["t"], s["r"])), 0)


def top_lines(df: DataFrame, code: str, semantic: Column, graph: Column, fusion: Column, band: Column) -> DataFrame:
    """``df`` with ``raw_lines`` and ``top_lines``: ``array<struct<line_number, score, code, reasons>>``, best first.

    Two lines for band 'inspect', four for 'high', else one. Without a line
    that scores, the first three lines that aren't blank stand in, at 0.1.
    Ties go to the earlier line. Code without a line gives an empty array.
    """
    rows = df.withColumn("raw_lines", F.split(X.normalize_code(F.col(code)), X.LINE)).withColumn("_scale", branch_scale(semantic, graph, fusion))
    numbered = F.filter(F.transform("raw_lines", lambda x, i: F.struct((i + 1).alias("n"), F.regexp_replace(x, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+$", "").alias("c"))), lambda s: s["c"] != "")
    rows = rows.withColumn("_numbered", numbered)
    scored = F.transform("_numbered", lambda s: F.struct(s["n"].alias("n"), s["c"].alias("c"), line_score(s["c"]).alias("r")))
    rows = rows.withColumn("_scored", F.filter(scored, lambda s: s["r"]["score"] * F.col("_scale") > 0))
    line = lambda n, score, c, reasons: F.struct((-F.round(score, 4)).alias("o"), n.alias("line_number"), F.round(score, 4).alias("score"), c.alias("code"), reasons.alias("reasons"))
    own = F.transform("_scored", lambda s: line(s["n"], s["r"]["score"] * F.col("_scale"), s["c"], s["r"]["reasons"]))
    context = F.transform(F.slice("_numbered", 1, 3), lambda s: line(s["n"], 0.1 * F.col("_scale"), s["c"], F.array(F.lit("fallback_context"))))
    best = F.sort_array(F.when(F.size("_scored") > 0, own).otherwise(context))
    k = F.when(band == "inspect", 2).when(band == "high", 4).otherwise(1)
    best = F.transform(F.slice(best, F.lit(1), k), lambda s: F.struct(s["line_number"], s["score"], s["code"], s["reasons"]))
    return rows.withColumn("top_lines", best).drop("_scale", "_numbered", "_scored")


def slices(df: DataFrame, radius: int = 1) -> DataFrame:
    """``df`` (of :func:`top_lines`) with ``slices``: a line around each top line, in line order; a slice that overlaps an earlier one is left out."""
    last = F.size("raw_lines")
    centres = F.array_sort(F.array_distinct(F.transform("top_lines", lambda t: t["line_number"])))
    spans = F.transform(centres, lambda c: F.struct(F.greatest(F.lit(1), c - radius).alias("a"), F.least(last, c + radius).alias("b")))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    kept = F.aggregate(spans, empty, lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))), acc), -1)["b"] < s["a"]), F.concat(acc, F.array(s))).otherwise(acc))

    def cut(s: Column) -> Column:
        inside = F.filter("top_lines", lambda t: (t["line_number"] >= s["a"]) & (t["line_number"] <= s["b"]))
        text = F.transform(F.sequence(s["a"], s["b"]), lambda i: F.concat(F.lpad(i.cast("string"), 4, " "), F.lit(": "), F.get("raw_lines", i - 1)))
        return F.struct(
            s["a"].alias("start_line"),
            s["b"].alias("end_line"),
            F.coalesce(F.array_max(F.transform(inside, lambda t: t["score"])), F.lit(0.0)).alias("score"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(inside, lambda t: t["reasons"])))).alias("reasons"),
            F.array_join(text, "\n").alias("text"),
        )

    return df.withColumn("slices", F.transform(kept, cut))


def token_highlights(most: int = 8) -> Column:
    """The most frequent identifier tokens of the top lines (of :func:`top_lines`), but for if, for, while and return; the first to appear where equal."""
    every = F.filter(F.flatten(F.transform("top_lines", lambda t: X.tokens(t["code"]))), lambda x: x.rlike(r"^[A-Za-z_]\w*$") & ~x.isin("if", "for", "while", "return"))

    def counted(ts: Column) -> Column:
        rows = F.transform(F.array_distinct(ts), lambda x, i: F.struct((-F.size(F.filter(ts, lambda y: y == x))).alias("n"), i.alias("i"), x.alias("x")))
        return F.slice(F.sort_array(rows), 1, most)["x"]

    return F.get(F.transform(F.array(every), counted), 0)


def slices_text(limit: int = 2200) -> Column:
    """The slices (of :func:`slices`) written out, each under a line that tells score, lines and reasons; cut."""
    one = lambda s: F.concat(F.format_string("Slice score=%.4f | lines %d-%d | reasons=", s["score"], s["start_line"], s["end_line"]), F.coalesce(F.nullif(F.array_join(s["reasons"], ","), F.lit("")), F.lit("n/a")), F.lit("\n"), s["text"])
    return F.when(F.size("slices") > 0, X.truncate_text(F.array_join(F.transform("slices", one), "\n\n"), limit)).otherwise("No suspicious slices.")
