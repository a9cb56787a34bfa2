"""Answers of a classifier as text: finding the object in it, reading label, confidence and reason, and checking evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import text as X

# Words for the labels, patterns of answers without an object, and names of outcomes.
POSITIVE = ("vulnerable", "1")
NEGATIVE = ("non-vulnerable", "not vulnerable", "non vulnerable", "safe", "benign", "0")
FINAL = r"(?is)FINAL_JSON:\s*(\{.*\})"
SAID = r"(vulnerable|non-vulnerable|non vulnerable|safe|benign)"
VERDICTS = (rf"(?i)FINAL_LABEL\s*[:=]\s*{SAID}", rf"(?i)final answer\s*[:=]\s*{SAID}", rf"(?i)verdict\s*[:=]\s*{SAID}")
NEGATIVE_TAIL, POSITIVE_TAIL = r"(?i)\bnon[- ]vulnerable\b|\bsafe\b|\bbenign\b", r"(?i)\bvulnerable\b"
CONFIDENCE = r"(?i)confidence\s*[:=]\s*(0(?:\.\d+)?|1(?:\.0+)?)"
REASON = r"(?i)reason\s*[:=]\s*([^\n]+)"
TAIL_LINES, REASON_LIMIT = 8, 280
NEEDED = ("label", "confidence", "reason")
_OBJECT = "map<string,string>"
_STRICT = {"allowSingleQuotes": "false"}


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def objects(text: Column) -> Column:
    """What every opening brace of a text starts, as maps from names to texts; what is no object is left out."""
    parts = F.split(text, r"\{")

    def tails(p: Column) -> Column:
        at = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.from_json(F.concat(F.lit("{"), F.array_join(F.slice(p, i + 1, F.size(p)), "{")), _OBJECT, _STRICT))

    return F.filter(_let(parts, tails), lambda m: m.isNotNull())


def payload(text: Column) -> Column:
    """The first object with label, confidence and reason: behind the mark of the final answer, else anywhere; null if none."""
    final = F.regexp_extract(text, FINAL, 1)
    found = F.filter(F.concat(objects(final), objects(text)), lambda m: F.map_contains_key(m, "label") & F.map_contains_key(m, "confidence") & F.map_contains_key(m, "reason"))
    return F.get(found, 0)


def label_of(said: Column) -> Column:
    """1 or 0 for a word of a label in any notation, null for anything else."""
    word = F.replace(F.lower(X.strip(said)), F.lit("_"), F.lit("-"))
    return F.when(word.isin(*POSITIVE), 1).when(word.isin(*NEGATIVE), 0)


def line_spans(value: Column) -> Column:
    """Texts of a list, or parts of a text between semicolons and commas; null and blank give none."""
    listed = F.from_json(value, "array<string>")
    parts = F.coalesce(listed, F.split(value, "[;,]"))
    return F.coalesce(F.filter(F.transform(parts, X.strip), lambda x: x != ""), F.array().cast("array<string>"))


def fallback_label(text: Column) -> Column:
    """The label named by a verdict, or in the last lines (a negative one first); null if none."""
    said = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in VERDICTS]
    lines = F.split(text, X.LINE)
    tail = F.array_join(F.when(F.size(lines) > TAIL_LINES, F.slice(lines, -TAIL_LINES, TAIL_LINES)).otherwise(lines), "\n")
    return F.coalesce(*said, F.when(tail.rlike(NEGATIVE_TAIL), "Non-vulnerable").when(tail.rlike(POSITIVE_TAIL), "Vulnerable"))


def fallback_reason(text: Column) -> Column:
    """What stands behind the word reason, else the text before the final answer, cut."""
    told = X.strip(F.regexp_extract(text, REASON, 1))
    rest = X.strip(F.regexp_replace(text, "(?is)FINAL_JSON:.*", ""))
    rest = X.strip(F.regexp_replace(F.when(rest != "", rest).otherwise(text), r"\s+", " "))
    cut = lambda x, other: F.coalesce(F.nullif(X.truncate_text(x, REASON_LIMIT), F.lit("")), F.lit(other))
    return F.when(text == "", "fallback_parse_empty_output").when(text.rlike(REASON), cut(told, "fallback_parse_reason_line")).otherwise(cut(rest, "fallback_parse_short_output"))


def parse(raw: Column, strict: bool = False) -> Column:
    """``struct<label, confidence, reason, cwe_family, vulnerable_lines, sink_or_api, missing_guard, error>`` of an answer.

    An answer without an object is read by its words.  ``error`` names what is
    missing, and then the label is null.  A confidence outside [0, 1] is cut to
    it, or is an error if ``strict``.  Null is read as the empty text.
    """
    text = X.strip(F.coalesce(raw, F.lit("")))

    def of(s: Column) -> Column:
        t, m = s["text"], s["object"]
        known = m.isNotNull()
        get = lambda name: F.coalesce(X.strip(F.try_element_at(m, F.lit(name))), F.lit(""))
        said = F.when(known, get("label")).otherwise(fallback_label(t))
        told = F.when(known, F.try_element_at(m, F.lit("confidence")).try_cast("double")).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, CONFIDENCE, 1), F.lit("")).try_cast("double"), F.lit(0.5)))
        reason = F.when(known, F.coalesce(F.nullif(get("reason"), F.lit("")), get("brief_reason"))).otherwise(fallback_reason(t))
        outside = (told < 0) | (told > 1)
        error = F.when(said.isNull(), "no label").when(label_of(said).isNull(), "invalid label").when(told.isNull() | F.isnan(told), "invalid confidence")
        if strict:
            error = error.when(outside, "confidence out of range")
        error = error.when(reason == "", "missing reason")
        return F.struct(
            F.when(error.isNull(), label_of(said)).alias("label"),
            F.when(error.isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), told))).alias("confidence"),
            F.when(error.isNull(), reason).alias("reason"),
            get("cwe_family").alias("cwe_family"),
            F.when(known, line_spans(F.try_element_at(m, F.lit("vulnerable_lines")))).otherwise(F.array().cast("array<string>")).alias("vulnerable_lines"),
            get("sink_or_api").alias("sink_or_api"),
            get("missing_guard").alias("missing_guard"),
            error.alias("error"),
        )

    if strict:  # the answer may stand between fences
        text = X.strip(F.regexp_replace(text, r"^```(?:json)?\s*|\s*```$", ""))
    return _let(F.struct(text.alias("text"), payload(text).alias("object")), of)


def verified(label: Column, lines: Column, sink: Column, guard: Column) -> tuple[Column, Column]:
    """A positive label needs lines and a sink or a missing guard, else it is turned to 0; and what was decided."""
    some = lambda c: F.coalesce(X.strip(c), F.lit("")) != ""
    evident = (F.coalesce(F.size(lines), F.lit(0)) > 0) & (some(sink) | some(guard))
    rejected = (label == 1) & ~evident
    return F.when(rejected, 0).otherwise(label), F.when(rejected, "rejected_missing_evidence").otherwise("accepted")


def cache_key(*parts: Column) -> Column:
    """The key of a prompt under its settings: the digest of all of them, one a line."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def failure_kind(message: Column) -> Column:
    """What kind of failure a message tells of: missing packages, a missing model, no memory, or other."""
    low = F.lower(message)
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("no module named", "importerror", "cannot import"), "missing_dependencies").when(has("out of memory", "oom", "cuda error"), "out_of_memory").when(has("not found", "no such file", "does not exist"), "model_missing").otherwise("other")
