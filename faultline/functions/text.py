"""Text functions over source code, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that define the results.
KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch "
    "typedef union unsigned void volatile while class namespace new delete public private protected template typename try catch throw using virtual bool true false nullptr null"
).split()
CONTROL = "if else switch case for while do goto return break continue".split()
RISKY = (
    "strcpy strncpy strcat strncat sprintf snprintf vsprintf scanf sscanf fscanf gets memcpy memmove memset malloc calloc realloc free new delete read write recv send open close "
    "fopen fclose strtok system exec popen"
).split()
MEMORY = "malloc calloc realloc free new delete memcpy memmove memset".split()
SUMMARY_MEMORY = "malloc calloc realloc free new delete memcpy memmove".split()
STRING = r'(?s)"(?:\\.|[^"\\])*"'
CHAR = r"(?s)'(?:\\.|[^'\\])*'"
NUMBER = r"\b(?:0x[0-9a-fA-F]+|\d+\.\d+|\d+)\b"
TOKEN = r"[A-Za-z_]\w*|==|!=|<=|>=|->|\+\+|--|&&|\|\||[{}\[\]();,.*&|^~!<>%/\-+=?:]"
SIGNATURE = r"(?s)([A-Za-z_]\w*)\s*\((.*?)\)\s*\{"
CALL = r"\b([A-Za-z_]\w*)\s*\("
#: White space at the ends of a text, in any script.
ENDS = r"^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$"
LINE = r"[\n\x0b\x0c\x1c-\x1e\x85  ]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, ENDS, "")


def _is(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def normalize_code(x: Column) -> Column:
    """Line ends to LF, tabs to four spaces, NUL to a space; blanks before LF and more than one empty line dropped; stripped. Null gives ''."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n")
    x = F.replace(F.replace(x, F.lit("\t"), F.lit("    ")), F.lit("\x00"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(x, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def sanitize_literals(x: Column) -> Column:
    """Strings, characters and numbers, in this order, become STR_LIT, CHAR_LIT and NUM_LIT between blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, STRING, " STR_LIT "), CHAR, " CHAR_LIT "), NUMBER, " NUM_LIT ")


def raw_tokens(code: Column) -> Column:
    return raw_tokens_of(normalize_code(code))


def raw_tokens_of(text: Column) -> Column:
    """The same of a normalised text."""
    return F.regexp_extract_all(sanitize_literals(text), F.lit(TOKEN), F.lit(0))


def split_identifier(x: Column) -> Column:
    """Camel case and underscores cut into lower-case parts; an identifier of underscores only gives one empty part."""
    y = F.replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"), F.lit("__"), F.lit("_"))
    parts = F.filter(F.split(F.lower(y), "_"), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))


def tokens(code: Column) -> Column:
    """Normalised tokens: literals as str_lit and num_lit, keywords in lower case, identifiers in parts, operators as they are."""
    return tokens_of(normalize_code(code))


def tokens_of(text: Column) -> Column:
    """The same of a normalised text."""

    def one(t: Column) -> Column:
        low = F.lower(t)
        return (
            F.when(_is(t, ["STR_LIT", "CHAR_LIT"]), F.array(F.lit("str_lit")))
            .when(t == "NUM_LIT", F.array(F.lit("num_lit")))
            .when(~t.rlike("^[A-Za-z_]"), F.array(t))
            .when(_is(low, KEYWORDS), F.array(low))
            .otherwise(split_identifier(t))
        )

    return F.flatten(F.transform(raw_tokens_of(text), one))


def skeleton(code: Column) -> Column:
    """Tokens with literals, numbers, calls and identifiers abstracted, joined by blanks."""

    def build(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            low = F.lower(t)
            return (
                F.when(_is(t, ["STR_LIT", "CHAR_LIT"]), "lit")
                .when(t == "NUM_LIT", "num")
                .when(~t.rlike("^[A-Za-z_]"), t)
                .when(_is(low, KEYWORDS), low)
                .when(F.get(ts, i + 1) == "(", "call")
                .otherwise("id")
            )

        return F.transform(ts, one)

    return F.array_join(F.get(F.transform(F.array(raw_tokens(code)), build), 0), " ")


def function_name(text: Column) -> Column:
    """The name before the first ``( ... ) {`` of the first 1,200 characters of a normalised text; 'unknown' if none or a control keyword."""
    name = F.regexp_extract(F.substring(text, 1, 1200), SIGNATURE, 1)
    return F.when((name == "") | _is(F.lower(name), CONTROL), "unknown").otherwise(name)


def _count_parameters(inside: Column) -> Column:
    inside = strip(inside)
    return F.when((inside == "") | (inside == "void"), 0).otherwise(F.size(F.filter(F.split(inside, ","), lambda p: strip(p) != "")))


def signature_parameters(text: Column) -> Column:
    """Parameters between the brackets of the signature that :func:`function_name` finds."""
    return _count_parameters(F.regexp_extract(F.substring(text, 1, 1200), SIGNATURE, 2))


def head_parameters(text: Column) -> Column:
    """Parameters between the first bracket and the next closing one of the first 1,000 characters."""
    return _count_parameters(F.regexp_extract(F.substring(text, 1, 1000), r"(?s)^[^(]*\((.*?)\)", 1))


def _first_spellings(names: Column, stop: list[str]) -> Column:
    """Names but for ``stop``, each once whatever its case, in the spelling and order of their first appearance."""
    kept = F.filter(names, lambda n: ~_is(F.lower(n), stop))
    return F.get(F.transform(F.array(kept), lambda k: F.get(F.transform(F.array(F.transform(k, lambda n: F.lower(n))), lambda low: F.filter(k, lambda n, i: F.array_position(low, F.get(low, i)) == i + 1)), 0)), 0)


def calls(text: Column) -> Column:
    """Called names of a normalised text, keywords left out."""
    return _first_spellings(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), KEYWORDS)


def line_calls(line: Column) -> Column:
    """As :func:`calls`, but only control keywords are left out."""
    return _first_spellings(F.regexp_extract_all(line, F.lit(CALL), F.lit(1)), CONTROL)


def lines(text: Column) -> Column:
    """The lines of a normalised text that aren't blank, stripped."""
    return F.filter(F.transform(F.split(text, LINE), strip), lambda x: x != "")


def occurrences(text: Column, part: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def pointer_marks(text: Column) -> Column:
    return occurrences(text, "->") + occurrences(text, "*") + occurrences(text, "&")


def truncate_text(x: Column, limit: int) -> Column:
    """The normalised text, cut to ``limit`` characters with '...' at its end if it is longer."""
    text = normalize_code(x)
    cut = F.regexp_replace(F.substring(text, 1, limit - 3), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+$", "")
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def count_in(ts: Column, words: list[str]) -> Column:
    return F.size(F.filter(ts, lambda t: _is(t, words)))


def structure_summary(code: Column) -> Column:
    """Nine lines of text about a function: name, parameters, lines, calls, control keywords, risky calls, memory operations, pointers, arrays."""
    text = normalize_code(code)

    def build(ts: Column, cs: Column) -> Column:
        some = lambda a, n=None: F.coalesce(F.nullif(F.array_join(a if n is None else F.slice(a, 1, n), ", "), F.lit("")), F.lit("none"))
        counted = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), count_in(ts, [k]).alias("n")) for k in CONTROL)), lambda x: x["n"] > 0)
        control = F.concat(F.lit("{"), F.array_join(F.transform(counted, lambda x: F.concat(F.lit('"'), x["k"], F.lit('": '), x["n"].cast("string"))), ", "), F.lit("}"))
        memory = F.filter(F.array(*(F.lit(k) for k in SUMMARY_MEMORY)), lambda k: F.array_contains(ts, k))
        parts = {
            "function": function_name(text),
            "params": signature_parameters(text),
            "lines": F.size(lines(text)),
            "calls": some(cs, 8),
            "control": control,
            "risky_apis": some(F.filter(cs, lambda c: _is(F.lower(c), RISKY))),
            "memory_ops": some(memory),
            "pointer_ops": pointer_marks(text),
            "array_accesses": occurrences(text, "["),
        }
        return F.concat_ws("\n", *(F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in parts.items()))

    return F.get(F.transform(F.array(F.struct(tokens(code).alias("t"), calls(text).alias("c"))), lambda s: build(s["t"], s["c"])), 0)
