"""Byte-level BPE of a whole corpus with a public vocabulary, inside the JVM.

A text is cut into words by the vocabulary's pattern, once.  Words that are
themselves entries are looked up in place, in a literal map from piece to rank.
All others are handled as rows of bytes, a byte being written as the character
of the same number: each distinct one is merged once by a fold over its bytes,
and the ids go back to where the word stands.  The map is the value of a session
variable: a literal in the plan, but one that no description of the plan spells out.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.workspace import join_groups, materialize, spread

#: Folder of the public vocabularies; every function takes another path as a parameter.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE_50K = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
#: How byte_bpe_50k cuts a text into words (no part gives back what it has taken).
WORDS = r"(?U)'(?:[stmd]|re|ve|ll)| ?(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s+(?!\S)|\s+"
#: The literal map's parts; a look-up reads the few entries of one part.
PARTS = 8192
#: Marks of the literal map (no byte is written as one of these), and the character of rank 0.
OPEN, CLOSE, FIRST_RANK = "\u0100", "\u0101", 0x10000
#: The fold copies its pieces at every merge, so its work grows with the square of a word's bytes: longer words, which no text of a language has, are merged with a heap.
LONG = 4096


@lru_cache(maxsize=4)
def ranks(path: str = BYTE_BPE_50K) -> dict[bytes, int]:
    """The vocabulary's pieces and their ranks, which are also their ids."""
    lines = Path(path).read_bytes().split()
    return {base64.b64decode(a): int(b) for a, b in zip(lines[::2], lines[1::2], strict=True)}


@lru_cache(maxsize=4)
def _rank_parts(path: str, whole: bool) -> list[str]:
    """The literal map: parts in which an entry is a piece between two marks, followed by the character that stands for its rank.

    Pieces are written byte by byte, or, for look-ups of ``whole`` words, as the texts they are in UTF-8.
    """
    parts = [""] * PARTS
    for piece, rank in ranks(path).items():
        try:
            name = piece.decode("utf-8" if whole else "latin-1")
        except UnicodeDecodeError:  # part of a character, so no word
            continue
        parts[zlib.crc32(name.encode()) % PARTS] += f"{OPEN}{name}{CLOSE}{chr(FIRST_RANK + rank)}"
    return parts


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (and, for a literal, stands in the plan once)."""
    return F.get(F.transform(F.array(value), body), 0)


def _literal(name: str, values: list, kind: pa.DataType) -> Column:
    """A list as a literal, by way of a variable of the session that holds it as one block of memory."""
    spark = SparkSession.active()
    key = (spark._jsparkSession.sessionUUID(), name)
    if key not in _DECLARED:
        table = spark.createDataFrame(pa.table({"value": pa.array([values], pa.list_(kind))}))
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {table.schema['value'].dataType.simpleString()}")
        spark.sql(f"SET VARIABLE {name} = (SELECT value FROM {{table}})", table=table)
        _DECLARED.add(key)
    return F.expr(name)


_DECLARED: set[tuple[str, str]] = set()


def _table(path: str, whole: bool = False) -> Column:
    return _literal(f"faultline_ranks_{zlib.crc32(f'{path} {whole}'.encode())}", _rank_parts(path, whole), pa.string())


def _rank(table: Column, piece: Column) -> Column:
    """The rank of a piece, negative if it is none."""
    part = F.get(table, (F.crc32(piece.cast("binary")) % PARTS).cast("int"))
    # what stands behind the entry, or the whole part, which starts with a mark
    return F.ascii(F.call_function("substring_index", part, F.concat(F.lit(OPEN), piece, F.lit(CLOSE)), F.lit(-1))) - FIRST_RANK


def as_bytes(text: Column) -> Column:
    """A text as a row of bytes, each written as the character of that number."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def merged(word: Column, path: str = BYTE_BPE_50K) -> Column:
    """The ids of a word's pieces, as ``array<int>``; null for a null word.

    The fold's state holds the pieces and the rank of each neighbouring pair.
    Every step joins the first pair of the lowest rank and looks up only the two
    pairs that this makes; steps after the last possible merge change nothing.
    """
    never = F.lit(1 << 30)
    none = F.array().cast("array<int>")

    def fold(table: Column) -> Column:
        rank = lambda piece: _rank(table, piece).bitwiseAND(F.lit(0x7FFFFFFF))  # noqa: E731  # what is no piece ranks above never
        size = F.char_length(word)
        pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
        # the last entry of r stands behind the last piece and is never joined
        pairs = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i < size, rank(F.substring(word, i, F.lit(2)))).otherwise(never))

        def join(s: Column, at: Column) -> Column:
            p, r = s["p"], s["r"]
            left = lambda new: F.when(at > 1, F.concat(F.slice(r, F.lit(1), at - 2), F.array(rank(F.concat(F.get(p, at - 2), new))))).otherwise(none)
            right = lambda new: F.when(at + 1 < F.size(p), rank(F.concat(new, F.get(p, at + 1)))).otherwise(never)
            return _let(
                F.concat(F.get(p, at - 1), F.get(p, at)),
                lambda new: F.struct(
                    F.concat(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
                    F.concat(left(new), F.array(right(new)), F.slice(r, at + 2, F.size(r))).alias("r"),
                ),
            )

        def step(s: Column, _: Column) -> Column:
            return _let(F.array_min(s["r"]), lambda low: F.when(low < never, _let(F.array_position(s["r"], low).cast("int"), lambda at: join(s, at))).otherwise(s))

        start = F.struct(pieces.alias("p"), pairs.alias("r"))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), start, step, lambda s: F.transform(s["p"], lambda x: _rank(table, x)))

    return F.when(word.isNotNull(), _let(_table(path), fold))


def _merged_by_heap(path: str):
    table = ranks(path)

    def merge(word: bytes) -> list[int]:
        pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        before, after = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap = [(table[word[i : i + 2]], i, 2) for i in range(len(word) - 1) if word[i : i + 2] in table]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            if pieces[i] is None or after[i] < 0 or len(pieces[i]) + len(pieces[after[i]]) != length:
                continue  # one of the two has been joined since
            j = after[i]
            pieces[i], pieces[j] = pieces[i] + pieces[j], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0:
                    both = pieces[a] + pieces[after[a]]
                    if both in table:
                        heapq.heappush(heap, (table[both], a, len(both)))
        return [table[p] for p in pieces if p is not None]

    @F.pandas_udf("array<int>")
    def udf(words_: pd.Series) -> pd.Series:
        return words_.map(lambda w: merge(w.encode("latin-1")), na_action="ignore")

    return udf


def _tasks(df: DataFrame) -> int:
    """Tasks for few bytes that take much work, which would else be gathered into a task or two."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_ids(distinct_words: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """``distinct_words`` with ``ids`` of its column ``word`` (a text)."""
    rows = distinct_words.repartition(_tasks(distinct_words)).withColumn("_bytes", as_bytes(F.col("word")))
    short = F.when(F.char_length("_bytes") <= LONG, F.col("_bytes"))
    long_ = F.when(F.char_length("_bytes") > LONG, F.col("_bytes"))
    return rows.withColumn("ids", F.coalesce(merged(short, path), _merged_by_heap(path)(long_))).drop("_bytes")


def _cut(df: DataFrame, text: str, path: str) -> tuple[DataFrame, DataFrame]:
    """``df`` without ``text`` but with ``_row`` (a number) and ``_own`` (for each word its id, negative if it is no entry), and ``_row, at, ids`` of these other words.

    Every text is cut and looked up once; what comes of it is written.
    """
    rows = spread(df).withColumn("_words", words(F.col(text))).drop(text)
    rows = rows.withColumn("_own", _let(_table(path, True), lambda t: F.transform(F.col("_words"), lambda w: _rank(t, w))))
    more = F.filter(F.transform("_words", lambda w, i: F.when(F.get(F.col("_own"), i) < 0, F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    rows = materialize(rows.withColumn("_more", more).drop("_words").withColumn("_row", F.monotonically_increasing_id()))
    places = rows.select("_row", F.explode("_more").alias("m")).select("_row", "m.at", "m.word")
    found = materialize(word_ids(places.groupBy("word").agg(F.count("*").alias("n")), path))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return rows.drop("_more"), join_groups(places, found, "word", "n", total).select("_row", "at", "ids")


def encode(df: DataFrame, doc_id: str, text: str, out: str = "ids", path: str = BYTE_BPE_50K) -> DataFrame:
    """``doc_id, out``: the ids of every row's text, without special tokens, as ``array<int>``.

    Null and empty texts give an empty list.  Blank text and text that looks
    like a special token are ordinary text.  Every row of the input gives one
    row, also if an id or a whole row is repeated; ids may be null.  Texts and
    words of any length are encoded whole.
    """
    rows, places = _cut(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text", path)
    found = places.groupBy("_row").agg(F.collect_list(F.struct("at", "ids")).alias("_others"))  # at most a text's words
    own = F.filter(F.transform("_own", lambda x, i: F.when(x >= 0, F.struct(i.alias("at"), F.array(x).alias("ids")))), lambda x: x.isNotNull())
    ids = F.when(F.col("_others").isNull(), F.col("_own")).otherwise(F.flatten(F.sort_array(F.concat(own, F.col("_others")))["ids"]))
    return rows.join(found, "_row", "left").select(F.col("_id").alias(doc_id), F.coalesce(ids, F.array().cast("array<int>")).alias(out))


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", path: str = BYTE_BPE_50K) -> DataFrame:
    """``df`` with the number of tokens instead of its text; null and empty texts have none.  No list of ids is put together."""
    rows, places = _cut(df, text, path)
    rows = rows.withColumn(out, F.coalesce(F.size(F.filter("_own", lambda x: x >= 0)), F.lit(0)).cast("long")).drop("_own")
    more = places.groupBy("_row").agg(F.sum(F.size("ids")).alias("_others"))
    return rows.join(more, "_row", "left").withColumn(out, F.col(out) + F.coalesce("_others", F.lit(0))).drop("_row", "_others")


def decode(df: DataFrame, ids: str, out: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``df`` with the text that its ids stand for: their binary pieces, put together.  Null ids give null, unknown ones too."""
    pieces = [None] * (max(ranks(path).values()) + 1)
    for piece, rank in ranks(path).items():
        pieces[rank] = piece
    table = _literal(f"faultline_pieces_{zlib.crc32(path.encode())}", pieces, pa.binary())
    parts = _let(table, lambda t: F.transform(F.col(ids), lambda i: F.get(t, i)))
    whole = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return df.withColumn(out, whole.cast("string"))
