"""Records of evaluation splits that also stand, exactly or almost, in training.

Texts of the same words are one class.  Evaluation classes are cut into all
their word n-grams, training classes into n-grams that don't overlap; the
hashes of both are partitioned together.  A training class of w words that
differs from an evaluation class in at most d words has lost at most d of its
pieces, so any d + 1 of them hold one that both share: only the d + 1 pieces
that are rarest in evaluation are followed (a piece that doesn't occur there
costs nothing).  What is found is scored by containment and confirmed by the
edit distance of the whole texts, in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm.records import tree
from faultline.workspace import materialize, spread

#: Words of a piece.
N = 5
#: Words are written as single characters of these planes, so that a text's edit distance in words is one in characters.
FIRST_CHAR, CHARS = 0x10000, 0x100000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The words of a text: runs of letters and digits (A-Z, a-z, 0-9), in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_APART).split()


def words_as_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of ``text``: ``root``, the digest of its tree, and ``chars``, each of its words as one character."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        if len(seen) > 1_000_000:
            seen.clear()
        out, roots = [], []
        for text in batch.column("text").to_pylist():
            found = words_of(text)
            codes = np.empty(len(found), np.uint32)
            for i, w in enumerate(found):
                c = seen.get(w)
                if c is None:
                    c = seen[w] = FIRST_CHAR + xxhash.xxh64_intdigest(w) % CHARS
                codes[i] = c
            out.append(codes.tobytes().decode("utf-32-le"))
            roots.append(tree(text)[0][:16])
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(roots, pa.binary()), pa.array(out, pa.string())], [*kept, "root", "chars"])


#: Bytes of letters and digits in lower case, all others as blanks.
_APART = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def _grams(chars: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the N-word pieces of a text that start at every ``step``-th word, and where they start."""
    c = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c) - N + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = np.zeros(n, np.uint64)
    for i in range(N):
        h = (h ^ c[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    at = np.arange(0, n, step, dtype=np.int32)
    if step == N and len(c) == 2 * N - 1:  # one whole piece, but one inserted word is allowed: a second piece from the end
        at = np.array([0, n - 1], np.int32)
    return h[at].view(np.int64), at


def _pieces(step: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("chars").to_pylist()
            if not texts:
                continue
            grams, ats = zip(*(_grams(t, step) for t in texts), strict=True)
            lengths = [len(g) for g in grams]
            arrays = [np.repeat(batch.column("cls").to_numpy(), lengths), np.concatenate(grams), np.concatenate(ats)]
            names = ["cls", "gram", "at"]
            if step > 1:
                arrays += [np.repeat(np.array([len(t) for t in texts], np.int32), lengths), np.repeat(np.array(lengths, np.int32), lengths)]
                names += ["words", "pieces"]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    return cut


def side_of(split: Column) -> Column:
    """``train``, ``eval`` or null, of a split name in any case with blanks around it."""
    name = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return F.when(name == "train", "train").when(name.isin("val", "valid", "validation", "test"), "eval")


def classes(df: DataFrame, record_id: str, text: str, split: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``record_id, side, root, cls, chars`` and the columns ``keep`` of every record with a side and a word, as a written table."""
    rows = df.select(F.col(record_id).alias("record_id"), side_of(F.col(split)).alias("side"), *keep, F.col(text).alias("text"))
    rows = rows.where("record_id is not null and side is not null and text rlike '[A-Za-z0-9]'")
    fields = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", root binary, chars string"
    return materialize(spread(rows).mapInArrow(words_as_characters, schema).withColumn("cls", F.xxhash64("chars")))


def near_classes(members: DataFrame, most: float = 0.1) -> DataFrame:
    """Pairs of different word sequences, one in training and one in evaluation, that differ by at most ``most`` in words.

    Copies of each other that have different words are pairs, too, without a
    distance.  Result: ``cls_t, cls_e, distance, containment`` (the share of the evaluation
    text's n-grams that the training text has, too).  The difference is the
    least number of words inserted, deleted or replaced, divided by the words of
    the longer text.  No pair is lost for ``most`` up to 0.1.
    """
    if not 0 <= most <= 0.1:
        raise ValueError("the pieces find differences of at most 0.1")
    # every text once, whatever number of rows it has on either side
    texts = materialize(members.groupBy("cls", "chars").agg(F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval")))
    train, eval_ = texts.where("in_train").select("cls", "chars"), texts.where("in_eval").select("cls", "chars")
    cut = train.mapInArrow(_pieces(N), "cls long, gram long, at int, words int, pieces int")
    slid = eval_.mapInArrow(_pieces(1), "cls long, gram long, at int")
    # how often a piece occurs in evaluation; pieces that don't occur end here
    hits = cut.join(slid.groupBy("gram").agg(F.count("*").alias("there")), "gram")
    # the longer text may have words / 0.9 words, so at most words / 9 pieces are lost
    one = Window.partitionBy("cls")  # at most words / N rows
    hits = hits.withColumn("nth", F.row_number().over(one.orderBy("there", "at"))).withColumn("found", F.count("*").over(one))
    lost = F.floor(F.col("words") / 9).cast("int")
    hits = hits.where(F.col("nth") <= lost + 1 - (F.col("pieces") - F.col("found"))).select("gram", F.col("cls").alias("cls_t"), F.col("at").alias("at_t"), lost.alias("lost"))
    met = hits.join(slid.select("gram", F.col("cls").alias("cls_e"), F.col("at").alias("at_e")), "gram")
    met = met.where((F.col("cls_t") != F.col("cls_e")) & (F.abs(F.col("at_t") - F.col("at_e")) <= F.col("lost")))
    pairs = met.select("cls_t", "cls_e", F.lit(False).alias("copy")).unionByName(_same_root(members).where("cls_t <> cls_e").withColumn("copy", F.lit(True)))
    pairs = pairs.groupBy("cls_t", "cls_e").agg(F.max("copy").alias("copy"))
    pairs = pairs.join(train.select(F.col("cls").alias("cls_t"), F.col("chars").alias("t")), "cls_t").join(eval_.select(F.col("cls").alias("cls_e"), F.col("chars").alias("e")), "cls_e")
    wt, we = F.char_length("t"), F.char_length("e")
    edits = F.floor(F.greatest(wt, we) * F.lit(float(most))).cast("int")
    pairs = pairs.withColumn("edits", edits).where(F.col("copy") | (F.abs(wt - we) <= F.col("edits")))
    # the built-in takes its threshold as a literal only, so it is applied by steps of the text's length
    pairs = pairs.withColumn("distance", F.when(~F.col("copy"), _edit_distance(F.col("t"), F.col("e"), F.col("edits")))).where("copy or distance between 0 and edits")
    return pairs.select("cls_t", "cls_e", "distance", F.round(_containment(F.col("e"), F.col("t")), 6).alias("containment"))


def _edit_distance(a: Column, b: Column, most: Column) -> Column:
    """Edit distance of two texts if it is at most ``most``, else -1 or a larger number; in narrow bands where ``most`` is small."""
    out = F.levenshtein(a, b)
    for limit in (1024, 256, 64, 32, 16, 8, 4, 2, 1, 0):
        out = F.when(most <= limit, F.levenshtein(a, b, limit)).otherwise(out)
    return out


def _containment(part: Column, whole: Column) -> Column:
    def grams(x: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(x) - N + 1)), lambda i: F.substring(x, i, F.lit(N))))

    return F.size(F.array_intersect(grams(part), grams(whole))) / F.size(grams(part))


def _same_root(members: DataFrame) -> DataFrame:
    train, eval_ = (members.where(F.col("side") == s) for s in ("train", "eval"))
    t, e = train.select("root", F.col("cls").alias("cls_t")).distinct(), eval_.select("root", F.col("cls").alias("cls_e")).distinct()
    return t.join(e, "root").select("cls_t", "cls_e")


def class_links(members: DataFrame, most: float = 0.1) -> DataFrame:
    """Linked classes ``cls_t, cls_e, distance, containment``: the same words (distance 0, containment 1), copies of each other, or near by :func:`near_classes`."""
    both = members.groupBy("cls").agg(F.max(F.col("side") == "train").alias("t"), F.max(F.col("side") == "eval").alias("e")).where("t and e")
    same_words = both.select(F.col("cls").alias("cls_t"), F.col("cls").alias("cls_e"), F.lit(0).alias("distance"), F.lit(1.0).alias("containment"))
    return same_words.unionByName(near_classes(members, most))


def containments(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of linked classes by its first records: ``record_id_train, record_id_eval, n_train, n_eval`` (records of each class), ``distance, containment``."""
    named = lambda side, to: members.where(F.col("side") == side).groupBy(F.col("cls").alias(f"cls_{to[0]}")).agg(F.min("record_id").alias(f"record_id_{to}"), F.countDistinct("record_id").alias(f"n_{to}"))
    return links.join(named("train", "train"), "cls_t").join(named("eval", "eval"), "cls_e").select("record_id_train", "record_id_eval", "n_train", "n_eval", "distance", "containment")


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct pairs of record ids of linked classes, ``record_id_a < record_id_b``; the pairs are the result asked for."""
    t = members.where("side = 'train'").select(F.col("cls").alias("cls_t"), F.col("record_id").alias("t")).distinct()
    e = members.where("side = 'eval'").select(F.col("cls").alias("cls_e"), F.col("record_id").alias("e")).distinct()
    pairs = links.join(t, "cls_t").join(e, "cls_e").where("t <> e")
    return pairs.select(F.least("t", "e").alias("record_id_a"), F.greatest("t", "e").alias("record_id_b")).distinct()


def overlap_report(members: DataFrame, links: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Evaluation records and those with a relative in training, counted by the columns ``by`` of ``members``; no pair of records is made."""
    linked = links.select(F.col("cls_e").alias("cls")).distinct().withColumn("hit", F.lit(1))
    records = members.where("side = 'eval'").join(linked, "cls", "left").groupBy("record_id", *by).agg(F.max("hit").alias("hit"))
    return records.groupBy(*by).agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping"))
