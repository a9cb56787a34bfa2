"""Duplicates of nested records that differ only in writing.

A record is parsed into a tree.  Its leaves are texts, of which only the letters
and digits count; ordered nodes stand for plain text, unordered nodes for
initialisers ``{ .name = value, ... }``, whose entries may stand in any order.
Digests are built bottom-up: a leaf's is that of its normalised text, an ordered
node's is that of its leaves' texts and its children's digests as they stand, an
unordered node's is that of its children's digests, sorted.  Records are grouped
by the root's digest, and every group is confirmed by comparing whole trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.workspace import join_groups, materialize, spread

#: The head of an entry up to its sign of equality; every part takes all it can, so that no text is tried twice.
_NAME = r"[^A-Za-z0-9{}();,=.]*+\.[^A-Za-z0-9_{}();,=]*+[A-Za-z_]\w*+[^A-Za-z0-9{}();,=.\"]*+=(?!=)"
_ENTRY = re.compile(_NAME)
_OPEN = re.compile(r"\{" + _NAME)
_SIGN = re.compile(r"[\"“”'/{}()\[\],;]")
_STRING = re.compile(r"\"(?:\\.|[^\"\\])*+\"", re.S)
_QUOTED = re.compile(r"[“”][^“”]*+[“”]")
_CHAR = re.compile(r"'(?:\\.|[^'\\])'", re.S)
#: Bytes of letters and digits, in lower case; all others (of other scripts, too) go.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_OTHERS = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)


def leaf(text: str) -> bytes:
    """The letters and digits (A-Z, a-z, 0-9) of a text in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER, _OTHERS)


@dataclass(slots=True)
class _Node:
    """An unordered node: where it stands, its digest, and its entries written out in the order of their digests."""

    start: int
    end: int
    digest: bytes
    parts: list


def _ordered(text: str, start: int, end: int, nodes: list[_Node]) -> tuple[bytes, list]:
    """Digest and parts (leaves and nodes) of the text between two places, in which ``nodes`` stand."""
    if not nodes:
        only = leaf(text[start:end])
        return sha256(only).digest(), [only]
    parts, whole = [], sha256()
    for node in nodes:
        before = leaf(text[start : node.start])
        parts += [before, node]
        whole.update(before + b"\x01" + node.digest)
        start = node.end
    last = leaf(text[start:end])
    whole.update(last)
    return whole.digest(), [*parts, last]


def _unordered(text: str, start: int, end: int, cuts: list[int], inside: list[_Node]) -> _Node | None:
    """The node of the initialiser between the brackets at ``start`` and ``end``; None if it is none or has a single entry."""
    entries, at = [], 0
    for a, b in zip([start + 1, *(c + 1 for c in cuts)], [*cuts, end], strict=True):
        first = at
        while at < len(inside) and inside[at].start < b:
            at += 1
        if _ENTRY.match(text, a, b):
            entries.append(_ordered(text, a, b, inside[first:at]))
        elif first < at or leaf(text[a:b]):
            return None
    if len(entries) < 2:
        return None  # a single entry has one order only
    entries.sort(key=lambda e: e[0])
    parts: list = [b"{"]
    for digest, own in entries:
        parts += own
        parts.append(b",")
    return _Node(start, end + 1, sha256(b"\x02" + b"".join(digest for digest, _ in entries)).digest(), [*parts, b"}"])


def tree(text: str) -> tuple[bytes, bytes]:
    """The root's digest and the whole tree of ``text`` written out (empty without a letter or digit).

    Brackets are matched in one pass with a stack, so the work grows with the
    text, however deep its initialisers are nested or whether they ever end.
    """
    opened = _OPEN.search(text)
    if opened is None:
        only = leaf(text)
        return sha256(only).digest(), only
    found: list[_Node] = []  # complete nodes that no other complete node holds yet
    stack: list[list] = []  # place, places of commas, number of nodes before; no commas are kept where it is no initialiser
    at, no_string, no_quoted, no_comment = opened.start(), False, False, False
    while m := _SIGN.search(text, at):
        at, sign = m.end(), m.group()
        if sign in "([{":
            stack.append([m.start(), [] if sign == "{" and _OPEN.match(text, m.start()) else None, len(found)])
        elif sign in ")]}":
            if stack:
                start, cuts, first = stack.pop()
                if cuts is not None and sign == "}" and (node := _unordered(text, start, m.start(), cuts, found[first:])):
                    found[first:] = [node]
        elif sign == ",":
            if stack and stack[-1][1] is not None:
                stack[-1][1].append(m.start())
        elif sign == ";":
            if stack:
                stack[-1][1] = None
        elif sign == '"':
            if not no_string:
                end = _STRING.match(text, m.start())
                at, no_string = (end.end(), False) if end else (at, True)
        elif sign in "“”":
            if not no_quoted:
                end = _QUOTED.match(text, m.start())
                at, no_quoted = (end.end(), False) if end else (at, True)
        elif sign == "'":
            if end := _CHAR.match(text, m.start()):
                at = end.end()
        elif text.startswith("/", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif text.startswith("*", at) and not no_comment:
            end = text.find("*/", at + 1)
            at, no_comment = (end + 2, False) if end >= 0 else (at, True)
    digest, parts = _ordered(text, 0, len(text), found)
    out, todo = [], parts[::-1]
    while todo:
        part = todo.pop()
        if isinstance(part, _Node):
            todo += part.parts[::-1]
        else:
            out.append(part)
    return digest, b"".join(out)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [tree(t) for t in batch.column("_text").to_pylist()]
        kept = [i for i, (_, written) in enumerate(made) if written]
        roots, written = pa.array([made[i][0] for i in kept], pa.binary()), pa.array([made[i][1] for i in kept], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(kept, pa.int64())), roots, written], ["_row", "_root", "_tree"])


def with_tree(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``_row, _root, _tree`` (row id, root digest, whole tree) of the rows with a letter or digit, as a written table: every text is parsed once."""
    rows = spread(df.select(F.col(row_id).alias("_row"), F.col(text).alias("_text")).where("_text is not null"))
    return materialize(rows.mapInArrow(_trees, f"_row {rows.schema['_row'].dataType.simpleString()}, _root binary, _tree binary"))


def _groups(trees: DataFrame) -> DataFrame:
    """``_root, _tree, row_id_first, n_copies`` of the confirmed groups of two or more rows, as a written table.

    Roots are counted by their digests alone; whole trees are compared only
    where a root stands twice.  Both are combined within each task before the
    shuffle, so a group of a third of all rows sends one row for each task.
    """
    roots = materialize(trees.groupBy("_root").agg(F.count("*").alias("n")).where("n > 1"))
    rows = join_groups(trees, roots, "_root", "n", trees.count())
    return materialize(rows.groupBy("_root", "_tree").agg(F.min("_row").alias("row_id_first"), F.count("*").alias("n_copies")).where("n_copies > 1"))


def copy_groups(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Groups of two or more copies: ``row_id_first, n_copies``, as in :func:`copies`; rows with a repeated or null row id count, too."""
    return _groups(with_tree(df, row_id, text)).select("row_id_first", "n_copies")


def copies(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row for every copy but the first: ``row_id_first, row_id_copy``.

    Two rows are copies if their texts have the same letters and digits (A-Z,
    a-z, 0-9) in the same order, ignoring case and everything else; the entries
    of an initialiser may stand in any order, at any depth.  A group's first row
    has its smallest row id.  Null texts and texts without a letter or digit
    have no copies.  Every row gives a row of its own unless it has the group's
    first row id, also if its id is repeated; rows without an id give none.
    An initialiser that never ends is plain text.  Other columns are ignored.
    """
    trees = with_tree(df, row_id, text)
    groups = _groups(trees)
    # one root, two trees: as good as impossible, but then rows must be told apart by their trees
    shared = groups.groupBy("_root").agg(F.count("*").alias("trees")).where("trees > 1").select("_root")
    total = trees.count()
    if shared.isEmpty():
        pairs = join_groups(trees.select("_row", "_root"), groups.select("_root", "row_id_first", "n_copies"), "_root", "n_copies", total)
    else:
        pairs = join_groups(trees, groups, ["_root", "_tree"], "n_copies", total)
    return pairs.where("_row <> row_id_first").select("row_id_first", F.col("_row").alias("row_id_copy"))
