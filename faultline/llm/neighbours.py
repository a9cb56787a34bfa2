"""The k most similar vectors for every vector of a collection.

An inverted index whose lists are cut by spherical k-means.  What a vector
differs by from its list's centre is coded in four bits for each pair of
dimensions, with a loss that weighs the error along the vector more than the
error across it, as only the former changes large inner products.  A query
scans the codes of its nearest lists by table look-ups; the best of each list
are ranked again by the exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.workspace import join_groups, materialize

#: Lists that lie near each other share a task, so that a query is sent once for most lists it asks; at least so many tasks.
BLOCKS = 64
#: Vectors that meet in one task with as many queries as ASKED, about; a larger block is cut into parts, each of which sees all its queries.
PART, ASKED = 32_768, 65_536
#: Vectors that are searched by brute force in the whole collection, to measure recall when an index is fitted.
PROBED = 512
#: Cosines above this matter; it sets the weight of the parallel error.
THRESHOLD = 0.2


class Settings(NamedTuple):
    """How an index is fitted and asked.

    ``sample`` vectors at most are fitted on and ``lists`` centres at most are
    made; with the code books they are what is sent to all tasks (2 MB for
    8,192 lists of 64 dimensions).  The number of lists grows with the root of
    the collection; where ``lists`` stops it (at 17 million vectors), lists grow
    instead, so larger collections should have more of both, as far as the
    driver's memory goes.  ``recall`` is what the lists asked and the candidates
    ranked again must each reach for some vectors, whose neighbours are found by
    brute force in the whole collection; both numbers grow until they do, up to
    all.  ``exact`` compares all with all, in blocks.
    """

    sample: int = 65_536
    lists: int = 8192
    recall: float = 0.985
    exact: bool = False


class Index(NamedTuple):
    centres: np.ndarray  # lists x dims
    books: np.ndarray  # pairs of dimensions x 16 x 2
    block: np.ndarray  # the block of each list
    parts: np.ndarray  # parts of each block's vectors
    shifts: np.ndarray  # parts of each block's queries
    weight: float  # of the parallel error, less 1
    probes: int  # lists a vector asks
    rerank: int  # candidates of a list that are ranked by the exact cosine, for each query
    found: float  # recall measured


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` centres of the largest inner product, best first."""
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 1024):
        score = x[a : a + 1024] @ centres.T
        if k == 1:
            out[a : a + 1024, 0] = score.argmax(1)
            continue
        top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.broadcast_to(np.arange(k), (len(score), k))
        order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
        out[a : a + 1024] = np.take_along_axis(top, order, 1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres, 1)[:, 0]
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, at, x)
        length = np.linalg.norm(sums, axis=1)
        fresh = length > 1e-9
        centres[fresh] = (sums[fresh] / length[fresh, None]).astype(np.float32)
    return centres


def encode(x: np.ndarray, residual: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x pairs) by coordinate descent on |r|^2 + weight * (r . x)^2, r being the error."""
    n, pairs = len(x), len(books)
    t, u = residual.reshape(n, pairs, 2), x.reshape(n, pairs, 2)
    codes = np.zeros((n, pairs), np.uint8)
    along = np.zeros((n, pairs), np.float32)  # each pair's part of r . x
    for sweep in range(sweeps + 1):
        whole = along.sum(1)
        for s in range(pairs):
            diff = t[:, s, None, :] - books[s][None]  # rows x 16 x 2
            par = np.einsum("ncd,nd->nc", diff, u[:, s])
            loss = (diff * diff).sum(2)
            if sweep:  # the first sweep takes the nearest word of each pair by itself
                loss += weight * (whole[:, None] - along[:, s, None] + par) ** 2
            best = loss.argmin(1)
            codes[:, s] = best
            now = np.take_along_axis(par, best[:, None], 1)[:, 0]
            whole += now - along[:, s]
            along[:, s] = now
    return codes


def _fit_books(x: np.ndarray, residual: np.ndarray, weight: float, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    n, pairs = len(x), x.shape[1] // 2
    t, u = residual.reshape(n, pairs, 2).astype(np.float64), x.reshape(n, pairs, 2).astype(np.float64)
    books = np.stack([t[rng.choice(n, 16, replace=n < 16), s] for s in range(pairs)]).astype(np.float32)
    for _ in range(rounds):
        codes = encode(x, residual, books, weight, 1)
        error = t - books[np.arange(pairs)[None], codes]
        along = (error * u).sum(2)
        whole = along.sum(1)
        for s in range(pairs):
            # the word that makes the loss least, the other pairs' words being kept: (sum I + w u u') c = sum t + w u (rest + u.t)
            rest = whole - along[:, s]
            left = np.zeros((16, 2, 2))
            right = np.zeros((16, 2))
            np.add.at(left, codes[:, s], np.eye(2) + weight * u[:, s, :, None] * u[:, s, None, :])
            np.add.at(right, codes[:, s], t[:, s] + weight * u[:, s] * (rest + (u[:, s] * t[:, s]).sum(1))[:, None])
            used = np.bincount(codes[:, s], minlength=16) > 0
            books[s][used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
    return books


def fit(sample: np.ndarray, total: int, k: int, settings: Settings, asked: np.ndarray | None = None, near: np.ndarray | None = None, seed: int = 7) -> Index:
    """An index for ``total`` vectors, fitted on unit vectors ``sample`` and on the neighbours ``near`` (queries x k vectors) of some queries; if not given, on neighbours within the sample."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    if settings.exact:
        parts = max(1, math.ceil(total / PART))
        return Index(np.zeros((1, dims), np.float32), np.zeros((dims // 2, 16, 2), np.float32), np.zeros(1, np.int32), np.array([parts]), np.array([max(1, math.ceil(total / ASKED))]), 0.0, 1, total, 1.0)
    lists = max(1, min(settings.lists, int(2 * math.sqrt(total)), len(sample) // 8 or 1))
    centres = _kmeans(sample, lists, rng)
    weight = max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)) - 1
    few = sample[rng.choice(len(sample), min(len(sample), 16_384), replace=False)]
    books = _fit_books(few, few - centres[_nearest(few, centres, 1)[:, 0]], weight, rng)
    at = _nearest(sample, centres, 1)[:, 0]
    if asked is None:
        asked = sample[rng.choice(len(sample), min(PROBED, len(sample)), replace=False)]
        score = asked @ sample.T
        score[score > 1 - 1e-6] = -2
        near = sample[np.argsort(-score, axis=1)[:, :k]]
    probes, rerank, found = _tune(sample, at, centres, books, weight, total, asked, near, settings.recall)
    blocks = min(lists, max(BLOCKS, total // PART))
    block = _nearest(centres, _kmeans(centres, blocks, rng), 1)[:, 0]
    share = np.bincount(block[at], minlength=blocks) / len(sample)
    rows = np.repeat(np.arange(len(few)), probes)
    pairs = np.unique(rows * blocks + block[_nearest(few, centres, probes).ravel()]) % blocks
    asked = np.bincount(pairs, minlength=blocks) / len(few)
    count = lambda x, size: np.maximum(1, np.ceil(x * total / size)).astype(np.int32)
    return Index(centres, books, block.astype(np.int32), count(share, PART), count(asked, ASKED), weight, probes, rerank, found)


def _tune(x, at, centres, books, weight, total: int, asked, near, target: float) -> tuple[int, int, float]:
    """The lists to ask and the candidates of a list to rank again that find ``target`` of the neighbours ``near`` of the queries ``asked``."""
    if not near.size or len(centres) == 1:
        return 1, 40, 1.0
    flat = near.reshape(-1, near.shape[2])
    home = _nearest(flat, centres, 1)[:, 0].reshape(near.shape[:2])
    ranked = _nearest(asked, centres, len(centres))
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(len(centres), dtype=np.int32)[None].repeat(len(asked), 0), 1)
    needed = np.take_along_axis(place, home, 1) + 1  # lists to ask until a neighbour's is among them
    probes = 1
    while probes < len(centres) and (needed <= probes).mean() < target:
        probes = min(probes + (probes // 2 or 1), len(centres))
    # how many of a neighbour's list mates the codes put before it; the sample's are a part of them
    codes = encode(x, x - centres[at], books, weight)
    own = encode(flat, flat - centres[home.ravel()], books, weight).reshape(*near.shape[:2], -1)
    order, starts = np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(len(centres) + 1))
    behind = np.empty(home.shape)
    pair = np.arange(len(books))
    for i, q in enumerate(asked):
        table = np.einsum("pcd,pd->pc", books, q.reshape(-1, 2))
        for j, one in enumerate(home[i]):
            mates = order[starts[one] : starts[one + 1]]
            behind[i, j] = (table[pair, codes[mates]].sum(1) > table[pair, own[i, j]].sum()).sum()
    behind *= max(1.0, total / len(x))
    rerank = 40
    while rerank < total and (behind < rerank).mean() < target:
        rerank *= 2
    return probes, rerank, float(((needed <= probes) & (behind < rerank)).mean())


def _brute(queries, names: list[str], k: int):
    """The ``k`` nearest vectors of a task's rows for each query: ``q, id, v, cosine``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        dims = asked.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            ids = np.array(batch.column("id").to_pylist(), object)
            score = asked @ x.T
            score[ids[None, :] == np.array(names, object)[:, None]] = -2
            few = min(k, score.shape[1])
            top = np.argpartition(-score, few - 1, axis=1)[:, :few] if few < score.shape[1] else np.broadcast_to(np.arange(few), score.shape)
            q = np.repeat(np.arange(len(asked)), few)
            cosine = np.take_along_axis(score, top, 1).ravel()
            real = cosine > -2
            at = top.ravel()[real]
            yield pa.RecordBatch.from_arrays([pa.array(q[real], pa.int32()), pa.array(ids[at], pa.string()), pa.array([r.tobytes() for r in x[at]], pa.binary()), pa.array(cosine[real].astype(np.float64))], ["q", "id", "v", "cosine"])

    return search


def _true_neighbours(reps: DataFrame, ids: list[str], asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The queries and their ``k`` nearest vectors in all of ``reps``: a scan of the collection that keeps a few vectors of each batch."""
    queries = reps.sparkSession.sparkContext.broadcast(asked)
    found = reps.select("id", "v").mapInArrow(_brute(queries, ids, k), "q int, id string, v binary, cosine double")
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    table = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).orderBy("q", "nth").select("q", "v").toArrow()  # at most k for each query
    q, v = table.column("q").to_numpy(), np.frombuffer(b"".join(table.column("v").to_pylist()), np.float32).reshape(-1, asked.shape[1])
    least = np.bincount(q, minlength=len(asked)).min() if len(q) else 0
    first = np.searchsorted(q, np.arange(len(asked)))
    return asked, v[first[:, None] + np.arange(least)[None]] if least else np.empty((len(asked), 0, asked.shape[1]), np.float32)


def _spread(index, dims: int):
    """Rows of data (once for each part of their block's queries) and of queries (once for each part of the blocks that hold lists they ask)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, block, parts, shifts, weight, probes, _, _ = index.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("id")
            raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.float32)
            x = _unit(raw)
            near = _nearest(x, centres, probes)
            codes = encode(x, x - centres[near[:, 0]], books, weight) if len(centres) > 1 else np.zeros((n, dims // 2), np.uint8)
            codes = codes[:, ::2] << 4 | np.pad(codes[:, 1::2], ((0, 0), (0, codes.shape[1] % 2)))  # two in a byte
            vectors = pa.array([r.tobytes() for r in raw], pa.binary())
            mark = np.arange(n) * 2654435761 + np.frombuffer(raw.tobytes(), np.uint32).reshape(n, dims)[:, 0]
            home = block[near[:, 0]]
            own = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), pa.array(near[:, 0], pa.int32()))
            yield _rows(home, mark % parts[home], shifts[home], True, ids, vectors, pa.array([r.tobytes() for r in codes], pa.binary()), own)
            row, lists = np.repeat(np.arange(n), near.shape[1]), near.ravel()
            order = np.lexsort((block[lists], row))
            row, lists = row[order], lists[order]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[lists[1:]] != block[lists[:-1]])])
            asked = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(lists, pa.int32()))
            row, to = row[starts], block[lists[starts]]
            take = pa.array(row)
            yield _rows(to, mark[row] // 7 % shifts[to], parts[to], False, ids.take(take), vectors.take(take), pa.nulls(len(row), pa.binary()), asked)

    return spread


def _rows(blocks, own, times, data: bool, *columns) -> pa.RecordBatch:
    """Every row ``times`` over: with its own place on one side of the block, and every place on the other."""
    row = np.repeat(np.arange(len(blocks)), times)
    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    part, shift = (own[row], other) if data else (other, own[row])
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(blocks[row], pa.int32()), pa.array(part, pa.int32()), pa.array(shift, pa.int32()), *(c.take(take) for c in columns)], ["block", "part", "shift", "id", "v", "code", "lists"])


def _scan(index, dims: int, k: int):
    def scan(table: pa.Table) -> pa.Table:
        books, rerank = index.value[1], index.value[7]
        is_data = np.asarray(table.column("code").is_valid())
        data, asked = table.filter(pa.array(is_data)).sort_by("id"), table.filter(pa.array(~is_data))
        ones, twos, scores = [], [], []
        if data.num_rows and asked.num_rows:
            x = np.frombuffer(b"".join(data.column("v").to_pylist()), np.float32).reshape(-1, dims)
            packed = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(x), -1)[:, : dims // 2]
            q = np.frombuffer(b"".join(asked.column("v").to_pylist()), np.float32).reshape(-1, dims)
            home = data.column("lists").combine_chunks().flatten().to_numpy()
            wanted = asked.column("lists").combine_chunks()
            asker = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy())
            wanted = wanted.flatten().to_numpy()
            for one in np.unique(home):
                mine, theirs = np.flatnonzero(home == one), asker[wanted == one]
                step = max(16, min(1024, (1 << 23) // len(mine)))
                for a in range(0, len(theirs), step):
                    some = theirs[a : a + step]
                    at, who, score = _best(x[mine], codes[mine], q[some], books, k + 1, rerank)
                    ones.append(some[who]), twos.append(mine[at]), scores.append(score)
        if not ones:
            return pa.Table.from_arrays([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], ["id", "neighbour", "cosine"])
        one, two, score = np.concatenate(ones), np.concatenate(twos), np.concatenate(scores)
        names, askers = data.column("id").combine_chunks(), asked.column("id").combine_chunks()
        # of all lists, the best for each query
        order = np.lexsort((two, -score, one))
        one, two, score = one[order], two[order], score[order]
        first = np.maximum.accumulate(np.where(np.r_[True, one[1:] != one[:-1]], np.arange(len(one)), 0))
        keep = np.arange(len(one)) - first <= k
        out = pa.Table.from_arrays([askers.take(pa.array(one[keep])), names.take(pa.array(two[keep])), pa.array(score[keep])], ["id", "neighbour", "cosine"])
        return out.filter(pc.not_equal(out.column("id"), out.column("neighbour")))

    return scan


def _best(x, codes, q, books, k, rerank):
    """The ``k`` best data rows of each query: row, query, exact cosine; found by the codes, ranked by the vectors. Ties go to the earlier row."""
    pairs = len(books)
    length = np.linalg.norm(x.astype(np.float64), axis=1)
    unit = q.astype(np.float64) / np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True)
    if rerank >= len(x):  # all are ranked
        exact = unit @ (x.astype(np.float64) / length[:, None]).T
        few = min(k, len(x))
        least = np.partition(exact, len(x) - few, axis=1)[:, len(x) - few]
        who, at = np.nonzero(exact >= least[:, None] - 2e-9)  # with all that may be equal once rounded
        return at, who, np.round(exact[who, at], 9)
    tables = np.matmul(books, np.ascontiguousarray(unit.astype(np.float32).reshape(len(q), pairs, 2).transpose(1, 2, 0)))  # pairs x 16 x queries
    score = np.zeros((len(x), len(q)), np.float32)
    for s in range(pairs):
        score += tables[s].take(codes[:, s], axis=0)
    top = np.sort(np.argpartition(-score, rerank - 1, axis=0)[:rerank], axis=0)
    near = np.empty(top.shape)
    for a in range(0, len(q), 128):  # so that few vectors are copied at once
        near[:, a : a + 128] = np.einsum("rqd,qd->rq", x[top[:, a : a + 128]], unit[a : a + 128], optimize=True)
    near = np.round(near / length[top], 9)
    keep = np.argsort(-near, axis=0, kind="stable")[:k]
    at = np.take_along_axis(top, keep, 0)
    return at.ravel(), np.tile(np.arange(len(q)), len(keep)), np.take_along_axis(near, keep, 0).ravel()


def usable(df: DataFrame, record_id: str, vector: str, dims: int) -> DataFrame:
    """``id, v`` of the rows with an id and a vector of ``dims`` finite numbers that aren't all zero."""
    v = F.col("v")
    rows = df.select(F.col(record_id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    inf = F.lit(float("inf")).cast("float")
    finite = (F.size(v) == dims) & ~F.coalesce(F.array_contains(v, F.lit(float("nan")).cast("float")), F.lit(True)) & (F.array_max(v) < inf) & (F.array_min(v) > -inf)
    return rows.where(F.col("id").isNotNull() & finite & ((F.array_max(v) > 0) | (F.array_min(v) < 0)))


def nearest(df: DataFrame, record_id: str, vector: str, dims: int = 64, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """For each usable vector the ``k`` others of the highest cosine: ``id, neighbour, cosine, rank``.

    Vectors that are null, of another length, hold a null, NaN or infinity or
    are all zero are neither queries nor neighbours.  Ids are read as strings;
    rows that repeat both id and vector count once.  Equal vectors are
    searched once, however many there are, and are each other's neighbours
    first; ties (of nine decimals) go to the smaller id.  A collection of k or fewer gives fewer
    neighbours, an empty one none.  The search is approximate unless
    ``settings`` ask for an exact one: how many lists a vector asks is set by
    the recall that a held-out sample reaches.  ``dims`` must be even.
    """
    if dims % 2 or k < 1:
        raise ValueError("an even number of dimensions and k >= 1 are needed")
    spark = df.sparkSession
    rows = usable(df, record_id, vector, dims).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    groups = rows.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    many = materialize(groups.where("n > 1"))
    copies, repeated = many.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_rows = rows.count()
    total = n_rows - repeated + copies  # different vectors: what is sampled, indexed and searched
    if not total:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    reps = rows
    if copies:
        reps = join_groups(rows, many, ["k1", "k2"], "n", n_rows, "left").where("first is null or id = first").drop("first", "n").dropDuplicates(["id", "k1", "k2"])
    want = min(settings.sample, max(16_384, 32 * int(2 * math.sqrt(total))))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id", "k1"), F.lit(1 << 30)) < int(min(1.0, want / total) * (1 << 30))
    sample = reps.where(chance).select("id", "v").toArrow().combine_chunks()
    if sample.num_rows * 2 < min(want, total):  # can't happen but for a poor hash; an index of a handful finds little
        sample = reps.select("id", "v").limit(want).toArrow().combine_chunks()
    x = _unit(sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    some = np.random.default_rng(3).permutation(len(x))[:PROBED]
    true = (None, None) if settings.exact else _true_neighbours(reps, [sample.column("id")[int(i)].as_py() for i in some], x[some], k)
    index = spark.sparkContext.broadcast(tuple(fit(x, total, k, settings, *true)))  # plain arrays: tasks need no class of this package
    spread = reps.select("id", "v").mapInArrow(_spread(index, dims), "block int, part int, shift int, id string, v binary, code binary, lists array<int>")
    hits = spread.groupBy("block", "part", "shift").applyInArrow(_scan(index, dims, k), "id string, neighbour string, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return _with_copies(hits, rows, many, n_rows, k) if copies else hits


def _with_copies(hits: DataFrame, rows: DataFrame, many: DataFrame, total: int, k: int) -> DataFrame:
    """Neighbours among representatives carried over to all copies: each group stands by its k + 1 smallest ids, and its rows share one list."""
    members = join_groups(rows.select("id", "k1", "k2"), many, ["k1", "k2"], "n", total).select("id", "first").distinct()
    some = members.withColumn("nth", F.row_number().over(Window.partitionBy("first").orderBy("id"))).where(F.col("nth") <= k + 1).select(F.col("id").alias("other"), "first")  # cut to k + 1 before the shuffle, too
    some = materialize(some)
    named = hits.join(some, F.col("neighbour") == F.col("first"), "left").select("id", F.coalesce("other", "neighbour").alias("other"), "cosine")
    own = some.select(F.col("first").alias("id"), "other", F.lit(1.0).alias("cosine"))
    # at most (k + 1) * (k + 1) names each
    lists = named.unionByName(own).groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "other"))).alias("near"))
    sizes = many.select(F.col("first").alias("id"), "n")
    shared = materialize(lists.join(sizes, "id", "left"))
    of_groups = join_groups(members, shared.where("n is not null").select(F.col("id").alias("first"), "n", "near"), "first", "n", total)
    all_ = shared.where("n is null").select("id", "near").unionByName(of_groups.select("id", "near"))
    mine = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return all_.select("id", F.posexplode(mine).alias("pos", "x")).select("id", F.col("x.other").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Distinct unordered pairs of which one is among the other's neighbours: ``record_id_a < record_id_b``."""
    return found.select(F.least("id", "neighbour").alias("record_id_a"), F.greatest("id", "neighbour").alias("record_id_b")).distinct()
