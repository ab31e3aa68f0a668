"""Most similar vectors of every vector: multiprobe p-stable hashing, and for
pairs of a high cosine few large cross-polytope cells (``near_candidates``).

Every usable vector enters its own bucket in each table and the perturbed
buckets in which its neighbours most probably lie. Buckets travel as
(cell, id, fixed-point code) through one shuffle; inside a bucket the full
distance is evaluated, and the lists of all tables are merged and ranked.

Scale: the shuffle carries ``copies`` codes of 2 bytes a value for each
vector, whatever the number of vectors. A bucket above the cap is cut
into a grid of cells that together hold every pair of the bucket, so no task
holds more than two blocks and no pair is lost. The only thing sent to all tasks
is the list of such buckets, at most ``MOST_HEAVY`` by the choice of the cap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lecterna.llm import hashing as H
from lecterna.plans.lineage import written

#: Rows of a bucket that one task compares; larger buckets are cut into a grid.
BLOCK = 30_000
#: At most so many buckets can exceed the cap, as the cap is copies * n / MOST_HEAVY at least.
MOST_HEAVY = 10_000
#: Bytes that a task reads of the rows to compare, whatever their number.
TASK_BYTES = 2 << 20
#: Rows that a cell of ``near_candidates`` has about.
ROWS = 60_000
#: Pairs of which so many may be sent to every task: 16 bytes each.
SMALL = 300_000

CELLS = "cell long, side int, id long, code binary"


def usable(vec: Column, dim: int) -> Column:
    """True for a vector of ``dim`` finite values that are not all zero."""
    return (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(vec, lambda x: x != 0)


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of the usable vectors of a batch (id, vec)."""
    ids, vec = batch.column(0), batch.column(1)
    lens = np.asarray(vec.value_lengths().fill_null(-1))
    ok = (lens == dim) & ~np.asarray(ids.is_null())
    # a null inside a vector becomes NaN and makes it unusable
    vec = vec.filter(pa.array(ok))
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x, fine = H.unit(flat, dim)
    return np.asarray(ids.filter(pa.array(ok)))[fine].astype(np.int64), x


def packed_rows(data: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    offsets = (np.arange(len(data) + 1) * data.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def unpacked_rows(col: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary column without nulls, ``width`` a row."""
    start = int(np.frombuffer(col.buffers()[1], np.int32)[col.offset]) if len(col) else 0
    return np.frombuffer(col.buffers()[2], np.uint8)[start : start + len(col) * width].reshape(len(col), width) if len(col) else np.zeros((0, width), np.uint8)


#: Rows of a batch (ids, unit rows, bytes that travel with each).
Reader = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _hash(read: Reader, hasher: H.Hasher | H.Polytope, heavy: dict[int, int] | None, grid: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """heavy: the number of blocks of each bucket above the cap; None: only the keys are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(heavy or ()), np.int64)
        blocks = np.array([(heavy or {})[int(k)] for k in known], np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                ids, x, data = read(whole.slice(at, 4096))
                if not len(ids):
                    continue
                keys = hasher.keys(x)
                new = H.distinct(keys)
                cell, row = keys[new], np.nonzero(new)[0]
                if heavy is None:
                    yield pa.RecordBatch.from_arrays([pa.array(cell)], names=["bucket"])
                    continue
                side = np.zeros(len(cell), np.int32)  # 1 and 2: the two blocks of a cell of a cut bucket
                if len(known):
                    p = np.minimum(np.searchsorted(known, cell), len(known) - 1)
                    hot = np.nonzero(known[p] == cell)[0]
                    if len(hot):
                        m = blocks[p[hot]]
                        own = (H.mix(ids[row[hot]]).astype(np.uint64) % m.astype(np.uint64)).astype(np.int64)
                        if not grid:
                            m = np.ones_like(m)
                        rep = np.repeat(np.arange(len(hot)), m)
                        other = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) if grid else own
                        o = own[rep]
                        with np.errstate(over="ignore"):
                            c = H.mix(cell[hot][rep] + np.minimum(o, other) * np.int64(1_000_003) + np.maximum(o, other) * np.int64(998_244_353) + 1)
                        s = np.where(o == other, 0, np.where(o < other, 1, 2)).astype(np.int32)
                        cold = np.ones(len(cell), bool)
                        cold[hot] = False
                        cell, row, side = np.r_[cell[cold], c], np.r_[row[cold], row[hot][rep]], np.r_[side[cold], s].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(side), pa.array(ids[row]), packed_rows(data[row])], names=["cell", "side", "id", "code"])

    return run


def unit_reader(dim: int, bits: int) -> Reader:
    """Reads (id, vec); a usable vector travels as its fixed-point code."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x = _rows(batch, dim)
        codes = H.encode(x, bits)
        return ids, x, codes.view(np.uint8).reshape(len(codes), dim * codes.itemsize)

    return read


def cells(df: DataFrame, read: Reader, hasher: H.Hasher | H.Polytope, n: int, *, grid: bool = True, block: int = 0) -> DataFrame:
    """(cell, side, id, code): every row of ``df`` in the cells in which it is
    compared. A bucket above the cap (``block`` rows, else ``BLOCK``) is cut into blocks
    by the id; with ``grid`` every pair of blocks is a cell, else every block alone."""
    copies = hasher.copies
    cap = max(block or BLOCK, -(-copies * n // MOST_HEAVY))
    heavy: dict[int, int] = {}
    if copies * n > cap:
        counts = df.mapInArrow(_hash(read, hasher, None, grid), "bucket long").groupBy("bucket").count().where(F.col("count") > cap)
        heavy = {r["bucket"]: -(-r["count"] // cap) for r in counts.collect()}
    return df.mapInArrow(_hash(read, hasher, heavy, grid), CELLS)


def by_cell(parts: DataFrame, kernel: Callable[..., list[pa.Array]], names: list[str], schema: str, width: int, rows: int, *, alone: bool = False) -> DataFrame:
    """``kernel(ids, bytes, side)`` over every cell, one cell in memory at a time;
    cells of one row only if ``alone``. ``side`` is None for a whole cell. There
    are about ``rows`` rows in ``parts``: a task reads ``TASK_BYTES`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(cell: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.asarray(b.column(2)) for b in cell])
            if len(ids) < 2 - alone:
                return
            side = np.concatenate([np.asarray(b.column(1)) for b in cell])
            data = np.concatenate([unpacked_rows(b.column(3), width) for b in cell])
            for s in (None, 0):  # a cell is whole (side 0) or a pair of blocks (sides 1, 2)
                m = side == 0 if s is None else side != 0
                if m.sum() > 1 - (alone and s is None):
                    out = kernel(ids[m], data[m], None if s is None else side[m])
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays(out, names=names)

        open_, key = [], None
        for b in batches:
            k = np.asarray(b.column(0))
            cuts = np.r_[0, np.nonzero(np.diff(k))[0] + 1, len(k)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi <= lo:
                    continue
                if open_ and k[lo] != key:
                    yield from work(open_)
                    open_ = []
                key = k[lo]
                open_.append(b.slice(lo, hi - lo))
        if open_:
            yield from work(open_)

    tasks = max(parts.sparkSession.sparkContext.defaultParallelism, -(-rows * (width + 24) // TASK_BYTES))
    return parts.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays in double precision."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def measured(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """``pairs`` (id, other, ...) with their cosine in full precision as
    ``similarity``. Up to ``SMALL`` pairs are sent to the vectors; beyond that
    both are shuffled."""
    one = base.dropDuplicates(["id"]) if pairs.count() > SMALL else None
    if one is not None:
        out = pairs.join(one.withColumnRenamed("vec", "x"), "id").join(one.select(F.col("id").alias("other"), F.col("vec").alias("y")), "other")
    else:
        ends = F.broadcast(pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct())
        some = base.join(ends, "id").groupBy("id").agg(F.first("vec").alias("vec"))
        out = pairs.join(some.withColumnRenamed("vec", "x"), "id").join(some.select(F.col("id").alias("other"), F.col("vec").alias("y")), "other")
    return out.withColumn("similarity", cosine(F.col("x"), F.col("y"))).drop("x", "y")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``2 * k`` best of each id in the lists of all cells, with their place."""
    best = found.groupBy("id", "other").agg(F.max("est").alias("est"), F.max("err").alias("err"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("est"), "other"))
    return best.withColumn("nth", nth).where(F.col("nth") <= 2 * k)


def candidates(df: DataFrame, *, k: int, least: float, dim: int, tables: int, functions: int, width: float, probes: int, every: int = 1) -> DataFrame:
    """(id, other, est, err): of every vector of ``df`` (id, vec) whose id is a
    multiple of ``every`` the best candidates of all tables among all vectors, twice
    as many as are wanted, by 8-bit similarity."""
    n = df.count()
    plan = H.plan_for(n, dim, tables=tables, functions=functions, width=width, probes=probes, bits=8)

    def kernel(ids: np.ndarray, data: np.ndarray, side: np.ndarray | None) -> list[pa.Array]:
        a, b, v, e = H.top_pairs(ids, data.view(np.int8), 2 * k, least, side, every)
        return [pa.array(a), pa.array(b), pa.array(v), pa.array(e)]

    found = by_cell(cells(df, unit_reader(dim, 8), H.Hasher(plan), n), kernel, ["id", "other", "est", "err"], "id long, other long, est float, err float", dim, n * plan.copies)
    return _best(found, k)


def near_hasher(n: int, dim: int, least: float) -> H.Polytope:
    """Cells for pairs of a cosine of ``least`` or more among ``n`` vectors: one
    table, few large cells, and for every row those whose wall is near."""
    cells = max(32, 3 * n // ROWS)
    each = 3 if cells <= 48 else 4 if cells <= 160 else 5 if cells <= 2 * dim else 8
    return H.Polytope(dim, 1, cells, each, 5, 0.2 * math.sqrt(max(0.0, 2 - 2 * least)))


def near_candidates(df: DataFrame, *, k: int, least: float, dim: int) -> DataFrame:
    """As ``candidates``, for a high ``least``: every vector travels to a few large
    cells, and what it is compared with is sought inside a cell (``hashing.near_pairs``)."""
    n = df.count()
    hasher = near_hasher(n, dim, least)

    def kernel(ids: np.ndarray, data: np.ndarray, side: np.ndarray | None) -> list[pa.Array]:
        return [pa.array(z) for z in H.near_pairs(ids, data.view(np.int8), 2 * k, least, side)]

    parts = cells(df, unit_reader(dim, 8), hasher, n, block=5 * BLOCK)
    return _best(by_cell(parts, kernel, ["id", "other", "est", "err"], "id long, other long, est float, err float", dim, n * hasher.copies), k)


#: For the neighbours of every vector, however alike they are.
HOW_ANY = {"dim": 192, "tables": 4, "functions": 12, "width": 6.0, "probes": 1}


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, *, k: int = 5, least: float = -1.0, every: int = 1, **how: object) -> DataFrame:
    """(id, other, similarity, rank): for every usable vector of ``df`` its
    ``k`` most similar other vectors of cosine ``least`` or more; with ``every``,
    for those whose id is a multiple of it, against all.

    Vectors whose length isn't ``dim``, with a null, NaN or infinite value or
    all zero, and rows with a null id, have no row in the result. Repeated ids
    count once. Ties go to the smaller id; equal vectors are each other's
    neighbours at similarity 1. An empty table gives an empty result, and other
    columns of ``df`` are ignored whatever their names. The 2k best candidates of
    a vector by 8-bit similarity are ranked by their full cosine; recall against
    brute force grows with the similarity (the README has measured figures).
    """
    h = {**HOW_ANY, **how}
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    cand = written(candidates(base, k=k, least=least, every=every, **h).select("id", "other"), "candidates")
    true = measured(cand, base).where(F.col("similarity") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return true.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "similarity", "rank")


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, *, k: int = 5, least: float = 0.9, dim: int = 192) -> DataFrame:
    """(vec_id_a, vec_id_b): pairs of which one is among the other's ``k``
    most similar vectors, at a cosine of ``least`` or more, each pair once.

    As ``similar_vectors``, but the full cosine is only evaluated where the
    8-bit similarity, with its error, doesn't settle whether the pair reaches
    ``least`` or stands among the ``k``; nothing else about a pair is returned.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    cand = near_candidates(base, k=k, least=least, dim=dim)
    mine = Window.partitionBy("id")
    # the estimate at place k and the one after it; a gap below their errors leaves the place open
    at = lambda n: F.max(F.when(F.col("nth") == n, F.col("est"))).over(mine)
    cand = cand.withColumn("here", at(k)).withColumn("after", at(k + 1))
    open_rank = F.col("after").isNotNull() & (F.col("here") - F.col("after") < 2 * F.col("err")) & (F.abs(F.col("est") - F.col("here")) < 2 * F.col("err"))
    cand = written(cand.select("id", "other", "est", "nth", (open_rank | (F.abs(F.col("est") - least) <= F.col("err"))).alias("open")), "candidates")
    true = measured(cand.where("open").select("id", "other", "est", "nth"), base).where(F.col("similarity") >= least)
    settled = cand.where(~F.col("open")).select("id", "other", "nth", F.col("est").cast("double").alias("similarity"))
    # in a list with an open place, the settled ones above it stay above, those below stay below
    every = settled.select("id", "other", "similarity").unionByName(true.select("id", "other", "similarity"))
    rank = F.row_number().over(mine.orderBy(F.desc("similarity"), "other"))
    near = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()
