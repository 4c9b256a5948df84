"""Exact top-k inner products by a Voronoi kNN join (operator 8).

Vectors become integers, floor(256 x). One more coordinate lifts all vectors to
the largest norm, and queries are scaled to it (which changes no ranks), so
that larger inner products are smaller distances on one sphere and the triangle
inequality prunes. Pivots are settled on a bounded sample of the queries;
queries form groups by their nearest pivot. One pass over the data summarises
it per group: the k + 1 smallest pivot distances of different ids, and the
group's radius. With reach = radius + the last of them, every query of the group
has k neighbours within reach, so only vectors within reach + radius of the
pivot are replicated to it. Groups that would need more than half of the data
share one copy of it, so where nothing can be pruned each vector is sent once.
Groups are solved in parts of data and blocks of queries of bounded size, and
the parts' best are merged.

Defined results: vectors that are null, or hold a null or non-finite
component, take no part; shorter ones are filled with zeros; a null vec_id
takes no part; a query id given twice is answered once, with the smaller of its
vectors; other ids given twice are candidates twice; equal scores go to smaller
ids; fewer than k candidates are all returned; an empty table gives no rows.
Very long vectors are taken whole; scores are exact while squared norms stay
under 2**63. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIVOTS, TOP, PART_ROWS, QUERY_BLOCK = 64, 5, 20_000, 128
#: Queries of a group that one task answers; more are more blocks.
PART_QUERIES = 50_000
#: Queries that the pivots are settled on.
SAMPLE_QUERIES = 4096
#: Groups that need more than this part of the data share one copy of it.
SHARED_PART = 0.5


def _vectors(vectors: DataFrame) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, dims: int, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(kind)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)] = flat
    return out


def _distances(points: np.ndarray, pivots: np.ndarray, square: float) -> np.ndarray:
    """Between points and pivots that all lie on the sphere."""
    return np.sqrt(np.maximum(2 * square - 2 * points @ pivots.T, 0))


def _lifted(x: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))[:, None]])


def _scaled(x: np.ndarray, square: float) -> np.ndarray:
    """Queries on the sphere; one of zeros, to which all are equal, is put at its pole."""
    size = np.sqrt((x * x).sum(1))
    out = np.hstack([x * np.sqrt(square) / np.where(size > 0, size, 1)[:, None], np.zeros((len(x), 1))])
    out[size == 0, -1] = np.sqrt(square)
    return out


def settle(points: np.ndarray, pivots: int, square: float, rounds: int = 8) -> np.ndarray:
    """Pivots on the sphere: farthest first, then a few rounds of means."""
    chosen = [0]
    near = _distances(points, points[:1], square)[:, 0]
    while len(chosen) < min(pivots, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(points, points[chosen[-1:]], square)[:, 0])
    p = points[chosen]
    for _ in range(rounds):
        own = _distances(points, p, square).argmin(1)
        for c in range(len(p)):
            mean = points[own == c].sum(0)
            size = np.linalg.norm(mean)
            if size > 0:
                p[c] = mean * np.sqrt(square) / size
    return p


def _least(d: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k smallest distances of different ids."""
    take = min(len(d), 4 * k)
    while True:
        at = np.argpartition(d, take - 1)[:take] if take < len(d) else np.arange(len(d))
        best: dict[int, float] = {}
        for x, i in sorted(zip(d[at].tolist(), ids[at].tolist())):
            best.setdefault(i, x)
        if len(best) >= k or take == len(d):
            return sorted((x, i) for i, x in best.items())[:k]
        take = min(len(d), 4 * take)


def top_k(vectors: DataFrame, every: int = 50, k: int = TOP, pivots: int = PIVOTS, stats: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's best; stats gets the counts of rows, groups and routed rows."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = common.cut(spark, _vectors(vectors))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, dims, top = data.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not n or not dims:
        return spark.createDataFrame([], schema)
    norm, whole = float(max(top, 1)), np.float64 if top < 1 << 53 else np.int64
    asked = common.cut(spark, data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    first = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        first[i, : len(r.v)] = r.v
    p = settle(_scaled(first, norm), pivots, norm)
    slack = 1e-6 * (1 + np.sqrt(norm))

    def summary(batches):
        best: list[list] = [[] for _ in p]
        for b in batches:
            d, ids = _distances(_lifted(_matrix(b.column(1), dims), norm), p, norm), np.asarray(b.column(0))
            for g in range(len(p)):
                if len(ids):
                    near = _least(d[:, g], ids, k + 1) + best[g]
                    best[g] = _least(np.array([x for x, _ in near]), np.array([i for _, i in near]), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array([[x for x, _ in g] for g in best], pa.list_(pa.float64())), pa.array([[i for _, i in g] for g in best], pa.list_(pa.int64())), pa.array(range(len(p)), pa.int32())], names=["d", "ids", "g"])

    def spread(batches):
        radius, count = np.zeros(len(p)), np.zeros(len(p), np.int64)
        for b in batches:
            d = _distances(_scaled(_matrix(b.column(1), dims), norm), p, norm)
            g = d.argmin(1)
            np.maximum.at(radius, g, d[np.arange(len(g)), g])
            count += np.bincount(g, minlength=len(p))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(p)), pa.int32()), pa.array(radius), pa.array(count)], names=["g", "radius", "n"])

    near: list[list] = [[] for _ in p]
    for r in data.mapInArrow(summary, "d array<double>, ids array<bigint>, g int").toLocalIterator():  # k + 1 numbers a group and task
        both = near[r.g] + list(zip(r.d, r.ids))
        near[r.g] = _least(np.array([x for x, _ in both]), np.array([i for _, i in both]), k + 1) if both else []
    radius, n_asked = np.zeros(len(p)), np.zeros(len(p), np.int64)
    for r in asked.mapInArrow(spread, "g int, radius double, n long").toLocalIterator():
        radius[r.g] = max(radius[r.g], r.radius)
        n_asked[r.g] += r.n
    limit = np.array([2 * radius[g] + near[g][k][0] + slack if len(near[g]) > k else np.inf for g in range(len(p))])
    limit[n_asked == 0] = -1

    def count(batches):
        total = np.zeros(len(p), np.int64)
        for b in batches:
            total += (_distances(_lifted(_matrix(b.column(1), dims), norm), p, norm) <= limit).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(p)), pa.int32()), pa.array(total)], names=["g", "n"])

    needs = np.zeros(len(p), np.int64)
    for r in data.mapInArrow(count, "g int, n long").toLocalIterator():
        needs[r.g] += r.n
    shared = needs > SHARED_PART * n
    home = np.where(shared, len(p), np.arange(len(p)))  # the group that serves each group's queries
    size = np.append(np.where(shared, 0, needs), n if shared.any() else 0)
    parts = np.maximum(1, -(-size // PART_ROWS))
    blocks = np.maximum(1, -(-np.bincount(home, n_asked, len(p) + 1).astype(np.int64) // PART_QUERIES))
    if stats is not None:
        stats.update(rows=int(n), groups=int((n_asked > 0).sum()), routed=int(np.where(shared, 0, needs).sum() + (n if shared.any() else 0)))
    shape = "g int, part int, block int, vec_id long, v array<bigint>"
    names = [x.split()[0] for x in shape.split(", ")]

    def rows(b, at, g, part, block):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(at)).astype(np.int32)) for x in (g, part, block)] + [b.column(i).take(pa.array(at)) for i in (0, 1)], names=names)

    def route(batches):
        seen = TaskContext.get().partitionId()
        for b in batches:
            near = _distances(_lifted(_matrix(b.column(1), dims), norm), p, norm) <= limit
            served = np.append(near & ~shared, (near & shared).any(1)[:, None], axis=1)
            for g in np.flatnonzero(served.any(0)):
                at = np.flatnonzero(served[:, g])
                for block in range(blocks[g]):
                    yield rows(b, at, g, (seen + at) % parts[g], block)
            seen += b.num_rows

    def group(batches):
        for b in batches:
            g = home[_distances(_scaled(_matrix(b.column(1), dims), norm), p, norm).argmin(1)]
            block = np.asarray(b.column(0)) // every % blocks[g]
            for own in np.unique(g):
                at = np.flatnonzero(g == own)
                for part in range(parts[own]):
                    yield rows(b, at, own, part, block[at])

    def solve(queries: pa.Table, part: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and part.num_rows:
            part = part.sort_by("vec_id")
            ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims, whole)
            qid, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), dims, whole)
            for i in range(0, len(q), QUERY_BLOCK):
                s = q[i : i + QUERY_BLOCK] @ x.T
                for j in range(len(s)):
                    lo, hi = np.searchsorted(ids, qid[i + j]), np.searchsorted(ids, qid[i + j], side="right")
                    row = np.delete(s[j], slice(lo, hi)) if lo < hi else s[j]
                    if len(row) > k:
                        c = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    else:
                        c = np.arange(len(row))
                    own = ids[np.where(c >= lo, c + hi - lo, c)]
                    best = np.lexsort((own, -row[c]))[:k]
                    out[0].append(np.full(len(best), qid[i + j]))
                    out[1].append(own[best])
                    out[2].append(row[c][best].astype(np.int64))
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    key = ["g", "part", "block"]
    found = asked.mapInArrow(group, shape).groupBy(*key).cogroup(data.mapInArrow(route, shape).groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
