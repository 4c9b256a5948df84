"""Best-fit packing certified by dual-feasible lower bounds (operator 6).

Texts become ids once; only (doc_id, piece, start, length, checksum) rows move.
Each group of pieces is packed by best-fit decreasing, and dual-feasible
functions give a lower bound for its number of bins. A group that meets its
bound is certified and settles whole. A group with a gap settles its full bins
only; its other pieces are dealt anew, together with those of other groups with
gaps, and packed again. The exchange ends when every group is certified, when
only one group is left, or when a round saves no bin: then the packing of the
round before stands. It ends at once where the bins
in use meet the bound over all lengths together.

Defined results: a null or empty text is its end id alone. Documents over the
length, however long, are cut from the back into full pieces, so the first is
the shorter one. Rows with a null doc_id and repeated rows are packed like any
other; equal lengths are placed in the order of doc_id, piece and row; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, END_ID = 2048, 0
#: Pieces that one task packs at a time, in every round.
GROUP_PIECES = 50_000


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian bytes) of docs(doc_id, text)."""

    def run(batches):
        enc = tokens.encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids, off = enc.encode(b.column(1))
                cols = [[], [], [], [], [], []]
                doc_ids = b.column(0).to_pylist()
                for d, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    own = np.empty(j - i + 1, "<u4")
                    own[:-1], own[-1] = ids[i:j], end_id
                    n = len(own)
                    cuts = [0, *range(n % length or length, n, length), n]
                    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                        raw = own[a:z].tobytes()
                        for c, v in zip(cols, (doc_ids[d], k, a, z - a, zlib.crc32(raw), raw)):
                            c.append(v)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:5], names=names if with_ids else names[:5])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.tidy(run), schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. A bit mask finds the tightest bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - r
        r -= size
        if r:
            room[r].append(b)
            mask |= 1 << r
    return bins, offsets, used


def histogram_bound(count: np.ndarray, capacity: int) -> int:
    """The best of two families of dual-feasible functions over the number of pieces of each length."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # f_eps: sizes over capacity - eps weigh the whole bin, sizes under eps nothing
    n_tail = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    s_tail = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])
    for eps in range(1, capacity // 2 + 1):
        big = n_tail[capacity - eps + 1]
        middle = s_tail[eps] - s_tail[capacity - eps + 1]
        best = max(best, int(big) + -(-int(middle) // capacity))
    # u_k: x -> floor((k + 1) x / C) / k, and x itself where (k + 1) x / C is whole
    for k in range(1, 21):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        total = (count * np.where(whole, size * k, (scaled // capacity) * capacity)).sum()
        best = max(best, -(-int(total) // (k * capacity)))
    return best


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of the lengths has fewer bins."""
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


_PLACED = "group long, bin long, offset long, settled boolean, key long, piece int, length long, row long, bound long, bins long"


def _pack(capacity: int):
    names = [x.split()[0] for x in _PLACED.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        size = table.column("length").to_numpy()
        bins, offsets, used = best_fit_decreasing(size, capacity)
        bound = lower_bound(size, capacity)
        filled = np.bincount(bins, size, used)
        settled = np.full(len(size), True) if used == bound else (filled == capacity)[bins]
        n = len(size)
        made = [np.full(n, group), bins, offsets, settled, table.column("key"), table.column("piece"), table.column("length"), table.column("row"), np.full(n, bound), np.full(n, used)]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in made], names=names)

    return run


def _bins(placed: DataFrame) -> int:
    return placed.select("group", "bin").distinct().count()


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces() with sequence_id and offset, and the round, bound and bins of the group that settled each."""
    spark = docs.sparkSession
    made = pieces(docs, path, length, end_id).withColumn("row", F.monotonically_increasing_id())
    made = common.cut(spark, made)
    zero = F.lit(0).cast("long")
    columns = ["row", "round", "group", "bin", "offset", "bound", "bins"]
    placed = [made.where(F.col("length") == length).select("row", F.lit(-1).alias("round"), F.col("row").alias("group"), zero.alias("bin"), zero.alias("offset"), F.lit(1).cast("long").alias("bound"), F.lit(1).cast("long").alias("bins"))]
    rest = made.where(F.col("length") < length).select(F.col("doc_id").alias("key"), "piece", "length", "row")
    count = np.zeros(length + 1, np.int64)
    for r in rest.groupBy("length").count().collect():  # at most one row a length
        count[r["length"]] = r["count"]
    n, bound, settled = int(count.sum()), histogram_bound(count, length), 0
    base, r, before, old = 0, 0, None, None  # first group of the round, round, its pieces as they were packed and in how many bins
    while n:
        groups = max(1, -(-n // group_pieces))
        dealt = rest.withColumn("group", base + F.pmod(F.xxhash64("row", F.lit(r)), F.lit(groups)))
        out = common.cut(spark, dealt.groupBy("group").applyInArrow(_pack(length), _PLACED).withColumn("round", F.lit(r)))
        used = _bins(out)
        if old is not None and used >= old:  # the exchange saved nothing
            placed.append(before)
            break
        done = settled + used <= bound or groups == 1
        placed.append((out if done else out.where("settled")).select(columns))
        if done:
            break
        before = out.where("not settled")
        rest, old = before.select("key", "piece", "length", "row"), _bins(before)
        before = before.select(columns)
        settled += used - old
        n, base, r = rest.count(), base + groups, r + 1
    at = placed[0]
    for p in placed[1:]:
        at = at.unionByName(p)
    # groups, numbered through all rounds, and bins side by side in one integer: 32 and 31 bits; full pieces apart below zero
    sequence = F.when(F.col("round") < 0, -1 - F.col("group")).otherwise(F.shiftleft(F.col("group"), 31).bitwiseOR(F.col("bin")))
    return made.join(at.withColumn("sequence_id", sequence).drop("group", "bin"), "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.col("round").alias("pack_round"), F.col("bound").alias("group_bound"), F.col("bins").alias("group_bins"))
