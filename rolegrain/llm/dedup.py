"""Near-duplicates by an LSH forest over MinHash signatures (operator 5).

A text's set: distinct 5-word shingles. Signatures of ``HASHES`` minima of
their hashes are read in several sorted orders, each starting at its own block
of ``DEPTH`` minima. Texts with the same first block are a region of the order;
inside it they are sorted by the next minima, so that neighbours have the
longest common prefixes. The orders are sorted as one range-partitioned table,
so a hot region is spread over tasks. Each text and its predecessor are
candidates; those whose signatures agree too little to reach the threshold are
dropped (more than five deviations below), the rest are confirmed on the full
sets, word by word: first one candidate per text (a forest), then those that
still join different components. A region that still holds several components
is compared across them whole, in tiles of ``TILE`` texts. What is found there
is confirmed in blocks of ``BLOCK_DOCS`` texts against as many: a block's full
sets are made once, whatever the number of its pairs, and one link is returned
for each two components that meet in it. A pair at the threshold misses all
regions with probability (1 - 0.85**5)**25 < 1e-6.

Texts with equal word sequences (by a 128-bit digest) are one class and enter
by its smallest doc_id. Only texts of candidate pairs are shuffled, picked by a
fixed-size bitmap.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; fewer than five words are one shingle; very long texts are taken
whole; a null doc_id is linked with nothing, has a null component and is kept;
rows that repeat a doc_id are one vertex, with the links of all its rows, and
each row has its own n_shingles. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import attach, components

HASHES, DEPTH, ORDERS = 128, 5, 25
PERCENT = 85
#: Texts that a task compares with as many others; results don't depend on it.
TILE = 8000
#: Texts, and their bytes, on either side of a block of pairs; a longer text is a block of its own. Results don't depend on them.
BLOCK_DOCS, BLOCK_BYTES = 1000, 2_000_000
_BITMAP_BITS = 24

_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x HASHES, 16 bits of each minimum; zeros for empty sets."""
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), np.uint16)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        x = (sets >> np.uint64(32)).astype(np.uint32)
        begins = offsets[some]
        buf = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=buf)
            np.add(buf, _B[k], out=buf)
            low = np.minimum.reduceat(buf, begins)
            out[some, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sequences(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 16-byte digest of each document's lower-cased words, whatever the white space between them."""
    low = common.LOWER[data]
    space = common.IS_SPACE[low]
    keep = ~space
    keep[:-1] |= space[:-1] & ~space[1:]  # the last of the white space before a word
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    own = np.where(space, 0x20, low)[keep].astype(np.uint8)
    return [hashlib.blake2b(own[i:j].tobytes().strip(b" "), digest_size=16).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _sign(batches):
    for b in batches:
        data, off = common.text_buffer(b.column(1))
        size, keys, sigs = [np.zeros(0, np.int64)], [], []
        n_bytes = pa.array(np.diff(off), pa.int64())
        for i, j in common.slices(off):
            part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
            sets, so = common.shingle_sets(part, own)
            size.append(np.diff(so))
            keys += sequences(part, own)
            sigs += [r.tobytes() for r in signatures(sets, so)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(size), pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), n_bytes], names=["doc_id", "n_shingles", "key", "sig", "bytes"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _blocks(sig: np.ndarray, orders: int = ORDERS) -> np.ndarray:
    """The first block of minima of each text in each of so many orders."""
    own = (sig[:, : orders * DEPTH] & 0xFFF).astype(np.int64).reshape(len(sig), orders, DEPTH)
    return (own << np.arange(12 * (DEPTH - 1), -1, -12)).sum(2)


def _orders(batches):
    """25 rows a text: order, first block of minima, next block (it sorts the region)."""
    for b in batches:
        blocks = _blocks(_matrix(b.column(2)))
        n = len(blocks)
        blocks = np.concatenate([blocks, blocks[:, :1]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), n)), pa.array(blocks[:, :ORDERS].reshape(-1)), pa.array(blocks[:, 1:].reshape(-1)), pa.array(np.repeat(np.asarray(b.column(0)), ORDERS)), pa.array(np.repeat(np.asarray(b.column(1)), ORDERS))],
            names=["o", "k1", "k2", "rep", "n"],
        )


def _next_to(batches):
    """Neighbours of one region in sorted rows, and the ends of the partition, to be joined with others'."""
    part = TaskContext.get().partitionId()
    last = None
    names = ["a", "b", "o", "k1", "part"]

    def rows(a, b, o, k1, at):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(o, pa.int32()), pa.array(k1, pa.int64()), pa.array(np.full(n, at, np.int64))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        o, k1, rep = (np.asarray(batch.column(i)) for i in (0, 1, 3))
        if last is None:
            yield rows(rep[:1], [0], o[:1], k1[:1], 2 * part)
        else:
            o, k1, rep = np.append(last[0], o), np.append(last[1], k1), np.append(last[2], rep)
        last = o[-1:], k1[-1:], rep[-1:]
        ok = (o[1:] == o[:-1]) & (k1[1:] == k1[:-1]) & (rep[1:] != rep[:-1])
        x, y = rep[:-1][ok], rep[1:][ok]
        yield rows(np.minimum(x, y), np.maximum(x, y), o[1:][ok], k1[1:][ok], -1)
    if last is not None:
        yield rows(last[2], [0], last[0], last[1], 2 * part + 1)


def neighbours(forest: DataFrame) -> DataFrame:
    """(a, b): each text and its predecessor in every region of every order."""
    spark = forest.sparkSession
    order = ["o", "k1", "k2", "n", "rep"]
    out = common.cut(spark, forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(common.tidy(_next_to), "a long, b long, o int, k1 long, part long"))
    ends = sorted((r.part, r.o, r.k1, r.a) for r in out.where("part >= 0").collect())  # two rows a partition
    met = [(min(x[3], y[3]), max(x[3], y[3])) for x, y in zip(ends, ends[1:]) if x[0] % 2 and x[1:3] == y[1:3] and x[3] != y[3]]
    inside = out.where("part < 0").select("a", "b")
    return (inside.unionByName(spark.createDataFrame(met, "a long, b long")) if met else inside).distinct()


def _agree(least: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column(2)) == _matrix(b.column(3))).sum(1)
                ok = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(same[same >= least].astype(np.int32))], names=["a", "b", "same"])

    return run


def least_agreement(percent: int) -> int:
    p = percent / 100
    return max(1, int(HASHES * p - 5.5 * (HASHES * p * (1 - p)) ** 0.5))


def _bit(ids: np.ndarray) -> np.ndarray:
    return (common.mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)


def _bitmaps(batches):
    bits = np.zeros(1 << _BITMAP_BITS, bool)
    for b in batches:
        for c in b.columns:
            bits[_bit(np.asarray(c))] = True
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])


def _confirm(percent: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                n = b.num_rows
                data, off = common.text_buffer(pa.concat_arrays([b.column(2).cast(pa.large_string()), b.column(3).cast(pa.large_string())]))
                sets, so = common.exact_shingles(data, off)
                ok = np.zeros(n, bool)
                for i in range(n):
                    s, t = sets[so[i] : so[i + 1]], sets[so[n + i] : so[n + i + 1]]
                    if len(s) and len(t):
                        both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                        ok[i] = 100 * both >= percent * (len(s) + len(t) - both)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of docs whose ids are in some column of ids, and a few more."""
    spark = docs.sparkSession
    bits = np.zeros(1 << (_BITMAP_BITS - 3), np.uint8)
    for r in ids.coalesce(8).mapInArrow(common.tidy(_bitmaps), "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    shared = spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))  # 2 MB at most

    def pick(batches):
        there = np.unpackbits(np.frombuffer(zlib.decompress(shared.value), np.uint8)).astype(bool)
        for b in batches:
            yield b.filter(pa.array(there[_bit(np.asarray(b.column(0)))]))

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(common.tidy(pick), "doc_id long, text string")


def confirm(docs: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """The edges(a, b) that hold on the full sets of docs(doc_id, text)."""
    spark = docs.sparkSession
    texts = _texts(docs, edges.select("a", "b"))
    pairs = edges.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return common.cut(spark, pairs.select("a", "b", "ta", "tb").mapInArrow(common.tidy(_confirm(percent)), "a long, b long").distinct())


def _across(least: int):
    """Candidates between components of two tiles of a region (or inside one), by signature, in blocks: the ids and components of both sides, and a bit a pair.

    A pair that meets in several regions is a candidate of the first order only.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("comp", "ascending"), ("rep", "ascending")])
        rep, comp, tile, size = (t.column(c).to_numpy() for c in ("rep", "comp", "tile", "bytes"))
        place = [t.column(c)[0].as_py() for c in ("o", "k1", "x", "y")]
        s = _matrix(t.column("sig").combine_chunks())
        earlier = _blocks(s, place[0])
        left, right = np.flatnonzero(tile == place[2]), np.flatnonzero(tile == place[3])
        across = np.ascontiguousarray(s[right].T)
        rows, used = [], np.zeros(len(right), bool)
        for i in range(0, len(left), 64):
            own = left[i : i + 64]
            at = np.searchsorted(comp[right], comp[own[0]], side="right")  # components rise, so earlier ones have had their turn
            if len(own) * (len(right) - at) <= 4096:
                same = (s[own][:, None] == s[right[at:]][None]).sum(2)
            else:
                same = np.zeros((len(own), len(right) - at), np.int16)
                for k in range(HASHES):
                    same += s[own, k][:, None] == across[k, at:][None, :]
            x, y = np.nonzero((same >= least) & (comp[own][:, None] < comp[right[at:]][None, :]))
            for o in range(place[0] if len(x) else 0):
                new = earlier[own[x], o] != earlier[right[at + y], o]
                x, y = x[new], y[new]
            hit = np.zeros((len(own), len(right)), bool)
            hit[x, at + y] = True
            used |= hit.any(0)
            rows.append(np.packbits(hit, axis=1))
        bits = np.concatenate(rows) if rows else np.zeros((0, 0), np.uint8)
        held = np.flatnonzero(bits.any(1))
        columns = np.flatnonzero(used)
        out = []
        for i, j in _runs(size[left[held]]):
            some = np.unpackbits(bits[held[i:j]], axis=1, count=len(right)).astype(bool)[:, columns]
            for p, q in _runs(size[right[columns]]):
                hit = some[:, p:q]
                a, b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                if len(a):
                    both = np.concatenate([left[held[i + a]], right[columns[p + b]]])
                    name = hashlib.blake2b(repr((*place, i, p)).encode(), digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), len(a), rep[both].tobytes(), comp[both].tobytes(), zlib.compress(np.packbits(hit[np.ix_(a, b)]).tobytes(), 1)))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["g", "n", "ids", "comps", "bits"])

    return run


def _runs(size: np.ndarray):
    return common.slices(np.concatenate([[0], np.cumsum(size)]), BLOCK_BYTES, BLOCK_DOCS)


def _members(batches):
    """(g, id) of each text of a block."""
    for b in batches:
        ids = [np.unique(np.frombuffer(x, np.int64)) for x in b.column(1).to_pylist()]
        g = np.repeat(np.asarray(b.column(0)), [len(x) for x in ids])
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))], names=["g", "id"])


def _links(t: pa.Table, percent: int) -> pa.RecordBatch:
    """One confirmed pair for each two components that meet in a block; t(g, id, text, n, ids, comps, bits) has blocks whole, with their texts."""
    whole = t.column("id").is_valid()
    texts, blocks = t.filter(whole), t.filter(pc.invert(whole))
    code = texts.column("text").cast(pa.large_string()).combine_chunks().dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    sets, so = common.exact_shingles(*common.text_buffer(code.dictionary))
    g, ids, code = texts.column("g").to_numpy(), texts.column("id").to_numpy(), code.indices.fill_null(0).to_numpy()
    some = np.diff(so)[code] > 0 if len(code) else np.zeros(0, bool)
    g, ids, code = g[some], ids[some], code[some]
    order = np.lexsort((ids, g))
    g, ids, code = g[order], ids[order], code[order]
    mark = np.zeros(int(sets.max(initial=0)) + 1, np.uint8)
    out: list[tuple[int, int]] = []
    for r in blocks.select(["g", "n", "ids", "comps", "bits"]).to_pylist():
        i, j = np.searchsorted(g, r["g"], "left"), np.searchsorted(g, r["g"], "right")
        own, comp = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["comps"], np.int64)
        n, m = r["n"], len(own) - r["n"]
        hit = np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8), count=n * m).reshape(n, m).astype(bool)
        first, last = i + np.searchsorted(ids[i:j], own, "left"), i + np.searchsorted(ids[i:j], own, "right")
        # an id of several rows has the links of each of its texts
        at = np.repeat(np.arange(n, len(own)), (last - first)[n:])
        right = code[np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b) for a, b in zip(first[n:], last[n:])]])]
        size = so[right + 1] - so[right]
        flat = np.concatenate([sets[:0], *[sets[so[c] : so[c + 1]] for c in right]])
        ends = np.concatenate([[0], np.cumsum(size)])
        _, far = np.unique(comp[n:], return_inverse=True)
        met = np.zeros(m, bool)
        for k in range(n):
            if k and comp[k] != comp[k - 1]:
                met[:] = False  # components that the left one has been linked with
            for c in code[first[k] : last[k]]:
                js = np.flatnonzero(hit[k, at - n] & ~met[far[at - n]])
                if not len(js):
                    continue
                a = sets[so[c] : so[c + 1]]
                mark[a] = 1
                if 2 * len(js) < len(at):
                    begins = np.concatenate([[0], np.cumsum(size[js])])
                    own_flat = flat[np.repeat(ends[js] - begins[:-1], size[js]) + np.arange(begins[-1])]
                    both = np.add.reduceat(mark[own_flat], begins[:-1], dtype=np.int64)
                else:
                    both = np.add.reduceat(mark[flat], ends[:-1], dtype=np.int64)[js]
                mark[a] = 0
                js = js[100 * both >= percent * (len(a) + size[js] - both)]
                _, new = np.unique(far[at[js] - n], return_index=True)
                met[far[at[js] - n]] = True
                out += [(min(own[k], x), max(own[k], x)) for x in own[at[js[new]]].tolist()]
    found = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _confirm_blocks(percent: int):
    """Rows sorted by block become links; blocks are taken together up to BLOCK_BYTES."""

    def run(batches):
        held, n_bytes, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            g = np.asarray(b.column(0))
            _, off = common.text_buffer(b.column(2))
            begins = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
            for i, j in zip(begins, [*begins[1:], len(g)]):
                if n_bytes >= BLOCK_BYTES and g[i] != last:
                    yield _links(pa.Table.from_batches(held), percent)
                    held, n_bytes = [], 0
                held.append(b.slice(i, j - i))
                n_bytes += int(off[j] - off[i])
                last = g[i]
        if held:
            yield _links(pa.Table.from_batches(held), percent)

    return run


def confirm_blocks(docs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the candidates of blocks(g, n, ids, comps, bits), on the full sets of docs(doc_id, text): one for each two components that meet in a block."""
    members = common.cut(docs.sparkSession, blocks.select("g", "ids").mapInArrow(_members, "g long, id long").distinct())
    texts = members.join(_texts(docs, members.select("id")), F.col("id") == F.col("doc_id")).select("g", "id", "text")
    rows = texts.unionByName(blocks, allowMissingColumns=True).select("g", "id", "text", "n", "ids", "comps", "bits")
    rows = rows.repartition("g").sortWithinPartitions("g")
    return common.cut(docs.sparkSession, rows.mapInArrow(common.tidy(_confirm_blocks(percent)), "a long, b long"))


def _tiles(batches):
    """Numbers rows of sorted regions by tiles: partition, then runs of TILE rows of a region."""
    part = TaskContext.get().partitionId() << 32
    last, run, tile = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        o, k1 = np.asarray(b.column(0)), np.asarray(b.column(1))
        new = np.append(last is None or last != (o[0], k1[0]), (o[1:] != o[:-1]) | (k1[1:] != k1[:-1]))
        begins = np.flatnonzero(np.append(new[0], new[1:]))
        place = np.arange(len(o)) + (0 if new[0] else run)
        since = np.zeros(len(o), np.int64)
        since[begins] = place[begins]
        place = place - np.maximum.accumulate(since)
        step = (place % TILE == 0) & ((place > 0) | new)
        number = tile + np.cumsum(step)
        last, run, tile = (o[-1], k1[-1]), int(place[-1]) + 1, int(number[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part + number), b.column(2), b.column(3)], names=["o", "k1", "tile", "rep", "comp"])


def _crossing(placed: DataFrame, sig: DataFrame, least: int) -> DataFrame:
    """Blocks of candidates between components of a region; placed(o, k1, rep, comp) in order of component, tile against tile; sig(rep, sig, bytes)."""
    spark = placed.sparkSession
    mixed = placed.groupBy("o", "k1").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("o", "k1")
    several = common.cut(spark, placed.join(mixed, ["o", "k1"]).select("o", "k1", "rep", "comp"))
    order = ["o", "k1", "comp", "rep"]
    tiled = common.cut(spark, several.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tiles, "o int, k1 long, tile long, rep long, comp long"))
    ends = tiled.groupBy("o", "k1", "tile").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    first, last = ends.select("o", "k1", F.col("tile").alias("x"), "c0"), ends.select("o", "k1", F.col("tile").alias("y"), "c1")
    # tiles of one and the same component have nothing to compare
    pairs = first.join(last, ["o", "k1"]).where("x <= y and c0 <> c1").select("o", "k1", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    both = tiled.join(pairs, ["o", "k1", "tile"]).join(sig, "rep").select("o", "k1", "x", "y", "tile", "rep", "comp", "sig", "bytes")
    return both.groupBy("o", "k1", "x", "y").applyInArrow(_across(least), "g long, n int, ids binary, comps binary, bits binary")


def _again(some: DataFrame, classes: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Ids of several rows, and edges between the classes of each such id; None if there are none."""
    spark = some.sparkSession
    ids = common.cut(spark, some.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not common.has_rows(ids):
        return None, None
    of = some.join(ids, "doc_id").select("doc_id", "key").distinct().join(classes.select("key", "rep"), "key")
    lo = of.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return ids, common.cut(spark, of.join(lo, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct())


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = least_agreement(percent)
    signed = common.cut(spark, docs.mapInArrow(common.tidy(_sign), "doc_id long, n_shingles long, key binary, sig binary, bytes long"))
    known = signed.where("doc_id is not null")
    some = known.where("n_shingles > 0")
    classes = common.cut(spark, some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.max("bytes").alias("bytes")))
    sig = classes.select("rep", "sig")
    forest = classes.select("rep", "n", "sig").mapInArrow(common.tidy(_orders), "o int, k1 long, k2 long, rep long, n long")
    near = neighbours(forest)

    def estimated(pairs):
        both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(common.tidy(_agree(least)), "a long, b long, same int")

    near = common.cut(spark, estimated(near))
    best = near.groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("a"), "b")
    repeated, own = _again(known, classes)
    held = confirm(docs, best, percent)
    if own is not None:
        held = held.unionByName(own)
    stars = components(held)
    rest = attach(attach(near.join(best, ["a", "b"], "left_anti"), "a", stars, "ra"), "b", stars, "rb").where("ra <> rb")
    rest = common.cut(spark, rest.select("a", "b").distinct())
    if common.has_rows(rest):
        held = held.unionByName(confirm(docs, rest, percent))
        stars = components(held)
    # regions that still hold several components
    placed = attach(forest, "rep", stars, "comp")
    more = common.cut(spark, _crossing(placed, classes.select("rep", "sig", "bytes"), least))
    if common.has_rows(more):
        held = held.unionByName(confirm_blocks(docs, more, percent))
        stars = components(held)
    # a document is its class's member; an empty set belongs to none
    member = attach(classes.select(F.col("key").alias("own"), "rep"), "rep", stars, "component_id").select("own", "component_id")
    rows = common.cut(spark, signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("key")).alias("key")))
    out = common.hot_left(rows, "key", member, "own", rows.count())
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if repeated is not None:  # a row without words joins the other rows of its id
        best = out.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(best, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that are their group's smallest doc_id; of rows that repeat it, the one with the first text."""
    ids = link(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    joined = docs.where("doc_id is not null").join(ids, docs["doc_id"].cast("long") == F.col("__kept_id"))
    first = F.row_number().over(Window.partitionBy("__kept_id").orderBy("text"))
    return joined.withColumn("__first", first).where("__first = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))
