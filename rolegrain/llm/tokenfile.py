"""Token ids in a file format coded by interleaved static rANS (operator 10).

Documents are range-partitioned by doc_id. Each task writes a file of segments.
A segment holds whole documents (about ``SEGMENT_IDS`` ids), one frequency
table that all its blocks share, and blocks that decode on their own: every
block has ``LANES`` interleaved rANS coders, the lanes' final states as its
checkpoint, and a CRC-32 of its ids. States are 64-bit, words 32-bit,
frequencies sum to 2**24.

A file is written under a temporary name and renamed when complete, and its
name holds the task attempt, so that a retried or speculative task never
touches another's file; only files named by the surviving attempt's manifest
rows are read. The manifest has one row per segment.

Defined results: a null or empty text is the end id alone; a very long text is
one document of one segment, however many blocks that takes; null doc_ids come
first; rows with equal doc_id are in the order of their checksums, then texts;
an empty table gives no segment. Files of lost attempts are deleted once the
manifest is complete. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

END_ID = 2
SEGMENT_IDS, BLOCK_IDS, LANES = 1 << 22, 1 << 18, 1024
BITS = 24
#: Input behind each file (as Spark estimates it), and a limit to what an estimate may ask for.
PART_BYTES, MOST_PARTS = 1 << 26, 100_000
_LOW = np.uint64(1 << 32)
_MAGIC = b"RGT1"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**24, at least 1 where a count isn't 0."""
    total, there = int(counts.sum()), counts > 0
    f = np.where(there, np.maximum(1, counts.astype(np.float64) * (1 << BITS) // max(total, 1)), 0).astype(np.int64)
    over = int(f.sum()) - (1 << BITS)
    order = np.argsort(-f, kind="stable")
    k = 0
    while over > 0:  # take from the most frequent
        take = min(over, int(f[order[k]]) // 2)
        f[order[k]] -= take
        over -= take
        k = (k + 1) % len(order)
    f[order[0]] -= over
    return f


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES) -> bytes:
    n = len(ids)
    lanes = min(lanes, max(n, 1))
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    sizes = np.zeros(steps, np.uint32)
    f_all, s_all = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    for t in range(steps - 1, -1, -1):
        a, z = t * lanes, min(n, (t + 1) * lanes)
        f, s, y = f_all[a:z], s_all[a:z], x[: z - a]
        out = (y >> np.uint64(64 - BITS)) >= f
        if out.any():
            words.append(y[out].astype(np.uint32))
            sizes[t] = len(words[-1])
            y = np.where(out, y >> np.uint64(32), y)
        q = y // f
        x[: z - a] = (q << np.uint64(BITS)) + (y - q * f) + s
    body = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    head = struct.pack("<IIII", n, lanes, len(body) // 4, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + x.astype("<u8").tobytes() + body


def decode_block(raw: memoryview, at: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, int]:
    n, lanes, n_words, crc = struct.unpack_from("<IIII", raw, at)
    at += 16
    x = np.frombuffer(raw, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    words = np.frombuffer(raw, "<u4", n_words, at)
    at += 4 * n_words
    begins = start[symbol]
    ids, w, mask = np.zeros(n, np.uint32), 0, np.uint64((1 << BITS) - 1)
    for t in range(-(-n // lanes)):
        a, z = t * lanes, min(n, (t + 1) * lanes)
        y = x[: z - a]
        slot = y & mask
        s = symbol[np.searchsorted(begins, slot, side="right") - 1]
        ids[a:z] = s
        y = freq[s] * (y >> np.uint64(BITS)) + slot - start[s]
        need = np.flatnonzero(y < _LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | words[w : w + len(need)].astype(np.uint64)
            w += len(need)
        x[: z - a] = y
    # every lane ends in the state that its encoder began with, all words used
    if w != n_words or (x != _LOW).any() or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum doesn't match its ids")
    return ids, at


def write_segment(doc_ids: list, per_doc: list[np.ndarray]) -> bytes:
    ids = np.concatenate(per_doc)
    lengths = np.array([len(p) for p in per_doc], "<u8")
    nulls = np.packbits(np.array([d is None for d in doc_ids])).tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    symbols = np.unique(ids)
    counts = np.bincount(ids, minlength=int(ids.max()) + 1)
    freq = frequencies(counts)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq[symbols].astype("<u4").tobytes(), 1)
    index = zlib.compress(keys.tobytes() + lengths.tobytes() + nulls, 1)
    blocks = [encode_block(ids[a : a + BLOCK_IDS], freq, start) for a in range(0, len(ids), BLOCK_IDS)]
    head = struct.pack("<4sIIIQI", _MAGIC, len(doc_ids), len(index), len(symbols), len(ids), len(table))
    return head + index + table + struct.pack("<I", len(blocks)) + np.array([len(b) for b in blocks], "<u4").tobytes() + b"".join(blocks)


def read_segment(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths, ids. Blocks stand alone: any of them decodes from its own offset."""
    magic, n_docs, n_index, n_symbols, n_ids, n_table = struct.unpack_from("<4sIIIQI", raw)
    if magic != _MAGIC:
        raise ValueError("not a segment of token ids")
    at = struct.calcsize("<4sIIIQI")
    index = zlib.decompress(raw[at : at + n_index])
    at += n_index
    keys = np.frombuffer(index, "<i8", n_docs)
    lengths = np.frombuffer(index, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    null = np.unpackbits(np.frombuffer(index, np.uint8, offset=16 * n_docs))[:n_docs].astype(bool)
    table = np.frombuffer(zlib.decompress(raw[at : at + n_table]), "<u4")
    at += n_table
    symbol = table[:n_symbols].astype(np.int64)
    freq = np.zeros(int(symbol.max()) + 1, np.uint64)
    freq[symbol] = table[n_symbols:]
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    (n_blocks,) = struct.unpack_from("<I", raw, at)
    at += 4 + 4 * n_blocks
    parts, view = [], memoryview(raw)
    for _ in range(n_blocks):
        ids, at = decode_block(view, at, freq, start, symbol)
        parts.append(ids)
    ids = np.concatenate(parts)
    if len(ids) != n_ids:
        raise ValueError("a segment's ids are incomplete")
    return [None if z else int(k) for k, z in zip(keys, null)], lengths, ids


_MANIFEST = "file string, at long, size long, first long, n_docs long, n_ids long, part int, segment int"


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text) to ``folder`` (shared by all executors) and returns the manifest."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, MOST_PARTS))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text"), "text")

    def run(batches):
        files, own = fs.FileSystem.from_uri(folder)
        enc = tokens.encoder(path)
        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part:06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.ids"
        files.create_dir(own, recursive=True)
        rows, keys, held, size, at = [], [], [], 0, 0
        out = files.open_output_stream(f"{own}/{name}.tmp")

        def flush():
            nonlocal keys, held, size, at
            if keys:
                raw = write_segment(keys, held)
                out.write(raw)
                rows.append((name, at, len(raw), keys[0], len(keys), size, part, len(rows)))
                keys, held, size, at = [], [], 0, at + len(raw)

        with out:
            for whole in batches:
                for a in range(0, whole.num_rows, 500):
                    b = whole.slice(a, 500)
                    ids, off = enc.encode(b.column(1))
                    for d, i, j in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                        keys.append(d)
                        held.append(np.append(ids[i:j], np.uint32(end_id)))
                        size += j - i + 1
                        if size >= SEGMENT_IDS:
                            flush()
            flush()
        if rows:
            files.move(f"{own}/{name}.tmp", f"{own}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=[x.split()[0] for x in _MANIFEST.split(", ")])
        else:
            files.delete_file(f"{own}/{name}.tmp")

    manifest = common.cut(spark, ranged.mapInArrow(run, _MANIFEST))
    _sweep(folder, {r.file for r in manifest.select("file").distinct().toLocalIterator()})
    return manifest


def _sweep(folder: str, kept: set[str]) -> None:
    """Deletes what failed or repeated attempts left in the folder; a file a partition is listed."""
    files, own = fs.FileSystem.from_uri(folder)
    for f in files.get_file_info(fs.FileSelector(own, allow_not_found=True)):
        if f.is_file and f.base_name not in kept:
            files.delete_file(f.path)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded segment by segment."""
    spark = manifest.sparkSession
    # one small row per segment of some four million ids
    rows = sorted(manifest.select("part", "segment", "file", "at", "size", "n_ids").collect())
    begin, plan = 0, []
    for r in rows:
        plan.append((r.file, r.at, r.size, begin))
        begin += r.n_ids

    def run(batches):
        files, own = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file, at, size, begin in zip(*(c.to_pylist() for c in b.columns)):
                with files.open_input_file(f"{own}/{file}") as f:
                    raw = f.read_at(size, at)
                keys, lengths, ids = read_segment(raw)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begins + begin), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not plan:
        return spark.createDataFrame([], schema)
    tasks = spark.createDataFrame(plan, "file string, at long, size long, begin long").repartition(min(len(plan), 10_000))
    return tasks.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    shared = common.shared_folder(docs.sparkSession)
    folder = f"{shared if '://' in shared else 'file://' + shared}/token-ids-{uuid.uuid4().hex}"
    return read(write(docs, folder, path), folder)
