"""Shared pieces of the training-data operators: Arrow batches as byte buffers,
vectorised word hashing, and the Spark plumbing that survives lost executors.

Texts are never turned into Python strings where bytes will do: an Arrow string
column is one UTF-8 buffer with offsets, and words, their hashes and their
shingles are computed for a whole slice of documents by numpy.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one numpy pass; a longer document is a pass of its own.
SLICE_BYTES = 1 << 19
#: Documents of one numpy pass, however short they are.
SLICE_DOCS = 512

_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def ascii_lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = ascii_lower_table()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: 0 white space, 1 letter or non-ASCII byte, 2 digit, 3 anything else
BYTE_CLASS = np.full(256, 3, np.uint8)
BYTE_CLASS[IS_SPACE] = 0
BYTE_CLASS[48:58] = 2
BYTE_CLASS[65:91] = 1
BYTE_CLASS[97:123] = 1
BYTE_CLASS[128:] = 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1] if offsets is not None and offsets.size else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, docs: int = SLICE_DOCS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of at most ``docs`` documents and ``limit`` bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + docs, n)
        yield i, j
        i = j


class Spans:
    """Words of a slice: start and end bytes, and the document of each."""

    __slots__ = ("start", "end", "doc", "first", "count")

    def __init__(self, start, end, offsets):
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets[:-1])
        last = np.searchsorted(start, offsets[1:])
        self.count = last - self.first
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)


def space_words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Runs of bytes that aren't ASCII white space, cut at document ends."""
    return class_words(data, offsets, IS_SPACE[data], None)


def class_words(data, offsets, blank, kind) -> Spans:
    """Runs that hold no blank and, if ``kind`` is given, one kind of byte only."""
    n = len(data)
    if not n:
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), offsets)
    cut = np.zeros(n + 1, bool)  # a word may not run across position i
    cut[offsets] = True
    if kind is None:
        cut[1:n] |= blank[1:] != blank[:-1]
    else:
        cut[1:n] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(cut)
    keep = ~blank[at[:-1]]
    return Spans(at[:-1][keep], at[1:][keep], offsets)


#: Spans of more bytes are hashed one by one.
_LONG = 64
#: Masks that keep the first k bytes of a little-endian word.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], _U64)
_EIGHTHS = [_U64(0x9FB21C651E98DF25 * (2 * k + 1) & ((1 << 64) - 1)) for k in range(_LONG // 8)]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one little-endian integer; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand.

    Blocks of eight bytes are mixed one after another (nothing is linear in the
    text); long spans are digested whole. Equal hashes aren't proof: callers
    that need proof compare bytes (``interned``, the token table).
    """
    size = end - start
    h = size.astype(_U64) * _U64(0xD6E8FEB86659FD93)
    if not len(h):
        return h
    words = eights(data) if words is None else words
    short = size <= _LONG
    live = np.flatnonzero(short) if not short.all() else slice(None)
    for k in range(-(-int(size[live].max(initial=0)) // 8)):
        if k:
            live = np.flatnonzero(short & (size > 8 * k))
        block = words[start[live] + 8 * k] & _HEAD[np.minimum(size[live] - 8 * k, 8)]
        h[live] = mix64((h[live] ^ block) + _EIGHTHS[k])
    for i in np.flatnonzero(~short):
        h[i] = _U64(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little"))
    return h


def interned(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span, equal exactly if the bytes are: hashes find candidates, bytes decide."""
    h = span_hashes(data, start, end)
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    size, own = end - start, first[ids]
    words = eights(data)
    differ = size != size[own]
    for k in range(-(-min(int(size.max(initial=0)), _LONG) // 8)):
        live = np.flatnonzero(~differ & (size > 8 * k) & (size <= _LONG))
        head = _HEAD[np.minimum(size[live] - 8 * k, 8)]
        differ[live] = (words[start[live] + 8 * k] & head) != (words[start[own[live]] + 8 * k] & head)
    for i in np.flatnonzero(~differ & (size > _LONG)):
        differ[i] = data[start[i] : end[i]].tobytes() != data[start[own[i]] : end[own[i]]].tobytes()
    if differ.any():  # unlike spans with one hash
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(differ):
            ids[i] = seen.setdefault(data[start[i] : end[i]].tobytes(), len(first) + len(seen))
    return ids


_SHINGLE = [_U64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document, and their offsets.

    ASCII letters are lower-cased; words are runs without ASCII white space. A
    document of fewer than k words has its whole sequence as one shingle; one
    without words has none.
    """
    low = LOWER[data]
    words = space_words(low, offsets)
    h = span_hashes(low, words.start, words.end)
    n_docs = len(offsets) - 1
    if not len(h):
        return np.zeros(0, _U64), np.zeros(n_docs + 1, np.int64)
    full = len(h) - k + 1
    if full > 0:
        s = h[:full] * _SHINGLE[0]
        for i in range(1, k):
            s = s * _U64(0x9FB21C651E98DF25) + h[i : i + full] * _SHINGLE[i % 5]
        ok = words.doc[:full] == words.doc[k - 1 :]
        sh, sd = mix64(s[ok]), words.doc[:full][ok]
    else:
        sh, sd = np.zeros(0, _U64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = np.zeros(len(short), _U64)
        for j in range(k - 1):
            has = words.count[short] > j
            at = words.first[short[has]] + j
            extra[has] = extra[has] * _U64(0x9FB21C651E98DF25) + h[at] * _SHINGLE[j % 5]
        extra = mix64(extra + words.count[short].astype(_U64) * _U64(0xC2B2AE3D27D4EB4F))
        sh, sd = np.concatenate([sh, extra]), np.concatenate([sd, short])
    return _by_document(sh, sd, n_docs)


def _by_document(value: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document, sorted, and their offsets."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(n_docs + 1))


def exact_shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Like shingle_sets, but numbers that are equal exactly if the words are (inside this call)."""
    low = LOWER[data]
    words = space_words(low, offsets)
    n_docs = len(offsets) - 1
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    ids = interned(low, words.start, words.end)
    first = np.concatenate([words.first[d] + np.arange(max(1, words.count[d] - k + 1)) for d in np.flatnonzero(words.count)])
    doc = words.doc[first]
    value = ids[first]
    for j in range(1, k):  # pairs of numbers become numbers
        has = j < words.count[doc]
        after = np.where(has, ids[np.minimum(first + j, len(ids) - 1)] + 1, 0)
        _, value = np.unique(value.astype(np.int64) * (len(ids) + int(ids.max()) + 2) + after, return_inverse=True)
    return _by_document(value, doc, n_docs)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session (tests) may do without."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="rolegrain-")
        spark.conf.set("spark.checkpoint.dir", got)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(got)
    return got


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and cuts its lineage; meanwhile Python workers get batches of 1000 rows."""
    shared_folder(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


#: Keys with at least this part of all rows are hot; there can't be more of them than its inverse.
HOT = 1000


def hot_left(frame: DataFrame, column: str, unique: DataFrame, key: str, rows: int) -> DataFrame:
    """frame (cut, of ``rows`` rows) left join unique (one row a key) on column = key.

    Hot keys, at most HOT of them, are looked up by broadcast, so that no task gets
    one's rows; all others meet by a shuffle.
    """
    hot = frame.groupBy(F.col(column).alias("__hot")).count().where(F.col("count") * HOT >= max(rows, HOT)).select("__hot")
    hot = F.broadcast(cut(frame.sparkSession, hot))
    marked = frame.join(hot, F.col(column) == F.col("__hot"), "left")
    few = unique.join(hot, F.col(key) == F.col("__hot"), "left_semi")
    often = marked.where("__hot is not null").join(F.broadcast(few), F.col(column) == F.col(key), "left")
    rest = marked.where(F.col("__hot").isNull() & F.col(column).isNotNull()).join(unique, F.col(column) == F.col(key), "left")
    return often.unionByName(rest).drop("__hot").unionByName(frame.where(F.col(column).isNull()), allowMissingColumns=True)


def release() -> None:
    """Gives the memory that this Python worker has freed back to the system; workers outlive their tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """run, a function of batches, that gives memory back when a task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def one_thread() -> None:
    """Arithmetic libraries in a Python worker keep to the task's own core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` of labels(doc_id, label), picked by hash before any text is read."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").distinct()
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    first = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # a bounded number of ids
    return first.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows of docs, with all their columns, for which decide(texts) is true."""
    at = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                yield b.filter(pa.array(decide(b.column(at)), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
