"""Benchmark passages in documents, by q-gram windows and exact edit distance (operator 2).

A passage matches an item if some stretch of the text is within
``max_rate`` x (item's bytes) edits of it; both are compared as ASCII-lower-case
UTF-8. Windows are opened where a diagonal band of the text holds as
many of the item's grams as that edit distance must leave (the q-gram
lemma, so no match is lost); grams are of 8 bytes, or shorter where the lemma
would leave less than one. Every window is decided by the exact
edit distance (Myers' bit vectors) of the item to any stretch near it, so
insertions and deletions are found like substitutions. CGK walks with bit
sampling decided before; they lose step after insertions and deletions, lost
matches and took longer than the distances they spared.

The items are broadcast in groups of at most ``GROUP_BYTES``; more items are
more passes over the documents.

Defined results: null and empty texts hold nothing; items of fewer than
``min_bytes`` bytes are searched for without edits, empty and null ones not at all; equal items each match;
repeated rows match each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_RATE, MIN_BYTES = 0.1, 24
GROUP_BYTES = 1 << 20
_Q = 8
_FILTER_BITS = 22


def _grams(low: np.ndarray, q: int = _Q) -> np.ndarray:
    """The q (at most 8) bytes from each place as one integer."""
    return common.eights(low)[: max(0, len(low) - q + 1)] & np.uint64((1 << 8 * q) - 1)


def _edits(size, max_rate: float, min_bytes: int):
    return np.where(size < min_bytes, 0, np.floor(size * max_rate)).astype(int)


def _gram_bytes(size, edits):
    """The longest grams of which the edits leave at least one: size - q + 1 - q * edits >= 1."""
    return np.clip(size // (edits + 1), 1, _Q)


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Items:
    """A bounded group of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, bytes]], max_rate: float, min_bytes: int = MIN_BYTES):
        self.ids = [i for i, _ in rows]
        self.low = [common.LOWER[np.frombuffer(t, np.uint8)] for _, t in rows]
        self.raw = [x.tobytes() for x in self.low]
        self.size = np.array([len(x) for x in self.low])
        self.edits = _edits(self.size, max_rate, min_bytes)
        self.q = int(_gram_bytes(self.size, self.edits).min())
        self.least = np.maximum(1, self.size - self.q + 1 - self.q * self.edits)
        self.band = int(max(64, self.edits.max() if len(rows) else 0))
        grams = [_grams(x, self.q) for x in self.low]
        g = np.concatenate(grams)
        item = np.repeat(np.arange(len(rows)), [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x)) for x in grams])
        order = np.argsort(g, kind="stable")
        self.gram, self.item, self.place = g[order], item[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slot(self.gram)] = True

    def windows(self, low: np.ndarray, offsets: np.ndarray):
        """(document, item, first byte) of the windows to verify."""
        g = _grams(low, self.q)
        none = np.zeros(0, np.int64)
        hit = np.flatnonzero(self.filter[_slot(g)])
        left = np.searchsorted(self.gram, g[hit])
        times = np.searchsorted(self.gram, g[hit], side="right") - left
        hit, left, times = hit[times > 0], left[times > 0], times[times > 0]
        if not len(hit):
            return none, none, none
        entry = np.repeat(left - np.concatenate([[0], np.cumsum(times)])[:-1], times) + np.arange(times.sum())
        at = np.repeat(hit, times)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + self.q <= offsets[doc + 1]
        entry, at, doc = entry[inside], at[inside], doc[inside]
        item, begin = self.item[entry], at - self.place[entry]
        found = []
        for shift in (0, self.band):  # bands of twice the greatest drift, overlapping by half
            band = (begin - offsets[doc] + shift + (1 << 20)) // (2 * self.band)
            # places of the item count once in a band; few bands get past their number of hits
            key = (doc * len(self.ids) + item) * (1 << 28) + band
            kinds, which, count = np.unique(key, return_inverse=True, return_counts=True)
            more = np.flatnonzero(count[which] >= self.least[item])
            order = more[np.lexsort((begin[more], self.place[entry[more]], which[more]))]
            w, place = which[order], self.place[entry[order]]
            new = np.ones(len(order), bool)
            new[1:] = (w[1:] != w[:-1]) | (place[1:] != place[:-1])
            w, order = w[new], order[new]
            again = np.lexsort((begin[order], w))
            w, order = w[again], order[again]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else none
            count = np.diff(np.append(first, len(w)))
            ok = count >= self.least[item[order[first]]]
            middle = order[first[ok] + count[ok] // 2]
            found.append(np.stack([doc[middle], item[middle], begin[middle]]))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """(document, item, first byte, end byte, edits) in a slice of documents."""
        low = common.LOWER[data]
        doc, item, begin = self.windows(low, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        room = 2 * self.band  # a match and the middle of its band are less than a band's width apart
        for x, y, a in zip(doc.tolist(), item.tolist(), begin.tolist()):
            lo, hi = max(a - room, int(offsets[x])), min(a + int(self.size[y]) + room, int(offsets[x + 1]))
            got = nearest(self.raw[y], low[lo:hi].tobytes(), int(self.edits[y]))
            if got is not None:
                edits, i0, i1 = got
                new = (edits, lo + i0 - int(offsets[x]), lo + i1 - int(offsets[x]))
                best[x, y] = min(best.get((x, y), new), new)
        return [(x, y, i0, i1, e) for (x, y), (e, i0, i1) in sorted(best.items())]


def _ends(pattern: bytes, text: bytes) -> list[int]:
    """Edit distance of pattern to the nearest stretch of text that ends at each byte."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        out.append(score)
    return out


def nearest(pattern: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, first, end) of the best stretch within ``most`` edits, the earliest of equals."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    ends = _ends(pattern, text)
    edits = min(ends, default=most + 1)
    if edits > most:
        return None
    end = ends.index(edits) + 1
    back = _ends(pattern[::-1], text[:end][::-1])
    return edits, end - (back.index(edits) + 1 if edits in back else len(pattern)), end


def _groups(items: DataFrame, max_rate: float, min_bytes: int):
    """Item groups of bounded size and one length of grams, read one after the other."""
    rows: dict[int, list] = {}
    size: dict[int, int] = {}
    known = items.where("text is not null and item_id is not null").select("item_id", "text").where(F.octet_length("text") > 0)
    for r in known.orderBy("item_id", "text").toLocalIterator():
        raw = r.text.encode()
        q = int(_gram_bytes(len(raw), _edits(len(raw), max_rate, min_bytes)))
        if q in rows and size[q] + len(raw) > GROUP_BYTES:
            yield Items(rows.pop(q), max_rate, min_bytes)
        if q not in rows:
            rows[q], size[q] = [], 0
        rows[q].append((r.item_id, raw))
        size[q] += len(raw)
    for own in rows.values():
        yield Items(own, max_rate, min_bytes)


def find(docs: DataFrame, items: DataFrame, max_rate: float = MAX_RATE, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, item_id, start and stop (code points) and edits of each match of docs(doc_id, text)."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, stop long, edits int"
    out = None
    for group in _groups(items, max_rate, min_bytes):
        shared = spark.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            own = shared.value
            for b in batches:
                data, off = common.text_buffer(b.column(1))
                ids, rows = b.column(0), []
                for i, j in common.slices(off):
                    part = data[off[i] : off[j]]
                    for x, y, i0, i1, e in own.matches(part, off[i : j + 1] - off[i]):
                        text = data[off[i + x] : off[i + x + 1]].tobytes()
                        start = len(text[:i0].decode(errors="ignore"))
                        rows.append((ids[i + x].as_py(), own.ids[y], start, start + len(text[i0:i1].decode(errors="ignore")), e))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "start", "stop", "edits"])

        got = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, max_rate: float = MAX_RATE, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item."""
    at = docs.columns.index("text")
    for group in _groups(items, max_rate, min_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            own = shared.value
            for b in batches:
                data, off = common.text_buffer(b.column(at))
                keep = np.ones(b.num_rows, bool)
                for i, j in common.slices(off):
                    for x, *_ in own.matches(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                        keep[i + x] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(common.tidy(run), docs.schema)
    return docs
