"""Quality by random indexing and a small calibrated network (operator 1).

Every term (words and runs of signs, hashed within its shape class) has a fixed
sparse random vector. A pass over all documents adds, into each term slot, the
random vectors of the terms within two places: the slots' word vectors. A
document is pooled into the mean, the spread and the mean step between
neighbours of its word vectors. A two-layer numpy network is trained on a bounded sample of labelled rows
(``sample_rows``); a temperature fitted on rows set aside calibrates it.

Defined results: null and empty texts pool to zeros and get the network's
answer to that; without labels every score is 0. Very long texts are pooled
whole, in runs of ``RUN`` terms; repeated rows count as often in the word
vectors and get equal scores; labels at the sample's edge are taken by hash,
then doc_id, then label; of rows that repeat a doc_id the first text is learned
from. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import held_out

SLOTS, DIMS, NONZERO = 1 << 13, 32, 4
SAMPLE_ROWS, HIDDEN = 8000, 48
#: Terms whose vectors are held at a time.
RUN = 1 << 16
_BLOCK = 512  # slots in a row of the table of word vectors


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(0, DIMS, (SLOTS, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


_PLACE, _SIGN = _index_vectors()


def term_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each term. Shape classes own an eighth of the slots each."""
    kind = common.BYTE_CLASS[data]
    w = common.class_words(data, offsets, kind == 0, kind)
    h = common.span_hashes(data, w.start, w.end)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    n_up, size = upper[w.end] - upper[w.start], w.end - w.start
    first = (data[w.start] >= 65) & (data[w.start] <= 90)
    k = kind[w.start] if len(w.start) else np.zeros(0, np.uint8)
    shape = np.where(k == 3, 6, np.where(k == 2, 5, np.where(n_up == 0, 0, np.where((n_up == 1) & first & (size > 1), 1, np.where(n_up * 2 > size, 2, 3)))))
    shape = np.where((k == 1) & (size > 24), 4, shape)
    each = SLOTS // 8
    return w.doc, shape * each + (h % np.uint64(each)).astype(np.int64)


def _contexts(batches):
    total = np.zeros(SLOTS * DIMS)
    for b in batches:
        data, off = common.text_buffer(b.column(0))
        for i, j in common.slices(off, 1 << 21, 1 << 14):
            doc, slot = term_slots(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for gap in (1, 2):
                ok = doc[gap:] == doc[:-gap]
                a, c = slot[:-gap][ok], slot[gap:][ok]
                pair, times = np.unique(a * SLOTS + c, return_counts=True)
                a, c = pair // SLOTS, pair % SLOTS
                for z in range(NONZERO):
                    total += np.bincount(a * DIMS + _PLACE[c, z], _SIGN[c, z] * times, SLOTS * DIMS)
                    total += np.bincount(c * DIMS + _PLACE[a, z], _SIGN[a, z] * times, SLOTS * DIMS)
    parts = total.astype(np.float32).reshape(-1, _BLOCK * DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "sums"])


def _add_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(s, np.float32).astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Slots x dimensions, of unit length, from the contexts in all documents: 1 MB at any size."""
    parts = docs.select("text").mapInArrow(_contexts, "block int, sums binary")
    rows = parts.repartition(SLOTS // _BLOCK, "block").mapInArrow(_add_blocks, "block int, sums binary").collect()
    v = np.zeros((SLOTS, DIMS), np.float32)
    for r in rows:
        v[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(bytes(r.sums), np.float32).reshape(_BLOCK, DIMS)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.maximum(norm, 1e-9)


def pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x features."""
    n = len(offsets) - 1
    doc, slot = term_slots(data, offsets)
    count = np.maximum(np.bincount(doc, minlength=n), 1)[:, None]
    total, square, steps = (np.zeros((n, DIMS)) for _ in range(3))
    for a in range(0, len(doc), RUN):
        before = max(a - 1, 0)
        v, own = vectors[slot[before : a + RUN]], doc[before : a + RUN]
        step = np.abs(v[1:] - v[:-1])
        step[own[1:] != own[:-1]] = 0
        if a:
            v, own = v[1:], own[1:]
        else:
            step = np.concatenate([np.zeros_like(v[:1]), step])
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for held, x in ((total, v), (square, v * v), (steps, step)):
            held[own[begins]] += np.add.reduceat(x, begins, axis=0)
    mean = total / count
    return np.hstack([mean, np.sqrt(np.maximum(square / count - mean**2, 0)), steps / count]).astype(np.float32)


def _pooled(shared):
    def run(batches):
        for b in batches:
            data, off = common.text_buffer(b.column(1))
            rows = []
            for i, j in common.slices(off):
                rows += [x.tobytes() for x in pool(shared.value, data[off[i] : off[j]], off[i : j + 1] - off[i])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["label", "features"])

    return run


class Network:
    """features -> tanh layer -> logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 60):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        aside = rng.random(len(y)) < 0.15 if len(y) >= 60 else np.zeros(len(y), bool)
        tx, ty = x[~aside], y[~aside]
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        share = min(max(ty.mean(), 0.02), 0.98)
        weight = np.where(ty == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        for epoch in range(epochs):
            order = rng.permutation(len(ty))
            for at in range(0, len(order), 128):
                own = order[at : at + 128]
                a = np.tanh(tx[own] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -30, 30))) - ty[own]) * weight[own] / len(own)
                ga = g[:, None] * p[2] * (1 - a * a)
                grad = [tx[own].T @ ga + 1e-4 * p[0], ga.sum(0), a.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                t += 1
                for i in range(4):
                    m[i] += 0.1 * (grad[i] - m[i])
                    s[i] += 0.001 * (grad[i] ** 2 - s[i])
                    p[i] -= 0.004 / (1 + epoch / 20) * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.heat = p, 1.0
        if aside.any():
            z, ay = self._logit(x[aside]), y[aside]
            loss = {h: np.mean(np.logaddexp(0, -np.where(ay == 1, z, -z) / h)) for h in np.geomspace(0.3, 8, 40)}
            self.heat = float(min(loss, key=loss.get))

    def _logit(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.heat, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    common.one_thread()
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = common.labelled(docs, known, sample_rows).select("label", "text").mapInArrow(_pooled(shared), "label int, features binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r.features), r.label))
    x = np.frombuffer(b"".join(bytes(r.features) for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return Network(x, np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        common.one_thread()
        vectors, network = shared.value
        for b in batches:
            data, off = common.text_buffer(b.column(1))
            out = np.zeros(len(off) - 1)
            if network is not None:
                for i, j in common.slices(off):
                    out[i:j] = network(pool(vectors, data[off[i] : off[j]], off[i : j + 1] - off[i]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    vectors = word_vectors(docs)
    network = fit(docs.where(~held_out(3, 1)), labels.where(~held_out(3, 1)), vectors)
    return score(docs, vectors, network).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
