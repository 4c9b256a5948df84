"""Toxicity by a factorisation machine over hashed terms (operator 3).

Terms of a text are its lower-cased words and their 4- and 5-byte beginnings,
hashed; a term is present or not. The machine has a weight per term and a
small vector per term whose inner products weigh pairs of terms that occur
together. It is trained by Adam on the driver over a bounded sample of labelled
rows (``sample_rows``). Of the terms that at least ``min_rows`` of them (three,
of small samples) hold, it gets those whose count among the toxic rows is off
the expected one by ``min_z`` deviations, and both terms of every pair that is
toxic more or less often, by ``pair_z`` deviations, than the two terms' own log
odds add up to: such terms may each be neutral. Pairs are sought among the
``pair_terms`` most frequent terms. Terms that do neither only add noise.

Defined results: null and empty texts get the machine's bias as score; if no
row is labelled, every score is 0. Only label values 0 and 1 are learned from;
a document with several labels gives several rows, and of rows that repeat a
doc_id the first text is learned from. Very long texts are read whole; repeated
rows get equal scores; labels at the sample's edge are taken by hash, then
doc_id, then label. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import held_out

BITS = 18
SAMPLE_ROWS, FACTORS = 8000, 8
PAIR_TERMS, PAIR_Z, PAIR_ROWS = 3072, 6.0, 8


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed term) of each occurrence."""
    low = common.LOWER[data]
    kind = common.BYTE_CLASS[low]
    w = common.class_words(low, offsets, kind != 1, kind)
    docs, slots = [], []
    for n, salt in ((None, 0), (4, 0x51ED270B), (5, 0x2545F491)):
        pick = slice(None) if n is None else np.flatnonzero(w.end - w.start > n)
        start, end = w.start[pick], w.end[pick]
        h = common.span_hashes(low, start, end if n is None else start + n) + np.uint64(salt)
        slots.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
        docs.append(w.doc[pick])
    return np.concatenate(docs), np.concatenate(slots)


def _term_rows(batches):
    for b in batches:
        data, off = common.text_buffer(b.column(1))
        rows = []
        for i, j in common.slices(off):
            d, t = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
            key = np.unique((d << BITS) | t)
            at = np.searchsorted(key, np.arange(j - i + 1) << BITS)
            t = (key & ((1 << BITS) - 1)).astype(np.uint32)
            rows += [t[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["label", "terms"])


def interacting(sets: list[np.ndarray], y: np.ndarray, terms: np.ndarray, least_z: float, least_rows: int = PAIR_ROWS) -> np.ndarray:
    """The terms in pairs whose toxic share isn't the sum of their own log odds."""
    m = len(terms)
    if m < 2 or not 0 < y.sum() < len(y):
        return np.zeros(0, np.int64)
    at = np.full(1 << BITS, -1, np.int32)
    at[terms] = np.arange(m)
    both, bad = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for i in range(0, len(sets), 500):
        x = np.zeros((min(500, len(sets) - i), m), np.float32)
        for k, s in enumerate(sets[i : i + 500]):
            s = at[s]
            x[k, s[s >= 0]] = 1
        both += x.T @ x
        x = x[y[i : i + 500] == 1]
        bad += x.T @ x
    rate = y.mean()
    n, t = both.diagonal(), bad.diagonal()
    odds = np.log((t + rate) / (n - t + 1 - rate)) - np.log(rate / (1 - rate))
    found = np.zeros(m, bool)
    for i in range(0, m, 256):
        p = 1 / (1 + np.exp(-np.clip(odds[i : i + 256, None] + odds[None, :] + np.log(rate / (1 - rate)), -30, 30)))
        n = both[i : i + 256]
        z = (np.abs(bad[i : i + 256] - n * p) - 0.5) / np.sqrt(n * p * (1 - p) + 0.25)
        hit = (n >= least_rows) & (z >= least_z)
        hit[np.arange(len(hit)), i + np.arange(len(hit))] = False
        found |= hit.any(0)
        found[i : i + 256] |= hit.any(1)
    return terms[found]


def fit(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS, min_rows: int = 5, min_z: float = 3.0, epochs: int = 12, seed: int = 7, pair_terms: int = PAIR_TERMS, pair_z: float = PAIR_Z):
    """{slot map, bias, weights, vectors}, or None without labels. docs(doc_id, text), labels(doc_id, label)."""
    common.one_thread()
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    rows = common.labelled(docs, known, sample_rows).select("label", "text").mapInArrow(_term_rows, "label int, terms binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r.terms), r.label))
    sets = [np.frombuffer(bytes(r.terms), np.uint32) for r in rows]
    y = np.array([r.label for r in rows], np.float64)
    seen = np.bincount(np.concatenate(sets), minlength=1 << BITS)
    bad = np.bincount(np.concatenate([s for s, t in zip(sets, y) if t] or [np.zeros(0, np.uint32)]), minlength=1 << BITS)
    rate = y.mean()
    z = (bad - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
    often = seen >= min(min_rows, max(3, len(rows) // 400), max(1, len(rows) // 20))
    frequent = np.argsort(-seen, kind="stable")[:pair_terms]
    pairs = interacting(sets, y, frequent[often[frequent]], pair_z)
    kept = np.union1d(np.flatnonzero(often & (np.abs(z) >= min_z)), pairs).astype(np.int64)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    sets = [s[s >= 0] for s in (slot[s] for s in sets)]
    rng = np.random.default_rng(seed)
    m, k = len(kept), FACTORS
    p = {"b": np.zeros(1), "w": np.zeros(m), "v": rng.normal(0, 0.01, (m, k))}
    if not m:
        p["b"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return {"slot": slot, **p}
    first = {n: np.zeros_like(x) for n, x in p.items()}
    second = {n: np.zeros_like(x) for n, x in p.items()}
    pos = max(y.sum(), 1)
    weight = np.where(y == 1, np.sqrt(max(1.0, (len(y) - pos) / pos)), 1.0)
    step = 0
    epochs = max(epochs, -(-600 * 256 // len(y)))  # few rows are gone over more often
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            own = order[at : at + 256]
            size = np.array([len(sets[i]) for i in own])
            t = np.concatenate([sets[i] for i in own])
            row = np.repeat(np.arange(len(own)), size)
            sv = np.zeros((len(own), k))
            if len(t):
                begins = np.concatenate([[0], np.cumsum(size)])[:-1][size > 0]
                vt = p["v"][t]
                sv[size > 0] = np.add.reduceat(vt, begins, axis=0)
                sq = np.bincount(row, (vt * vt).sum(1), len(own))
                lin = np.bincount(row, p["w"][t], len(own))
            else:
                sq = lin = np.zeros(len(own))
            z = p["b"][0] + lin + 0.5 * ((sv * sv).sum(1) - sq)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)
            grad = {"b": np.array([g.sum()]), "w": np.bincount(t, g[row], m) + 1e-5 * p["w"], "v": 1e-4 * p["v"]}
            if len(t):
                gv = g[row][:, None] * (sv[row] - vt)
                for f in range(k):
                    grad["v"][:, f] += np.bincount(t, gv[:, f], m)
            step += 1
            for n in p:
                first[n] += 0.1 * (grad[n] - first[n])
                second[n] += 0.001 * (grad[n] ** 2 - second[n])
                p[n] -= 0.02 / (1 + 3 * epoch / epochs) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return {"slot": slot, **p}


def _margin(model, data, offsets):
    n = len(offsets) - 1
    d, t = terms(data, offsets)
    s = model["slot"][t]
    key = np.unique((d[s >= 0] << BITS) | s[s >= 0])
    d, s = key >> BITS, key & ((1 << BITS) - 1)
    z = model["b"][0] + np.bincount(d, model["w"][s], n)
    for f in range(FACTORS):
        v = model["v"][s, f]
        z += 0.5 * (np.bincount(d, v, n) ** 2 - np.bincount(d, v * v, n))
    return z


def judge(model, text: pa.Array) -> np.ndarray:
    """Scores of a column of texts."""
    data, off = common.text_buffer(text)
    out = np.zeros(len(off) - 1)
    if model is not None:
        for i, j in common.slices(off):
            z = _margin(model, data[off[i] : off[j]], off[i : j + 1] - off[i])
            out[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 slots and the kept terms' numbers

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(judge(shared.value, b.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def civil(docs: DataFrame, model, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score under the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.keep_rows(docs, lambda text: judge(shared.value, text) < limit)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out(5, 0)), labels.where(~held_out(5, 0)), "toxic")
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
