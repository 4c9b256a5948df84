"""Language identification by string kernels (operator 9).

A text is the set of hashed 1- to 3-byte grams of its lower-cased form (a
blended spectrum, presence only). The kernel of two texts is the size of the
intersection over the geometric mean of their sizes. Landmark texts give the
Nyström map; one-versus-rest kernel ridge regression is solved in it on the
driver, over a bounded sample of labelled rows (``sample_rows``). Scores are
batched matrix products: presence x (landmarks x weights), the product of the
two right factors being taken once, since (P Z')A = P(Z'A).

Defined results: a null text or one without a letter is ``und`` with score 0;
if no row is labelled, every text is. Extra columns are ignored; very long
texts are taken whole; repeated rows are learned from once and, like ties, give
the same prediction (the alphabetically first language on a tie).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 14
_SIZE = 1 << BITS
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
SAMPLE_ROWS, LANDMARKS = 2000, 256
#: A text that scores less is in none of the learned languages.
LEAST_SCORE = 0.5


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x grams, true where a gram occurs."""
    n = len(offsets) - 1
    out = np.zeros(n * _SIZE, bool)
    low = common.LOWER[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * _SIZE, np.diff(offsets))
    h = np.zeros(len(low), np.uint32)
    for k in range(3):
        m = len(low) - k
        if m <= 0:
            break
        h = (h[:m] * np.uint32(257) + low[k:] + np.uint32(1)) if k else low + np.uint32(1)
        ok = doc[:m] == doc[k:]
        slot = (h * _MULT[k] + np.uint32(k * 0x27D4EB2F)) >> np.uint32(32 - BITS)
        out[doc[:m][ok] + slot[ok]] = True
    return out.reshape(n, _SIZE)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    total = np.concatenate([[0], np.cumsum(ascii_letter, dtype=np.int64)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def _packed(batches):
    for b in batches:
        data, off = common.text_buffer(b.column(1))
        rows = []
        for i, j in common.slices(off):
            rows += [r.tobytes() for r in np.packbits(presence(data[off[i] : off[j]], off[i : j + 1] - off[i]), axis=1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["lang", "grams"])


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = 1e-2):
    """(languages, weights per gram, temperature) from train(doc_id, text, lang); at most ``sample_rows`` of them."""
    common.one_thread()
    usable = train.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("__h"))
    # hashes first, so that no task gathers texts; then one row a hash
    picked = usable.select("__h").distinct().orderBy("__h").limit(sample_rows)
    chosen = usable.join(F.broadcast(picked), "__h", "left_semi").groupBy("__h").agg(F.min(F.struct("lang", "text")).alias("r"))
    rows = chosen.select("r.lang", "r.text").mapInArrow(_packed, "lang string, grams binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.grams)))
    if not rows:
        return [], np.zeros((_SIZE, 0), np.float32), 1.0
    langs = sorted({r.lang for r in rows})
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r.grams) for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([langs.index(r.lang) for r in rows])
    marks: list[int] = []  # in turn over languages, so that a rare one has landmarks
    by = [list(np.flatnonzero(y == k)) for k in range(len(langs))]
    while len(marks) < min(landmarks, len(rows)):
        marks += [g.pop(0) for g in by if g]
    z = x[marks]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ z.T) @ root
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    gram = phi.T @ phi
    w = np.linalg.solve(gram + ridge * len(rows) / 100 * np.eye(len(gram)), phi.T @ target)
    weights = (z.T @ (root @ w)).astype(np.float32)
    s = x @ weights
    nll = {t: -np.log(np.maximum(_softmax(s * t)[np.arange(len(y)), y], 1e-12)).mean() for t in (0.5, 1, 2, 3, 4, 6)}
    return langs, weights, float(min(nll, key=nll.get))


def _softmax(s):
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def judge(model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of a column of texts."""
    langs, weights, heat = model
    data, off = common.text_buffer(text)
    n = len(off) - 1
    pred, score = np.full(n, "und", object), np.zeros(n)
    if langs:
        for i, j in common.slices(off):
            part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
            p = presence(part, own).astype(np.float32)
            prob = _softmax(heat * (p @ weights) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1)))
            best = prob.argmax(1)
            ok = has_letter(part, own)
            pred[i:j][ok] = np.array(langs, object)[best][ok]
            score[i:j][ok] = prob[np.arange(j - i), best][ok]
    return pred, score


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred and score of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grams x languages: 64 KB a language

    def run(batches):
        common.one_thread()
        for b in batches:
            pred, score = judge(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def known(docs: DataFrame, model, wanted: list[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, predicted to be in a wanted language (all learned ones) with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(text):
        pred, score = judge(shared.value, text)
        return (pred != "und") & (score >= least) & (np.isin(pred, wanted) if wanted is not None else True)

    return common.keep_rows(docs, decide)


def held_out(mod: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == rest, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows outside the held-out fold and predicts every row."""
    model = fit(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
