"""Quality rules: base counts, and a calibrated logistic regression on hashed n-grams.

Features are the shares of a text's word unigrams and bigrams, and of its byte
trigrams and pentagrams, hashed to ``BUCKETS``.  The regression is fitted on at
most ``TRAIN_ROWS`` labelled rows and calibrated on a fifth of them left out; all
texts are scored whole in Arrow batches against a fixed threshold.

Edge cases: a null or empty text has no words and fails the base rules; without
labels of both kinds the model says the share of good labels (1 if none) for
every text; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, steps, texts_of
from .labelled import sample
from .vechash import BLOCK, U, Words, mix

BUCKETS = 1 << 14
TRAIN_ROWS = 1500
#: Columns of the training matrix that are squared at a time.
COLUMNS = 1 << 10
THRESHOLD = 0.35
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANK = " \t\n\x0b\x0c\r"
BASE = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Model(NamedTuple):
    weights: np.ndarray  # of each bucket
    bias: float
    slope: float  # of the calibration
    shift: float


def grams(w: Words):
    """(buckets, the row of each, how many each row has) of each family of n-grams; of bytes, block by block."""
    part = U(BUCKETS // 4 - 1)
    h = w.hashes()
    yield (h & part).astype(np.int32), w.row(), w.count
    at = w.inside(2)
    row = w.row()[at]
    yield (w.windows(2, hashes=h)[at] & part).astype(np.int32) + BUCKETS // 4, row, np.maximum(w.count - 1, 0)
    size = np.diff(w.off)
    for a in range(0, len(w.bytes), BLOCK):
        near = w.bytes[a : a + BLOCK + 4].astype(np.uint64)
        n_here = min(BLOCK, len(w.bytes) - a)
        row = np.searchsorted(w.off, np.arange(a, a + n_here), side="right") - 1
        for k, n in ((2, 3), (3, 5)):
            code = near[:n_here].copy()
            for j in range(1, n):
                code[: max(0, len(near) - j)] |= near[j : j + n_here] << U(8 * j)
            inside = np.arange(a, a + n_here) + n <= w.off[1:][row]
            yield (mix(code[inside]) & part).astype(np.int32) + k * (BUCKETS // 4), row[inside], np.maximum(size - n + 1, 0)


def dense(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, text in enumerate(texts):
        for bucket, _, n in grams(Words(pa.array([text]))):
            if n[0]:
                out[k] += np.bincount(bucket, minlength=BUCKETS).astype(np.float32) / n[0]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the labels best, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * logit + b)
        g = np.array([np.sum((p - y) * logit) + 0.1 * (a - 1), np.sum(p - y) + 0.01 * b])
        v = p * (1 - p) + 1e-6
        h = np.array([[np.sum(v * logit * logit) + 0.1, np.sum(v * logit)], [np.sum(v * logit), np.sum(v) + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.05, a - step[0]), b - step[1]
    return float(a), float(b)


def fit(texts: list[str], y: list[int]) -> Model:
    labels = np.array(y, np.float32)
    if len(set(y)) < 2:
        share = float(labels.mean()) if len(y) else 1.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    held = np.arange(len(y)) % 5 == 4
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    # The one large array: rows to train on come first, so that both parts are views of it, and it is squared a few columns at a time.
    order, cut = np.argsort(held, kind="stable"), int((~held).sum())
    x, labels = dense([texts[k] for k in order]), labels[order]
    back = np.argsort(order)
    scale = np.concatenate([1 / (np.sqrt((x[back, a : a + COLUMNS] ** 2).mean(0)) + 1e-3) for a in range(0, BUCKETS, COLUMNS)])
    x *= scale
    x /= np.sqrt(BUCKETS)
    own, truth = x[:cut], labels[:cut]
    theta, bias = np.zeros(BUCKETS, np.float32), 0.0
    weight = np.where(truth == 1, 0.5 / max(truth.mean(), 1e-3), 0.5 / max(1 - truth.mean(), 1e-3)).astype(np.float32)
    m, v = np.zeros(BUCKETS + 1, np.float32), np.zeros(BUCKETS + 1, np.float32)
    for t in range(1, 201):
        err = (_sigmoid(own @ theta + bias) - truth) * weight / len(truth)
        g = np.append(own.T @ err + 1e-4 * theta, err.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta -= step[:-1]
        bias -= float(step[-1])
    pick = slice(cut if held.any() else 0, None)
    slope, shift = platt(x[pick] @ theta + bias, labels[pick])
    return Model(theta * scale / np.float32(np.sqrt(BUCKETS)), bias, slope, shift)


def probability(model: Model, w: Words) -> np.ndarray:
    logit = np.full(len(w.count), model.bias)
    for bucket, row, n in grams(w):
        logit += np.bincount(row, model.weights[bucket], len(w.count)) / np.maximum(n, 1)
    return _sigmoid(model.slope * logit + model.shift)


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[edges[1:]] - total[edges[:-1]]


def base_counts(w: Words, texts: list[str]) -> dict[str, np.ndarray]:
    """The four base counts of each row."""
    inside = np.zeros(len(w.bytes) + 1, np.int8)
    inside[w.start] += 1
    np.subtract.at(inside, w.end, 1)
    lead = (np.cumsum(inside[:-1]) > 0) & ((w.bytes & 0xC0) != 0x80)
    dup = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(BLANK)]
        dup.append(len(lines) - len(set(lines)))
    at = w.inside(3)
    covered = np.zeros(len(w.start), bool)
    if len(at):
        h, row = w.windows(3)[at], w.row()[at]
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        for k in range(3):
            covered[twice + k] = True
    return {"word_chars": _per_row(lead, w.off), "n_symbols": _per_row(SYMBOLS[w.bytes], w.off), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": _per_row(covered, w.first)}


def judge(batch: pa.RecordBatch, model: Model, threshold: float) -> dict[str, np.ndarray]:
    w = Words(batch.column("text"))
    out = {"n_words": w.count.astype(np.int64), **base_counts(w, texts_of(batch))}
    out["base_failed"] = (w.count < 50) | (100 * out["n_repeat_words"] > 50 * w.count)
    out["quality"] = probability(model, w)
    out["kept"] = ~out["base_failed"] & (out["quality"] >= threshold)
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(*sample(docs, labels, "quality", rows))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, the base counts, base_failed, quality, kept), a row for each row."""

    def run(batches):
        for b in steps(batches):
            out = judge(b, model, threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in out.values())], ["doc_id", *out])

    counts = ", ".join(f"{c} long" for c in BASE)
    return id_text(docs).mapInArrow(run, f"doc_id long, n_words long, {counts}, base_failed boolean, quality double, kept boolean")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no join, no shuffle."""

    def run(batches):
        for b in steps(batches):
            yield b.filter(pa.array(judge(b, model, threshold)["kept"]))

    return map_arrow(docs, run, docs.schema)
