"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a hashed word embedding beside the scaled sum of the embeddings
of its character trigrams and of its first four and five bytes.  A gated recurrent unit runs over a window in both
directions; attention pools its states into one logit.  All windows of ``WINDOW``
words at a stride of half a window, the last one reaching to the text's end, are
scored; a document's logit is its highest window's, calibrated to a probability.

Training takes at most ``TRAIN_ROWS`` labelled rows, all their windows.  Labels are of documents, so
each round trains on the windows the network itself finds likeliest, after a
first round on random ones (multiple-instance learning).

In scoring, each distinct word of a batch is projected once for both directions;
a step of the recurrence is one small matrix product over thousands of windows.

Edge cases: a null or empty text, or one without letters, is one empty window;
without labels of both kinds every text has the share of label 1 (0 if none) as
score; repeated rows are scored each; a null doc_id is never held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, steps
from .labelled import sample
from .quality import platt
from .vechash import U, Words, mix

TRAIN_ROWS = 2500
WINDOW = 24
STRIDE = WINDOW // 2
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN = 1 << 14, 1 << 15, 8, 8
THRESHOLD = 0.7
#: Training takes so many steps at least.
STEPS = 300
#: A word is a run of letters; bytes of other alphabets count as letters.
SPACE = np.ones(256, bool)
SPACE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Inputs:
    """The distinct words of a column: word buckets, character trigram buckets; each occurrence's word."""

    def __init__(self, column: pa.Array):
        w = Words(column, SPACE, FOLD)
        self.first, self.count = w.first, w.count
        h = w.hashes()
        distinct, at, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (distinct & U(WORD_BUCKETS - 1)).astype(np.int32)
        start, size = w.start[at], (w.end - w.start)[at]
        self.size = size
        self.seg = np.concatenate(([0], np.cumsum(size)))[:-1]
        pos = np.arange(int(size.sum())) - np.repeat(self.seg, size)
        byte = np.repeat(start, size) + pos
        mid = w.bytes[byte].astype(np.uint64) if len(byte) else np.zeros(0, np.uint64)
        before, after = np.zeros_like(mid), np.zeros_like(mid)
        before[1:], after[:-1] = mid[:-1], mid[1:]
        before[pos == 0] = 0
        after[pos == np.repeat(size, size) - 1] = 0
        tri = mix(mid | before << U(8) | after << U(16))
        # Beside each byte's trigram, a word's first four and first five bytes are character inputs.
        head = [self._head(w.bytes, start, size, n) for n in (4, 5)]
        self.chars = np.empty(len(tri) + 2 * len(size), np.int32)
        self.seg = self.seg + 2 * np.arange(len(size))
        self.chars[np.repeat(self.seg, size) + pos] = (tri & U(CHAR_BUCKETS - 1)).astype(np.int32)
        for k, h in enumerate(head):
            self.chars[self.seg + size + k] = (h & U(CHAR_BUCKETS - 1)).astype(np.int32)
        self.size = size + 2

    @staticmethod
    def _head(data: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        code = np.full(len(start), n << 56, np.uint64)
        for j in range(n):
            on = size > j
            code[on] |= data[start[on] + j].astype(np.uint64) << U(8 * j)
        return mix(code)

    def chars_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(character buckets of the given distinct words end to end, where each word's begin, how many they are)."""
        size = self.size[words]
        begin = np.cumsum(size) - size
        return self.chars[np.repeat(self.seg[words] - begin, size) + np.arange(int(size.sum()))], begin, size

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, length) of each window."""
        n = 1 + np.maximum(0, -(-(self.count - WINDOW) // STRIDE))
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.minimum(k * STRIDE, np.maximum(self.count[row] - WINDOW, 0))
        return row, self.first[row] + begin, np.minimum(self.count[row], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gather(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by index."""
    return np.stack([np.bincount(at, c, size) for c in rows.T], axis=1).astype(np.float32)


def _texts_with(at: np.ndarray, bucket: np.ndarray, size: int) -> np.ndarray:
    """How many texts hold each bucket."""
    return np.bincount(np.unique(at.astype(np.int64) * size + bucket) % size, minlength=size)


class Network:
    """Parameters by name, forward over windows, gradients by back-propagation through time."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        #: Word buckets that enough training texts hold; the others enter as zeros.
        self.known = np.ones(WORD_BUCKETS, f)
        #: The same for character buckets.
        self.common = np.ones(CHAR_BUCKETS, f)

        def init(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(f)

        self.p = {"word": np.zeros((WORD_BUCKETS, DIM), f), "char": (0.03 * r.standard_normal((CHAR_BUCKETS, DIM))).astype(f)}
        for d in "fb":
            self.p |= {f"x{d}": init(2 * DIM, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, f), f"h{d}": init(HIDDEN, 3 * HIDDEN)}
        self.p |= {"a": init(2 * HIDDEN, HIDDEN), "v": init(HIDDEN, 1)[:, 0], "o": init(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, f)}

    def words(self, x: Inputs, ids: np.ndarray | None = None) -> np.ndarray:
        """The input vector of each (or of the given) distinct words."""
        ids = np.arange(len(x.bucket)) if ids is None else ids
        out = np.zeros((len(ids), 2 * DIM), np.float32)
        if len(ids):
            out[:, :DIM] = self.p["word"][x.bucket[ids]] * self.known[x.bucket[ids], None]
            chars, begin, size = x.chars_of(ids)
            out[:, DIM:] = np.add.reduceat(self.p["char"][chars] * self.common[chars, None], begin) / np.sqrt(size)[:, None].astype(np.float32)
        return out

    def forward(self, proj: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; proj: the distinct words' projections (a last row for no word); index, mask: (windows, steps)."""
        n, steps_ = index.shape
        at, on_at = np.ascontiguousarray(index.T), np.ascontiguousarray(mask.T)
        states, saved = {}, {}
        for d in "fb":
            h = np.zeros((n, HIDDEN), np.float32)
            hs = np.zeros((steps_, n, HIDDEN), np.float32)
            u = self.p[f"h{d}"]
            for t in range(steps_) if d == "f" else range(steps_ - 1, -1, -1):
                x = proj[d][at[t]]
                g = h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                on = on_at[t, :, None]
                after = h + on * (1 - z) * (new - h)
                if keep:
                    saved[d, t] = (h, z, r, new, g[:, 2 * HIDDEN :])
                h = hs[t] = after
            states[d] = hs
        both = np.concatenate((states["f"], states["b"]), axis=2)
        e = np.tanh(both @ self.p["a"])
        s = e @ self.p["v"] + (on_at - 1) * np.float32(1e9)
        att = np.exp(s - s.max(0)) * on_at
        att /= np.maximum(att.sum(0), np.float32(1e-9))
        pooled = np.einsum("tn,tnk->nk", att, both)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, both, e, att, pooled, saved) if keep else logit

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        padded = np.vstack((vectors, np.zeros((1, 2 * DIM), np.float32)))
        return {d: padded @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}

    def gradients(self, x: Inputs, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        used, inv = np.unique(index, return_inverse=True)
        local = inv.reshape(index.shape)
        real = used < len(x.bucket)
        ids = used[real]
        vectors = np.zeros((len(used), 2 * DIM), np.float32)
        vectors[real] = self.words(x, ids)
        proj = {d: vectors @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}
        logit, both, e, att, pooled, saved = self.forward(proj, local, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g["o"], g["c"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * self.p["o"]
        datt = np.einsum("tnk,nk->tn", both, dpool)
        ds = att * (datt - (att * datt).sum(0))
        de = ds[..., None] * self.p["v"] * (1 - e * e)
        g["v"] = np.einsum("tn,tnk->k", ds, e)
        g["a"] = np.einsum("tnk,tnj->kj", both, de)
        dboth = att[..., None] * dpool + de @ self.p["a"].T
        dvec = np.zeros_like(vectors)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, dh = self.p[f"h{d}"], np.zeros((len(y), HIDDEN), np.float32)
            dxs = np.zeros((index.shape[1], len(y), 3 * HIDDEN), np.float32)
            for t in range(index.shape[1] - 1, -1, -1) if d == "f" else range(index.shape[1]):
                h, z, r, new, gn = saved[d, t]
                dh = dh + dboth[t][:, part]
                on = mask[:, t, None]
                dz = dh * on * (h - new) * z * (1 - z)
                dn = dh * on * (1 - z) * (1 - new * new)
                dr = dn * gn * r * (1 - r)
                dx = np.concatenate((dz, dr, dn), axis=1)
                dg = np.concatenate((dz, dr, dn * r), axis=1)
                dxs[t] = dx
                g[f"h{d}"] += h.T @ dg
                dh = dh * (1 - on * (1 - z)) + dg @ u.T
            dproj = _gather(local.T.ravel(), dxs.reshape(-1, 3 * HIDDEN), len(used))
            g[f"b{d}"] = dproj.sum(0)
            g[f"x{d}"] = vectors.T @ dproj
            dvec += dproj @ self.p[f"x{d}"].T
        g["word"] = _gather(x.bucket[ids], dvec[real][:, :DIM] * self.known[x.bucket[ids], None], WORD_BUCKETS)
        chars, _, size = x.chars_of(ids)
        spread = np.repeat(dvec[real][:, DIM:] / np.sqrt(size)[:, None], size, axis=0) * self.common[chars, None]
        g["char"] = _gather(chars, spread, CHAR_BUCKETS)
        return g


def _index(x: Inputs, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(WINDOW)
    mask = k < size[:, None]
    at = np.minimum(first[:, None] + k, max(0, len(x.word) - 1))
    word = x.word[at] if len(x.word) else np.zeros_like(at)
    return np.where(mask, word, len(x.bucket)), mask.astype(np.float32)


def document_logits(net: Network, x: Inputs, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(each row's highest logit, and of all windows: logit, row, first word, length)."""
    row, first, size = x.windows()
    proj = net.project(net.words(x))
    logit = np.concatenate([net.forward(proj, *_index(x, first[k : k + chunk], size[k : k + chunk])) for k in range(0, len(row), chunk)] or [np.zeros(0, np.float32)])
    best = np.full(len(x.count), -np.inf)
    np.maximum.at(best, row, logit)
    return best, logit, row, first, size


class Model:
    """A trained network with its calibration; without a network, one probability for all."""

    def __init__(self, net: Network | None, slope: float, shift: float):
        self.net, self.slope, self.shift = net, slope, shift

    def score(self, column: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(column), self.shift)
        return _sigmoid(np.clip(self.slope * document_logits(self.net, Inputs(column))[0] + self.shift, -30, 30))


def fit(texts: list[str], labels: list[int], rounds: int = 6, seed: int = 11) -> Model:
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return Model(None, 0.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    x, net = Inputs(pa.array(texts)), Network(seed)
    row, first, size = x.windows()
    own = np.flatnonzero(~held[row])
    doc = np.repeat(np.arange(len(y)), x.count)
    keep = ~held[doc]
    word = x.word[keep]
    net.known[:] = _texts_with(doc[keep], x.bucket[word], WORD_BUCKETS) >= 3
    chars, _, size_of = x.chars_of(word)
    net.common[:] = _texts_with(np.repeat(doc[keep], size_of), chars, CHAR_BUCKETS) >= 3
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    t = 0
    for turn in range(max(rounds, -(-STEPS * 128 // max(1, 3 * int((~held).sum()))))):
        logit = rng.standard_normal(len(row))
        if turn:
            proj = net.project(net.words(x))
            logit[own] = np.concatenate([net.forward(proj, *_index(x, first[k], size[k])) for k in np.array_split(own, len(own) // 2048 + 1)])
        order = own[np.lexsort((rng.random(len(own)), logit[own], row[own]))[::-1]]
        rank = np.arange(len(order)) - np.searchsorted(-row[order], -row[order])  # 0: a row's likeliest window
        pick = order[(rank < np.where(y[row[order]] == 1, 1 + (turn == 0), 2))]
        if turn:  # and as many at random, of rows without the label
            rest = own[y[row[own]] == 0]
            pick = np.concatenate((pick, rng.choice(rest, min(len(rest), len(pick) // 2), replace=False)))
        pick = rng.permutation(pick)
        share = y[row[pick]].mean()
        for at in range(0, len(pick), 128):
            some = pick[at : at + 128]
            index, mask = _index(x, first[some], size[some])
            truth = y[row[some]]
            g = net.gradients(x, index, mask, truth, np.where(truth == 1, min(4.0, 0.5 / max(share, 1e-3)), 1.0).astype(np.float32))
            t += 1
            for k, grad in g.items():
                m, v = adam[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[k] -= (0.005 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    pick = held if held.any() else ~held
    best = document_logits(net, Inputs(pa.array([texts[k] for k in np.flatnonzero(pick)])))[0]
    slope, shift = platt(best, y[pick])
    return Model(net, slope, shift)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Only rows whose crc32(doc_id as text) mod 3 isn't 1."""
    return fit(*sample(docs, labels, "toxic", rows, F.crc32(F.col("k").cast("string")) % 3 != 1))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row."""

    def run(batches):
        for b in steps(batches):
            p = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.astype(np.float64)), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    found = id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
