"""Toxicity scores against a plain forward pass, and texts of megabytes through the real path of each operator."""

from __future__ import annotations

import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from ledgerloom.llm import bytebpe, simhash, spm, token_counts, toxicity
from ledgerloom.llm.common import ship
from ledgerloom.llm.vechash import Words

SF = "/root/testdata/sf0.1"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    docs, labels = (pq.read_table(f"{SF}/{n}.parquet").to_pydict() for n in ("documents", "labels"))
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = [(text[i] or "", t) for i, t in zip(labels["doc_id"], labels["toxic"], strict=True) if i in text and len(text[i] or "") < 5000][:400]
    return toxicity.fit([t for t, _ in rows], [y for _, y in rows])


def _sigmoid(x):
    return 1 / (1 + math.exp(-x))


def _plain_score(model, text):
    """Window by window, word by word, unit by unit."""
    p, net = {k: v.astype(np.float64) for k, v in model.net.p.items()}, model.net
    words = re.findall("[A-Za-z\u0080-\U0010ffff]+", text)
    vectors = []
    for w in words:
        x = toxicity.Inputs(pa.array([w]))
        chars, _, size = x.chars_of(np.array([0]))
        bucket = int(x.bucket[0])
        own = p["word"][bucket] * net.known[bucket]
        vectors.append(np.concatenate((own, sum(p["char"][c] * net.common[c] for c in chars) / math.sqrt(size[0]))))
    size, stride, hidden = toxicity.WINDOW, toxicity.STRIDE, toxicity.HIDDEN
    starts = [0] if len(words) <= size else sorted({*range(0, len(words) - size, stride), len(words) - size})
    best = -math.inf
    for a in starts:
        window, states = vectors[a : a + size], {}
        for d in "fb":
            h, out = [0.0] * hidden, []
            for x in window if d == "f" else window[::-1]:
                gx, gh = x @ p[f"x{d}"] + p[f"b{d}"], np.array(h) @ p[f"h{d}"]
                z = [_sigmoid(gx[j] + gh[j]) for j in range(hidden)]
                r = [_sigmoid(gx[hidden + j] + gh[hidden + j]) for j in range(hidden)]
                new = [math.tanh(gx[2 * hidden + j] + r[j] * gh[2 * hidden + j]) for j in range(hidden)]
                h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(hidden)]
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        both = [np.array(f + b) for f, b in zip(states["f"], states["b"], strict=True)]
        weight = [math.exp(np.tanh(s @ p["a"]) @ p["v"]) for s in both]
        pooled = sum((w * s for w, s in zip(weight, both, strict=True)), np.zeros(2 * hidden)) / max(sum(weight), 1e-9)
        best = max(best, pooled @ p["o"] + p["c"][0])
    return _sigmoid(min(30, max(-30, model.slope * best + model.shift)))


def test_scores_equal_a_plain_forward_pass(model):
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t and len(t) < 1500][:25]
    texts += ["", "one", "1 2 3", "été Ünï wide", "WORD word WoRd", " ".join(["a"] * 24), " ".join(["a"] * 25), " ".join(f"w{chr(97 + k % 26)}x" for k in range(61))]
    got = model.score(pa.array(texts))
    want = np.array([_plain_score(model, t) for t in texts])
    assert np.abs(got - want).max() < 1e-3 and got.std() > 1e-3


def test_a_text_of_ten_megabytes_is_scored_in_all_windows(model):
    """Its score is the highest of its parts', wherever the part lies."""
    plain = "the quick brown fox jumps over a lazy dog and on " * 200_000
    assert len(plain) > 9_000_000
    words = [c for c in map(str, pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()) if len(c) < 3000]
    alone = model.score(pa.array(words[:2000]))
    worst = words[int(alone.argmax())]
    low, late, early = model.score(pa.array([plain, plain + worst, worst + " " + plain]))
    assert alone.max() > 0.5 > low and late >= alone.max() - 0.05 and early >= alone.max() - 0.05


LONG = {"words": "".join(f"word{k % 9973} {'x' * (k % 11)}\n"[: 8 + k % 13] for k in range(250_000)), "one word": "a" * 1_000_000, "spaces": " " * 1_000_000, "lines": "ab\n" * 300_000, "mixed": "Ünï cödé 　wide ▁x\t" * 60_000}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts_through_the_tokenizers(spark, name):
    """Whole texts, equal to the libraries on the whole text."""
    import sentencepiece

    ship(spark)
    text = LONG[name]
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    if name != "one word":  # the library itself takes quadratic time there
        sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        got = {r.doc_id: r for r in spm.round_trip(docs, PIECES).collect()}[1]
        ids = sp.encode(text)
        assert (got.n_tokens, got.ids, got.decoded) == (len(ids), ",".join(map(str, ids)), sp.decode(ids))
    if name in ("words", "mixed", "spaces"):
        counts = token_counts.section_counts(docs, BPE).filter("doc_id = 1").selectExpr("sum(n_tokens)", "max(end_char)").first()
        assert tuple(counts) == (len(bytebpe.tokenizer(BPE).encode(text, add_special_tokens=False).ids), len(text))


def test_long_texts_through_fingerprints(spark):
    ship(spark)
    rows = [(k, t) for k, t in enumerate(LONG.values())] + [(9, LONG["words"] + " end")]
    got = {r.doc_id: r.fp for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    w = Words(pa.array([LONG["lines"]]))
    h = xxhash.xxh64_intdigest(b"ab ab ab", 42)
    assert w.count[0] == 300_000 and got[list(LONG).index("lines")] % 2**64 == h and bin((got[0] ^ got[9]) % 2**64).count("1") <= 3
