"""What the classifiers do on rows that they weren't trained on, both ways; and texts of any length."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from ledgerloom.llm import quality, toxicity, vechash

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    docs, labels = (pq.read_table(f"{SF}/{n}.parquet").to_pydict() for n in ("documents", "labels"))
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    return [(i, text[i] or "", q, t) for i, q, t in zip(labels["doc_id"], labels["quality"], labels["toxic"], strict=True) if i in text]


def test_quality_of_rows_not_trained_on(labelled):
    """Good rows stay, and bad rows that pass the base rules are rejected by the model."""
    order = sorted(labelled, key=lambda r: zlib.crc32(b"%d" % r[0]))
    own, rest = [r for r in order if len(r[1]) <= 20_000][: quality.TRAIN_ROWS], order[quality.TRAIN_ROWS :]
    ids = {r[0] for r in own}
    rest = [r for r in rest if r[0] not in ids]
    model = quality.fit([r[1] for r in own], [r[2] for r in own])
    out = quality.judge(pa.RecordBatch.from_pydict({"text": [r[1] for r in rest]}), model, quality.THRESHOLD)
    good, passed = np.array([r[2] for r in rest]) == 1, ~out["base_failed"]
    assert (good & passed).sum() > 1500 and (~good & passed).sum() > 100
    assert out["kept"][good & passed].mean() >= 0.98
    assert 1 - out["kept"][~good & passed].mean() >= 0.95


def test_toxicity_of_rows_not_trained_on(labelled):
    held = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    own = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 3 != 1 and len(r[1]) <= 20_000][: toxicity.TRAIN_ROWS]
    model = toxicity.fit([r[1] for r in own], [r[3] for r in own])
    p, truth = model.score(pa.array([r[1] for r in held])) >= 0.7, np.array([r[3] for r in held]) == 1
    assert p[truth].mean() >= 0.75 and p[~truth].mean() <= 0.03


def test_blocks_change_no_hash(monkeypatch):
    """Hashes of words and windows don't depend on the block size, so a long text needs no long array."""
    texts = pa.array(["one two  three", "", "été three one two", " ".join(f"w{k % 7}" for k in range(200)), None, "x"])
    want = [(vechash.Words(texts).hashes(f), vechash.Words(texts).windows(3, f)) for f in (0, 1)]
    grams = {}
    for block in (1 << 20, 16, 7):
        vechash.powers.cache_clear()
        monkeypatch.setattr(vechash, "BLOCK", block)
        monkeypatch.setattr(quality, "BLOCK", block)
        w = vechash.Words(texts)
        for f in (0, 1):
            assert (w.hashes(f) == want[f][0]).all() and (w.windows(3, f) == want[f][1]).all()
        total = np.zeros((6, quality.BUCKETS))
        for bucket, row, _ in quality.grams(w):
            np.add.at(total, (row, bucket), 1)
        grams[block] = total
    vechash.powers.cache_clear()
    assert (grams[1 << 20] == grams[16]).all() and (grams[16] == grams[7]).all()
    assert (want[0][0][0] == want[0][0][5]) and len(set(want[0][0].tolist())) == 4 + 7 + 1 - 0


def test_long_texts_are_judged():
    text = "the quick brown fox " * 400_000
    out = quality.judge(pa.RecordBatch.from_pydict({"text": [text, "", None]}), quality.fit([], []), quality.THRESHOLD)
    assert out["n_words"].tolist() == [1_600_000, 0, 0] and out["n_repeat_words"].tolist() == [1_600_000, 0, 0] and out["base_failed"].tolist() == [True, True, True]
    assert toxicity.fit([], []).score(pa.array([text])).tolist() == [0.0]


def test_fitting_holds_one_matrix():
    """The driver's memory while it fits: the training matrix once, not a square or a part of it beside it."""
    r = random.Random(3)
    texts = [" ".join(("good", "bad")[k % 3 == 0] + str(r.randrange(400)) for _ in range(60)) for k in range(400)]
    tracemalloc.start()
    try:
        model = quality.fit(texts, [int(k % 3 > 0) for k in range(400)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * 400 * quality.BUCKETS * 4
    p = quality.probability(model, vechash.Words(pa.array(texts)))
    assert all((x > 0.5) == (k % 3 > 0) for k, x in enumerate(p))
