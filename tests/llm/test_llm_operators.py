"""Each operator against a brute-force version, a round trip or held-out accuracy, and on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import bytebpe, components, licenses, media, packing, pii, quality, simhash, spm, substring, token_counts, toxicity, vechash
from ledgerloom.llm.common import ship

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts() -> list[str | None]:
    r = random.Random(5)
    words = ["alpha", "beta,", "Gamma", "délta.", "été", "x", "42", "the", "of", "naïve"]

    def prose(n: int) -> str:
        return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))

    shared, other = prose(70), prose(55)
    long = prose(3000)
    out = [None, "", " \t\n", "one", prose(20), shared, shared, prose(30) + " " + shared + " " + prose(10), prose(9) + "\n" + shared[:-3] + "!", other + " " + shared, long, long, long.replace("alpha", "omega", 1)]
    return [*out, "a\t  b\n\n c " + other, "▁x  y ▁", "Ünï cödé 　wide", "  lead", "trail  ", "same words here " * 30, prose(200) + "\n" + prose(5)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i * 3 % 20, t, "en", "s", len(t or "")) for i, t in enumerate(_texts())]
    rows += [(7, "repeated row", "en", "s", 3), (7, "repeated row", "en", "s", 3), (None, _texts()[5], None, None, None), (None, None, None, None, None)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("fp", "h1", "k", "score", "n_words", "u", "v", "owner", "at", "pos", "g", "media")})
    return clash.cache()


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


def _rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def _bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_words_and_windows():
    texts = ["a bb  ccc", "", "ccc a", " bb ccc a bb "]
    w = vechash.Words(pa.array(texts))
    assert w.count.tolist() == [3, 0, 2, 4]
    h = w.hashes()
    assert h[0] == h[4] == h[7] and h[1] == h[5] == h[8] and len(set(h.tolist())) == 3
    win, at = w.windows(2), w.inside(2)
    assert at.tolist() == [0, 1, 3, 5, 6, 7] and win[0] == win[7] and win[1] == win[5] and win[3] == win[6]


def test_simhash(docs, nothing):
    def fp(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        g = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fp(t)) for i, t in _rows(docs)]
    group = {f: f for _, f in rows}
    for _ in rows:
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    want = Counter((i, f - 2**64 if f >= 2**63 else f, min((j for j, g in rows if group[g] == group[f] and j is not None), default=None)) for i, f in rows)
    assert _bag(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(docs, shingle=3).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for _, _, c in want if c is not None}) and kept.count(None) == 2


def test_links_are_complete(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (1, 2, 3, 3, 4)]
    fps = [x - 2**64 if x >= 2**63 else x for x in {*base, *near, 0, 2**64 - 1}]
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    edges = [(k + 1, k) for k in range(60)] + [(100, 200), (200, 300), (7, 7), (None, 3)] + [(500, 500 + k) for k in range(1, 30)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100, **{500 + k: 500 for k in range(30)}}


def test_substring(docs, nothing):
    rows = _rows(docs)
    first: dict[tuple, int] = {}
    for i, t in sorted((x for x in rows if x[0] is not None)):
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    assert _bag(substring.dedup_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(n for (_, _, lost, _), n in want.items() if lost) >= 4
    assert substring.dedup_digests(nothing).count() == 0
    cut = substring.cut_texts(docs)
    assert cut.columns == docs.columns and cut.count() < docs.count()


def test_difference_cover():
    cover = substring.difference_cover(31)
    assert len(cover) == 6 and {(a - b) % 31 for a in cover for b in cover} == set(range(31))


def test_sentencepiece(docs, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len(sp.encode(t)), ",".join(map(str, sp.encode(t))), sp.decode(sp.encode(t))) for i, t in _rows(docs))
    assert _bag(spm.round_trip(docs, PIECES), "doc_id", "n_tokens", "ids", "decoded") == want
    assert spm.round_trip(nothing, PIECES).count() == 0


def test_chunk_table_is_bounded(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(spm, "TABLE_CHUNKS", 5)
    table = spm.ChunkTable(PIECES)
    for t in _texts():
        assert table.encode(t or "") == (",".join(map(str, sp.encode(t or ""))), sp.decode(sp.encode(t or ""))) and len(table.ids) <= 10


def test_byte_ids(monkeypatch):
    tok = bytebpe.tokenizer(BPE)
    hard = ["don't  stop\n\n  now\t  x", "a. b,c  d&&&. <|endoftext|>", "\x1c \x85y  z", "It's 12.5%  of\r\n it’s", " Été.été,Ça\nñ"]
    for bound in (400_000, 3):
        monkeypatch.setattr(bytebpe, "TABLE_CHUNKS", bound)
        ids = bytebpe.Ids(BPE)
        for t in [x or "" for x in _texts()] + hard:
            assert np.frombuffer(ids.of(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing(docs, nothing):
    got = packing.pack(docs, BPE, size=64, group_docs=8).collect()
    tok, left = bytebpe.tokenizer(BPE), Counter()
    for i, t in _rows(docs):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 64):
            left[i, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == left
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(nothing, BPE).count() == 0


def test_first_fit_decreasing():
    r = random.Random(1)
    sizes = sorted((r.randrange(1, 101) for _ in range(300)), reverse=True)
    room: list[int] = []
    want = []
    for s in sizes:
        k = next((k for k, free in enumerate(room) if free >= s), len(room))
        if k == len(room):
            room.append(100)
        room[k] -= s
        want.append(k)
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_token_counts(docs, nothing):
    tok, want = bytebpe.tokenizer(BPE), Counter()
    for i, t in _rows(docs):
        cuts = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)]
        ends, n, over = [*cuts[1:], len(t)], Counter(), Counter()
        for a, b in tok.encode(t, add_special_tokens=False).offsets:
            held = [max(0, min(b, z) - max(a, y)) for y, z in zip(cuts, ends, strict=True)]
            n[held.index(max(held))] += 1
            over[held.index(max(held))] += sum(h > 0 for h in held) > 1
        for k, (a, b) in enumerate(zip(cuts, ends, strict=True)):
            want[i, k, a, b, n[k], over[k]] += 1
    assert _bag(token_counts.section_counts(docs, BPE), "doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing") == want
    assert token_counts.section_counts(nothing, BPE).count() == 0
    owner, crossing = token_counts.attribute(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 4, 6]), 9)
    assert owner.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, True]


VALUES = [
    "+1 (017) 555-7713", "9807915762804490", "4111111111111111", "4111 1111 1111 1111", "97.51.17.173", "2024-02-29", "31.12.1999", "12/31/2050", "and.34@mail7.example.com", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "123-45-6789",
]


def test_pii(spark, docs, nothing):
    d = spark.createDataFrame([(v,) for v in VALUES], "s string").withColumn("p", pii.pseudonym(F.col("s")))
    for r in d.withColumn("back", pii.pseudonym(F.col("p"), undo=True)).withColumn("other", pii.pseudonym(F.col("s"), key="k2")).collect():
        assert r.back == r.s and r.p != r.s and r.other != r.p
        assert re.sub(r"\d+", "9", r.p.split("@")[0].lower()).count("9") >= 1
    valid = d.select(pii.luhn(F.col("p")).alias("x")).where(F.col("s") == "4111111111111111").first().x
    assert valid == 0
    text = "Call +1 (017) 555-7713, mail and.34@mail7.example.com. Host 97.51.17.173; card 4111111111111111 on 2024-02-29. Not: 999.1.2.3, 2023-02-31, v1.2.3, 12345."
    rows = spark.createDataFrame([(1, text, "a"), (2, "again 4111111111111111!", "b"), (3, None, None), (4, "", "c")], "doc_id long, text string, n string")
    got = {r.doc_id: r for r in pii.pseudonymize(rows).collect()}
    assert not any(v in got[1].text for v in ("555-7713", "and.34@", "97.51.17.173", "4111111111111111", "2024-02-29"))
    assert all(v in got[1].text for v in ("999.1.2.3", "2023-02-31", "v1.2.3", "12345.", "Call +1 (", "@mail7.example.com. Host "))
    card = re.search(r"card (\d{16}) ", got[1].text)[1]
    assert got[2].text == f"again {card}!" and got[2].n_found == 1
    assert (got[3].text, got[3].n_found, got[4].text) == (None, 0, "")
    assert pii.pseudonymize(nothing).count() == 0 and pii.pseudonymize(docs).count() == docs.count()


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert n.select(pii.feistel_text(F.col("s"), "key", [pii.DIGITS]).alias("p")).distinct().count() == 1000


def test_licenses(docs, nothing):
    text = "Licensed under CC BY-NC 4.0. GNU Lesser General Public License, version 3! All rights reserved. Copyright (c) 2020 Some One. All rights reserved; released under the MIT License."
    n, base, first, last, base_labels, labels, score = licenses.scan(text.encode())
    assert (base, base_labels, labels) == (4, "cc-by,gpl,reserved", "cc-by,cc-by-nc-4.0,copyright,gpl,lgpl-3.0,mit,reserved")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    assert (n, first, last) == (len(words), 2, max(k for k in range(n) if words[k : k + 3] == ["all", "rights", "reserved"])) and 0 < score <= 1
    assert licenses.scan(b"copyright a b c d e f g all rights reserved")[5] == "reserved"  # more words than the template lets
    assert licenses.scan(b"") == (0, 0, None, None, "", "", 0.0)
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(nothing).count() == 0


def test_media(docs, nothing):
    def png() -> bytes:
        def chunk(kind: bytes, data: bytes) -> bytes:
            return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")

    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff\x2c\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    blob = b"BM RIFF junk" + png() + b"GIF89a no" + gif + media.wav(b"abc")
    assert [(m.kind, blob[m.offset : m.offset + m.length]) for m in media.sniff(blob)] == [("image/png", png()), ("image/gif", gif), ("audio/wav", media.wav(b"abc"))]
    assert media.inspect(png() + b"tail", "audio/wav")[0] == "image/png" and media.inspect(png()[:-1], "image/jpeg") == ("image/jpeg", [])
    for r in media.media_features(media.store(docs.select("doc_id", "text"))).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and r.media_bytes == r.payload_bytes + 44
    want = Counter()
    for i, t in _rows(docs):
        b = t.encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert _bag(media.media_features(media.store(docs)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert media.media_features(media.store(nothing)).count() == 0


def test_quality(spark, docs, nothing):
    model = quality.fit([], [])
    want = Counter()
    for i, t in _rows(docs):
        w = WORD.findall(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = Counter(three)
        rep = {j for k, x in enumerate(three) if seen[x] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed, not failed] += 1
    assert _bag(quality.score(docs, model), "doc_id", "n_words", *quality.BASE, "base_failed", "kept") == want
    assert quality.score(nothing, model).count() == 0
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if k[-1])


def _labelled(spark, label):
    from ledgerloom.llm.common import id_text, table

    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = id_text(docs).join(labels.select(F.col("doc_id").alias("k"), label), F.col("k") == F.col("doc_id")).select("doc_id", "text", label).collect()
    return docs, labels, rows


def test_quality_held_out(spark):
    docs, labels, rows = _labelled(spark, "quality")
    model = quality.train(docs, labels)
    p = quality.probability(model, vechash.Words(pa.array([r.text for r in rows[-1500:]])))
    truth = np.array([r.quality for r in rows[-1500:]])
    assert ((p >= quality.THRESHOLD) & (truth == 1)).sum() >= 0.98 * (truth == 1).sum()


def test_toxicity_held_out(spark, nothing):
    docs, labels, rows = _labelled(spark, "toxic")
    model = toxicity.train(docs, labels)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    p = model.score(pa.array([r.text for r in held]))
    truth = np.array([r.toxic for r in held])
    assert ((p >= 0.7) & (truth == 1)).sum() >= 0.7 * truth.sum() and ((p >= 0.7) & (truth == 0)).sum() <= 0.03 * (truth == 0).sum()
    got = toxicity.score(docs.limit(5).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and toxicity.score(nothing, model).count() == 0
    assert toxicity.fit([], []).score(pa.array(["x"])).tolist() == [0.0]


def test_gradients():
    """Back-propagation agrees with finite differences."""
    net = toxicity.Network(3)
    net.p["word"] = np.random.default_rng(1).standard_normal(net.p["word"].shape).astype(np.float32) * 0.5
    x = toxicity.Inputs(pa.array(["one two three two", "four one"]))
    _, first, size = x.windows()
    index, mask = toxicity._index(x, first, size)
    y, w = np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)

    def loss() -> float:
        z = net.forward(net.project(net.words(x)), index, mask).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    g = net.gradients(x, index, mask, y, w)
    for name in ("hf", "hb", "xf", "bb", "a", "v", "o", "c", "char"):
        k = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        was, eps = net.p[name][k], 1e-2
        net.p[name][k] = was + eps
        up = loss()
        net.p[name][k] = was - eps
        down = loss()
        net.p[name][k] = was
        assert abs((up - down) / (2 * eps) - g[name][k]) < 0.05 * abs(g[name][k]) + 2e-4, name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {r.doc_id for r in docs.collect()}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == ids and len(ids) > 50
