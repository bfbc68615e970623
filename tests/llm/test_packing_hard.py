"""Packing: special tokens as the library has them, fill on whole documents, repeated rows and null ids."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from ledgerloom.llm import bytebpe, packing, token_counts
from ledgerloom.llm.common import ship
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"


def test_ids_are_the_untouched_librarys():
    tok, ids, r = Tokenizer.from_file(BPE), bytebpe.Ids(BPE), random.Random(6)
    hard = [MARK, "x" + MARK, MARK * 3, f"a {MARK} b", f"a  {MARK}\n\n {MARK}z", "<|endoftext|", f"<|<|endoftext|>{MARK[:-1]}", f" {MARK} ", f"tab\t\t{MARK}\t\tend  "]
    bits = [" ", "  ", "\n", "\t", MARK, "word", "Été", ",", ".", "<|", "|>", "12", "'s", " ", "　", "x"]
    hard += ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    for t in hard:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_special_tokens_in_counts_and_pieces(spark):
    ship(spark)
    tok, text = Tokenizer.from_file(BPE), f"one two{MARK}three\nfour {MARK}\n{MARK}"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    n = len(tok.encode(text, add_special_tokens=False).ids)
    assert sum(r.n_tokens for r in token_counts.section_counts(docs, BPE).collect()) == n
    row = packing.pack(docs, BPE).first()
    assert (row.length, row.ids_crc32) == (n + 1, zlib.crc32(np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()))


def test_fill_of_whole_documents(spark):
    """Over 99 % of the room is used with the query's parameters."""
    ship(spark)
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), BPE, size=2048, group_docs=4096).collect()
    used, places = Counter(), {}
    for r in got:
        used[r.sequence_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.99
    for parts in places.values():
        assert [a for a, _ in sorted(parts)] == np.concatenate(([0], np.cumsum([n for _, n in sorted(parts)])[:-1])).tolist()


def test_one_key_isnt_one_partition(spark):
    """Rows with one doc_id, or none, and one text are dealt over partitions, and nothing is lost."""
    ship(spark)
    docs = spark.createDataFrame([(7, "same text")] * 400 + [(None, "same text")] * 400 + [(None, None)] * 200, "doc_id long, text string").repartition(2)
    found = packing.pack(docs, BPE, size=64, group_docs=16)
    assert Counter(r.doc_id for r in found.collect()) == {7: 400, None: 600}
    dealt = packing.pieces(docs, BPE, 64).selectExpr("xxhash64(doc_id, start, ids_crc32, doc_tokens, nth) as deal").distinct().count()
    assert dealt >= 500


def test_one_long_document(spark):
    """A text of many more pieces than a group holds."""
    ship(spark)
    docs = spark.createDataFrame([(1, "ab " * 300_000), (2, "x")], "doc_id long, text string")
    got = packing.pack(docs, BPE, size=64, group_docs=32).collect()
    own = sorted((r.start, r.length) for r in got if r.doc_id == 1)
    assert len(own) > 4000 and [a for a, _ in own] == np.concatenate(([0], np.cumsum([n for _, n in own])[:-1])).tolist()
    assert {r.doc_tokens for r in got if r.doc_id == 1} == {sum(n for _, n in own)}
