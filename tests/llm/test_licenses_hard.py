"""Licenses: base places against brute force on documents, whole wordings with every mandatory word, and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from ledgerloom.llm import licenses
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _base(text):
    words = WORD.findall(_lower(text or ""))
    hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


def test_base_places_equal_brute_force(spark):
    ship(spark)
    extra = [None, "", "ALL  RIGHTS--reserved all rights reserved", "cc by cc by cc", "general public license general public", "all rights", "É cc by é", "reserved all rights reserved all rights"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(extra)] + [(-1, None)], docs.schema)).withColumn("n_words", F.lit("clash"))
    want = Counter((r.doc_id, *_base(r.text)) for r in docs.collect())
    got = licenses.license_scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert sum(n for k, n in want.items() if k[2]) > 20 and all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def _plain(template: str) -> str:
    """The template with its optional regions and a short name for replaceable words."""
    return re.sub(r"<<any:\d+>>", "The Example Authors", re.sub(r"<</?o>>", "", template))


def _labels(text: str) -> set[str]:
    return set(filter(None, licenses.scan(text.encode())[5].split(",")))


@pytest.mark.parametrize("label", sorted(licenses.WHOLE))
def test_whole_wordings(label):
    template = licenses.WHOLE[label]
    whole, bare = _plain(template), re.sub(r"<<o>>.*?<</o>>", " ", template, flags=re.S).replace("<<any:6>>", "X").replace("<<any:8>>", "X Y").replace("<<any:10>>", "X")
    for text in (whole, bare, "Copyright 2020 Some One\n\n# " + whole.replace("\n", "\n# ") + "\nmore", whole.upper()):
        assert label in _labels(text)
    must = re.sub(r"<<o>>.*?<</o>>|<<any:\d+>>", " | ", template, flags=re.S)
    words = [m for m in re.finditer(r"[A-Za-z0-9]+", must)]
    for m in words[:: max(1, len(words) // 40)] + words[-1:]:
        for other in ("", "changed"):
            if other or m is not words[-1]:
                changed = must[: m.start()] + other + must[m.end() :]
                assert label not in _labels(changed.replace("|", "X"))
    last = words[-1]
    assert label not in _labels(must[: last.start()].replace("|", "X"))


def test_versions_and_clauses():
    assert _labels("Licensed under the Apache License, Version 1.1") == set() and "apache-2.0" in _labels("Licensed under the Apache License, Version 2.0")
    three, two = (_plain(licenses.WHOLE[f"bsd-{n}-clause"]) for n in (3, 2))
    assert _labels(three) == {"bsd-3-clause"} and _labels(two) == {"bsd-2-clause"}
    assert _labels(_plain(licenses.MIT)) == set()
    long = " ".join(["name"] * 9)
    assert _labels(licenses.WHOLE["bsd-2-clause"].replace("<<any:8>>", long).replace("<<o>>", "").replace("<</o>>", "")) == set()


def test_long_texts():
    text = ("this software is provided permission is hereby granted all rights reserved " * 20_000).encode()
    n, base, first, last, *_ = licenses.scan(text)
    assert (n, base, first, last) == (11 * 20_000, 20_000, 8, 11 * 20_000 - 3)


def _ends(parts, words, at, k=0, used=0):
    """All places where a template can end, tried part by part."""
    if k == len(parts):
        return {at}
    part, found = parts[k], set()
    if part == "<<o>>":
        depth, z = 1, k + 1
        while depth:
            depth += (parts[z] == "<<o>>") - (parts[z] == "<</o>>")
            z += 1
        return _ends(parts, words, at, k + 1) | _ends(parts, words, at, z)
    if part == "<</o>>":
        return _ends(parts, words, at, k + 1)
    if part.startswith("<<any"):
        if used:
            found |= _ends(parts, words, at, k + 1)
        if used < int(part[6:-2]) and at < len(words):
            found |= _ends(parts, words, at + 1, k, used + 1)
        return found
    return _ends(parts, words, at + 1, k + 1) if at < len(words) and words[at] == part else set()


def _brute(text):
    """(labels, score) by trying every template at every word."""
    words = [w.encode().decode(errors="replace") for w in WORD.findall(_lower(text))]
    made = [(p, label) for p, label in licenses.BASE.items()] + [(t, label) for label, ts in licenses.REFERENCES.items() for t in ts] + list((t, label) for label, t in licenses.WHOLE.items())
    labels, inside = set(), set()
    for template, label in made:
        parts = licenses.MARKUP.findall(template.lower())
        starts = {parts[0]} if not parts[0].startswith("<<") else set(words)
        for k, w in enumerate(words):
            if w in starts and (ends := _ends(parts, words, k)) and max(ends) > k:
                labels.add(label)
                inside.update(range(k, max(ends)))
    return ",".join(sorted(labels)), len(inside) / len(words) if words else 0.0


def test_labels_and_scores_equal_brute_force():
    """Documents with a license line, whole wordings, references in pieces and out of order."""
    r = random.Random(8)
    docs = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if re.search("licen[sc]e|reserved|cc.by", t or "", re.I)]
    refs = [_plain(t) for ts in licenses.REFERENCES.values() for t in ts]
    wholes = [_plain(t) for t in licenses.WHOLE.values()]
    made = [" ".join(r.choice([*refs, "gnu", "version 3", "the mit license", "cc by", "all rights reserved", "x", "copyright"]) for _ in range(8)) for _ in range(150)]
    made += [w + " and " + r.choice(refs) for w in wholes] + [w[: len(w) // 2] + r.choice(wholes) for w in wholes]
    seen = set()
    for text in docs[:150] + made:
        *_, labels, score = licenses.scan(text.encode())
        assert (labels, round(score, 12)) == (_brute(text)[0], round(_brute(text)[1], 12)), text[:200]
        seen |= set(labels.split(","))
    assert seen >= set(licenses.WHOLE) | set(licenses.REFERENCES) | set(licenses.BASE.values())


def test_gnu_licenses_are_told_apart():
    for name, version, label in (("General", "3", "gpl-3.0"), ("General", "2", "gpl-2.0"), ("Lesser General", "3", "lgpl-3.0"), ("Lesser General", "2.1", "lgpl-2.1"), ("Affero General", "3", "agpl-3.0")):
        assert _labels(f"GNU {name} Public License, version {version}") == {"gpl", label}
    assert _labels("GNU Lesser General Public License version 2") == {"gpl"} and _labels("Creative Commons Attribution-ShareAlike 4.0 International License") == {"cc-by-sa-4.0"}
