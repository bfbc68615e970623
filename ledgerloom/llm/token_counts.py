"""Token counts of a document's sections by offsets.

A whole document is encoded once.  Each id's byte length gives the tokens' byte
spans, and a count of lead bytes turns them into character spans.  Sections are
intervals of characters that tile the document; a sorted interval join puts each
token span into the section that it starts in, and finds the tokens that reach
into later ones.  Rule for those: a token belongs to the section with most of
its characters, the earliest of equals.

Edge cases: a null or empty text is one empty section without tokens; a token
that is part of a character covers that character; empty lines are sections of
their line end alone; repeated rows are counted each; a null doc_id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import Ids, token_bytes
from .common import id_text, steps, texts_of


def char_spans(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of the given byte lengths over UTF-8 ``data``."""
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Where each section starts: 0 and after each line end; the last closes at the text's end."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses into another) for sections that tile [0, size)."""
    first = np.searchsorted(sections, start, side="right") - 1
    last = np.searchsorted(sections, end - 1, side="right") - 1
    owner = first.copy()
    close = np.append(sections[1:], size)
    for k in np.flatnonzero(last > first):  # few: only tokens over a boundary
        s = np.arange(first[k], last[k] + 1)
        held = np.minimum(close[s], end[k]) - np.maximum(sections[s], start[k])
        owner[k] = s[int(np.argmax(held))]
    return owner, last > first


def section_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing): a row per line of each document.

    ``n_tokens`` add up to the document's tokens; ``n_crossing`` are those of them that reach over a boundary.
    """

    def run(batches):
        ids, size_of = Ids(vocabulary), token_bytes(vocabulary)
        for b in steps(batches):
            parts = []
            for k, text in enumerate(texts_of(b)):
                found = np.frombuffer(ids.of(text), "<u4")
                cuts = line_sections(text)
                n, over = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
                if len(found):
                    start, end = char_spans(np.frombuffer(text.encode(), np.uint8), size_of[found])
                    owner, crossing = attribute(start, end, cuts, len(text))
                    n, over = np.bincount(owner, minlength=len(cuts)), np.bincount(owner[crossing], minlength=len(cuts))
                parts.append((np.full(len(cuts), k), np.arange(len(cuts)), cuts, np.append(cuts[1:], len(text)), n, over))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0])), *(pa.array(c.astype(np.int64)) for c in cols[1:])], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long")
