"""Byte-level BPE ids of whole texts, each distinct chunk segmented once.

The vocabulary's splitting rule never lets a token cross from a character that
isn't white space to one that is, and what a run of white space becomes depends
only on the run and the character after it.  So a text splits into chunks
(white space, then what follows up to the next white space) that encode alone.
The table of chunks is emptied at ``TABLE_CHUNKS`` and long chunks aren't kept.

Added tokens (such as an end-of-text mark) in a text become their own ids, as the
library has it; the texts between them are encoded as texts of their own.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Unicode's White_Space characters.
SPACES = "\t-\r \x85\xa0  -     　"
#: A word of Latin letters before a space, comma, stop or line end is a whole pre-token with the space before it.
CHUNK = re.compile(f" [A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ ,.\\n])|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
WHITE = frozenset(re.findall(f"[{SPACES}]", "".join(map(chr, range(0x3001)))))
TABLE_CHUNKS = 400_000
LONG_CHUNK = 128


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """(what splits a text at added tokens, the ids of each)."""
    found = tokenizer(path).get_added_tokens_decoder()
    for t in found.values():
        if t.lstrip or t.rstrip or t.single_word:
            raise ValueError(f"an added token that looks at its neighbours: {t.content}")
    ids = {t.content: np.array([i], "<u4").tobytes() for i, t in found.items()}
    return (re.compile(f"({'|'.join(map(re.escape, sorted(ids, key=len, reverse=True)))})") if ids else None), ids


@cache
def token_bytes(path: str) -> np.ndarray:
    """The length in bytes of each id's token; the vocabulary writes a byte as one character."""
    tok = tokenizer(path)
    out = np.zeros(tok.get_vocab_size(), np.int64)
    for piece, i in tok.get_vocab().items():
        out[i] = len(piece)
    return out


class Ids:
    def __init__(self, path: str):
        self.tok, self.table, self.width = tokenizer(path), {}, token_bytes(path)
        self.split, self.special = added(path)

    def _divide(self, part: list[str]) -> None:
        """Encode the joined chunks and give each its ids."""
        ids = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(c.encode()) for c in part])
        cuts = (4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
        data, a = ids.tobytes(), 0
        for c, b in zip(part, cuts, strict=True):
            self.table[c] = data[a:b]
            a = b

    def of(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        return b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(self.split.split(text)))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        chunks, table = CHUNK.findall(text), self.table
        new = [c for c in set(chunks) if c not in table]
        rare: list[str] = []
        if new:
            if len(table) + len(new) > TABLE_CHUNKS:
                table.clear()
                new = list(set(chunks))
            # Chunks from white space to something else stay apart when joined: they are encoded together and
            # divided by the bytes that their tokens stand for.
            joined = [c for c in new if c[0] in WHITE and c[-1] not in WHITE]
            for at in range(0, len(joined), 1024):
                self._divide(joined[at : at + 1024])
            alone = [c for c in new if c not in table]
            for at in range(0, len(alone), 4096):
                part = alone[at : at + 4096]
                for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    table[c] = np.array(e.ids, "<u4").tobytes()
            rare = new if len(table) > 2 * TABLE_CHUNKS else [c for c in new if len(c) > LONG_CHUNK]
        out = b"".join(map(table.__getitem__, chunks))
        for c in rare:
            del table[c]
        return out
