"""SentencePiece encoding and decoding by a distinct-chunk table.

The model's pieces hold the white-space marker only at their start, so no piece
crosses from a mark-less character to a marker: a text splits into chunks (a run
of markers and what follows up to the next marker) that encode independently.
Each worker segments a distinct chunk once, keeps its ids in a table, and joins
ids back by position.  The table is emptied at ``TABLE_CHUNKS`` entries and
chunks longer than ``LONG_CHUNK`` aren't kept, so memory is bounded whatever the
text; nothing is left out.  ``crossing_pieces`` checks the condition on a model.

Edge cases: null and empty texts have no ids and decode to the empty text; the
marker itself in a text reads as a space, as the library does; texts without
spaces are one chunk.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_text, steps, texts_of

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_CHUNKS = 300_000
LONG_CHUNK = 256


@cache
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if crossing_pieces(model):
        raise ValueError("pieces of this model cross white-space markers; chunks can't be segmented alone")
    return model


def crossing_pieces(model: sentencepiece.SentencePieceProcessor) -> list[str]:
    """Pieces with a marker after another character, or models that normalise texts first."""
    probe = "  a  b \nﬁé "
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    bad = [p for p in pieces if MARK in p.lstrip(MARK)]
    return bad or ([] if model.decode(model.encode(probe)) == probe else [probe])


class ChunkTable:
    """chunk -> (ids as decimal text, decoded text)."""

    def __init__(self, path: str):
        self.model, self.ids, self.text = _model(path), {}, {}

    def _segment(self, chunks: list[str]) -> dict[str, list[int]]:
        # The library puts one marker before a text itself; a lone marker is an empty text to it.
        out = dict(zip(chunks, self.model.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1), strict=True))
        if MARK in out:
            out[MARK] = [self.model.piece_to_id(MARK)]
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text)."""
        if not text:
            return "", ""
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        ids, table = self.ids, self.text
        new = [c for c in set(chunks) if c not in ids]
        rare = {}
        if new:
            if len(ids) + len(new) > TABLE_CHUNKS:
                ids.clear()
                table.clear()
                new = list(set(chunks))
            for chunk, found in self._segment(new).items():
                # decode() takes one marker off the front of what it gets; a piece before it keeps all.
                out = (",".join(map(str, found)), self.model.decode([*_lead(self.model), *found])[1:])
                ids[chunk], table[chunk] = out
                if len(chunk) > LONG_CHUNK:
                    rare[chunk] = out
            if len(ids) > 2 * TABLE_CHUNKS:  # a text of very many distinct chunks
                rare = dict.fromkeys(ids)
        joined, decoded = ",".join(map(ids.__getitem__, chunks)), "".join(map(table.__getitem__, chunks))
        for chunk in rare:
            del ids[chunk], table[chunk]
        return joined, decoded[1:]


@cache
def chunk_table(path: str) -> ChunkTable:
    """The worker's table: it outlives a task, so a worker segments a distinct chunk once, not once a task."""
    return ChunkTable(path)


@cache
def _lead(model: sentencepiece.SentencePieceProcessor) -> list[int]:
    """A piece whose decoded form is one character."""
    return [model.piece_to_id("a")]


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): encoded as the library does, ids as decimal text joined by commas."""

    def run(batches):
        table = chunk_table(model_path)
        for b in steps(batches):
            got = [table.encode(x) for x in texts_of(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([i.count(",") + 1 if i else 0 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); the digests are taken in the worker, so ids never cross to the JVM."""

    def run(batches):
        table = chunk_table(model_path)
        for b in steps(batches):
            got = [table.encode(x) for x in texts_of(b)]
            sha = [[hashlib.sha256(x[k].encode()).hexdigest() for x in got] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.count(",") + 1 if i else 0 for i, _ in got], pa.int64()), pa.array(sha[0]), pa.array(sha[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
