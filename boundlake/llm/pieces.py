"""SentencePiece ids and texts by a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next one.
Where no piece of the model has a marker after another character and texts are
taken as they are, merges never cross the start of a chunk, so a text's ids are
its chunks' ids in order. Each task keeps a table of the distinct chunks it has
met, segments each of them once, in one library call for all new ones of a batch,
and joins the ids back by position. Models of another kind, whose pieces may cross
markers, segment whole texts.

Null text: as an empty one. Repeated rows are each encoded. Empty table: no
rows. Other columns are not read, so clashing names cannot reach the output.
Ids are binary columns of little-endian unsigned 32-bit numbers, the form that
token files have.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

MARK = "▁"
#: Distinct chunks that a task keeps (about 250 bytes each); beyond that its table starts anew.
MOST_CHUNKS = 1 << 19
#: Longer chunks are segmented with their batch and not kept.
KEPT_CHARS = 64
#: Characters of a text, and tokens of a row, that are worked on at a time.
PART_CHARS, PART_TOKENS = 1 << 20, 1 << 18
#: Bytes of results in an Arrow batch.
OUT_BYTES = 8 << 20

_CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
_BORDER = re.compile(f"[^ {MARK}](?=[ {MARK}])")


class Pieces:
    """A model file, and the table of chunks that were segmented with it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        normal = spec.normalizer_spec
        self.mark_id = self.model.piece_to_id(MARK)
        self.by_chunk = (
            normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
            and not spec.trainer_spec.treat_whitespace_as_suffix and self.mark_id != self.model.unk_id()
            and not any(MARK in x.piece.lstrip(MARK) for x in spec.pieces)
        )
        self.table: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _ids(self, chunks: set[str]) -> dict[str, bytes]:
        """Packed ids of (at least) the given chunks; new ones are segmented together."""
        new = chunks - self.table.keys()
        if len(self.table) + len(new) > MOST_CHUNKS:
            self.table.clear()
            new = chunks
        if not new:
            return self.table
        # The library puts the first marker before a text by itself, but nothing before an empty one.
        order = list(new)
        found = dict(zip(order, map(self._packed, self.model.encode([x[1:] for x in order], num_threads=1))))
        found.update((x, self._packed([self.mark_id])) for x in (" ", MARK) if x in found)
        kept = {k: v for k, v in found.items() if len(k) <= KEPT_CHARS}
        self.table.update(kept)
        return self.table if len(kept) == len(found) else {x: found.get(x) or self.table[x] for x in chunks}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, without begin and end."""
        if not self.by_chunk:
            return [self._packed(x) for x in self.model.encode(texts, num_threads=1)]
        split = [_CHUNK.findall(" " + x) if x else [] for x in texts]
        ids = self._ids(set().union(*split))
        return [b"".join(map(ids.__getitem__, x)) for x in split]

    def encode_long(self, text: str) -> bytes:
        """The same for one text, in parts cut between chunks."""
        if not self.by_chunk or len(text) <= PART_CHARS:
            return self.encode([text])[0]
        out, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + PART_CHARS)
            end = border.end() if border else len(text)
            # A later part starts with a marker of its own, which stands for the one that is put before a text.
            out.append(self.encode([text[at + (at > 0) : end]])[0] if end > at + 1 or at == 0 else self._packed([self.mark_id]))
            at = end
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; long rows in parts cut before pieces that start with a marker."""
        ids = np.frombuffer(packed, "<u4")
        if not self.by_chunk or len(ids) <= PART_TOKENS:
            return self.model.decode(ids.tolist())
        out, at, cuts = [], 0, self._cuts()
        while at < len(ids):
            end = at + PART_TOKENS
            while end < len(ids) and not cuts[ids[end]]:
                end += 1
            # One marker at the start of the ids is dropped, so later parts get one to drop.
            out.append(self.model.decode(([self.mark_id] if at else []) + ids[at:end].tolist()))
            at = end
        return "".join(out)

    @functools.cache  # noqa: B019  one object for each model and worker
    def _cuts(self) -> np.ndarray:
        return np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(self.model.get_piece_size())])


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One model and table for each file and Python worker."""
    return Pieces(path)


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` together; a larger row is a range of its own."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, path: str, begin: bool = False, end: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens) of every row: packed ids of the whole text, with the model's begin and end ids if asked for."""

    def run(batches):
        p = pieces(path)
        head, tail = p._packed([p.model.bos_id()] if begin else []), p._packed([p.model.eos_id()] if end else [])
        for batch in batches:
            column = batch.column(1)
            texts = (column.fill_null("") if column.null_count else column).to_pylist()
            for a, b in _runs([len(x) for x in texts], PART_CHARS):
                found = [p.encode_long(texts[a])] if b == a + 1 else p.encode(texts[a:b])
                found = [head + x + tail for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())], names=[id_col, "ids", "n_tokens"])

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, n_tokens, decoded) of every row of :func:`encode`: the text that the library makes of the ids. Null ids: as none."""

    def run(batches):
        p = pieces(path)
        for batch in batches:
            column = batch.column(1)
            ids = (column.fill_null(b"") if column.null_count else column).to_pylist()
            for a, b in _runs([len(x) for x in ids], OUT_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.decode(x) for x in ids[a:b]], pa.string())], names=[id_col, "ids", "n_tokens", "decoded"])

    ship(encoded.sparkSession)
    return encoded.select(id_col, "ids", "n_tokens").mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, ids binary, n_tokens long, decoded string")
