"""Whole-batch text primitives on UTF-8 byte buffers (numpy, no per-word loop)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text that one step works on; a single longer document is one step.
STEP_BYTES = 2 << 20
#: Bytes hashed at a time inside a step, which bounds the wide temporaries.
HASH_BYTES = 1 << 18

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values; ranges are inclusive."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: A byte of a word when words are separated by ASCII white space.
NON_SPACE = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: A byte of a word when words are ASCII letters and digits and all non-ASCII.
ALNUM_HIGH = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, none of them empty."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def gathered(batches, column: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until a column holds about ``limit`` bytes."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the number of words in each row."""
    mask = is_word[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True  # words do not run on into the next row
    before = np.empty_like(mask)
    before[:1] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    after = np.empty_like(mask)
    after[-1:] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, HASH_BYTES + 4096)
        for key, base in (("p", _P), ("q", _PINV)):
            table = np.full(size, base, _U)
            table[0] = 1
            _POWERS[key] = np.multiply.accumulate(table)
    return _POWERS["p"], _POWERS["q"]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes (polynomial modulo 2**64, then mixed).

    Two different words share a hash with a chance of about 2**-64, so counts
    by hash equal counts by word for any realistic vocabulary.
    """
    out = np.empty(len(starts), _U)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + HASH_BYTES, side="right")), first + 1)
        piece = raw[base : int(ends[last - 1])]
        p, q = _powers(len(piece) + 1)
        total = np.empty(len(piece) + 1, _U)
        total[0] = 0
        np.cumsum((piece.astype(_U) + _U(1)) * p[: len(piece)], out=total[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[e] - total[s]) * q[s] + (e - s).astype(_U)
        first = last
    return mix(out)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under light compression."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for x in arrays:
        x = np.ascontiguousarray(x)
        if x.dtype == np.int64 and (not len(x) or x.min() >= 0):
            top = int(x.max()) if len(x) else 0
            x = x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        parts.append(x.dtype.str.encode().ljust(8) + np.array([len(x)], np.int64).tobytes())
        parts.append(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        dtype, n = np.dtype(raw[at : at + 8].strip().decode()), int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        at += 16
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += size
    return out
