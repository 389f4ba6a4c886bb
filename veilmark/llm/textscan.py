"""Vectorised text scanning over Arrow string columns.

Everything here works on the UTF-8 buffer of a whole Arrow column at once:
words are runs of bytes accepted by a 256-entry table, their hashes come from
prefix sums of a byte polynomial, and k-word grams are folded from word
hashes.  Multi-byte characters consist only of bytes >= 0x80, so byte classes
that accept or refuse all of them agree with code-point classes.

A null text counts as empty.  Texts are scanned whole; ``pieces`` cuts a batch
between texts, never inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that one numpy pass takes, unless a single text is longer.
PIECE_BYTES = 2_000_000

_SEED = np.random.default_rng(20240613)
_BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = _BYTE_CODE[_LOWER]  # A-Z and a-z share a code
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}

#: word bytes of the "not ASCII white space" class.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: word bytes of the "letters, digits and everything beyond ASCII" class.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    up, down = _POWERS["up"][:n], _POWERS["down"][:n]
    if n > 4 * PIECE_BYTES:  # not worth keeping for one very long text
        _POWERS.clear()
    return up, down


def pieces(batch: pa.RecordBatch, column: str = "text", piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into the bytes) of runs of whole texts."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece_bytes, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of the table's bytes inside a text."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True  # a text's first byte never continues the text before it
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 words have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = mix(hashes[:n] + np.uint64(k))
    for t in range(1, k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[t : t + n])
    return out


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Position of each row's first word, and the number of words at the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def row_shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct k-word shingle hashes); fewer words than k make one shingle, none make none."""
    every = grams(hashes, k)
    for row in range(len(bounds) - 1):
        a, b = int(bounds[row]), int(bounds[row + 1])
        if b - a >= k:
            yield row, np.unique(every[a : b - k + 1])
        elif b > a:
            yield row, grams(hashes[a:b], b - a)
        else:
            yield row, every[:0]
