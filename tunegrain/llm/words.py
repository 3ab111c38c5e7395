"""Vectorised helpers over whole texts inside Arrow tasks: bytes, word hashes, shingles, segment reductions."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
WORDS_PER_SHINGLE = 5

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = values ^ (values >> U64(30))
        z = z * U64(0xBF58476D1CE4E5B9)
        z ^= z >> U64(27)
        z *= U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def byte_codes() -> np.ndarray:
    """A fixed random 64-bit code per byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(_MULTIPLIER))


EXACT = byte_codes()
#: Bytes with A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: Byte classes: what separates words (space and 0x09 to 0x0D).
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters: ASCII letters and every byte of a longer UTF-8 sequence.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, so later tasks find what earlier ones built.

    The package is pickled by value; its own globals are new in every task.
    """
    return sys.modules.setdefault("_tunegrain_worker_store", {})  # type: ignore[arg-type]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone and whole."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that do not cross a row's border."""
    before = np.empty_like(inside)
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[:-1]
    before[borders[borders < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:-1] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


#: Spans of more bytes are hashed by a cryptographic function, one by one.
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal contents wherever they stand. ``fold`` replaces each element first.

    Eight bytes at a time are mixed into the hash so far, all spans at once. No sum of powers stands behind it,
    under which regular words of equal letters could meet.
    """
    plain = np.ascontiguousarray(data if fold is None else fold[data])
    sizes = ends - starts
    held = mix(sizes.astype(U64) + U64((1 + seed) * _MULTIPLIER % (1 << 64)))
    size = plain.itemsize
    step = 8 // size
    loads = np.ndarray(len(plain) + 1, dtype="<u8", buffer=np.concatenate([plain, np.zeros(step, plain.dtype)]), strides=(size,))
    rows, done = np.flatnonzero(sizes > 0), 0
    while len(rows) and done * size < LONG_SPAN:
        bits = np.minimum(sizes[rows] - done, step) * (8 * size)
        chunk = loads[starts[rows] + done] & (~U64(0) >> (64 - bits).astype(U64))
        held[rows] = mix(held[rows] ^ chunk)
        done += step
        rows = rows[sizes[rows] > done]
    for i in rows.tolist():
        digest = hashlib.blake2b(plain[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        held[i] = int.from_bytes(digest.digest(), "little")
    return held


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and for each row where its words begin (one more at the end)."""
    starts, ends = runs(~SEPARATOR[data], offsets)
    return span_hashes(data, starts, ends, FOLDED), np.searchsorted(starts, offsets)


def word_shingles(hashes: np.ndarray, first: np.ndarray, size: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the row of each, repeats included; a row with fewer words has one, of all its words."""
    counts = np.diff(first)
    row_of_word = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        whole = max(0, len(hashes) - size + 1)
        rolled = np.zeros(whole, dtype=U64)
        for i in range(size):
            rolled += hashes[i : i + whole] * U64(pow(_MULTIPLIER, 2 * i + 3, 1 << 64))
        fits = row_of_word[:whole] == row_of_word[size - 1 : size - 1 + whole] if whole else np.zeros(0, dtype=bool)
        rolled, owner = mix(rolled[fits]), row_of_word[:whole][fits]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            folded = np.zeros(len(short), dtype=U64)
            for i in range(size - 1):
                has = counts[short] > i
                folded[has] += hashes[first[short[has]] + i] * U64(pow(_MULTIPLIER, 2 * i + 3, 1 << 64))
            folded = mix(folded + counts[short].astype(U64))
            rolled, owner = np.concatenate([rolled, folded]), np.concatenate([owner, short])
    return rolled, owner


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in ascending order, and where each row's begin."""
    hashes, owner = word_shingles(*word_hashes(data, offsets))
    order = np.lexsort((hashes, owner)) if len(offsets) > 2 else np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's run of ``values``; empty runs give 0."""
    total = np.zeros(len(values) + 1, dtype=np.result_type(values.dtype, np.int64) if values.dtype.kind in "bi" else values.dtype)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[first[1:]] - total[first[:-1]]


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)


def binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary cell per row with the bytes of its run of ``values``."""
    width = values.dtype.itemsize
    ends = np.asarray(first, dtype=np.int64) * width
    data = np.ascontiguousarray(values)
    if ends[-1] - ends[0] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
