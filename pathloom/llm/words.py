"""Words and n-grams of Arrow string columns as hashed numpy arrays.

Texts are handled as UTF-8 bytes a megabyte or so at a time (a longer text is
one piece), so memory follows the longest text, never the batch. All separators
are ASCII, which makes byte-wise splitting exact for UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
LONG = 256
U = np.uint64

#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space x20 and x09-x0D ends a word.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: After lowering, only 0-9, a-z and non-ASCII bytes belong to a word.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes padded by 8, offsets) of runs of rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        own = np.zeros(offsets[end] - offsets[row] + 8, np.uint8)
        own[:-8] = data[offsets[row] : offsets[end]]
        yield row, own, offsets[row : end + 1] - offsets[row]
        row = end


def spans(own: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; ``ends`` marks the bytes outside words."""
    inside = np.zeros(len(own) - 6, bool)  # a gap before and after
    inside[1:-1] = ~ends[own[:-8]]
    fresh = np.zeros(len(own) - 7, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def hashes(own: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    at = np.ndarray((len(own) - 7,), "<u8", own, strides=(1,))
    sizes = stops - starts
    out = np.zeros(len(starts), U)
    left = np.arange(len(starts))
    for i in np.flatnonzero(sizes > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(own[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    left = left[sizes <= LONG]
    done = 0
    while left.size:
        rest = np.minimum(sizes[left] - done, 8).astype(U)
        mask = np.where(rest == 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (U(8) * (rest % U(8)))) - U(1))
        out[left] = mix(out[left] * U(0x9E3779B97F4A7C15) + (at[starts[left] + done] & mask) + sizes[left].astype(U))
        done += 8
        left = left[sizes[left] > done]
    return out


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, sorted; a row of fewer words has its whole sequence as one."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U)
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[firsts, len(rows)])
    n = max(0, len(words) - k + 1)
    whole = rows[:n] == rows[k - 1 : k - 1 + n]
    total = np.zeros(n, U)
    for i in range(k):
        total = total * U(0x9E3779B97F4A7C15) + words[i : i + n]
    row, sh = rows[:n][whole], mix(total[whole])
    for length in range(1, k):
        short = firsts[counts == length]
        if short.size:
            total = np.full(short.size, U(0x51ED270B * length))
            for i in range(length):
                total = total * U(0x9E3779B97F4A7C15) + words[short + i]
            row, sh = np.r_[row, rows[short]], np.r_[sh, mix(total + U(length))]
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])] if len(row) else np.zeros(0, bool)
    return row[keep], sh[keep]


def word_hash(text: str) -> np.uint64:
    own = np.zeros(len(text.encode()) + 8, np.uint8)
    own[:-8] = np.frombuffer(text.encode(), np.uint8)
    return hashes(own, np.array([0]), np.array([len(own) - 8]))[0]
