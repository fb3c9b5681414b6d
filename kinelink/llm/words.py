"""Vectorised words and window hashes over the UTF-8 bytes of many texts at once.

A slice of texts is one byte array with offsets (the layout of an Arrow string column). Words are
runs of bytes that a 256-entry table marks; no word crosses a text. A word's hash goes through its bytes
eight at a time, with a full mix after each eight (words above `LONG` bytes by XXH64), and depends on the
word and a key alone. Without a key anyone can look for words of equal hash; where equal hashes stand for equal words,
the key is drawn for each run (`secret`), so that texts cannot be made to meet in it and words meet by chance only. Within
one slice words can be told apart exactly, by number (`numbered`), and so can windows (`window_names`). A
window's hash mixes the hashes of its two halves, so no sum of powers and no structure of a text meets in it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20
#: Words above so many bytes are hashed and compared one by one.
LONG = 64

#: Words are separated by space and \\t \\n \\v \\f \\r only.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of digits, a-z and everything beyond ASCII (text is folded first).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Lower-cases A-Z and nothing else.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD_BYTES = FOLD.tobytes()
SPACES = b" \t\n\x0b\x0c\r"


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `size` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers, n = column.buffers(), len(column)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, index of the first word of each text and the count at the end)."""
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = table[data]
    other = np.empty(n, bool)
    other[0], other[1:] = False, word[:-1]
    other[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~other)
    other[-1], other[:-1] = False, word[1:]
    other[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~other) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros beyond the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))


def secret() -> int:
    """A key for one run's hashes."""
    return int.from_bytes(os.urandom(8), "little")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes and length under the key."""
    size, eight = ends - starts, eights(data)
    out = mix(mix(size.astype(U64) * _ODD + U64(key)) ^ (eight[starts] & _LOW[np.minimum(size, 8)]))
    at = np.flatnonzero(size > 8)
    for back in range(8, LONG, 8):
        at = at[size[at] > back]
        if not len(at):
            return out
        out[at] = mix(out[at] * _ODD ^ (eight[starts[at] + back] & _LOW[np.minimum(size[at] - back, 8)]))
    for i in at[size[at] > LONG].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), key)
    return out


def numbered(texts: list[list[bytes]], numbers: dict[bytes, int] | None = None) -> np.ndarray:
    """The words of the texts, one after the other, by number: equal words and no others have equal numbers."""
    numbers = {} if numbers is None else numbers
    return np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64, sum(map(len, texts)))


def window_names(numbers: np.ndarray, k: int) -> np.ndarray:
    """A number for numbers[i:i+k] for every i: equal windows and no others have equal numbers."""
    if len(numbers) < k:
        return np.empty(0, np.int64)
    span, out = 1, numbers
    while span < k:
        move = min(span, k - span)
        out = np.unique(out[:-move] * (int(out.max()) + 1) + out[move:], return_inverse=True)[1]
        span += move
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes of a from each place are those of b from its place."""
    out, ea, eb = np.ones(len(size), bool), eights(a), eights(b)
    at = np.flatnonzero(size > 0)
    for back in range(0, LONG, 8):
        at = at[size[at] > back]
        if not len(at):
            return out
        out[at] &= ((ea[a_starts[at] + back] ^ eb[b_starts[at] + back]) & _LOW[np.minimum(size[at] - back, 8)]) == 0
    for i in at[size[at] > LONG].tolist():
        out[i] &= a[a_starts[i] : a_starts[i] + size[i]].tobytes() == b[b_starts[i] : b_starts[i] + size[i]].tobytes()
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i with k words from there, whatever text they are in."""
    if len(words) < k:
        return np.empty(0, U64)
    span, out = 1, words
    while span < k:
        move = min(span, k - span)
        out = mix(out[:-move] * _ODD + out[move:])
        span += move
    return out


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether the k words from i on lie in one text, for i in range(n - k + 1)."""
    m = n - k + 1
    if m <= 0:
        return np.empty(0, bool)
    end = np.repeat(bounds[1:], np.diff(bounds))
    return end[:m] >= np.arange(k, n + 1)


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in any span [start, start + length)."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.asarray(starts) + length, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of `width` values."""
    span, out = 1, values
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[:-rest], out[rest:]) if rest else out
