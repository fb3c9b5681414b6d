"""Pre-tokens of byte-level BPE as arrays, and a bounded cache of what each pre-token gives.

The split follows the public pattern of byte-level BPE vocabularies (contractions, runs of letters,
of digits and of other signs with one space before them, runs of white space), worked out for all
texts of a slice at once from the classes of their code points; the library is asked for the class of each code point met.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers

from kinelink.llm import words as W

LETTER, NUMBER, SPACE, OTHER = range(4)
_LIBRARY = pre_tokenizers.ByteLevel(add_prefix_space=False)


#: A sign of each class but SPACE: a code point that makes one pre-token with it is of its class.
_SIGNS = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
_UNKNOWN = 255


@cache
def _known() -> np.ndarray:
    return np.full(sys.maxunicode + 1, _UNKNOWN, np.uint8)


def classes_of(points: np.ndarray) -> np.ndarray:
    """Classes of code points as the library tells them, so that both know the same Unicode; each is asked for once in a process."""
    known = _known()
    for c in np.unique(points[known[points] == _UNKNOWN]).tolist():
        known[c] = next((kind for kind, sign in _SIGNS if len(_LIBRARY.pre_tokenize_str(sign + chr(c))) == 1), SPACE)
    return known[points]


def starts_of(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; bounds: code-point offsets of the texts, the end included."""
    n = len(points)
    kind, first = classes_of(points), np.zeros(n + 3, bool)
    first[bounds[bounds < n]] = True
    first[n:] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    joined = np.zeros(n, bool)
    joined[1:] = points[:-1] == 32
    joined &= ~first[:n]
    ahead = np.zeros(n, bool)
    ahead[:-1] = ~blank[1:]
    ahead &= ~first[1 : n + 1]
    start = np.where(blank, change | ahead, change & ~joined)
    marks = np.flatnonzero((points == 39) & start)
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        a, b = padded[marks + 1], padded[marks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~first[marks + 1]
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~first[marks + 1] & ~first[marks + 2]
        for hit, size in ((one, 2), (two, 3)):
            p = marks[hit]
            start[p + 1] = False
            p = p[p + size < n]
            start[p + size] = True
    return np.flatnonzero(start)


class Store:
    """Values by pre-token: ragged ids (or just their counts), at most `most` pre-tokens.

    Pre-tokens are looked up by hash and every one found is compared with the stored bytes.
    """

    def __init__(self, made: Callable[[list[str]], tuple[np.ndarray, np.ndarray | None]], most: int = 1_000_000):
        self.made, self.most = made, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, W.U64)
        self.place = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.data = np.empty(0, np.uint8)
        self.begin = np.zeros(1, np.int64)

    def _append(self, pieces: list[bytes]) -> np.ndarray:
        """Places of new entries."""
        counts, ids = self.made([p.decode() for p in pieces])
        place = len(self.counts) + np.arange(len(pieces))
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(pieces), np.uint8)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        if ids is not None:
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts, dtype=np.int64)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        return place

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the pre-tokens in counts and first; makes those that are missing."""
        if len(self.keys) > self.most:
            self.clear()
        distinct, at, inverse = np.unique(W.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inner = spot < len(self.keys)
        known[inner] = self.keys[spot[inner]] == distinct[inner]
        place = np.empty(len(distinct), np.int64)
        place[known] = self.place[spot[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            place[new] = self._append([data[a:b].tobytes() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            self.keys = np.insert(self.keys, spot[new], distinct[new])
            self.place = np.insert(self.place, spot[new], place[new])
        place, size = place[inverse], ends - starts
        other = np.flatnonzero(size != np.diff(self.begin)[place])
        other = np.union1d(other, np.flatnonzero(~W.equal_spans(data, starts, self.data, self.begin[place], np.minimum(size, np.diff(self.begin)[place]))))
        if len(other):  # another pre-token with the same hash has the place
            pieces = [data[a:b].tobytes() for a, b in zip(starts[other].tolist(), ends[other].tolist())]
            own = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            place[other] = self._append(list(own))[[own[p] for p in pieces]]
        return place

    def ragged(self, places: np.ndarray) -> np.ndarray:
        """The ids of all places, one after the other."""
        counts = self.counts[places].astype(np.int64)
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.first[places] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def split_texts(column: pa.Array, special: dict[str, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, pre-token starts and ends in bytes, first pre-token of each row and the end, special id or -1 of each)."""
    for first, end, data, offsets in W.text_slices(column):
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = np.arange(len(data) + 1) if len(points) == len(data) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        rows = np.searchsorted(begin, offsets)
        cuts, found = rows, []
        for m in regex.finditer("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text) if any(s in text for s in special) else ():
            if np.searchsorted(rows, m.start(), "right") == np.searchsorted(rows, m.end() - 1, "right"):
                found.append((m.start(), m.end(), special[m.group()]))
        if found:
            at, stop, ids = (np.array(x) for x in zip(*found))
            cuts = np.union1d(rows, np.concatenate([at, stop]))
        starts, kinds = starts_of(points, cuts), None
        if found:
            k = np.searchsorted(at, starts, "right") - 1
            starts = starts[(k < 0) | (starts == at[k]) | (starts >= stop[k])]
            k = np.maximum(np.searchsorted(at, starts, "right") - 1, 0)
            kinds = np.where(starts == at[k], ids[k], -1)
        bounds = np.searchsorted(starts, rows)
        starts = begin[starts]
        yield first, end, data, starts, np.append(starts[1:], len(data)), bounds, np.full(len(starts), -1) if kinds is None else kinds


def special_tokens(vocabulary_file: str) -> dict[str, int]:
    """Texts of the file's added tokens and their ids: the library finds them inside texts before it splits.

    Only plain ones are known here: a token that strips or asks for whole words is refused.
    """
    with open(vocabulary_file, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{vocabulary_file} has added tokens with rules besides their text")
    return {t["content"]: t["id"] for t in added}
