"""Operator 12: runs of repeating words, found exactly by recompression.

A run is a stretch of consecutive words with smallest period q, of at least max(MIN_WORDS, MIN_REPEATS * q) words,
that no neighbouring word extends with period q. The texts of a slice, numbered word by word
(equal bytes, equal number) and parted by symbols that occur once, are one string, and one run-length grammar is
built for it (`recompression`). In a run of period q the places whose word equals the one q further on are
a stretch of (MIN_REPEATS - 1) * q or more, so it holds a place of the grid 0, g, 2g, ... with g = (MIN_REPEATS - 1) * q:
all grids together have about n log n / (MIN_REPEATS - 1) places. Those that repeat their word are extended to both
sides by the grammar, which gives maximal stretches; of equal stretches the smallest period is the run's.

Words are runs of anything but ASCII white space. Nulls: a null text has no words; a null id is passed on, and is not among the ids
whose text `rewritten` changes. Empty texts give no runs. Rows that repeat get equal answers. A text of any
length is looked at whole, in memory that is a small multiple of it. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelink.llm import words as W
from kinelink.llm.recompression import Grammar
from kinelink.llm.tables import row_slices

MIN_WORDS = 6
MIN_REPEATS = 4
SLICE_BYTES = 1 << 20
#: So many places of the grids are extended at a time.
PLACES = 1 << 20

_REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, for one id in ten (by its checksum) with a tail that repeats a few of them, so that every corpus has long runs."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def runs_of(texts: list[list[bytes]], min_words: int = MIN_WORDS, repeats: int = MIN_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start, then period."""
    if repeats < 2:
        raise ValueError("a run repeats its words twice at least")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = W.numbered(texts)
    first = np.cumsum(sizes + 1) - sizes  # a symbol of its own stands before each text and after the last
    string = np.arange(len(ids) + len(texts) + 1) + (ids.max(initial=-1) + 1)
    where = np.repeat(first, sizes) + np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    string[where] = ids
    found = [np.empty((4, 0), np.int64)]
    grammar = mirror = None
    for text, place, period in _repeated_places(string, first, sizes, min_words, repeats):
        if grammar is None:
            grammar = Grammar(string)
            mirror = grammar.reversed()
        after = grammar.extensions(place, place + period)
        before = mirror.extensions(len(string) - place - period, len(string) - place)
        start, length = place - before, before + after + period
        long = length >= np.maximum(min_words, repeats * period)
        found.append(np.stack([text[long], start[long] - first[text[long]], length[long], period[long]]))
    text, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _repeated_places(string: np.ndarray, first: np.ndarray, sizes: np.ndarray, min_words: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the grids' places whose word comes again one period on."""
    most = np.where(sizes >= min_words, sizes // repeats, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (repeats - 1) * period
    places = -(-(sizes[text] - period) // step)
    ends = np.cumsum(places)
    done = 0
    while done < len(text):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PLACES, "right")))
        n = places[done:upto]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first[text[done:upto]], n) + k * np.repeat(step[done:upto], n)
        q = np.repeat(period[done:upto], n)
        again = string[at] == string[at + q]
        if again.any():
            yield np.repeat(text[done:upto], n)[again], at[again], q[again]
        done = upto


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _each(batch: pa.RecordBatch, rewrite: bool, min_words: int, repeats: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, bytes]]:
    ids = batch.column("doc_id").to_pylist()
    texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
    if rewrite:
        texts = [rewritten(words, d) for words, d in zip(texts, ids)]
    text, *runs = runs_of(texts, min_words, repeats)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for i, words in enumerate(texts):
        start, length, period = (x[bounds[i] : bounds[i + 1]] for x in runs)
        yield words, start, length, period, _collapsed(words, start, length, period)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed_text of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices([batch], size=SLICE_BYTES):
                n_words, runs, kept = [], [], []
                for words, start, length, period, collapsed in _each(part, False, min_words, repeats):
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())])
                    kept.append(collapsed.decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "runs": pa.array(runs, kind), "collapsed_text": pa.array(kept, pa.string())})

    return _read(docs).mapInArrow(make, _RUNS)


def report(docs: DataFrame, rewrite: bool = True) -> DataFrame:
    """Digests of every row: its runs, the longest of them and what is left when runs keep their first period only.

    The longest is the one of most words, then of smallest start, then period. With `rewrite` the words are `rewritten` first.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices([batch], size=SLICE_BYTES):
                rows = []
                for _, start, length, period, collapsed in _each(part, rewrite, MIN_WORDS, MIN_REPEATS):
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
                    best = int(np.argmax(length)) if len(length) else None  # the first of the greatest: they stand by start, then period
                    longest = [None] * 4 if best is None else [int(start[best]), int(length[best]), int(period[best]), int(1000 * length[best] // period[best])]
                    rows.append([len(start), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()])
                columns = list(zip(*rows)) or [[]] * 7
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], [c.split()[0] for c in _REPORT.split(", ")])

    return _read(docs).mapInArrow(make, _REPORT)
