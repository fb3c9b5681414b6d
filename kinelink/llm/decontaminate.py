"""Operator 2: benchmark decontamination.

The test items' word windows form a broadcast hash set; every window of every document is looked up
by hash, and each hit is verified word for word. Then hit spans or whole documents go. The set's size is checked: items
are dealt into blocks of at most `max_chars` characters; a block becomes a set of arrays once, on the driver, and tasks only
read it. Every block is a pass of its own over the documents: with more than one, the rows are checkpointed between
passes, so that no task ever holds two sets. A single item above the limit is a block by itself.

A null text has no words; an item without words has no window; a null item id is written as an
empty string. Equal windows of several items count for each of them. Rows that repeat get equal answers. Other columns of
the documents, whatever their names, are not looked at and pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelink.llm import words as W
from kinelink.llm.tables import checkpointed, free_names, row_slices

WINDOW = 10
MAX_CHARS = 8_000_000
_TABLE = bytes(int(W.FOLD[b]) if W.ALNUM[W.FOLD[b]] else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Windows:
    """Windows of one length in order of their hashes: where their words lie in the blob, and the item of each."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: np.ndarray
    maybe: np.ndarray  # by the hash's first bits: whether any window has them
    shift: int


class WindowSet:
    """The windows of a block of test items by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        tokens = [normal_words(text) for _, text in items]
        self.names = [item for item, _ in items]
        lines = [b" ".join(t) for t in tokens]
        self.blob = b" ".join(lines) + b" "
        data = np.frombuffer(self.blob, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines], dtype=np.int64)])
        starts, ends, bounds = W.word_spans(data, offsets, W.ALNUM)
        hashes, count = W.word_hashes(data, starts, ends), np.diff(bounds)
        owner = np.repeat(np.arange(len(items)), count)
        self.lengths: dict[int, Windows] = {}
        for size in sorted(set(np.minimum(count[count > 0], window).tolist())):
            fits = W.inside(bounds, size, len(hashes))
            own = fits & (np.minimum(count, window)[owner[: len(fits)]] == size)
            at = np.flatnonzero(own)
            own_hashes = W.window_hashes(hashes, size)[at]
            order = np.argsort(own_hashes, kind="stable")
            at, own_hashes = at[order], own_hashes[order]
            bits = max(10, int(len(at) * 16).bit_length())
            maybe = np.zeros(1 << bits, bool)
            maybe[(own_hashes >> W.U64(64 - bits)).astype(np.int64)] = True
            self.lengths[size] = Windows(own_hashes, starts[at], ends[at + size - 1], owner[at], maybe, 64 - bits)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of every verified occurrence."""
        hashes = W.word_hashes(data, starts, ends)
        for size, w in self.lengths.items():
            if len(hashes) < size:
                continue
            own = W.window_hashes(hashes, size)
            at = np.flatnonzero(w.maybe[(own >> W.U64(w.shift)).astype(np.int64)] & W.inside(bounds, size, len(hashes)))
            first, last = np.searchsorted(w.hashes, own[at], "left"), np.searchsorted(w.hashes, own[at], "right")
            found = last > first
            for i, a, b in zip(at[found].tolist(), first[found].tolist(), last[found].tolist()):
                phrase = b" ".join(data[starts[i] : ends[i + size - 1]].tobytes().translate(_TABLE).split())
                items = {self.names[w.items[k]] for k in range(a, b) if self.blob[w.starts[k] : w.ends[k]] == phrase}
                if items:
                    yield i, size, items


def _blocks(benchmark: DataFrame, max_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The different items with text, in blocks of about max_chars characters."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text") + F.length("item") + 64)).first()[0] or 0
    n = -(-int(total) // max_chars) or 1
    for k in range(n):
        yield [(r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def _scanner(broadcast, spans_name: str, items_name: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value
        for batch in batches:
            for first, end, raw, offsets in W.text_slices(batch.column("text")):
                data = W.FOLD[raw]
                starts, ends, bounds = W.word_spans(data, offsets, W.ALNUM)
                places: list[list] = [[] for _ in range(end - first)]
                items: list[set] = [set() for _ in range(end - first)]
                for i, size, own in known.spans(data, starts, ends, bounds):
                    k = int(np.searchsorted(bounds, i, "right")) - 1
                    places[k].append({"start": i - int(bounds[k]), "length": size})
                    items[k] |= own
                part = batch.slice(first, end - first)
                for name, found in ((spans_name, places), (items_name, [sorted(x) for x in items])):
                    at = part.schema.get_field_index(name)
                    both = [(e or []) + f for e, f in zip(part.column(at).to_pylist(), found)]
                    part = part.set_column(at, part.schema.field(at), pa.array(both, part.schema.field(at).type))
                yield part

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, spans: str = "spans", items: str = "items", max_chars: int = MAX_CHARS) -> DataFrame:
    """docs with two columns more: start and length in words of every verified window, and the items found (by block, so maybe repeated)."""
    out = docs.withColumn(spans, F.expr("cast(array() as array<struct<start:int,length:int>>)")).withColumn(items, F.expr("cast(array() as array<string>)"))
    for k, block in enumerate(_blocks(benchmark, max_chars)):
        broadcast = docs.sparkSession.sparkContext.broadcast(WindowSet(block))
        out = (checkpointed(out) if k else out).mapInArrow(_scanner(broadcast, spans, items), out.schema)
    return out


def _hit(spans: list[dict], n: int) -> np.ndarray:
    return W.covered(np.array([s["start"] for s in spans], np.int64), np.array([s["length"] for s in spans], np.int64), n)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.diff(W.word_spans(W.FOLD[raw], offsets, W.ALNUM)[2]) for _, _, raw, offsets in W.text_slices(batch.column("text"))]
        n_words = np.concatenate(counts or [np.empty(0, np.int64)])
        spans, items = batch.column("spans").to_pylist(), [sorted(set(x)) for x in batch.column("items").to_pylist()]
        n_hit = pa.array([int(_hit(s, n).sum()) if s else 0 for s, n in zip(spans, n_words.tolist())], pa.int64())
        digests = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": n_words, "n_hit": n_hit, "n_items": pa.array(map(len, items), pa.int64()), "items_sha256": digests, "contaminated": pa.array(map(bool, spans), pa.bool_())})


def report(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """One row per document: words, hit words, items found and their digest."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **limits)
    return found.mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _cutter(spans_name: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(spans_name).to_pylist()):
                if spans:
                    raw = texts[k].encode()
                    starts, ends, _ = W.word_spans(W.FOLD[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), W.ALNUM)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], _hit(spans, len(starts)), [False]]).astype(np.int8)))
                    out, done = [], 0
                    for a, b in zip(edge[::2], edge[1::2]):
                        out.append(raw[done : starts[a]])
                        done = ends[b - 1]
                    texts[k] = b"".join([*out, raw[done:]]).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return cut


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **limits) -> DataFrame:
    """docs without contaminated documents, or (remove='spans') without the hit words; same columns."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    spans, items = free_names(docs, "_spans", "_items")
    marked = scan(docs, benchmark, spans, items, **limits)
    if remove == "documents":
        return marked.filter(F.size(spans) == 0).drop(spans, items)
    out = marked.mapInArrow(_cutter(spans), marked.schema).drop(spans, items)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
