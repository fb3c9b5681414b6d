"""Operator 6: substring dedup with sharded automata of repeated phrases.

A passage is a window of 35 words that starts at two places or more, anywhere. Every window has an
anchor, the phrase of 8 words with the lowest hash inside it, so equal windows have equal anchors.

1. Documents are dealt into blocks of bounded size. Each block reports its anchors; anchors that
   only one place has are dropped (a block reports an anchor once, however often it has it).
2. Each block reports the hashes of its windows with anchors that are left; windows that two
   places have recur. The first block that has one represents it.
3. Representatives send the words of recurring windows, overlapping ones as one passage, to the blocks that
   have them: each block gets a passage once, and no more than it has itself.
4. Each block is a shard: the anchors of its passages are compiled into an Aho-Corasick automaton, word for word, and all
   documents of the block stream through it. Every phrase found is compared to both sides with the passages it stands in, word for
   word; stretches of 35 equal words or more are removed. Nothing else decides which words go.

So a word goes if its window is equal, word for word, to a recurring window that another block (or its own) sent. That
a window recurs is found by two 64-bit hashes (the anchor's and the window's) under a key drawn for each run, so no text can
be made to meet in them. The work grows with the input; a key has at most one row for each block.

Nulls: a null text has no words. Rows that repeat are documents of their own, so their passages
recur. Texts of fewer than 35 words stay. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelink.llm import words as W
from kinelink.llm.tables import in_blocks

WINDOW = 35
ANCHOR = 8
BLOCK_BYTES = 4 << 20


class _Windows:
    """Windows and anchors of the texts of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int, key: int):
        self.starts, self.ends, self.bounds = W.word_spans(data, offsets)
        self.hashes = W.word_hashes(data, self.starts, self.ends, key)
        self.window = window
        self.n, span = len(self.hashes), window - anchor + 1
        self.phrases = W.window_hashes(self.hashes, anchor)
        self.valid = W.inside(self.bounds, window, self.n)
        if len(self.valid):
            self.windows = W.window_hashes(self.hashes, window)
            self.lowest = W.sliding(self.phrases, span, np.minimum)
            rim = np.zeros(span - 1, W.U64)
            reach = W.sliding(np.concatenate([rim, np.where(self.valid, self.lowest, W.U64(0)), rim]), span, np.maximum)
            self.anchored = reach == self.phrases
        else:
            self.windows = self.lowest = np.empty(0, W.U64)
            self.anchored = np.zeros(len(self.phrases), bool)


def _slices(table: pa.Table, window: int, anchor: int, key: int):
    for first, end, data, offsets in W.text_slices(table.column("text")):
        yield first, end, data, _Windows(data, offsets, window, anchor, key)


def _tally(block: int, found: list[np.ndarray], name: str) -> pa.Table:
    values, n = np.unique(np.concatenate(found or [np.empty(0, W.U64)]), return_counts=True)
    return pa.table({"block": pa.array(np.full(len(values), block, np.int32)), name: values.view(np.int64), "n": n.astype(np.int32)})


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _sorted(table: pa.Table, name: str) -> np.ndarray:
    return np.sort(np.asarray(table.column(name)).view(W.U64))


def _passages(part: _Windows, data: np.ndarray, windows: np.ndarray, targets: np.ndarray) -> tuple[list[int], list[str]]:
    """(target, words) of the slice's passages: wanted windows of a target that follow each other are one. windows is sorted, targets beside it."""
    values, places = np.unique(np.where(part.valid, part.windows, 0), return_index=True)
    have = np.zeros(len(windows), bool)
    if len(values):
        at = np.minimum(np.searchsorted(values, windows), len(values) - 1)
        have = (values[at] == windows) & part.valid[places[at]]
    target, place = targets[have], places[at[have]] if have.any() else np.empty(0, np.int64)
    order = np.lexsort((place, target))
    target, place = target[order], place[order]
    new = np.append(True, (target[1:] != target[:-1]) | (place[1:] != place[:-1] + 1))[: len(place)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    span = part.window - 1
    text = data.tobytes()
    words = [b" ".join(text[part.starts[place[a]] : part.ends[place[b] + span]].split()).decode() for a, b in zip(first.tolist(), last.tolist())]
    return target[first].tolist(), words


#: Words compared at a time.
_CELLS = 1 << 20
#: Numbers that no word of a passage has: of all other words and the ends of texts, and between passages.
_OTHER, _BETWEEN = (1 << 32) - 1, (1 << 32) - 2


class _Shard:
    """The automaton of a block's passages, and their words by number."""

    def __init__(self, passages: list[str], window: int, anchor: int, key: int):
        self.window, self.anchor, self.numbers = window, anchor, {}
        passages = sorted(set(passages))
        tokens = [p.encode().split() for p in passages]
        own = W.numbered(tokens, self.numbers)
        self.words = np.full(len(own) + len(tokens) + 1, _BETWEEN, np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        shift = np.repeat(np.arange(len(tokens)), sizes) + 1
        self.words[np.arange(len(own)) + shift] = own
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        places: list[list[int]] = []
        data = np.frombuffer("\n".join(passages).encode(), np.uint8)
        ends = np.cumsum([len(p.encode()) + 1 for p in passages]) if passages else np.empty(0, np.int64)
        part = _Windows(data, np.concatenate([[0], np.minimum(ends, len(data))]).astype(np.int64), window, anchor, key)
        found: dict[tuple[int, ...], int] = {}
        for p in np.flatnonzero(part.anchored).tolist():
            phrase = tuple(own[p : p + anchor].tolist())
            at = found.setdefault(phrase, len(found))
            if at == len(places):
                places.append([])
                self.automaton.add_word(phrase, at)
            places[at].append(p + int(shift[p]))
        if found:
            self.automaton.make_automaton()
        self.bounds = np.cumsum([0, *map(len, places)])
        self.flat = np.array([x for at in places for x in at], np.int64)
        self.firsts = np.cumsum(sizes + 1) - sizes  # where each passage starts

    def locate(self, texts: list[list[bytes]]) -> np.ndarray:
        """Which words of the texts lie in a stretch of `window` words or more that is equal to part of a passage."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        known: list[int] = []
        for words in texts:
            known.extend(map(self.numbers.get, words, repeat(_OTHER)))
            known.append(_OTHER)
        own, gone = np.array(known, np.int64), np.zeros(len(known), bool)
        # the automaton reads stretches of `window` words of passages or more, each with what ends it
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own != _OTHER]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.window
        where = np.flatnonzero(W.covered(begin[long], (end - begin + 1)[long], len(own))) if long.any() else gone[:0]
        hits = list(self.automaton.iter(tuple(own[where].tolist()))) if len(where) and len(self.automaton) else []
        if hits:
            ends, phrases = np.array(hits, np.int64).T
            times = np.diff(self.bounds)[phrases]
            at = np.repeat(where[ends] - self.anchor + 1, times)
            place = self.flat[np.repeat(self.bounds[phrases] - np.cumsum(times) + times, times) + np.arange(len(at))]
            for start, stop in self._equal(own, at, place):
                gone |= W.covered(start, stop - start, len(gone))
        return np.delete(gone, np.cumsum(sizes + 1) - 1)

    def _equal(self, own: np.ndarray, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, end) in the texts of all stretches of `window` words or more that are equal to a passage in which a phrase was found.

        A phrase at `at` in the texts and at `place` in a passage sets them against each other; phrases of one passage that do so at the
        same shift are looked at together, from a window's reach before the first to a window's reach after the last.
        """
        rim, n, m = self.window - self.anchor, len(own), len(self.words)
        half, same = rim // 2, lambda back: own[np.clip(at + back, 0, n - 1)] == self.words[np.clip(place + back, 0, m - 1)]
        # of the words beside the phrase half stand on one side at least
        near = same(-(rim - half)) | same(self.anchor + rim - half - 1)
        at, place = at[near], place[near]
        owner = np.searchsorted(self.firsts, place, "right")
        order = np.lexsort((place, owner, at - place))
        at, place, owner = at[order], place[order], owner[order]
        new = np.append(True, (np.diff(at - place) != 0) | (np.diff(owner) != 0))[: len(at)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        shift = (at - place)[first]
        low = np.maximum(np.maximum(place[first] - rim, 0), -shift)
        high = np.minimum(np.minimum(place[last] + self.window, m), n - shift)
        size = np.maximum(high - low, 0) + 1  # with a place between groups
        done = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + _CELLS, "right")))
            start = np.cumsum(size[a:b]) - size[a:b]
            step = np.arange(int(size[a:b].sum())) - np.repeat(start, size[a:b])
            inside = np.repeat(low[a:b], size[a:b]) + step
            equal = step < np.repeat(size[a:b] - 1, size[a:b])
            there = inside + np.repeat(shift[a:b], size[a:b])
            equal &= own[np.minimum(there, n - 1)] == self.words[np.minimum(inside, m - 1)]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
            begin, stop = edge[::2], edge[1::2]
            long = stop - begin >= self.window
            yield there[begin[long]], there[begin[long]] + (stop - begin)[long]
            a = b


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (start and end in words) removed, n_removed, kept_text of every row."""
    key = W.secret()

    def anchors(table: pa.Table) -> pa.Table:
        return _tally(table.column("block")[0].as_py(), [p.phrases[p.anchored] for _, _, _, p in _slices(table, window, anchor, key)], "anchor")

    def windows(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(table) or not len(shared):
            return _tally(0, [], "window")
        keep = _sorted(shared, "anchor")
        return _tally(table.column("block")[0].as_py(), [p.windows[p.valid & _member(p.lowest, keep)] for _, _, _, p in _slices(table, window, anchor, key)], "window")

    def send(table: pa.Table, wanted: pa.Table) -> pa.Table:
        target, words = [], []
        if len(table) and len(wanted):
            sought, targets = np.asarray(wanted.column("window")).view(W.U64), np.asarray(wanted.column("block"))
            order = np.argsort(sought)
            sought, targets = sought[order], targets[order]
            for _, _, data, part in _slices(table, window, anchor, key):
                found = _passages(part, data, sought, targets)
                target += found[0]
                words += found[1]
        return pa.table({"target": pa.array(target, pa.int32()), "passage": pa.array(words, pa.string())})

    def locate(table: pa.Table, passages: pa.Table) -> pa.Table:
        shard = _Shard(passages.column("passage").to_pylist() if len(passages) else [], window, anchor, key)
        n_words, n_removed, spans, kept = [], [], [], []
        column = table.column("text").combine_chunks() if len(table) else pa.array([], pa.string())
        for first, end, _, _ in W.text_slices(column):
            texts = [(t or "").encode().split() for t in column.slice(first, end - first).to_pylist()]
            gone, done = shard.locate(texts), 0
            for tokens in texts:
                mine = gone[done : done + len(tokens)]
                done += len(tokens)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))) if mine.any() else []
                n_words.append(len(tokens))
                n_removed.append(int(mine.sum()))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                kept.append(b" ".join(compress(tokens, (~mine).tolist()) if len(edge) else tokens).decode())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": table.column("doc_id") if len(table) else pa.array([], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(kept, pa.string())})

    rows = in_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), block_bytes)
    blocks = rows.groupBy("block")

    def recurring(found: DataFrame, name: str) -> DataFrame:
        same = Window.partitionBy(name)
        return found.withColumns({"total": F.sum("n").over(same), "source": F.min("block").over(same)}).filter(F.col("total") > 1).select("block", name, "source")

    shared = recurring(blocks.applyInArrow(anchors, "block int, anchor long, n int"), "anchor").select("block", "anchor")
    sure = recurring(blocks.cogroup(shared.groupBy("block")).applyInArrow(windows, "block int, window long, n int"), "window")
    passages = blocks.cogroup(sure.groupBy("source")).applyInArrow(send, "target int, passage string")
    return blocks.cogroup(passages.groupBy("target")).applyInArrow(locate, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")
