"""Operator 3: token counts by rank-synchronous array merging.

Pre-tokens wait in batches as ragged arrays of symbols. In each round every sequence finds the lowest
merge rank among its neighbouring pairs and all its places with that pair merge at once (of places
that overlap, every second one from the left); sequences without a pair left leave the arrays, and
their surviving symbols are the token count. This gives what merging one pair at a time gives,
because a pair that holds a merged symbol always ranks after the pair that made it.

A run of one class that no space breaks is one pre-token: its rounds each pass over all that is left of it, so
time grows a little faster than its length (400 000 letters take seconds). A null text is empty and has no tokens. Rows are answered one by one, repeated or not; other columns
are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelink.llm import pretokens as P
from kinelink.llm import words as W

_NONE = np.int32(1 << 30)


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Merge rules as sorted pair keys with their ranks and results."""

    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], byte_letters()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] * (1 << 20) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.results = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(W.U64) * W.U64(0x9E3779B97F4A7C15) >> W.U64(42)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * (1 << 20) + right
        out = np.full(len(keys), _NONE, np.int32)
        maybe = np.flatnonzero(self.filter[self._slot(keys)])
        wanted = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        out[maybe[hit]] = self.ranks[at[hit]]
        return out

    def apply(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each piece survive."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        survivors = sizes.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ranks = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(first, len(owner)))
            lowest = np.minimum.reduceat(ranks, first)
            survivors[owner[first]] = count
            active = lowest < _NONE
            if not active.all():
                keep = np.repeat(active, count)
                symbols, owner, ranks, lowest, count = symbols[keep], owner[keep], ranks[keep], lowest[active], count[active]
                if not len(symbols):
                    break
            merge = ranks == np.repeat(lowest, count)
            run = np.flatnonzero(merge)
            joined = np.concatenate([[False], (np.diff(run) == 1) & (owner[run[1:]] == owner[run[:-1]])])
            if joined.any():
                begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(run))))
                run = run[(np.arange(len(run)) - begin) % 2 == 0]
            symbols[run] = self.results[ranks[run]]
            stay = np.ones(len(symbols), bool)
            stay[run + 1] = False
            moved = np.cumsum(stay) - 1
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            run = moved[run]
            again = np.unique(np.concatenate([run, run[run > 0] - 1]))
            ranks[again] = _NONE
            again = again[again < len(owner) - 1]
            again = again[owner[again] == owner[again + 1]]
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
        return survivors


@lru_cache(1)
def _store(vocabulary_file: str) -> tuple[P.Store, dict[str, int]]:
    merges = Merges(vocabulary_file)
    return P.Store(lambda pieces: (merges.apply([p.encode() for p in pieces]), None)), P.special_tokens(vocabulary_file)


def count_tokens(column: pa.Array, store: P.Store, special: dict[str, int]) -> np.ndarray:
    out = []
    for _, _, data, starts, ends, rows, kinds in P.split_texts(column, special):
        counts, plain = np.ones(len(starts), np.int64), kinds < 0
        if plain.any():
            places = store.find(data, starts[plain], ends[plain])
            counts[plain] = store.counts[places]
        out.append(np.diff(np.concatenate([[0], np.cumsum(counts)])[rows]))
    return np.concatenate(out or [np.empty(0, np.int64)])


def token_counts(docs: DataFrame, vocabulary_file: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, special = _store(vocabulary_file)
        for batch in batches:
            tokens = count_tokens(batch.column("text"), store, special)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": tokens, "over_limit": tokens > limit})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
