"""Run-length grammars by recompression, and exact extensions by walking them, for many places at once.

A level is a string of symbols; the next level writes each stretch of one repeated symbol as one symbol
(block compression) or each neighbouring pair with its left symbol in one half of the alphabet and its right
symbol in the other as one symbol (pair compression), in turns until one symbol is left. Equal stretches of a level
are written alike but for their borders, so two places are compared by climbing while both stand at the
start of a symbol, with at most one symbol or block compared at a level, and by going down again from the first
level where they differ. All places climb together, so the work at a level is a few array operations.
"""

from __future__ import annotations

import numpy as np

_SEED = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """The levels of one string of symbols.

    symbols[k] is level k, starts[k] the place in level k of each symbol of level k + 1 (with the end of level k after
    them), parents[k] the symbol of level k + 1 that holds each place, blocks[k] whether level k + 1 compresses blocks.
    """

    def __init__(self, string: np.ndarray):
        self.symbols, self.starts, self.parents, self.blocks = [np.asarray(string, np.int64)], [], [], []
        fresh, turn = int(string.max()) + 1 if len(string) else 0, 0
        while len(self.symbols[-1]) > 1:
            now, block = self.symbols[-1], turn % 2 == 0
            first = _block_starts(now) if block else _pair_starts(now, turn)
            turn += 1
            if len(first) == len(now):
                continue  # nothing to compress here: the level would repeat this one
            ends = np.append(first[1:], len(now))
            size = ends - first
            long, above = np.flatnonzero(size > 1), now[first]
            # a block is named by its symbol and its length, a pair by its two symbols
            named = now[first[long]] * (fresh + len(now) + 1) + (size[long] if block else now[first[long] + 1])
            kinds, name = np.unique(named, return_inverse=True)
            above[long] = fresh + name
            fresh += len(kinds)
            self.starts.append(np.append(first, len(now)))
            self.parents.append(np.repeat(np.arange(len(first)), size))
            self.blocks.append(block)
            self.symbols.append(above)

    def reversed(self) -> Grammar:
        """The same grammar read from the end, for extensions to the left."""
        out = object.__new__(Grammar)
        out.symbols, out.blocks = [s[::-1] for s in self.symbols], self.blocks
        out.starts = [int(s[-1]) - s[::-1] for s in self.starts]
        out.parents = [len(s) - 1 - p[::-1] for s, p in zip(self.symbols[1:], self.parents)]
        return out

    def extensions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many symbols from left[i] on and from right[i] on are equal, for left[i] < right[i].

        Every stretch compared must end in unequal symbols before the string does, which a symbol that
        occurs once behind each text ensures.
        """
        met_i, met_j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        level_of = np.full(len(left), -1)
        going, i, j = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        for k, (s, parent, start, block) in enumerate(zip(self.symbols, self.parents, self.starts, self.blocks)):
            if not len(going):
                break
            p, q = parent[i], parent[j]
            inside = (start[p] != i) | (start[q] != j)
            same = s[i] == s[j]
            step = np.ones(len(i), np.int64)
            parted = ~same
            if block:
                rest_i, rest_j = start[p + 1] - i, start[q + 1] - j
                step = np.minimum(rest_i, rest_j)
                parted |= rest_i != rest_j
            move = inside & same
            i, j = i + step * move, j + step * move
            ended = inside & parted
            met_i[going[ended]], met_j[going[ended]], level_of[going[ended]] = i[ended], j[ended], k
            going, i, j = going[~ended], i[~ended], j[~ended]
            i, j = parent[i], parent[j]
        met_i[going], met_j[going], level_of[going] = i, j, len(self.starts)
        for k in range(len(self.starts) - 1, -1, -1):
            at = np.flatnonzero(level_of > k)
            if not len(at):
                continue
            s, start = self.symbols[k], self.starts[k]
            p, q = met_i[at], met_j[at]
            i, j = start[p], start[q]
            same = s[i] == s[j]
            step = np.minimum(start[p + 1] - i, start[q + 1] - j) if self.blocks[k] else 1
            met_i[at], met_j[at] = i + step * same, j + step * same
        return met_i - left


def _block_starts(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, s[1:] != s[:-1]))


def _pair_starts(s: np.ndarray, turn: int) -> np.ndarray:
    """Starts of the pairs and of the symbols left alone; the half of a symbol follows from a hash of it and the turn."""
    h = (s.astype(np.uint64) + np.uint64(turn)) * _SEED
    h ^= h >> np.uint64(32)
    half = ((h * _SEED) >> np.uint64(63)).astype(bool)
    pairs = half[:-1] & ~half[1:], ~half[:-1] & half[1:]
    chosen = pairs[0] if pairs[0].sum() >= pairs[1].sum() else pairs[1]
    return np.flatnonzero(np.append(True, ~chosen))
