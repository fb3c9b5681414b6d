"""Operator 5: best-fit-decreasing packing of documents into sequences of bounded length.

Tokenised documents end with an end id; longer ones are cut into full pieces, the first of which may
be shorter. Only the number of pieces of each length matters for the packing, so the lengths'
histogram (at most `capacity` rows, whatever the input) is packed: lengths go from long to short and
a segment tree over remaining capacities finds the tightest open bin in logarithmic time. Open bins
of equal room are kept as ranges of numbers and documents of equal length go in together, which gives
what placing them one by one gives. The plan has a row for each range; pieces find theirs
by their rank among the pieces of their length, counted in shards.

A null text is empty: its one piece holds the end id. Rows that repeat are documents of their own
right; null ids and clashing column names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelink.llm import pretokens as P
from kinelink.llm.tables import checkpointed


class RoomTree:
    """Open bins by remaining room: ranges of bin numbers at the leaves, their count above."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.bins[room].append((first, n))
            self._add(room, n)

    def take(self, room: int) -> tuple[int, int]:
        first, n = self.bins[room].pop()
        self._add(room, -n)
        return first, n

    def tightest(self, length: int) -> int | None:
        """Smallest room of an open bin that holds `length`."""
        node = length + self.size
        if self.count[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces a bin, first offset) for every range."""
    tree, out, bins = RoomTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        done, n = 0, histogram[length]
        while done < n:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, have = bins, -(-(n - done) // each)
                bins += have
            else:
                each = room // length
                first, have = tree.take(room)
            full = min(have, (n - done) // each)
            if full:
                out.append((length, done, done + full * each, first, each, capacity - room))
                tree.put(room - each * length, first, full)
                done += full * each
            if full < have and done < n:
                rest = n - done
                out.append((length, done, n, first + full, rest, capacity - room))
                tree.put(room - rest * length, first + full, 1)
                done, full = n, full + 1
            tree.put(room, first + full, have - full) if room < capacity else None
    return out


@lru_cache(1)
def _store(vocabulary_file: str) -> tuple[P.Store, dict[str, int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_file)

    def made(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.fromiter((x for one in ids for x in one), np.uint32, int(counts.sum()))

    return P.Store(made, 700_000), P.special_tokens(vocabulary_file)


def pieces_of(column: pa.Array, store: P.Store, special: dict[str, int], capacity: int, end_id: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, start, length, crc32 of the ids) of every piece of every text."""
    for row, _, data, starts, stops, bounds, kinds in P.split_texts(column, special):
        places = store.find(data, starts, stops)
        counts = store.counts[places].astype(np.int64)
        if (kinds >= 0).any():
            ids = [store.ids[store.first[p] : store.first[p] + c] if k < 0 else np.array([k], np.uint32) for p, c, k in zip(places, counts, kinds.tolist())]
            counts[kinds >= 0] = 1
            ids = np.concatenate(ids)
        else:
            ids = store.ragged(places)
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
        blob = ids.astype("<u4").tobytes()
        tail = np.array([end_id], "<u4").tobytes()
        for k in range(len(bounds) - 1):
            own = blob[4 * ends[k] : 4 * ends[k + 1]] + tail
            total = len(own) // 4
            at, length = 0, total % capacity or min(total, capacity)
            for piece in range(-(-total // capacity)):
                yield row + k, piece, at, length, zlib.crc32(own[4 * at : 4 * (at + length)])
                at, length = at + length, capacity


def tokenised_pieces(docs: DataFrame, vocabulary_file: str, capacity: int, end_id: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, special = _store(vocabulary_file)
        for batch in batches:
            found = list(pieces_of(batch.column("text"), store, special, capacity, end_id))
            row, piece, start, length, crc = (np.array(x, np.int64) for x in (zip(*found) if found else [[]] * 5))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 1024, shard_rows: int = 10_000) -> DataFrame:
    """pieces (doc_id, piece, length and more) with sequence_id and offset."""
    spark = pieces.sparkSession
    kept = checkpointed(pieces)
    histogram = {r.length: r["count"] for r in kept.groupBy("length").count().collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"every length must be from 1 to {capacity}")
    shards = max(1, -(-sum(histogram.values()) // shard_rows))
    # a plan row fills or splits a range of bins of one room: their number follows capacity, not the input
    ranges = spark.createDataFrame(plan(histogram, capacity) or [(0, 0, 0, 0, 1, 0)], "_l long, _lo long, _hi long, _bin long, _each long, _at long")
    sharded = kept.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    before = sharded.groupBy("_shard", "length").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)))
    local = sharded.withColumn("_rank", F.row_number().over(Window.partitionBy("_shard", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = local.join(before.select("_shard", "length", F.coalesce("_before", F.lit(0)).alias("_before")), ["_shard", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(ranges), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    step = F.col("_rank") - F.col("_lo")
    return placed.select(*pieces.columns, (F.col("_bin") + F.floor(step / F.col("_each"))).alias("sequence_id"), (F.col("_at") + step % F.col("_each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary_file: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenised_pieces(docs, vocabulary_file, capacity, end_id), capacity)
