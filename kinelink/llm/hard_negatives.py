"""Operator 13: hard negatives below each positive, by slots between the positives' scores.

Every anchor has up to `positives` rows of its own label, the best by score, and each of them has a window
[lowest share * its score, its score] over the scores of rows of other labels. The windows of an anchor overlap,
but the positives' scores, their upper limits, cut the scores into disjoint slots. Each task keeps the best `negatives` rows of
every (anchor, slot) over all blocks it reads; these meet by (anchor, slot), where the best of all tasks stay. A merge from the
lowest slot upwards then gives the best rows up to each positive's score, and the lower limit cuts them. A row goes
into one slot, whatever the number of windows it lies in.

Anchors pass in blocks of `block` rows, the only thing that is broadcast, and every block goes over all rows twice:
for the positives and for the slots. What a task keeps has the size of a block, not of the rows it reads. A label
or vector that a third of the rows share is dealt as the table's files are, and each task passes on a few rows for each anchor.

Scores are inner products of the whole numbers floor(scale * x), exact below 2**63; positives and negatives come by score, then by smaller id.
Nulls: rows with a null label, id or vector, an empty vector, or null or non-finite components take no part. Vectors of unequal length
count as zero beyond their ends. Rows that repeat an id are rows of their own; an anchor is not its own positive, nor are rows of its id.
Anchors without positives, and positives without negatives in their window, give no row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.llm.tables import checkpointed
from kinelink.llm.vectors import best_of_each, matrix, usable, widest

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
#: A negative scores at least so many hundredths of the positive.
LOWEST_PERCENT = 80
#: Anchors of a broadcast block.
BLOCK = 8192
#: Whole numbers up to here are exact as doubles.
_EXACT = float(1 << 53)
#: Scores of a matrix product at a time.
_CELLS = 1 << 21
_LEAST = np.iinfo(np.int64).min

_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; by doubles where every partial sum is exact in them, else by 64-bit numbers."""
    bound = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if bound < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.T.astype(np.int64)


def _read(rows: DataFrame, vector: str, label: Column) -> DataFrame:
    named = rows.filter(usable(F.col(vector)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    return named.filter("label IS NOT NULL")


def _top(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) that may be among the k best of each anchor's fitting rows: all down to the k-th best score."""
    if score.shape[1] > k:
        masked = np.where(fits, score, _LEAST)
        fits = fits & (masked >= np.partition(masked, -k, axis=1)[:, -k, None])
    return np.nonzero(fits)


def _kept(rows: DataFrame, sent: Broadcast, width: int, scale: int, k: int) -> DataFrame:
    """(anchor, slot, id, score): the k best rows of every anchor and slot, kept in each task first.

    sent holds the anchors' vectors, labels, ids and limits, and `anchor` is a place in them. Without limits there is
    one slot, of the rows of the anchor's label; else one from each limit (falling) down to the next, of the rows of other labels.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, labels, ids, limits = sent.value
        slots = 1 if limits is None else limits.shape[1]
        best = [np.empty(0, np.int64) for _ in range(3)]  # cell (anchor and slot), score, id
        for batch in batches:
            x = np.floor(scale * matrix(batch.column("v"), width))
            row_label, row_id = (batch.column(c).to_numpy() for c in ("label", "id"))
            few = max(1, _CELLS // max(1, len(row_id)))
            for a in range(0, len(ids), few):
                score = _scores(vectors[a : a + few], x)
                same = labels[a : a + few, None] == row_label
                parts = [best]
                for j in range(slots):
                    if limits is None:
                        fits = same & (ids[a : a + few, None] != row_id)
                    else:
                        fits = ~same & (score <= limits[a : a + few, j, None])
                        if j + 1 < slots:
                            fits &= score > limits[a : a + few, j + 1, None]
                    at, row = _top(score, fits, k)
                    parts.append([(a + at) * slots + j, score[at, row], row_id[row]])
                best = [np.concatenate(c) for c in zip(*parts)]
                top = best_of_each(*best, k)
                best = [c[top] for c in best]
        for a in range(0, len(best[0]), 1 << 16):
            cell, score, row = (c[a : a + (1 << 16)] for c in best)
            yield pa.RecordBatch.from_pydict({"anchor": cell // slots, "slot": cell % slots, "id": row, "score": score})

    found = rows.mapInArrow(make, "anchor long, slot long, id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _windows(anchor_ids: np.ndarray, positives: dict[int, list[tuple[int, int]]], lowest: int, k: int):
    """For groups of (anchor, slots): from the lowest slot upwards the best k rows up to each positive's score, cut at its lower limit."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for anchor, slots in zip(batch["anchor"], batch["slots"]):
                below: list[tuple[int, int]] = []
                rows = [(int(s["slot"]), -int(s["score"]), int(s["id"])) for s in slots]
                own = positives[anchor]
                for j in range(len(own) - 1, -1, -1):
                    positive, limit = own[j]
                    below = sorted(below + [r[1:] for r in rows if r[0] == j])[:k]
                    inside = [(-less, row) for less, row in below if lowest * limit <= -100 * less]
                    out += [(int(anchor_ids[anchor]), positive, rank, row, limit, score) for rank, (score, row) in enumerate(inside, 1)]
            yield pd.DataFrame(out, columns=_COLUMNS).astype("int64").astype({"rank": "int32"})

    return make


def hard_negatives(rows: DataFrame, anchors: Column, vector: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest_percent: int = LOWEST_PERCENT, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for the rows of vec_id, label and vector that `anchors` holds for.

    `label` may derive the label from the columns. A score is a whole number up to 2**63.
    """
    if min(positives, negatives, block) < 1:
        raise ValueError("positives, negatives and block are 1 at least")
    spark, width = rows.sparkSession, widest(rows, vector)
    read = _read(rows, vector, F.col("label") if label is None else label)
    chosen = checkpointed(_read(rows.filter(anchors), vector, F.col("label") if label is None else label))
    done = []
    for held in _blocks(chosen, block):
        ids, labels = (np.array([r[c] for r in held], np.int64) for c in ("id", "label"))
        vectors = np.zeros((len(held), width))
        for i, r in enumerate(held):
            vectors[i, : len(r["v"])] = r["v"]
        vectors = np.floor(scale * vectors)
        sent = spark.sparkContext.broadcast((vectors, labels, ids, None))
        own: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(ids))}
        for r in sorted(_kept(read, sent, width, scale, positives).collect(), key=lambda r: r["place"]):  # of one block: a few for each anchor
            own[r["anchor"]].append((r["id"], r["score"]))
        sent.destroy()
        limits = np.full((len(ids), positives), _LEAST)
        for i, found in own.items():
            limits[i, : len(found)] = [score for _, score in found]
        sent = spark.sparkContext.broadcast((vectors, labels, ids, limits))
        slots = _kept(read, sent, width, scale, negatives).groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "id")).alias("slots"))
        done.append(checkpointed(slots.mapInPandas(_windows(ids, own, lowest_percent, negatives), _SCHEMA)))
        sent.destroy()
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], _SCHEMA)


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows in runs of `size`, one partition at the driver at a time."""
    held = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def report(rows: DataFrame) -> DataFrame:
    """The contract's anchors and labels: ids divisible by 100, and labels that move on by one where 7 divides the id."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=moved)
