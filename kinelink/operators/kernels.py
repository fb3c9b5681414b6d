"""Kernel distance of two sets of vectors over all their pairs, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from kinelink.operators.storage import checkpointed

#: Most rows of a block; a cell is two blocks, and a task holds one cell at a time.
GROUP = 8192
#: Rows and columns of the matrices of distances that are made of a cell one after the other.
TILE = 256, 1024
#: Blocks are dealt to at most SPREAD partitions, more only when a partition would have over HELD of them.
SPREAD = 24
HELD = 16
#: The median is found by the digits of the distances' places in the range: NARROWINGS digits of BIN_BITS bits each, the first ones first.
BIN_BITS = 14
NARROWINGS = 3
BINS = 1 << BIN_BITS


def _cells(vectors: DataFrame, n: int, group: int) -> DataFrame:
    """Cells of two blocks (l, r), each pair of blocks once. Blocks are the rows packed by `group`, in any order; they are written once
    to the shared folder, and a task reads the blocks of its cells from there, so no row is shuffled once for each cell."""
    groups = max(1, -(-n // group))
    parts = max(min(groups, SPREAD), -(-groups // HELD))
    each = max(1, -(-n // parts))
    single = vectors.schema["v"].dataType.simpleString() == "array<float>"
    dealt = vectors.select("s", "k", F.col("v").cast("array<float>" if single else "array<double>").alias("v")).repartition(parts)
    schema = StructType().add("first", IntegerType()).add("k", ArrayType(vectors.schema["k"].dataType)).add("v", BinaryType())
    blocks = checkpointed(dealt.mapInArrow(_packed(-(-each // -(-each // group))), schema)).withColumn("id", F.monotonically_increasing_id())
    side = lambda name: blocks.select(F.col("id").alias(name), F.struct("first", "k", "v").alias(f"{name}_block"))
    pairs = side("l").join(side("r").hint("shuffle_replicate_nl"), F.col("l") <= F.col("r"))
    return pairs.select("l", "r", "l_block", "r_block", F.lit(single).alias("single"))


def _packed(size: int) -> Callable[[Iterator], Iterator]:
    """Rows of (s, k, v) to blocks of at most `size`: keys and the bytes of the vectors, those of side 0 `first`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - count))
                count, batch = count + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if count == size:
                    yield block(pa.Table.from_batches(held).combine_chunks())
                    held, count = [], 0
        if held:
            yield block(pa.Table.from_batches(held).combine_chunks())

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("s").combine_chunks()
        k, v = (rows.column(c).chunk(0) for c in "kv")
        if len(set(v.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors differ in length")
        keys = pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k)
        values = v.flatten().to_numpy(zero_copy_only=False)
        first = int((rows.column("s").to_numpy() == 0).sum())
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), keys, pa.array([values.tobytes()])], ["first", "k", "v"])

    return pack


def _over_pairs(cells: DataFrame, result: Callable[[Iterator], pa.RecordBatch], schema: str) -> DataFrame:
    """result of the tiles of each task's cells: (0 to 2 for the sum of the sides, squared distances that may be overwritten), every unordered pair of the rows once."""

    def read(block: dict, single: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        keys = block["k"].values.to_numpy(zero_copy_only=False)
        v = np.frombuffer(block["v"].as_buffer(), np.float32 if single else np.float64).reshape(len(keys), -1).astype(float)
        first = block["first"].as_py()
        return keys, v, ((0, first), (first, len(keys)))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        out = np.empty(TILE)
        for batch in batches:
            for i in range(batch.num_rows):
                l, r, single = (batch.column(c)[i].as_py() for c in ("l", "r", "single"))
                (k, v, rows), (m, w, columns) = (read(batch.column(c)[i], single) for c in ("l_block", "r_block"))
                one = np.ones((len(v), 1)), np.ones((len(w), 1))
                norm, other = (v * v).sum(axis=1)[:, None], (w * w).sum(axis=1)[:, None]
                v, w = np.hstack([-2 * v, norm, one[0]]), np.hstack([w, one[1], other])  # their products are squared distances
                for a in (0, 1):
                    for b in (0, 1) if l != r else range(a, 2):
                        within = l == r and a == b
                        # keys that both blocks have are no pair inside a side
                        apart = within or a == b and len(np.intersect1d(k[slice(*rows[a])], m[slice(*columns[b])]))
                        for x in range(*rows[a], TILE[0]):
                            xs = slice(x, min(x + TILE[0], rows[a][1]))
                            for y in range(x if within else columns[b][0], columns[b][1], TILE[1]):
                                ys = slice(y, min(y + TILE[1], columns[b][1]))
                                squared = np.matmul(v[xs], w[ys].T, out=out.ravel()[: (xs.stop - x) * (ys.stop - y)].reshape(xs.stop - x, -1))
                                np.maximum(squared, 0, out=squared)
                                if apart:
                                    counts = k[xs, None] != m[ys]
                                    if within:
                                        counts &= np.arange(*xs.indices(len(k)))[:, None] < np.arange(*ys.indices(len(m)))
                                    yield a + b, squared[counts]
                                else:
                                    yield a + b, squared.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield result(tiles(batches))

    return cells.mapInArrow(run, schema)


def _median(cells: DataFrame) -> float:
    """Median of the squared distances of all pairs, between the two middle ones if even; exact up to the last bin's width."""
    def reach(blocks: Iterator) -> pa.RecordBatch:
        most, count = 0.0, 0
        for _, squared in blocks:
            most, count = float(np.maximum(most, squared.max(initial=0))), count + len(squared)
        return pa.RecordBatch.from_pydict({"most": [most], "n": [count]})

    found = _over_pairs(cells, reach, "most double, n long").agg(F.max("most"), F.sum("n")).first()
    if not found[1]:
        return float("nan")
    return _at_places(cells, sorted({(found[1] - 1) // 2, found[1] // 2}), float(found[0]))


def _at_places(cells: DataFrame, places: list[int], most: float) -> float:
    """Mean of the distances at the places, numbered from 0 in order: each pass counts the next digit of those that share the digits known so far, for all places at once."""
    if not np.isfinite(most):
        return float("nan")
    scale, top = BINS**NARROWINGS / most if most > BINS**NARROWINGS / np.finfo(float).max else 0.0, BINS**NARROWINGS - 1
    if not scale:
        return 0.0
    left, known = dict(zip(places, places)), dict.fromkeys(places, 0)  # places among those that share the digits, and the digits
    for narrowing in range(NARROWINGS):
        below = BIN_BITS * (NARROWINGS - 1 - narrowing)
        wanted = sorted(set(known.values()))

        def histogram(blocks: Iterator, below: int = below, wanted: list[int] = wanted, every: bool = not narrowing) -> pa.RecordBatch:
            count = np.zeros((len(wanted), BINS), np.int64)
            # a sieve of the distances that may share the digits, a little wide
            ends = [((head << below + BIN_BITS) / scale * (1 - 1e-9), (head + 1 << below + BIN_BITS) / scale * (1 + 1e-9)) for head in wanted]
            for _, squared in blocks:
                for k, head in enumerate(wanted):
                    near = squared if every else squared[(squared >= ends[k][0]) & (squared <= ends[k][1])]
                    digits = np.multiply(np.minimum(np.multiply(near, scale, out=near), top, out=near), 0.5**below, out=near).astype(np.int64)
                    own = digits if every else digits[digits >> BIN_BITS == head] & (BINS - 1)
                    count[k] += np.bincount(own, minlength=BINS)
            head, at = np.nonzero(count)
            return pa.RecordBatch.from_pydict({"head": np.array(wanted, np.int64)[head], "bin": at, "n": count[head, at]})

        seen = {(r["head"], r["bin"]): r["n"] for r in _over_pairs(cells, histogram, "head long, bin long, n long").groupBy("head", "bin").agg(F.sum("n").alias("n")).collect()}  # one row for each bin
        for place in places:
            counts = np.array([seen.get((known[place], b), 0) for b in range(BINS)])
            ends = np.cumsum(counts)
            digit = int(np.searchsorted(ends, left[place], "right"))
            left[place] -= int(ends[digit] - counts[digit])
            known[place] = known[place] << BIN_BITS | digit
    return float(np.mean([(d + 0.5) / scale for d in known.values()]))


def kernel_gap(a: DataFrame, b: DataFrame, vector: str, key: str, group: int = GROUP) -> DataFrame:
    """mmd: kernel distance of two sets with the median bandwidth over all pairs, not below 0.

    Pairs are never rows: blocks of rows meet in cells, where matrix products give the distances of a tile at a time. The median comes
    from histograms of all distances, each narrower than the one before, the kernel's mean from sums. Rows of a side with equal keys are
    no pair. The work is that of all pairs; a sample (`stats.mmd_gap`) bounds it. Disk is that of the vectors, which are kept as floats
    if they are floats. Null vectors take no part.
    """
    pick = lambda df, side: df.filter(F.col(vector).isNotNull()).select(F.lit(side).alias("s"), F.col(key).alias("k"), F.col(vector).alias("v"))
    both = pick(a, 0).unionByName(pick(b, 1))
    cells = _cells(both, both.count(), group)
    band = max(_median(cells), 1e-12)

    def sums(blocks: Iterator) -> pa.RecordBatch:
        total, count = np.zeros(3), np.zeros(3, np.int64)
        for kind, squared in blocks:
            total[kind] += np.exp(np.multiply(squared, -1 / band, out=squared), out=squared).sum()
            count[kind] += len(squared)
        return pa.RecordBatch.from_pydict({"kind": np.arange(3), "total": total, "n": count})

    means = _over_pairs(cells, sums, "kind long, total double, n long")
    mean = lambda k: F.try_divide(F.sum(F.when(F.col("kind") == k, F.col("total"))), F.sum(F.when(F.col("kind") == k, F.col("n"))))
    return means.agg(F.greatest(mean(0) + mean(2) - 2 * mean(1), F.lit(0.0)).alias("mmd"))
