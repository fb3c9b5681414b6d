"""Reading the given tables, row keys, blocks of rows and checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelink.operators.storage import checkpointed

__all__ = ["block_count", "checkpointed", "free_names", "heavy_join", "in_blocks", "row_key", "row_slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(*columns: str) -> Column:
    """64-bit key of a row's content; equal rows have equal keys."""
    return F.xxhash64(*columns)


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """How many blocks of about block_bytes of text the documents fill."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


TASK_BYTES = 16 << 20


def in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Adds `block`: documents dealt by a hash into blocks of about block_bytes, hot sources or not, and shuffled by it.

    The number of partitions follows the input, about TASK_BYTES for each. Rows equal in id and text share a block.
    """
    blocks = block_count(docs, block_bytes)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return dealt.repartition(max(blocks * block_bytes // TASK_BYTES, min(blocks, dealt.sparkSession.sparkContext.defaultParallelism)), "block")


#: A key is heavy if more than one in so many rows has it, so there are fewer heavy keys than this.
HEAVY_SHARE = 1000


def heavy_join(rows: DataFrame, answers: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with their key's one row of answers, whose column `count` says how many rows have the key.

    The answers of heavy keys, fewer than HEAVY_SHARE whatever the input, are broadcast, so their rows stay where
    they are; all other rows meet by shuffle. Both tables are read twice and should be checkpointed.
    """
    total = rows.count()
    heavy = F.col(count) * HEAVY_SHARE > total
    busy, calm = F.broadcast(answers.filter(heavy).drop(count)), answers.filter(~heavy).drop(count)
    return rows.join(busy, key).unionByName(rows.join(busy.select(key), key, "left_anti").join(calm, key))


SLICE_BYTES = 4 << 20


def row_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `size` bytes of the column, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first, n = 0, len(batch)
        while first < n:
            before = int(ends[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(first, end - first)
            first = end
