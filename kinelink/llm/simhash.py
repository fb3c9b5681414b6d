"""Operator 8: SimHash near-duplicates, found by pigeonhole blocks.

Fingerprints that differ in at most three bits agree on three of six blocks of bits, so each distinct
fingerprint goes into twenty buckets, one for each choice of three blocks; every bucket's
members are compared by Hamming distance and give a spanning forest of their links, never all pairs.
Members of buckets above `bucket_limit` meet again by nine of twelve blocks, where a bucket has at most
2**18 different fingerprints whatever the input. Equal fingerprints are one node; rows of a
fingerprint, and fingerprints of a component, that make up a large share of all are not dealt by it.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null id gets a
fingerprint and component but never names one. Rows that repeat get equal answers. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelink.llm import similar
from kinelink.llm import words as W
from kinelink.llm.tables import checkpointed, free_names, heavy_join, row_key, row_slices
from kinelink.operators.graphs import connected_components

SHINGLE = 3
MOST_BITS = 3
SEED = 42


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    tokens = (text or "").encode().translate(W.FOLD_BYTES).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    k = min(k, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(tokens) - k + 1
    counts = np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist())
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in spans), W.U64, n)
    for i in range(0, n, 8192):
        counts += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = SHINGLE, bands: bool = False) -> DataFrame:
    """doc_id, key (of the text) and fp, the fingerprint as a signed long, of every row; with `bands` what `similar` needs too."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            found = np.fromiter((fingerprint(t, k) for t in batch.column("text").to_pylist()), W.U64, len(batch))
            wider = dict(zip(("size", "bands"), similar.banded(batch.column("text")))) if bands else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": found.view(np.int64)} | wider)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("key"), "text").mapInArrow(make, "doc_id long, key long, fp long" + bands * ", size int, bands array<long>")


def block_masks(blocks: int, differ: int = MOST_BITS) -> list[int]:
    """Bit masks, as signed longs, of every choice of all blocks but `differ`."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(keep) for keep in combinations(parts, blocks - differ)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _buckets(prints: DataFrame, blocks: int) -> DataFrame:
    """(table, key, fp, n): each fingerprint in each bucket of several, with the bucket's size; the answers of hot buckets are broadcast."""
    keys = F.array(*(F.struct(F.lit(t).cast("short").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks(blocks))))
    each = prints.select("fp", F.explode(keys).alias("bucket"))
    sizes = checkpointed(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").withColumn("n", F.col("rows")))
    return checkpointed(heavy_join(each, sizes, "bucket", "rows").select("bucket.table", "bucket.key", "fp", "n"))


def spanning_links(members: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within `most` bits, one fewer than members in each component."""
    left, heads, tails = np.unique(members), [], []
    queue: list = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= most
        if near.any():
            queue.extend(left[near])
            tails.append(left[near])
            heads.append(np.full(int(near.sum()), at, left.dtype))
            left = left[~near]
    none = np.empty(0, W.U64)
    return np.concatenate(heads or [none]), np.concatenate(tails or [none])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        column = batch.column("members")
        for i in range(len(column)):
            heads, tails = spanning_links(np.asarray(column[i].values).view(W.U64))
            a.append(heads)
            b.append(tails)
        none = [np.empty(0, W.U64)]
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a or none).view(np.int64), "b": np.concatenate(b or none).view(np.int64)})


def _links(bucketed: DataFrame) -> DataFrame:
    pairs = bucketed.filter("n = 2").groupBy("table", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b")
    more = bucketed.filter("n > 2").groupBy("table", "key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(_linked, "a long, b long")
    return pairs.unionByName(more)


def links(prints: DataFrame, bucket_limit: int = 4096) -> DataFrame:
    """(a, b): links within three bits that join every component of the distinct fingerprints."""
    bucketed = _buckets(prints, 6)
    crowded = bucketed.filter(F.col("n") > bucket_limit).select("fp").distinct()
    return _links(bucketed.filter((F.col("n") > 1) & (F.col("n") <= bucket_limit))).unionByName(_links(_buckets(crowded, 12).filter("n > 1")))


def _grouped(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, root (one fingerprint of its component by the edges), first_id and copies of every distinct fingerprint."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    roots = connected_components(edges)
    return checkpointed(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "copies"))


def near_duplicates(docs: DataFrame, bucket_limit: int = 4096) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable) of every row."""
    prints = checkpointed(fingerprints(docs))
    grouped = _grouped(prints, links(checkpointed(prints.select("fp").distinct()), bucket_limit))
    named = checkpointed(grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    answers = checkpointed(heavy_join(grouped.select("fp", "root", "copies"), named, "root", "members").select("fp", "component_id", "copies"))
    return heavy_join(prints, answers, "fp", "copies").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, bucket_limit: int = 4096, similarity: float | None = None) -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest id (null ids last), then the smallest text key, stays, once.

    With `similarity`, texts of that Jaccard similarity of five-word shingles are linked too (see `similar`).
    Rows that share an id but not a group are told apart by their text; of rows with equal id and text any one stays.
    """
    prints = checkpointed(fingerprints(docs, bands=similarity is not None))
    edges = checkpointed(links(checkpointed(prints.select("fp").distinct()), bucket_limit).distinct())
    edges = edges if similarity is None else edges.unionByName(similar.similar_links(docs, prints, edges, MOST_BITS, similarity))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"))
    kept = first.join(_grouped(prints, edges), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.key")
    doc_id, text_key = free_names(docs, "_id", "_key")
    keyed = docs.withColumn(doc_id, F.col("doc_id").cast("long")).withColumn(text_key, row_key("text"))
    same = (F.col(f"d.{text_key}") == F.col("k.key")) & F.col(f"d.{doc_id}").eqNullSafe(F.col("k.doc_id"))
    out = keyed.alias("d").join(checkpointed(kept).alias("k"), same, "left_semi")
    # rows of equal id and text are the same document and all but one go; where there are none the rows need not move
    repeated = not prints.groupBy("doc_id", "key").count().filter("count > 1").isEmpty()
    return (out.dropDuplicates([doc_id, text_key]) if repeated else out).drop(doc_id, text_key)
