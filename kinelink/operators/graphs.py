"""Connected components and minimum spanning forests of graphs, by contraction.

Every round each node (or component) moves to a neighbour, and only edges between what is left go on. Once at most `at_once`
edges are left, one task finishes them: what it holds is bounded by that number, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelink.operators.storage import checkpointed

#: Edges that one task finishes.
AT_ONCE = 1 << 17


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = AT_ONCE) -> DataFrame:
    """(node, root) of every node of the edges; root is one of the component's nodes.

    Each round shrinks every component of two nodes or more to at most half its nodes: every node joins its smallest
    neighbour. Null ends and loops count for nothing.
    """
    left = checkpointed(_plain(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    roots = None
    while left.count() > at_once:
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = checkpointed(ends.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("parent")))
        roots = parents.withColumnRenamed("parent", "root") if roots is None else checkpointed(_moved(roots, parents))
        pa_, pb = parents.withColumnsRenamed({"node": "a", "parent": "pa"}), parents.withColumnsRenamed({"node": "b", "parent": "pb"})
        left = checkpointed(_plain(left.join(pa_, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    kind = left.schema["a"].dataType.simpleString()
    rest = checkpointed(left.coalesce(1).mapInArrow(_components, f"node {kind}, parent {kind}"))
    return rest.withColumnRenamed("parent", "root") if roots is None else checkpointed(_moved(roots, rest))


def _moved(roots: DataFrame, parents: DataFrame) -> DataFrame:
    """roots whose root has a parent take it."""
    moved = parents.withColumnsRenamed({"node": "root", "parent": "_p"})
    return roots.join(moved, "root", "left").select("node", F.coalesce("_p", "root").alias("root"))


def _plain(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values, structs too, get equal numbers from 0."""
    if not pa.types.is_struct(column.type):
        return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.zeros(len(column), np.int64)
    for field in map(_codes, column.flatten()):
        code = np.unique(code * (field.max(initial=0) + 1) + field, return_inverse=True)[1].astype(np.int64)
    return code


def _ends(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All ends of the edges, the first place of each node among them, and each edge's two nodes by number."""
    ends = pa.concat_arrays([c for name in ("a", "b") for c in table.column(name).chunks])
    first, code = np.unique(_codes(ends), return_index=True, return_inverse=True)[1:]
    return ends, first, code[: len(table)], code[len(table) :]


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    ends, first, a, b = _ends(pa.Table.from_batches(held))
    root = np.arange(len(first))
    while (apart := root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b])[apart], np.minimum(root[a], root[b])[apart])
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([ends.take(pa.array(first)), ends.take(pa.array(first[root]))], ["node", "parent"])


def spanning_forest(edges: DataFrame, order: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """(a, b, order) of the edges of the minimum spanning forest; edges compare by the columns of order, then by a and b.

    Rounds after Boruvka: every component takes its least edge to another one, all of these are in the forest, and they
    are contracted. Null ends and loops count for nothing; of equal edges one counts.
    """
    edge = F.struct(*order, "a", "b")
    left = checkpointed(edges.filter(F.col("a") != F.col("b")).select(edge.alias("e"), "a", "b").distinct())
    chosen = []
    while left.count() > at_once:
        ends = left.unionByName(left.select("e", F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(ends.groupBy("a").agg(F.min("e").alias("e"), F.min_by("b", "e").alias("b")))
        chosen.append(least.select("e"))
        roots = connected_components(least, at_once=at_once)
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = checkpointed(left.join(ra, "a").join(rb, "b").select("e", F.col("ra").alias("a"), F.col("rb").alias("b")).filter(F.col("a") != F.col("b")))
    # sorted here, so that the task takes the edges as they come
    found = left.coalesce(1).sortWithinPartitions("e").mapInArrow(_forest, f"e {left.schema['e'].dataType.simpleString()}")
    for part in chosen:
        found = found.unionByName(part)
    return found.distinct().select("e.*")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    _, first, a, b = _ends(table)
    root, taken = list(range(len(first))), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[y] = x
            taken.append(i)
    yield from table.select(["e"]).take(taken).to_batches()
