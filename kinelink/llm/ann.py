"""Operator 11: nearest neighbours by inner product, through a hierarchical k-means tree searched best bin first.

Equal vectors are one class, with the k + 1 smallest ids that have it (no query needs more), so a vector that a third
of the rows share is compared once. The tree is fitted on a sample of classes (see `SAMPLE`); every class goes into its leaf. The
number of leaves a query visits is calibrated: the exact neighbours of `PROBES` query vectors are found among all classes, their leaves are
looked up in each probe's best-bin-first order, and visits widen until the share of neighbours in visited leaves reaches `recall`.

Neighbouring leaves make shards, and a query goes once to each shard that it visits, with the leaves to look at. A shard of
more than `PART` classes (one large leaf) is cut into parts, and so are the queries of a shard; each pair of parts is one
group: what a task holds is bounded, whatever the size of a leaf.
The tree is broadcast: at most `LEAVES` leaves, as their number grows with the table up to there. Beyond it leaves grow instead.

Scores are sums in double precision over the components in order; ties go to the smaller id, within leaves exactly.
Nulls: rows with a null id or vector, a zero or empty vector, or null or non-finite components take no part. Vectors of unequal
length count as zero beyond their ends. Rows equal in id and vector are one row. A query's own row is no candidate; rows that
share its id but not its vector are. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.llm.kmeans_tree import Tree
from kinelink.llm.tables import checkpointed, heavy_join
from kinelink.llm.vectors import best_of_each, matrix, usable, widest

NEAREST = 20
RECALL = 0.97
#: Classes in a leaf, as long as the tree has fewer than LEAVES leaves.
LEAF = 256
LEAVES = 8192
#: The tree is fitted on about so many classes for each leaf, drawn by their hash: 131,072 at most.
SAMPLE = 16
#: Query vectors that calibrate the visits, drawn by their hash.
PROBES = 256
PART = 65536
_CELLS = 1 << 21


def _classes(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """cid, v and ids (the k + 1 smallest, in order) of every distinct usable vector."""
    nonzero = F.exists(F.col("v"), lambda x: x != 0)
    read = rows.filter(usable(F.col(vector)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col(vector).alias("v")).filter(nonzero)
    each = read.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)
    found = each.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return checkpointed(found.select(F.monotonically_increasing_id().alias("cid"), "v", "ids", F.element_at("ids", 1).alias("name")))


def _drawn(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """About that share of the rows, by a hash of the vector."""
    return rows.filter(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products pair by pair, summed component after component."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * rows[:, d]
    return out


def _nearest(queries: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k nearest rows of each query, ties to the smaller name."""
    found = []
    few = max(1, _CELLS // max(1, len(rows)))
    norm = np.sqrt((rows**2).sum(axis=1)).max(initial=0)
    for a in range(0, len(queries), few):
        q = queries[a : a + few]
        rough = q @ rows.T  # sums in any order; what may reach the k-th place is summed again in order
        slack = 1e-12 * len(q[0]) * norm * np.sqrt((q**2).sum(axis=1))
        least = np.partition(rough, -k, axis=1)[:, -k] - slack if len(rows) > k else np.full(len(q), -np.inf)
        at, row = np.nonzero(rough >= least[:, None])
        score = _products(q[at], rows[row])
        top = best_of_each(at, score, names[row], k)
        found.append((a + at[top], row[top], score[top]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def _calibrated(classes: DataFrame, tree: Tree, probes: np.ndarray, width: int, k: int, recall: float) -> int:
    """The fewest visits at which the probes' exact neighbours lie in visited leaves to the share `recall`."""
    if tree.leaves == 1 or not len(probes):
        return tree.leaves
    sent = classes.sparkSession.sparkContext.broadcast((tree, probes))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, queries = sent.value
        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            rows, names = matrix(batch.column("v"), width), batch.column("name").to_numpy()
            at, row, score = _nearest(queries, rows, names, k + 1)
            near, place = np.unique(row, return_inverse=True)
            best = [np.concatenate(c) for c in zip(best, [at, score, names[row], shared.locate(rows[near])[place]])]
            top = best_of_each(best[0], best[1], best[2], k + 1)
            best = [c[top] for c in best]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["probe", "score", "name", "leaf"])

    found = classes.select("v", "name").mapInArrow(make, "probe long, score double, name long, leaf long")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "name")
    true = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).select("probe", "leaf").toPandas()  # a few for each probe
    sent.destroy()
    at = np.argsort(np.array(tree.visits(probes, tree.leaves)), axis=1)[true["probe"].to_numpy(), true["leaf"].to_numpy()]
    visits = 1
    while (at < visits).mean() < recall:
        visits += 1
    return visits


def _located(classes: DataFrame, tree: Tree, width: int) -> DataFrame:
    sent = classes.sparkSession.sparkContext.broadcast(tree)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.locate(matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    return classes.mapInArrow(make, f"cid long, v {dict(classes.dtypes)['v']}, name long, leaf int")


def _shards(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The shard of every leaf: neighbouring leaves together up to `capacity` classes."""
    shard, filled, out = 0, 0, []
    for size in sizes.tolist():
        if filled and filled + size > capacity:
            shard, filled = shard + 1, 0
        filled += size
        out.append(shard)
    return np.array(out)


def _visiting(wanted: DataFrame, tree: Tree, width: int, visits: int, least: int, sizes: np.ndarray, shards: np.ndarray) -> DataFrame:
    """(cid, v, shard, leaves): the leaves that each query visits, shard by shard."""
    sent = wanted.sparkSession.sparkContext.broadcast((tree, sizes, shards))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked, held, shard_of = sent.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                row, shard, leaves = [], [], []
                for i, seen in enumerate(walked.visits(matrix(part.column("v"), width), visits, held, least)):
                    by_shard: dict[int, list[int]] = {}
                    for x in seen:
                        by_shard.setdefault(int(shard_of[x]), []).append(x)
                    row += [i] * len(by_shard)
                    shard += by_shard
                    leaves += by_shard.values()
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("cid").take(at), part.column("v").take(at), pa.array(shard, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["cid", "v", "shard", "leaves"])

    return wanted.select("cid", "v").mapInArrow(make, f"cid long, v {dict(wanted.dtypes)['v']}, shard int, leaves array<int>")


def _in_shard(width: int, k: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if len(rows) and len(queries):
            rows = rows.sort_by("leaf")
            v, names, cids, leaf = matrix(rows.column("v").combine_chunks(), width), *(rows.column(c).to_numpy() for c in ("name", "cid", "leaf"))
            for part in (queries.slice(i, 512) for i in range(0, len(queries), 512)):
                q, visited, asking = matrix(part.column("v").combine_chunks(), width), part.column("leaves").combine_chunks(), part.column("cid").to_numpy()
                owner = np.repeat(np.arange(len(part)), pc.list_value_length(visited).to_numpy(zero_copy_only=False))
                wants = visited.flatten().to_numpy(zero_copy_only=False)
                found = []
                for x in np.unique(wants):
                    a, b = np.searchsorted(leaf, [x, x + 1])
                    if a < b:
                        who = owner[wants == x]
                        at, row, score = _nearest(q[who], v[a:b], names[a:b], k + 1)
                        found.append((who[at], a + row, score))
                if found:
                    at, row, score = (np.concatenate(c) for c in zip(*found))
                    top = best_of_each(at, score, names[row], k + 1)
                    for column, values in zip(out, (asking[at[top]], cids[row[top]], names[row[top]], score[top])):
                        column.append(values)
        return pa.table([np.concatenate(c) for c in out], ["cid", "near", "name", "score"])

    return search


def _searched(classes: DataFrame, wanted: DataFrame, tree: Tree, width: int, visits: int, k: int, part: int) -> DataFrame:
    """(cid, near, score): the k + 1 best classes found for every wanted class."""
    spark = classes.sparkSession
    located = checkpointed(_located(classes, tree, width))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in located.groupBy("leaf").count().collect():  # a row for each leaf of the tree
        sizes[r["leaf"]] = r["count"]
    # about a dozen shards at least, so that a small table is dealt out too
    shards = _shards(sizes, min(part, max(1024, int(sizes.sum()) // 12)))
    asked = checkpointed(_visiting(wanted, tree, width, visits, k + 1, sizes, shards))
    asking = {r["shard"]: r["count"] for r in asked.groupBy("shard").count().collect()}  # a row for each shard
    held = np.bincount(shards, sizes)
    dealt = F.broadcast(spark.createDataFrame([(x, s, -(-int(held[s]) // part), -(-asking.get(s, 0) // part)) for x, s in enumerate(shards.tolist())], "leaf int, shard int, row_parts int, query_parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    rows = located.join(dealt.filter("row_parts > 0 AND query_parts > 0"), "leaf").select("shard", own("row_parts").alias("row_part"), each("query_parts").alias("query_part"), "cid", "v", "name", "leaf")
    queries = asked.join(dealt.select("shard", "row_parts", "query_parts").distinct().filter("row_parts > 0"), "shard").select("shard", each("row_parts").alias("row_part"), own("query_parts").alias("query_part"), "cid", "v", "leaves")
    key = ["shard", "row_part", "query_part"]
    found = rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_in_shard(width, k), "cid long, near long, name long, score double")
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "name")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).select("cid", "near", "score")


def nearest_neighbours(rows: DataFrame, queries: Column, vector: str = "embedding", k: int = NEAREST, recall: float = RECALL, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row that `queries`, a condition on the columns, holds for."""
    if k < 1 or not 0 < recall <= 1:
        raise ValueError("k is 1 at least and recall lies in (0, 1]")
    classes, width = _classes(rows, vector, k), widest(rows, vector)
    asking = rows.filter(usable(F.col(vector)) & F.col("vec_id").isNotNull() & queries).select(F.col("vec_id").cast("long").alias("query_id"), F.col(vector).alias("v")).distinct()
    owners = checkpointed(asking.join(classes.select("cid", "v"), "v").select("query_id", "cid"))
    # a class's queries are counted, so that those of a hot one stay where they are when they get their answers
    wanted = checkpointed(classes.join(owners.groupBy("cid").agg(F.count(F.lit(1)).alias("n_queries")), "cid").select("cid", "v", "n_queries"))
    n, n_wanted = classes.count(), wanted.count()
    leaves = min(LEAVES, max(1, n // leaf))
    sample, probes = (_stacked(_drawn(t, share, seed), width) for t, share, seed in ((classes, SAMPLE * leaves / max(1, n), 1), (wanted, PROBES / max(1, n_wanted), 2)))
    tree = Tree(sample, SAMPLE if leaves > 1 else len(sample))
    visits = _calibrated(classes, tree, probes, width, k, recall)
    found = _searched(classes.select("cid", "v", "name"), wanted, tree, width, visits, k, part)
    near = found.join(classes.select(F.col("cid").alias("near"), "ids"), "near").select("cid", "near", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    listed = ranked.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "near"))).alias("listed"))
    each = heavy_join(owners, checkpointed(listed.join(wanted.select("cid", "n_queries"), "cid")), "cid", "n_queries")
    others = F.slice(F.filter("listed", lambda x: (x["vec_id"] != F.col("query_id")) | (x["near"] != F.col("cid"))), 1, k)
    ranks = each.select("query_id", F.posexplode(others).alias("pos", "one"))
    return ranks.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))


def _stacked(rows: DataFrame, width: int) -> np.ndarray:
    """The vectors of a bounded draw, in the order of their hash."""
    vectors = [r["v"] for r in rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").collect()]
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def report(rows: DataFrame) -> DataFrame:
    """The contract's queries: ids divisible by 20."""
    return nearest_neighbours(rows, F.col("vec_id") % 20 == 0)
