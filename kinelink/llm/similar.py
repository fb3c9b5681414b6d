"""Links between texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Twenty bands of five minhashes bring texts together (a pair at similarity s meets with probability
1 - (1 - s^5)^20, 0.9996 at 0.8). In a bucket of up to `ALL_PAIRS` different texts every pair is decided by its exact
similarity. In a larger one texts that are linked already need no comparison: the texts outside the bucket's largest component are dealt
into groups, so are those inside it, and each cell of two groups, one of them outside, is compared in one task by counting common shingles in arrays, which
gives back no more links than join its components. Only buckets of more than `CELL_TEXTS` texts compare all texts with a few leads before, so that a hot group of
alike texts is contracted in time of its size. Pairs are never rows in the cells, a text is in a bucket's cells as often as there are groups, and every pair that meets is decided or joined already. Shingles are told apart by 64-bit hashes of folded words, under a
key drawn for each run where they decide; a text of fewer words is one shingle.

Nulls: a null text, like an empty one, has no shingle and no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.llm import words as W
from kinelink.llm.tables import checkpointed, heavy_join, row_key, row_slices
from kinelink.operators.graphs import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SEED = 42
ALL_PAIRS = 8
#: Leads of a bucket that is larger than a cell.
FIRST_LEADS = 2
#: A group of a cell has about so many texts, and about so many shingles, at most.
CELL_TEXTS = 1024
CELL_SHINGLES = 1 << 20
#: Keys of texts that are broadcast, at most; more meet by shuffle.
BROADCAST_KEYS = 1_000_000
_A, _B = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), W.U64)
_A |= W.U64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE, key: int = 0) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of every text, under the key."""
    for _, _, data, offsets in W.text_slices(column):
        folded = W.FOLD[data]
        starts, ends, bounds = W.word_spans(folded, offsets)
        hashes = W.word_hashes(folded, starts, ends, key)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            yield np.unique(W.window_hashes(hashes[a:b], min(k, b - a))) if b > a else np.empty(0, W.U64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The band keys of sets that are not empty, one row each."""
    out = np.empty((len(sets), BANDS), W.U64)
    if sets:
        every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for band in range(BANDS):
            key = np.full(len(sets), band + 1, W.U64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                key = W.mix(key * W.U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(every * _A[i] + _B[i], starts))
            out[:, band] = key
    return out


def banded(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The number of shingles and the band keys, signed, of every text."""
    sets = list(shingle_sets(column))
    sizes = np.fromiter(map(len, sets), np.int32, len(sets))
    keys = band_keys([s for s in sets if len(s)])
    ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)])
    return pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))


def _shingled(key: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, size=1 << 20):
            sets = list(shingle_sets(batch.column("text"), key=key))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "shingles": lists})

    return make


def _near(x: str, y: str, similarity: float) -> Column:
    return F.least(x, y) >= similarity * F.greatest(x, y)


def _alike(similarity: float) -> Column:
    common = F.size(F.array_intersect("x", "y"))
    return common >= similarity * (F.size("x") + F.size("y") - common)


def _met(live: DataFrame) -> DataFrame:
    """(lead, own): texts of crowded buckets with those texts of their bucket that lead in this round, of other components."""
    one = F.struct("key", "fp", "size", "root")
    crowds = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    leads = checkpointed(live.filter("leads").groupBy("bucket").agg(F.collect_list(one).alias("leads")).join(crowds, "bucket"))
    both = heavy_join(live.select("bucket", one.alias("own")), leads, "bucket", "n").select(F.explode(F.filter("leads", lambda x: x["root"] != F.col("own.root"))).alias("lead"), "own")
    return both


def _few(members: DataFrame) -> DataFrame:
    """(lead, own): every pair of texts of a bucket of few."""
    few = members.groupBy("bucket").agg(F.collect_list(F.struct("key", "fp", "size", F.col("fp").alias("root"))).alias("all"))
    return few.select(F.explode("all").alias("lead"), "all").select("lead", F.explode("all").alias("own")).filter("lead.key < own.key")


class _Decider:
    """Decides pairs of texts by their shingles; the shingles of a text are made once."""

    def __init__(self, docs: DataFrame, texts: DataFrame, bits: int, similarity: float):
        self.docs, self.texts, self.bits, self.similarity = docs, texts, bits, similarity
        self.key, self.sets = W.secret(), None

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(key, shingles) of all texts asked for so far."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("key"), "key", "left_anti")
        more = _chosen_sets(self.docs, self.texts.select("key", "doc_id").join(wanted, "key"), self.key)
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def links(self, met: DataFrame) -> DataFrame:
        """(a, b): the fingerprints of the pairs that are similar and more than `bits` bits apart."""
        far = F.bit_count(F.col("lead.fp").bitwiseXOR(F.col("own.fp"))) > self.bits
        pairs = checkpointed(met.filter(far & _near("own.size", "lead.size", self.similarity)).select(F.col("lead.key").alias("a"), F.col("own.key").alias("b"), F.col("lead.fp").alias("a_fp"), F.col("own.fp").alias("b_fp")).distinct())
        sets = self.sets_of(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
        leads = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")).join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
        others = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
        found = heavy_join(pairs, checkpointed(leads), "a", "n").join(others, "b").filter(_alike(self.similarity))
        return checkpointed(found.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct())

    def cell_links(self, rooted: DataFrame) -> DataFrame:
        """(a, b): fingerprints of similar texts of different components that share a bucket; they join all components with such texts."""
        cells = checkpointed(_cells(rooted))
        sets = self.sets_of(cells.select("key").distinct())
        similarity = self.similarity

        def links(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _links_of_cell(pa.Table.from_batches(list(batches)), key[1].as_py(), key[2].as_py(), similarity)

        return checkpointed(cells.join(sets, "key").groupBy("bucket", "g", "h").applyInArrow(links, "a long, b long").distinct())


def _chosen_sets(docs: DataFrame, wanted: DataFrame, key: int) -> DataFrame:
    """(key, shingles) of the texts wanted by doc_id and key; the texts move only if there are too many to broadcast their keys."""
    chosen = checkpointed(wanted)
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("key"), "text").alias("d")
    same = (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    return checkpointed(keyed.join(chosen.alias("w"), same).select("d.key", "text").mapInArrow(_shingled(key), "key long, shingles array<long>").dropDuplicates(["key"]))


def similar_links(docs: DataFrame, prints: DataFrame, base: DataFrame, bits: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between fingerprints of similar texts that, with the links `base`, join every group of similar texts.

    prints, checkpointed, has doc_id, key (of the text), fp, size and bands of every row; base, checkpointed, has the links a, b of
    fingerprints up to `bits` bits apart.
    """
    texts = checkpointed(prints.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.first("bands").alias("bands")))
    met = checkpointed(texts.select("key", "fp", "size", F.explode("bands").alias("bucket")))
    crowds = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("_lo"), F.max("fp").alias("_hi")).filter("_lo < _hi")
    members = checkpointed(heavy_join(met, checkpointed(crowds.select("bucket", "n", F.col("n").alias("crowd"))), "bucket", "n"))
    decider = _Decider(docs, texts, bits, similarity)
    found = decider.links(_few(members.filter(F.col("crowd") <= ALL_PAIRS)))
    crowded = members.filter(F.col("crowd") > ALL_PAIRS).select("bucket", "key", "fp", "size", "crowd")
    hot = _with_leads(_rooted(crowded.filter(F.col("crowd") > CELL_TEXTS), base.unionByName(found)))
    if hot.count():
        found = found.unionByName(decider.links(_met(hot)))
    return found.unionByName(decider.cell_links(_rooted(crowded, base.unionByName(found))))


def _rooted(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """The texts of crowded buckets with `root`, a text's component by the links."""
    roots = connected_components(links)
    return checkpointed(crowded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("bucket", "key", "fp", "size", F.coalesce("root", "fp").alias("root")))


def _components_of(rooted: DataFrame) -> DataFrame:
    """(bucket, largest, n, texts, shingles, inner_texts, inner_shingles) of buckets of two components or more: its largest component, and how much is outside and inside it."""
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("part"), F.sum("size").alias("much"))
    top = F.max_by(F.struct("root", "part", "much"), F.struct("part", "root")).alias("top")
    every = parts.groupBy("bucket").agg(top, F.sum("part").alias("n"), F.sum("much").alias("all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return every.select("bucket", F.col("top.root").alias("largest"), "n", (F.col("n") - F.col("top.part")).alias("texts"), (F.col("all") - F.col("top.much")).alias("shingles"), F.col("top.part").alias("inner_texts"), F.col("top.much").alias("inner_shingles"))


def _with_leads(rooted: DataFrame) -> DataFrame:
    """The texts of buckets of two components or more; `leads` says of a few outside the largest that they lead."""
    largest = checkpointed(_components_of(rooted).select("bucket", "largest", "n"))
    beside = heavy_join(rooted, largest, "bucket", "n").filter("root <> largest")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("bucket", "key"), "key")
    chosen = checkpointed(beside.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FIRST_LEADS).select("bucket", "key", F.lit(True).alias("leads")))
    open_ = rooted.join(largest.select("bucket"), "bucket", "left_semi")
    return checkpointed(open_.join(chosen, ["bucket", "key"], "left").withColumn("leads", F.coalesce("leads", F.lit(False))))


def _cells(rooted: DataFrame) -> DataFrame:
    """(bucket, g, h, own, key, fp, root): the texts of each cell; groups outside the largest component come first, and no cell has two groups inside it."""
    groups = lambda texts, shingles: F.greatest(F.ceil(F.col(texts) / CELL_TEXTS), F.ceil(F.col(shingles) / CELL_SHINGLES)).cast("int")
    sizes = checkpointed(_components_of(rooted).select("bucket", "largest", "n", groups("texts", "shingles").alias("outer"), groups("inner_texts", "inner_shingles").alias("inner")))
    dealt = heavy_join(rooted, sizes, "bucket", "n").withColumn("_in", F.col("root") == F.col("largest"))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    own = F.when(F.col("_in"), F.col("outer") + place("inner")).otherwise(place("outer"))
    last = F.col("outer") - 1 + F.when(F.col("_in"), 0).otherwise(F.col("inner"))
    met = dealt.select("bucket", "key", "fp", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select("bucket", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own", "key", "fp", "root")


#: A shingle of few pairs of texts is counted pair by pair, others in matrix products of so many shingles.
FEW_PAIRS, PRODUCT = 64, 2048


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets, one of each side, have in common."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
        at = np.searchsorted(shared, every)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == every[hit]
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order], np.bincount(at[hit], minlength=len(shared))))
    (lrow, lcol, ln), (rrow, rcol, rn) = sides
    few, begin = ln * rn <= FEW_PAIRS, np.cumsum(rn) - rn
    rows, cols = lrow[few[lcol]], lcol[few[lcol]]
    times = rn[cols]
    places = np.repeat(begin[cols] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    counts = np.bincount(np.repeat(rows, times) * len(right) + rrow[places], minlength=len(left) * len(right)).reshape(len(left), len(right))
    number = np.cumsum(~few) - 1
    lrow, lcol, rrow, rcol = lrow[~few[lcol]], number[lcol[~few[lcol]]], rrow[~few[rcol]], number[rcol[~few[rcol]]]
    for first in range(0, int((~few).sum()), PRODUCT):
        here = []
        for row, col, n in ((lrow, lcol, len(left)), (rrow, rcol, len(right))):
            a, b = np.searchsorted(col, [first, first + PRODUCT])
            here.append(np.zeros((n, PRODUCT), np.float32))
            here[-1][row[a:b], col[a:b] - first] = 1
        counts += np.rint(here[0] @ here[1].T).astype(np.int64)
    return counts


def _links_of_cell(table: pa.Table, g: int, h: int, similarity: float) -> pa.RecordBatch:
    """(a, b): a forest of links between the components of a cell's similar texts."""
    own, fp, root = (table.column(c).to_numpy() for c in ("own", "fp", "root"))
    sets = [np.asarray(x).view(W.U64) for x in table.column("shingles").to_numpy()]
    left, right = np.flatnonzero(own == g), np.flatnonzero(own == h)
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        common = common_counts([sets[i] for i in left], [sets[i] for i in right])
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        x, y = size[left][:, None], size[right]
        alike = (np.minimum(x, y) >= similarity * np.maximum(x, y)) & (common >= similarity * (x + y - common)) & (root[left][:, None] != root[right])
        i, j = np.nonzero(alike)
        _, at = np.unique(np.stack([root[left[i]], root[right[j]]]), axis=1, return_index=True)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for p, q in zip(left[i[at]].tolist(), right[j[at]].tolist()):
            a, b = top(int(root[p])), top(int(root[q]))
            if a != b:
                parent[a] = b
                links.append((int(fp[p]), int(fp[q])))
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
