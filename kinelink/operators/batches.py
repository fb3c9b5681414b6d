"""Batch planning for training: which rows go together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelink.operators.storage import checkpointed


#: Batches of a shard, about.
SHARD_BATCHES = 1000


def same_group_batches(rows: DataFrame, group: str, size: int, seed: int, shards: int | None = None) -> DataFrame:
    """Adds batch: groups stay together and fill batches in hash order, within shards; a group above the size is cut.

    A batch starts where the shard's running count of rows passes a multiple of the size. Unless given, shards follow the
    rows, one for about SHARD_BATCHES batches.
    """
    shards = shards or max(1, rows.count() // (size * SHARD_BATCHES))
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.struct(*rows.columns)))
    cut = rows.withColumn("_part", F.floor((F.row_number().over(w) - 1) / size)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group, "_part")))
    units = cut.select(group, "_part", "_n").distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(group), "_part")).withColumn("_shard", F.pmod("_h", F.lit(shards)))
    # a unit's slot: rows before it, each unit padded so that none straddles two batches
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_h", group, "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = units.withColumn("_slot", F.floor(before / size)).withColumn("batch", F.concat_ws(":", F.col("_shard").cast("string"), F.col("_slot").cast("string")))
    return cut.join(slots.select(group, "_part", "batch"), [group, "_part"]).drop("_part", "_n")


def domain_balanced_batches(rows: DataFrame, domain: str, key: str, size: int, seed: int) -> DataFrame:
    """Adds batch and slot: rows of each domain in hash order, taken round robin over the domains."""
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(F.xxhash64(F.lit(seed), key), key)) - 1
    domains = rows.select(domain).distinct().withColumn("_d", F.row_number().over(Window.orderBy(domain)) - 1)
    count = domains.agg(F.count(F.lit(1)).alias("_m"))
    out = rows.withColumn("_r", rank).join(F.broadcast(domains), domain).crossJoin(F.broadcast(count))
    place = F.col("_r") * F.col("_m") + F.col("_d")
    return out.withColumn("batch", F.floor(place / size)).withColumn("slot", place % size).drop("_r", "_d", "_m")


def hard_negatives(rows: DataFrame, key: str, action: str, activity: str, k: int, seed: int | None = None, parts: int | None = None) -> DataFrame:
    """(anchor, negative, rank): the k rows of the same action with the nearest activity, ties by key; fewer where the action has fewer others.

    They are among the k + 1 smallest keys of the anchor's own activity and the k smallest of each of the k different activities
    before and after. Activities are dealt by ranges of (action, activity), into `parts` if given, and each range also gets the k
    activities of its action before it and after it, so a hot action is dealt out. Keys are unique; a row whose action
    or activity is null has none. `seed` is not used: nothing is drawn.
    """
    known = rows.select(F.col(key).alias("_key"), F.col(action).alias("_action"), F.col(activity).alias("_x")).filter("_action is not null and _x is not null")
    smallest = F.row_number().over(Window.partitionBy("_action", "_x").orderBy("_key"))
    levels = known.withColumn("_r", smallest).filter(F.col("_r") <= k + 1).groupBy("_action", "_x").agg(F.collect_list(F.struct("_x", "_key")).alias("_own"))
    by_range = ["_action", "_x"]
    dealt = checkpointed((levels.repartitionByRange(*by_range) if parts is None else levels.repartitionByRange(parts, *by_range)).withColumn("_part", F.spark_partition_id()))
    halo = _halo(dealt, k, before=True).unionByName(_halo(dealt, k, before=False))
    both = dealt.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
    beside = Window.partitionBy("_part", "_action").orderBy("_x").rowsBetween(-k, k)
    pools = both.withColumn("_pool", F.flatten(F.collect_list("_own").over(beside))).filter("not _halo").select("_action", "_x", "_pool")
    near = F.transform(F.filter("_pool", lambda p: p["_key"] != F.col("_key")), lambda p: F.struct(F.abs(p["_x"] - F.col("_x")).alias("d"), p["_key"].alias("negative")))
    best = known.join(pools, ["_action", "_x"]).select(F.col("_key").alias("anchor"), F.posexplode(F.slice(F.array_sort(near), 1, k)).alias("_at", "_n"))
    return best.select("anchor", F.col("_n.negative").alias("negative"), (F.col("_at") + 1).alias("rank"))


def _halo(dealt: DataFrame, k: int, before: bool) -> DataFrame:
    """For every range and action the k activities right before (or after) those it has, as rows of that range.

    Only the last (first) k activities of each range can be in another's halo: a few rows for each range, whatever the rows in it.
    """
    own = Window.partitionBy("_part", "_action")
    inner, outer = (F.desc("_x"), F.col("_x")) if before else (F.col("_x"), F.desc("_x"))
    edge = dealt.withColumn("_n", F.row_number().over(own.orderBy(inner))).filter(F.col("_n") <= k)
    around = Window.partitionBy("_action").orderBy("_x").rowsBetween(*((-k, -1) if before else (1, k)))
    seen = edge.withColumn("_near", F.collect_list(F.struct("_x", "_own")).over(around)).withColumn("_n", F.row_number().over(own.orderBy(outer)))
    return seen.filter("_n = 1").select("_action", "_part", F.explode("_near").alias("_o")).select("_action", "_o._x", "_o._own", "_part")
