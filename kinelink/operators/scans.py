"""Running recurrences over ordered rows, h = a * h_before + b, as segmented scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from kinelink.operators.storage import checkpointed

#: A series is cut wherever its order passes a multiple of this.
SEGMENT = 256


def _composed(rows: DataFrame, over: WindowSpec, steps: int) -> DataFrame:
    """Replaces the map (_a, _b) of every row by that of all rows of its window up to it, by doubling.

    After step j a row holds the map of the 2**j rows that end in it; `lag` gives the map of those before.
    """
    for j in range(steps):
        a, b = (F.lag(c, 1 << j).over(over) for c in ("_a", "_b"))
        rows = rows.withColumns({"_pa": a, "_pb": b}).withColumns({"_b": F.col("_b") + F.col("_a") * F.coalesce("_pb", F.lit(0.0)), "_a": F.col("_a") * F.coalesce("_pa", F.lit(1.0))})
    return rows.drop("_pa", "_pb")


def affine_scan(rows: DataFrame, by: list[str], order: str, factor: Column, term: Column, name: str, segment: int = SEGMENT) -> DataFrame:
    """Adds h of every row: factor * (h of the row of `by` before it) + term, from 0.

    A series is cut into segments of `segment` values of its whole-number order, and a segment is folded in order, so a long series is
    dealt out in bounded pieces. Each segment is then one map; maps are composed over the segments of a series, and the value carried into
    a segment is applied to its rows. Rows of one order value are taken in any order; beyond many of them a segment grows.
    """
    columns = rows.columns
    cell = F.struct(F.col(order).alias("o"), factor.cast("double").alias("a"), term.cast("double").alias("b"), F.struct(*columns).alias("row"))
    held = rows.groupBy(*by, F.floor(F.col(order) / segment).alias("_seg")).agg(F.array_sort(F.collect_list(cell), lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)).alias("_rows"))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("h"), F.expr("cast(array() as array<struct<a:double,h:double>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        a, h = state["a"] * x["a"], x["a"] * state["h"] + x["b"]
        return F.struct(a.alias("a"), h.alias("h"), F.array_append(state["out"], F.struct(a.alias("a"), h.alias("h"))).alias("out"))

    folded = checkpointed(held.withColumn("_fold", F.aggregate("_rows", start, step)).select(*by, "_seg", "_rows.row", "_fold"))
    ends = folded.select(*by, "_seg", F.col("_fold.a").alias("_a"), F.col("_fold.h").alias("_b"))
    across = Window.partitionBy(*by).orderBy("_seg")
    carried = _composed(ends, across, _doublings(ends, by)).select(*by, "_seg", F.lag("_b", 1, 0.0).over(across).alias("_in"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_seg"]]
    both = folded.alias("l").join(carried.alias("r"), same, "left").select(F.explode(F.arrays_zip(F.col("l.row").alias("row"), F.col("l._fold.out").alias("map"))).alias("_x"), F.col("r._in").alias("_in"))
    return both.select(*(F.col("_x.row")[c].alias(c) for c in columns), (F.col("_x.map.h") + F.col("_x.map.a") * F.col("_in")).alias(name))


def _doublings(rows: DataFrame, by: list[str]) -> int:
    """Steps until a map covers the longest run of rows of one key."""
    longest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return (longest - 1).bit_length()
