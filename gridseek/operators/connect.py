"""Connectivity of cell sets: joins on neighbouring cells or buckets, never on ranges.

Two datasets are connected within delta: for delta up to 1 if some two of their cells touch or are the
same (corners count), beyond if some two cells are at most delta apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.plans.lineage import settled
from gridseek.plans.sizes import small_side


def _around(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Each row for each of the nine neighbours (itself included) of its cell or bucket (x, y)."""
    steps = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    wide = frame.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return wide.withColumns({x: F.col(x) + F.col("dx"), y: F.col(y) + F.col("dy")}).drop("dx", "dy")


def connected(cells: DataFrame, query: DataFrame, delta: float = 0, keys: tuple[str, ...] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Keys of the datasets of cells that are connected to the query; by: columns in which both sides must agree."""
    keys = keys or tuple(c for c in ("source_id", "dataset_id") if c in cells.columns)
    own = query.select(*by, "cx", "cy").distinct()
    if delta <= 1:
        near = _around(own, "cx", "cy").distinct()
        return cells.join(small_side(near), [*by, "cx", "cy"], "left_semi").select(*keys).distinct()
    # any two cells of a small square are within delta: what shares one is connected and needs no more looks
    small = int(delta / 2**0.5) + 1
    tiles = [F.floor(F.col(c) / small).alias(t) for c, t in (("cx", "tx"), ("cy", "ty"))]
    mine = cells.select(*dict.fromkeys((*keys, *by)), "cx", "cy")
    sure = settled(mine.select("*", *tiles).join(small_side(own.select(*by, *tiles).distinct()), [*by, "tx", "ty"], "left_semi").select(*keys).distinct())
    rest = mine.join(small_side(sure), list(keys), "left_anti")
    # squares of the side delta: what is within delta is in the same or a neighbouring square
    side = max(1, int(-(-delta // 1)))
    square = {"bx": F.floor(F.col("cx") / side), "by_": F.floor(F.col("cy") / side)}
    near = _around(own.withColumns(square), "bx", "by_").select(*by, "bx", "by_", F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    apart = (F.col("cx") - F.col("qx")) * (F.col("cx") - F.col("qx")) + (F.col("cy") - F.col("qy")) * (F.col("cy") - F.col("qy"))
    met = rest.withColumns(square).join(small_side(near), [*by, "bx", "by_"])
    return sure.unionByName(met.where(apart <= float(delta) * float(delta)).select(*keys).distinct())


def is_connected(one: DataFrame, other: DataFrame, delta: float = 0) -> bool:
    """Whether two cell sets are connected."""
    return not connected(one.select(F.lit(1).alias("dataset_id"), "cx", "cy"), other, delta).isEmpty()


def reach(delta: float) -> float:
    """Distance of balls within which datasets may be connected: corners that touch are the root of 2 apart."""
    return max(float(delta), 2.0**0.5)
