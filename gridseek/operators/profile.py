"""Extents: one row for each dataset or source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.functions.grid import Grid, ball_gap, boxes_meet, common_cells
from gridseek.operators.keys import keys_of


def with_ball(boxes: DataFrame) -> DataFrame:
    """pivot: the middle of the box; radius: half its diagonal."""
    w, h = F.col("max_cx") - F.col("min_cx"), F.col("max_cy") - F.col("min_cy")
    return boxes.withColumns(
        {
            "pivot_x": (F.col("min_cx") + F.col("max_cx")) / F.lit(2.0),
            "pivot_y": (F.col("min_cy") + F.col("max_cy")) / F.lit(2.0),
            "radius": F.sqrt((w * w + h * h).cast("double")) / F.lit(2.0),
        }
    )


def boxes(cells: DataFrame, *keys: str) -> DataFrame:
    bounds = [f(c).alias(f"{m}_{c}") for m, f in (("min", F.min), ("max", F.max)) for c in ("cx", "cy")]
    return with_ball(cells.groupBy(*keys).agg(*bounds, F.count("*").alias("n_cells")))


def profiles(cells: DataFrame) -> DataFrame:
    """Box, ball and number of cells of each dataset."""
    keys = keys_of(cells)
    return boxes(cells, *keys)


def source_profiles(cells: DataFrame) -> DataFrame:
    """Box, ball and number of datasets of each source, from the datasets' boxes."""
    bounds = [f(f"{m}_{c}").alias(f"{m}_{c}") for m, f in (("min", F.min), ("max", F.max)) for c in ("cx", "cy")]
    return with_ball(profiles(cells).groupBy("source_id").agg(*bounds, F.count("*").alias("n_datasets")))


def prefixed(frame: DataFrame, prefix: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(prefix + c) for c in frame.columns])


def query_box(query: DataFrame) -> DataFrame:
    """The box of a query's cells: one row, columns q_..."""
    return prefixed(boxes(query), "q_")


def box_candidates(profile: DataFrame, query: DataFrame, reach: int = 0) -> DataFrame:
    """Profiles whose box meets the query's after widening by reach; common: cells of the common box."""
    met = profile.join(F.broadcast(query_box(query)), boxes_meet("", "q_", reach))
    return met.withColumn("common", common_cells("", "q_")).select(*profile.columns, "common")


def ball_candidates(profile: DataFrame, query: DataFrame, reach: float) -> DataFrame:
    """Profiles whose ball is within reach of the query's; gap: the distance between the balls."""
    met = profile.join(F.broadcast(query_box(query)), ball_gap("", "q_") <= F.lit(float(reach)))
    return met.withColumn("gap", ball_gap("", "q_")).select(*profile.columns, "gap")


def corners(profile: DataFrame, grid: Grid) -> DataFrame:
    """Profiles with their corners in degrees."""
    low = grid.lower_left(F.col("min_cx"), F.col("min_cy"))
    high = grid.lower_left(F.col("max_cx"), F.col("max_cy"))
    return profile.withColumns({"west": low[0], "south": low[1], "east": high[0], "north": high[1]})
