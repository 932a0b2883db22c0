"""Several sources, each with a resolution of its own.

Cells carry the source and its theta, and a query has cells for each theta in use; cells of different
resolutions are never compared. Sources that can't contribute are left out before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.functions.grid import HEIGHT, SOUTH, WEST, WIDTH, ball_gap, boxes_meet
from gridseek.operators.connect import reach
from gridseek.operators.coverage import greedy
from gridseek.operators.profile import boxes, prefixed, source_profiles
from gridseek.plans.sizes import small_side


def _cell(value: Column, low: float, extent: float, theta: Column) -> Column:
    return F.floor((value - low) / (F.lit(extent) / F.pow(F.lit(2.0), theta.cast("double")))).cast("long")


def _gridded(points: DataFrame, theta: Column) -> DataFrame:
    lng, lat = F.col("lng"), F.col("lat")
    inside = (lng > WEST) & (lng < WEST + WIDTH) & (lat > SOUTH) & (lat < SOUTH + HEIGHT)
    return points.where(inside).withColumn("theta", theta).withColumns({"cx": _cell(lng, WEST, WIDTH, F.col("theta")), "cy": _cell(lat, SOUTH, HEIGHT, F.col("theta"))})


def source_cells(points: DataFrame, thetas: dict[str, int], default: int = 12) -> DataFrame:
    """cells with theta of points(source_id, dataset_id, lng, lat): each source at its own resolution."""
    entries = [F.lit(x) for kv in thetas.items() for x in kv]
    theta = F.coalesce(F.create_map(*entries)[F.col("source_id")], F.lit(default)) if entries else F.lit(default)
    return _gridded(points, theta).groupBy("source_id", "dataset_id", "theta", "cx", "cy").agg(F.count("*").alias("density"))


def query_at(points: DataFrame, thetas: list[int]) -> DataFrame:
    """Distinct cells (theta, cx, cy) of a query's points at each resolution."""
    each = points.withColumn("t", F.explode(F.array(*[F.lit(t) for t in sorted(set(thetas))])))
    return _gridded(each, F.col("t")).select("theta", "cx", "cy").distinct()


def source_candidates(cells: DataFrame, query: DataFrame, delta: float | None = None) -> DataFrame:
    """source_id of the sources that a query can use. All is measured in cells of the source's resolution.

    For overlap (no delta) boxes must meet; for coverage the balls must be within reach of delta.
    """
    theta = cells.select("source_id", "theta").distinct()
    own = source_profiles(cells).join(theta, "source_id")
    box = prefixed(boxes(query, "theta"), "q_")
    near = boxes_meet("", "q_") if delta is None else ball_gap("", "q_") <= reach(delta)
    return own.join(F.broadcast(box), (F.col("theta") == F.col("q_theta")) & near).select("source_id")  # one row for each theta


def federated_overlap(cells: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """source_id, dataset_id and overlap: the best k of the best k of each source; ties by source, then id."""
    kept = cells.join(small_side(source_candidates(cells, query)), "source_id", "left_semi")
    counts = kept.join(small_side(query), ["theta", "cx", "cy"]).groupBy("source_id", "dataset_id").agg(F.count("*").alias("overlap"))
    own = Window.partitionBy("source_id").orderBy(F.desc("overlap"), "dataset_id")
    best = counts.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k)
    return best.orderBy(F.desc("overlap"), "source_id", "dataset_id").limit(k).select("source_id", "dataset_id", "overlap")


def federated_coverage(cells: DataFrame, query: DataFrame, k: int = 10, delta: float = 0, exclude: object = None) -> DataFrame:
    """source_id, step, dataset_id and coverage: the picks of each source by themselves, merged by their coverage."""
    sources = source_candidates(cells, query, delta)
    kept = cells.join(small_side(sources), "source_id", "left_semi")
    theta = kept.select("source_id", "theta").distinct()
    own = query.join(small_side(theta), "theta").select("source_id", "cx", "cy")
    picks = greedy(kept, own, k, delta, group="source_id", exclude=exclude)
    kind = cells.schema["dataset_id"].dataType.simpleString()
    frame = cells.sparkSession.createDataFrame(picks, f"source_id string, step long, dataset_id {kind}, coverage long")
    return frame.orderBy(F.desc("coverage"), "source_id", "dataset_id").limit(k)


def global_coverage(cells: DataFrame, query: DataFrame, k: int = 10, delta: float = 0, exclude: object = None) -> DataFrame:
    """Picks over all sources together; they must share one resolution."""
    one = cells.select("theta").distinct().limit(2).count()
    if one > 1:
        raise ValueError("the sources have different resolutions")
    merged = cells.withColumn("dataset_id", F.concat_ws("/", "source_id", F.col("dataset_id").cast("string")))
    picks = greedy(merged, query, k, delta, exclude=exclude)
    return cells.sparkSession.createDataFrame([p[1:] for p in picks], "step long, dataset_id string, coverage long")
