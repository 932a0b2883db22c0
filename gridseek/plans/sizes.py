"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that is sent to all executors.
MOST_ROWS = 200_000


def collected(frame: DataFrame, most: int = MOST_ROWS) -> DataFrame | None:
    """The rows of frame as a local table if they are at most `most` and narrow, so that rows bound bytes; else None.

    A broadcast passes through the driver as well. Taking the rows here measures the side and computes it in one run, which
    stops a row beyond the limit.
    """
    if len(frame.columns) > 12:
        return None
    rows = frame.limit(most + 1).toArrow()
    return frame.sparkSession.createDataFrame(rows, frame.schema) if rows.num_rows <= most else None


def small_side(frame: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """frame with a broadcast hint if it has at most `most` rows; else as it is, for a join by shuffles."""
    rows = collected(frame, most)
    return frame if rows is None else F.broadcast(rows)
