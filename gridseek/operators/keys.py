"""What names a dataset: its id, and its source where there are several, for sources may share ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys_of(*frames: DataFrame) -> list[str]:
    """source_id and dataset_id, as far as all frames have them."""
    return [c for c in ("source_id", "dataset_id") if all(c in f.columns for f in frames)]


def without(cells: DataFrame, exclude: object) -> DataFrame:
    """cells without the dataset `exclude`: an id, which leaves out the datasets of that id of all sources, or a pair (source, id); None leaves out nothing."""
    if exclude is None:
        return cells
    if isinstance(exclude, tuple):
        source, dataset = exclude
        return cells.where(~((F.col("source_id") == source) & (F.col("dataset_id") == dataset)))
    return cells.where(F.col("dataset_id") != exclude)
