"""Changed datasets and standing queries. Datasets are told apart by source and id where both sides have sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.functions.grid import boxes_equal
from gridseek.operators.coverage import top_k_coverage
from gridseek.operators.index import leaves
from gridseek.operators.keys import keys_of
from gridseek.operators.overlap import top_k_overlap
from gridseek.operators.profile import prefixed, profiles
from gridseek.plans.sizes import small_side


def delete(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """cells without the datasets of ids(dataset_id) or ids(source_id, dataset_id)."""
    keys = keys_of(cells, ids)
    return cells.join(small_side(ids.select(*keys).distinct()), keys, "left_anti").select(*cells.columns)


def upsert(cells: DataFrame, changed: DataFrame) -> DataFrame:
    """cells with all cells of the changed datasets replaced; new ones are added."""
    return delete(cells, changed).unionByName(changed.select(*cells.columns))


def updated_leaves(cells: DataFrame, changed: DataFrame, capacity: int = 10, axis: str = "x") -> DataFrame:
    """The leaves of the tree over the datasets as they are after the change."""
    return leaves(profiles(upsert(cells, changed)), capacity, axis)


def standing_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Results that entered: rows of the new answer whose dataset was not in the old one."""
    keys = keys_of(before, after)
    return after.join(before.select(*keys), keys, "left_anti").select(*after.columns)


def standing_overlap(cells: DataFrame, changed: DataFrame, query: DataFrame, k: int = 10, exclude: object = None) -> DataFrame:
    """What enters the answer of an overlap query by the change. The answer is made anew, so that scores may fall, too."""
    before = top_k_overlap(cells, query, k, exclude=exclude)
    return standing_delta(before, top_k_overlap(upsert(cells, changed), query, k, exclude=exclude))


def standing_coverage(cells: DataFrame, changed: DataFrame, query: DataFrame, k: int = 10, delta: float = 0, exclude: object = None, strategy: str = "sg") -> DataFrame:
    """What enters the answer of a coverage query by the change: step, dataset_id and coverage of picks that were none before."""
    before = top_k_coverage(cells, query, k, delta, strategy, exclude)
    return standing_delta(before, top_k_coverage(upsert(cells, changed), query, k, delta, strategy, exclude))


def changed_boxes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of the datasets whose box is new or has changed: the only ones whose place in an index moves."""
    keys = keys_of(before, after)
    old, new = prefixed(profiles(before.select(*keys, "cx", "cy")), "o_"), profiles(after.select(*keys, "cx", "cy"))
    on = [F.col(k) == F.col(f"o_{k}") for k in keys]
    return new.join(old, on, "left").where(~boxes_equal("", "o_")).select(*keys)
