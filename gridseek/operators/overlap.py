"""Overlap search: the k datasets that share the most cells with a query.

Nine strategies answer the one question with the same rows; they differ in what is pruned before the
join on cells. The default joins the query's cells, which are few, with all cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.functions.grid import boxes_meet, common_box
from gridseek.operators.index import leaves, positional_lists, tree_nodes
from gridseek.operators.keys import keys_of, without
from gridseek.operators.pairs import neighbours
from gridseek.operators.profile import box_candidates, profiles, query_box
from gridseek.plans.lineage import settled
from gridseek.plans.sizes import small_side


def query_cells(query: DataFrame) -> DataFrame:
    """The distinct cells of a query."""
    return query.select("cx", "cy").distinct()


def overlaps(cells: DataFrame, query: DataFrame) -> DataFrame:
    """dataset_id (and source_id) and overlap > 0 for all datasets.

    The query's side is sent to all executors if it is small by measure; else both sides are shuffled.
    """
    keys = keys_of(cells)
    return cells.join(small_side(query_cells(query)), ["cx", "cy"]).groupBy(*keys).agg(F.count("*").alias("overlap"))


def _best(found: DataFrame, k: int) -> DataFrame:
    keys = keys_of(found)
    return found.where("overlap > 0").orderBy(F.desc("overlap"), *reversed(keys)).limit(k).select(*keys, "overlap")


def _within(cells: DataFrame, query: DataFrame) -> DataFrame:
    """Cells within the query's box; on sorted files the condition reaches the reader as bounds where they are literals."""
    box = query_box(query)
    on = F.col("cx").between(F.col("q_min_cx"), F.col("q_max_cx")) & F.col("cy").between(F.col("q_min_cy"), F.col("q_max_cy"))
    return cells.join(F.broadcast(box), on).select(*cells.columns)  # one row


def _of(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    return cells.join(small_side(candidates.select(*keys_of(cells))), keys_of(cells), "left_semi")


def by_cells(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Join of posting lists with the query's cells, no pruning."""
    return _best(overlaps(cells, query), k)


def by_prefix(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Cells from the rare end: candidates by the first cells of the query, then exact counts.

    The datasets of the rarest cells give a first k-th score t. A dataset with more than t - 1 cells of
    the query must have one among all but its last t - 1, so that those datasets are all candidates.
    """
    keys = keys_of(cells)
    hits = settled(cells.join(small_side(query_cells(query)), ["cx", "cy"]).select(*keys, "cx", "cy"))
    frequency = settled(hits.groupBy("cx", "cy").agg(F.count("*").alias("often")))
    total = frequency.count()
    # places in the query's own order: as many rows as the query has cells
    places = settled(frequency.select("cx", "cy", F.row_number().over(Window.orderBy("often", "cx", "cy")).alias("place")))
    placed = hits.join(small_side(places), ["cx", "cy"])
    first = placed.where(F.col("place") <= max(1, total // 4)).groupBy(*keys).agg(F.count("*").alias("seen"))
    sure = first.orderBy(F.desc("seen")).limit(k).agg(F.min("seen").alias("t"), F.count("*").alias("n")).first()
    t = sure["t"] if sure["n"] == k else 1
    candidates = placed.where(F.col("place") <= total - t + 1).select(*keys).distinct()
    return _best(hits.join(small_side(candidates), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("overlap")), k)


def by_range(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Cells of the query's box only."""
    return _best(overlaps(_within(cells, query), query), k)


def by_boxes(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Datasets whose box meets the query's."""
    return _best(overlaps(_of(cells, box_candidates(profiles(cells), query)), query), k)


def by_all(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """All cells of all datasets, marked where the query has them, and no pruning."""
    mine = small_side(query_cells(query)).withColumn("shared", F.lit(1).cast("long"))
    return _best(cells.join(mine, ["cx", "cy"], "left").groupBy(*keys_of(cells)).agg(F.coalesce(F.sum("shared"), F.lit(0).cast("long")).alias("overlap")), k)


def by_slices(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Column by column: the rows of each column of a dataset against the query's."""
    keys = keys_of(cells)
    mine = query_cells(query).groupBy("cx").agg(F.collect_set("cy").alias("q"))
    slices = cells.groupBy(*keys, "cx").agg(F.collect_set("cy").alias("c"))
    shared = slices.join(small_side(mine), "cx").select(*keys, F.size(F.array_intersect("c", "q")).cast("long").alias("n"))
    return _best(shared.groupBy(*keys).agg(F.sum("n").alias("overlap")), k)


def by_bound(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Datasets by the bound that the common box sets: first the k of the greatest bound, then those whose bound reaches their score."""
    keys = keys_of(cells)
    bounds = settled(upper_bounds(cells, query))
    first = overlaps(_of(cells, bounds.orderBy(F.desc("bound"), *keys).limit(k)), query)
    sure = first.agg(F.min("overlap").alias("t"), F.count("*").alias("n")).first()
    least = sure["t"] if sure["n"] == k else 1
    return _best(overlaps(_of(cells, bounds.where(F.col("bound") >= least)), query), k)


def by_leaves(cells: DataFrame, query: DataFrame, k: int, capacity: int = 10) -> DataFrame:
    """Datasets of the tree's leaves whose box meets the query's."""
    leafed = leaves(profiles(cells), capacity)
    near = tree_nodes(leafed).where("is_leaf").join(F.broadcast(query_box(query)), boxes_meet("", "q_")).select(F.col("node").alias("leaf_id"))
    return _best(overlaps(_of(cells, leafed.join(near, "leaf_id", "left_semi")), query), k)


def by_clipped(cells: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Datasets whose box meets the query's, each clipped to the common box."""
    keys = keys_of(cells)
    met = box_candidates(profiles(cells), query).drop("common").join(F.broadcast(query_box(query)))  # one row
    box = met.select(*keys, *[c.alias(f"c_{name}") for name, c in common_box("", "q_").items()])
    inside = cells.join(small_side(box), keys).where(F.col("cx").between(F.col("c_min_cx"), F.col("c_max_cx")) & F.col("cy").between(F.col("c_min_cy"), F.col("c_max_cy")))
    return _best(overlaps(inside.select(*cells.columns), query), k)


#: Names of the strategies as users of such a search know them.
STRATEGIES: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "sts3": by_cells,
    "josie": by_prefix,
    "quadtree": by_range,
    "rtree": by_boxes,
    "slice_exact": by_slices,
    "exact": by_all,
    "mbr_bound": by_bound,
    "ibtree": by_leaves,
    "slice": by_clipped,
}


def top_k_overlap(cells: DataFrame, query: DataFrame, k: int = 10, strategy: str = "sts3", exclude: object = None) -> DataFrame:
    """dataset_id (and source_id) and overlap: the k greatest overlaps above 0, ties to the smaller id.

    exclude: an id that is left out, such as the query's own, or a pair (source, id) where sources share ids.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](without(cells, exclude), query, k)


def upper_bounds(cells: DataFrame, query: DataFrame) -> DataFrame:
    """Datasets whose box meets the query's, and bound: the lesser of both numbers of cells within the common box."""
    keys = keys_of(cells)
    met = box_candidates(profiles(cells), query).drop("common").join(F.broadcast(query_box(query)))  # one row
    box = met.select(*keys, *[c.alias(f"c_{name}") for name, c in common_box("", "q_").items()])
    inside = F.col("cx").between(F.col("c_min_cx"), F.col("c_max_cx")) & F.col("cy").between(F.col("c_min_cy"), F.col("c_max_cy"))
    theirs = cells.join(small_side(box), keys).where(inside).groupBy(*keys).agg(F.count("*").alias("theirs"))
    # a query is one dataset's cells; boxes are one row for each dataset
    mine = small_side(query_cells(query)).join(box, inside).groupBy(*keys).agg(F.count("*").alias("mine"))
    return theirs.join(mine, keys).select(*keys, F.least("theirs", "mine").alias("bound"))


def overlap_batch(cells: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank, dataset_id and overlap (with sources: query_source and source_id): the best k datasets of each of many queries, themselves left out."""
    keys = keys_of(cells, queries)
    names = {"dataset_id": "query_id", "source_id": "query_source"}
    found = neighbours(cells.select(*keys, "cx", "cy"), None if queries is cells else queries, CROWD, "best", k)
    return found.select(*[F.col(f"of_{c}").alias(names[c]) for c in keys], "rank", *keys, F.col("w").alias("overlap"))


#: Most datasets of a block, which a task meets with other blocks.
CROWD = 2048


def positional_overlaps(cells: DataFrame, query: DataFrame) -> DataFrame:
    """dataset_id (and source_id), overlap, first and last place of a shared cell and the dataset's size, from positional lists."""
    lists = positional_lists(cells)
    mine = query.select("cell_id").distinct()
    return lists.join(small_side(mine), "cell_id").groupBy(*keys_of(cells), "size").agg(F.count("*").alias("overlap"), F.min("position").alias("first"), F.max("position").alias("last"))


def random_queries(cells: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """The cells of n datasets drawn by a hash of their keys, so that a seed always draws the same."""
    keys = keys_of(cells)
    drawn = cells.select(*keys).distinct().orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
    return cells.join(F.broadcast(drawn), keys, "left_semi").select(*cells.columns)  # n rows
