"""Inverted lists, leaves of a split tree, and a hierarchy of rectangles, as columns and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.operators.keys import keys_of
from gridseek.plans.lineage import settled
from gridseek.plans.sizes import small_side


def _cell_keys(cells: DataFrame) -> list[str]:
    """Lists are of one source, as its index is."""
    return [c for c in ("source_id",) if c in cells.columns] + ["cell_id"]


def posting_lists(cells: DataFrame) -> DataFrame:
    """cell_id (and source_id) with the sorted ids of the datasets that have it and their number."""
    lists = F.array_sort(F.collect_set("dataset_id"))
    return cells.groupBy(*_cell_keys(cells)).agg(lists.alias("dataset_ids")).withColumn("n_datasets", F.size("dataset_ids").cast("long"))


def posting_counts(cells: DataFrame) -> DataFrame:
    """cell_id (and source_id), n_datasets, first_id, last_id: posting lists by their size and ends, without gathering them."""
    pairs = cells.select(*_cell_keys(cells), "dataset_id").distinct()
    return pairs.groupBy(*_cell_keys(cells)).agg(F.count("*").alias("n_datasets"), F.min("dataset_id").alias("first_id"), F.max("dataset_id").alias("last_id"))


def positional_lists(cells: DataFrame) -> DataFrame:
    """cell_id, dataset_id (and source_id), position (from 1, in order of the cells of the dataset) and size of the dataset."""
    keys = keys_of(cells)
    own = Window.partitionBy(*keys)
    pairs = cells.select(*keys, "cell_id").distinct()
    return pairs.select("cell_id", *keys, F.row_number().over(own.orderBy("cell_id")).cast("long").alias("position"), F.count("*").over(own).alias("size"))


#: Levels that node numbers have room for.
DEEPEST = 62


def leaves(profile: DataFrame, capacity: int = 10, axis: str = "x") -> DataFrame:
    """profile with leaf_id: a tree whose nodes split at the middle of their box, pivots below it to the left and the others to the right.

    A node is a leaf if it has at most `capacity` members or one side would be empty. The root is 1,
    the children of n are 2n and 2n + 1. axis: x, or widest. All nodes of a level are split in one
    go by sums that are partly made before a shuffle, so that a node of any size, the root first, spreads over all
    tasks. Rows that are done leave the loop; a level costs one sum over the others and one look at it.
    """
    keys = keys_of(profile)
    columns = (*keys, "pivot_x", "pivot_y", "min_cx", "max_cx", "min_cy", "max_cy", "node")
    open_ = settled(profile.withColumn("node", F.lit(1).cast("long")).select(*columns))
    bounds = [f(f"{m}_{c}").alias(f"all_{m}_{c}") for m, f in (("min", F.min), ("max", F.max)) for c in ("cx", "cy")]
    done = []
    for level in range(DEEPEST + 1):
        stats = open_.groupBy("node").agg(*bounds, F.count("*").alias("n"))
        # a node without a sibling is its parent, which then is a leaf; two rows a partition at most
        siblings = F.count("*").over(Window.partitionBy(F.shiftright("node", 1)))
        known = small_side(stats.withColumn("alone", (siblings < 2) & (F.col("node") > 1)))  # a row for each open node
        right = F.col("pivot_x") >= (F.col("all_min_cx") + F.col("all_max_cx")) / 2.0
        if axis == "widest":
            wide = (F.col("all_max_cx") - F.col("all_min_cx")) >= (F.col("all_max_cy") - F.col("all_min_cy"))
            right = F.when(wide, right).otherwise(F.col("pivot_y") >= (F.col("all_min_cy") + F.col("all_max_cy")) / 2.0)
        ended = F.col("alone") | (F.col("n") <= capacity)
        child = F.when(F.col("alone"), F.shiftright("node", 1)).when(ended, F.col("node")).otherwise(F.col("node") * 2 + right.cast("long"))
        placed = settled(open_.join(known, "node").select(*keys, *columns[len(keys) : -1], child.alias("node"), ended.alias("ended")))
        done.append(placed.where("ended").select(*keys, F.col("node").alias("leaf_id")))
        open_ = placed.where("not ended").select(*columns)
        if open_.isEmpty():
            break
        if level == DEEPEST:
            raise ValueError(f"the tree is deeper than {DEEPEST} levels")
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return profile.join(found, keys)


def tree_nodes(leafed: DataFrame) -> DataFrame:
    """node, is_leaf, box and number of datasets of each node above the leaves, from their boxes."""
    bounds = [f(f"{m}_{c}").alias(f"{m}_{c}") for m, f in (("min", F.min), ("max", F.max)) for c in ("cx", "cy")]
    leaf = leafed.groupBy(F.col("leaf_id").alias("node")).agg(*bounds, F.count("*").alias("n_datasets"))
    level = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    above = F.transform(F.sequence(F.lit(0), level), lambda i: F.expr("0L") + F.call_function("shiftright", F.col("node"), i.cast("int")))
    every = leaf.withColumn("above", F.explode(above))
    again = [f(f"{m}_{c}").alias(f"{m}_{c}") for m, f in (("min", F.min), ("max", F.max)) for c in ("cx", "cy")]
    return every.groupBy("above").agg(F.max((F.col("above") == F.col("node")).cast("int")).alias("leaf"), *again, F.sum("n_datasets").alias("n_datasets")).select(F.col("above").alias("node"), (F.col("leaf") == 1).alias("is_leaf"), "min_cx", "min_cy", "max_cx", "max_cy", "n_datasets")


def index_size(profile: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Estimated bytes of the indexes: 36 a tree node or dataset, 8 a list key and 4 a list entry."""
    trees = profile.agg(F.count("*").alias("d")).crossJoin(nodes.agg(F.count("*").alias("t")))  # one row each
    keys = _cell_keys(cells)
    lists = cells.select(*keys, "dataset_id").distinct().groupBy(*keys).agg(F.count("*").alias("e")).agg(F.count("*").alias("k"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"))
    return trees.crossJoin(lists).select((36 * (F.col("d") + F.col("t"))).alias("tree_bytes"), (8 * F.col("k") + 4 * F.col("e")).alias("list_bytes"))
