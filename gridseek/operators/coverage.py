"""Coverage search: k connected datasets, picked one after another, that make the covered area largest.

The picks depend on each other, so a loop on the driver makes one job for each; all that it keeps there
is the picks. Several groups (sources) are searched side by side in the same jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.functions.grid import ball_gap, boxes_meet
from gridseek.operators.connect import connected, reach
from gridseek.operators.index import leaves, tree_nodes
from gridseek.operators.keys import without
from gridseek.operators.overlap import overlaps
from gridseek.operators.profile import box_candidates, boxes, prefixed, profiles, with_ball
from gridseek.plans.lineage import cut, settled
from gridseek.plans.sizes import small_side

GROUP = "group"


def _grouped(cells: DataFrame, group: str | None) -> DataFrame:
    return cells.select((F.col(group) if group else F.lit(0)).alias(GROUP), "dataset_id", "cx", "cy").distinct()


def _pruned(mine: DataFrame, profile: DataFrame, covered: DataFrame, delta: float) -> DataFrame:
    """Profiles whose box and ball are near enough to what is covered to be connected."""
    box = prefixed(boxes(covered, GROUP), "q_")
    wide = max(1, int(-(-delta // 1)))
    met = profile.join(F.broadcast(box), (F.col(GROUP) == F.col(f"q_{GROUP}")) & boxes_meet("", "q_", wide) & (ball_gap("", "q_") <= reach(delta)))  # one row for each group
    return met.select(*profile.columns)


def _bounded(near: DataFrame, mine: DataFrame, covered: DataFrame) -> DataFrame:
    """Of the reached datasets those whose upper bound of the gain, all cells, is no less than another's lower bound, its cells outside the covered box."""
    box = prefixed(boxes(covered, GROUP), "q_")
    inside = F.col("cx").between(F.col("q_min_cx"), F.col("q_max_cx")) & F.col("cy").between(F.col("q_min_cy"), F.col("q_max_cy"))
    sized = mine.join(small_side(near), [GROUP, "dataset_id"], "left_semi").join(F.broadcast(box), F.col(GROUP) == F.col(f"q_{GROUP}")).groupBy(mine[GROUP], "dataset_id")
    bounds = sized.agg(F.count("*").alias("upper"), F.sum((~inside).cast("long")).alias("lower"))
    best = bounds.groupBy(GROUP).agg(F.max("lower").alias("sure"))
    return bounds.join(F.broadcast(best), GROUP).where("upper >= sure").select(GROUP, "dataset_id")  # one row for each group


def greedy(cells: DataFrame, query: DataFrame, k: int, delta: float, group: str | None = None, exclude: object = None, prune: bool = False, bound: bool = False) -> list[tuple]:
    """(group, step, dataset_id, coverage) of the picks. query: its cells, with the group's column if there are groups."""
    mine = cut(_grouped(without(cells, exclude), group))  # read in each round
    covered = settled(query.select((F.col(group) if group else F.lit(0)).alias(GROUP), "cx", "cy").distinct())
    size = {r[GROUP]: r["count"] for r in covered.groupBy(GROUP).count().collect()}  # one row for each group
    profile = settled(boxes(mine, GROUP, "dataset_id")) if prune else None
    fresh, reached, picks = covered, None, []
    schema = f"{GROUP} {mine.schema[GROUP].dataType.simpleString()}, dataset_id {mine.schema['dataset_id'].dataType.simpleString()}"
    for step in range(1, k + 1):
        among = mine
        if prune:
            among = mine.join(small_side(_pruned(mine, profile, fresh, delta).select(GROUP, "dataset_id")), [GROUP, "dataset_id"], "left_semi")
        # what the newest cells reach joins what the others have reached
        near = connected(among, fresh, delta, keys=(GROUP, "dataset_id"), by=(GROUP,))
        reached = settled((near if reached is None else reached.unionByName(near)).distinct())
        left = reached
        if picks:
            chosen = mine.sparkSession.createDataFrame([(p[0], p[2]) for p in picks], schema)
            left = reached.join(F.broadcast(chosen), [GROUP, "dataset_id"], "left_anti")  # k rows for each group at most
        if bound:
            left = _bounded(left, mine, covered)
        new = mine.join(small_side(left), [GROUP, "dataset_id"], "left_semi").join(small_side(covered), [GROUP, "cx", "cy"], "left_anti")
        gains = new.groupBy(GROUP, "dataset_id").agg(F.count("*").alias("gain"))
        first = Window.partitionBy(GROUP).orderBy(F.desc("gain"), "dataset_id")
        best = gains.withColumn("r", F.row_number().over(first)).where("r = 1").collect()  # one row for each group
        if not best:
            break
        for r in best:
            size[r[GROUP]] += r["gain"]
            picks.append((r[GROUP], step, r["dataset_id"], size[r[GROUP]]))
        if step == k:
            break
        newest = mine.sparkSession.createDataFrame([(r[GROUP], r["dataset_id"]) for r in best], schema)
        fresh = settled(mine.join(F.broadcast(newest), [GROUP, "dataset_id"], "left_semi").select(GROUP, "cx", "cy"))
        covered = settled(covered.unionByName(fresh).distinct())
    return picks


def greedy_by_graph(cells: DataFrame, query: DataFrame, k: int, delta: float, exclude: object = None, edges: DataFrame | None = None) -> list[tuple]:
    """Picks along the overlap graph: the gain of a dataset is its size less its overlap with one chosen neighbour.

    A round needs the edges of one dataset only. Where no graph is given they are counted from its cells; the whole graph isn't made.
    """
    mine = cut(_grouped(without(cells, exclude), None).drop(GROUP))
    own = settled(query.select("cx", "cy").distinct())
    sizes = settled(mine.groupBy("dataset_id").agg(F.count("*").alias("size")))
    shared = mine.join(small_side(own), ["cx", "cy"]).groupBy("dataset_id").agg(F.count("*").alias("w"))
    open_ = settled(connected(mine, own, delta, keys=("dataset_id",)).join(shared, "dataset_id", "left").select("dataset_id", F.coalesce("w", F.lit(0)).alias("w")))
    graph = cut(edges) if edges is not None else None
    total, picks = own.count(), []
    for step in range(1, k + 1):
        if picks:
            chosen = [p[2] for p in picks]
            last = F.lit(chosen[-1])
            if graph is not None:
                steps = graph.where(F.col("src") == last).select(F.col("dst").alias("dataset_id"), "w")
            else:
                steps = overlaps(mine, mine.where(F.col("dataset_id") == last)).select("dataset_id", F.col("overlap").alias("w"))
            open_ = settled(open_.unionByName(steps).where(~F.col("dataset_id").isin(chosen)))
        gains = open_.groupBy("dataset_id").agg(F.min("w").alias("w")).join(sizes, "dataset_id").select("dataset_id", (F.col("size") - F.col("w")).alias("gain"))
        best = gains.where("gain > 0").orderBy(F.desc("gain"), "dataset_id").limit(1).collect()
        if not best:
            break
        total += best[0]["gain"]
        picks.append((0, step, best[0]["dataset_id"], total))
    return picks


def _frame(cells: DataFrame, picks: list[tuple]) -> DataFrame:
    kind = cells.schema["dataset_id"].dataType.simpleString()
    return cells.sparkSession.createDataFrame([p[1:] for p in picks], f"step long, dataset_id {kind}, coverage long")


COVERAGE = {
    "sg": lambda c, q, k, d, x: greedy(c, q, k, d, exclude=x),
    "gasm": lambda c, q, k, d, x: greedy(c, q, k, d, exclude=x, prune=True),
    "bounds": lambda c, q, k, d, x: greedy(c, q, k, d, exclude=x, prune=True, bound=True),
    "gadm": lambda c, q, k, d, x, edges=None: greedy_by_graph(c, q, k, d, exclude=x, edges=edges),
}


def top_k_coverage(cells: DataFrame, query: DataFrame, k: int = 10, delta: float = 0, strategy: str = "sg", exclude: object = None, edges: DataFrame | None = None) -> DataFrame:
    """step, dataset_id and coverage (cells covered after the step) of up to k picks with a gain above 0.

    sg, gasm and bounds give the same rows: the greatest gain among the datasets that are connected to
    what is covered, ties to the smaller id. gasm prunes by boxes and balls, bounds by bounds of the gain as
    well. gadm picks along the overlap graph, given as edges or else counted for each pick, and has a result of its own. Ids are of one source; several
    sources are searched by federation.
    """
    if strategy not in COVERAGE:
        raise ValueError(f"strategy must be one of {', '.join(COVERAGE)}")
    more = {"edges": edges} if edges is not None and strategy == "gadm" else {}
    return _frame(cells, COVERAGE[strategy](cells, query, k, delta, exclude, **more))


def _near(boxed: DataFrame, query: DataFrame, delta: float) -> DataFrame:
    """Of boxes with balls those near enough to the query to hold something connected."""
    near = box_candidates(boxed, query, max(1, int(-(-delta // 1)))).drop("common")
    return near.join(F.broadcast(prefixed(boxes(query), "q_")), ball_gap("", "q_") <= reach(delta)).select(*near.columns)  # one row


def coverage_candidates(cells: DataFrame, query: DataFrame, delta: float = 0, capacity: int | None = None) -> DataFrame:
    """Profiles near enough to the query to be connected, by box and ball. With capacity, by those of the tree's leaves first, of that capacity."""
    profile = profiles(cells)
    if capacity is not None:
        leafed = leaves(profile, capacity)
        met = _near(with_ball(tree_nodes(leafed).where("is_leaf")), query, delta).select(F.col("node").alias("leaf_id"))
        profile = leafed.join(small_side(met), "leaf_id", "left_semi").select(*profile.columns)
    return _near(profile, query, delta)
