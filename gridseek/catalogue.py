"""Queries over collections that are derived from the star-schema tables, each with SQL that gives the same rows.

Datasets are suppliers and their points line items; events are a stream of changes. Coordinates are
multiples of 1/256, so that every engine grids them alike. The query is dataset 1 unless told.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.functions.grid import Grid, box_contains, boxes_meet, common_area
from gridseek.operators import federation, index, overlap, updates
from gridseek.operators.connect import connected
from gridseek.operators.coverage import coverage_candidates, top_k_coverage
from gridseek.operators.graph import cells_json, graph_from_json, load_or_make_graph, overlap_graph, ranked_graph
from gridseek.operators.profile import ball_candidates, box_candidates, corners, profiles, source_profiles
from gridseek.plans.lineage import cut, shared_folder
from gridseek.sources.points import cells_of, load_or_make_cells, valid_points
from gridseek.streaming.standing import StandingCoverage, StandingOverlap

GRID = Grid(12)
THETAS = {"S0": 12, "S1": 11, "S2": 12, "S3": 10, "S4": 12, "S5": 11}
CUTOFF = "2024-01-16"

POINTS = """select concat('S', cast(floor(s_nationkey/10)*2 + s_nationkey % 2 as int)) as source_id, l_suppkey as dataset_id,
 cast(-160 + 60*floor(s_nationkey/10) + s_nationkey % 10 as double) + cast((l_partkey*37 + l_suppkey*11) % 1024 as double)/cast(256 as double) as lng,
 cast(-60 + 25*floor(s_nationkey/10) as double) + cast(s_nationkey % 10 as double)/cast(2 as double) + cast((l_orderkey*91 + l_suppkey*7) % 1024 as double)/cast(256 as double) as lat
 from {lineitem} join {supplier} on l_suppkey=s_suppkey"""
CHANGES = """select user_id as dataset_id, ts,
 cast(-100 as double) + cast(user_id % 8 as double)/cast(2 as double) + cast((event_id*37) % 256 as double)/cast(256 as double) as lng,
 cast(30 as double) + cast(user_id % 4 as double)/cast(2 as double) + cast((cast(round(value*cast(100 as double)) as bigint)*91) % 256 as double)/cast(256 as double) as lat
 from {events}"""
#: Texts as a CSV file may hold them: dataset, x, y.
RAW = [("a", "10.5", "20.25"), ("a", "10.5", "20.25"), ("a", "-0", "0"), ("a", "180", "1"), ("a", "-180", "1"), ("b", "10", "90"), ("b", "10", "-90"), ("b", "179.9999", "89.9999"), ("b", "1e1", "10"), ("b", "+10", "10"), ("c", ".5", "10"), ("c", "5.", "10"), ("c", "10", "1e1"), ("d", "abc", "1"), ("d", "", "1"), ("d", "10", "abc"), ("d", None, "1"), ("d", "10", None)]
#: Rectangles: id, low x, low y, high x, high y.
RECTANGLES = [("r1", -2.0, 0.0, 0.0, 2.0), ("r2", -2.0, 1.0, 3.0, 3.0), ("r3", 1.0, 0.0, 2.0, 4.0), ("r4", -2.0, 1.0, -1.0, 2.0)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS, lineitem=_table(spark, sf_dir, "lineitem"), supplier=_table(spark, sf_dir, "supplier"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(points(spark, sf_dir), GRID)


def _one(c: DataFrame) -> DataFrame:
    return c.where("dataset_id = 1")


def _on_cells(use: Callable[[DataFrame], DataFrame], keep: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """keep: the cells are made once, for queries that read them often."""
    return lambda spark, d: use(cut(cells(spark, d)) if keep else cells(spark, d))


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, 6) for n in names})


def _resolved(c: DataFrame) -> DataFrame:
    ids = c.select("cell_id").distinct()
    cx, cy = GRID.resolve(F.col("cell_id"))
    lng, lat = GRID.lower_left(cx, cy)
    return ids.select("cell_id", cx.alias("cx"), cy.alias("cy"), lng.alias("lng"), lat.alias("lat"))


def _validity(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame(RAW, "dataset_id string, x string, y string").coalesce(1)
    kept = cells_of(valid_points(raw, GRID), GRID).groupBy("dataset_id").agg(F.count("*").alias("n_cells"), F.sum("density").alias("n_kept"))
    zero = F.lit(0).cast("long")
    return raw.groupBy("dataset_id").agg(F.count("*").alias("n_raw")).join(kept, "dataset_id", "left").select("dataset_id", "n_raw", F.coalesce("n_kept", zero).alias("n_kept"), F.coalesce("n_cells", zero).alias("n_cells"))


def _rectangles(spark: SparkSession, d: str) -> DataFrame:
    names = ("id", "min_cx", "min_cy", "max_cx", "max_cy")
    frame = spark.createDataFrame(RECTANGLES, "id string, min_cx double, min_cy double, max_cx double, max_cy double").coalesce(1)
    a, b = (frame.select(*[F.col(n).alias(p + n) for n in names]) for p in ("a_", "b_"))
    union = [f(f"a_{m}_{c}", f"b_{m}_{c}").alias(f"{m}_{c}") for m, f in (("min", F.least), ("max", F.greatest)) for c in ("cx", "cy")]
    pairs = a.join(b, F.col("a_id") < F.col("b_id"))  # four rectangles
    area = (F.col("max_cx") - F.col("min_cx")) * (F.col("max_cy") - F.col("min_cy"))
    return pairs.select("a_id", "b_id", boxes_meet("a_", "b_").alias("meets"), common_area("a_", "b_").alias("common_area"), box_contains("a_", "b_").alias("contains"), *union).withColumn("union_area", area)


def _federated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    return cut(federation.source_cells(p, THETAS)), cut(federation.query_at(_one(p), list(THETAS.values())))


def _changes(spark: SparkSession, d: str, sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells before the cutoff, and all cells of the datasets that change after it. With sources users are dealt to two, which share ids."""
    p = spark.sql(CHANGES, events=_table(spark, d, "events"))
    keys = ["dataset_id"]
    if sources:
        keys = ["source_id", "dataset_id"]
        p = p.withColumns({"source_id": F.concat(F.lit("E"), F.col("dataset_id") % 2), "dataset_id": F.floor(F.col("dataset_id") / 2)})
    late = p.where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp")).select(*keys).distinct()
    before = cells_of(p.where(F.col("ts") < F.lit(CUTOFF).cast("timestamp")), GRID)
    return cut(before), cut(cells_of(p.join(late, keys, "left_semi"), GRID))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    before, changed = _changes(spark, d)
    after = updates.upsert(before, changed)
    return overlap.top_k_overlap(after, _one(after), 5, exclude=1)


def _upserted_sources(spark: SparkSession, d: str) -> DataFrame:
    before, changed = _changes(spark, d, sources=True)
    after = updates.upsert(before, changed)
    return overlap.top_k_overlap(after, after.where("source_id = 'E1' and dataset_id = 0"), 5, exclude=("E1", 0))


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    before, _ = _changes(spark, d)
    after = updates.delete(before, before.where("dataset_id % 4 = 1 and dataset_id != 1").select("dataset_id").distinct())
    return overlap.top_k_overlap(after, _one(after), 5, exclude=1)


def _entered(spark: SparkSession, d: str) -> DataFrame:
    before, changed = _changes(spark, d)
    after = updates.upsert(before, changed)
    old = overlap.top_k_overlap(before, _one(before), 5, exclude=1)
    return updates.standing_delta(old, overlap.top_k_overlap(after, _one(after), 5, exclude=1))


def _entered_coverage(spark: SparkSession, d: str) -> DataFrame:
    before, changed = _changes(spark, d)
    return updates.standing_coverage(before, changed, _one(before), 3, 3, exclude=1)


def _moved(spark: SparkSession, d: str, sources: bool = False) -> DataFrame:
    before, changed = _changes(spark, d, sources)
    return updates.changed_boxes(before, updates.upsert(before, changed))


def _new_leaves(spark: SparkSession, d: str) -> DataFrame:
    before, changed = _changes(spark, d)
    return updates.updated_leaves(before, changed).groupBy("leaf_id").agg(F.count("*").alias("n_datasets"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, d: str, kind: Callable = StandingOverlap, **more) -> DataFrame:
    """The same change as a stream of files."""
    before, _ = _changes(spark, d)
    standing = kind(spark, _folder(spark, "standing"), GRID, more.pop("query", _one), exclude=1, **more)
    standing.start_with(before)
    static = _table(spark, d, "events")
    events = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    late = spark.sql(CHANGES, events=static).where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp")).select("dataset_id").distinct()
    standing.run(spark.sql(CHANGES, events=events).join(late, "dataset_id", "left_semi"))
    return standing.entered().drop("batch")


def _streamed_coverage(spark: SparkSession, d: str) -> DataFrame:
    own = cut(_one(_changes(spark, d)[0]))
    return _streamed(spark, d, StandingCoverage, k=3, delta=3, query=lambda _: own)


def _shared_ids(c: DataFrame) -> DataFrame:
    """Few ids, which the sources share."""
    return c.withColumn("dataset_id", F.col("dataset_id") % 7).groupBy("source_id", "dataset_id", "cx", "cy", "cell_id").agg(F.sum("density").alias("density"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """Cells that are made and stored, and read where they are."""
    folder = _folder(spark, "cells")
    load_or_make_cells(spark, folder, GRID.theta, lambda: points(spark, d))
    return load_or_make_cells(spark, folder, GRID.theta, lambda: points(spark, d).limit(0)).drop("source_id")


def _cached_graph(spark: SparkSession, d: str) -> DataFrame:
    folder, c = _folder(spark, "graph"), cells(spark, d).drop("source_id")
    load_or_make_graph(spark, folder, c)
    return load_or_make_graph(spark, folder, c.limit(0))


def _global(spark: SparkSession, d: str) -> DataFrame:
    c, q = _federated(spark, d)
    return federation.global_coverage(c.where("theta = 12"), q.where("theta = 12"), 3, 0)


def _best(strategy: str) -> Callable[[DataFrame], DataFrame]:
    return lambda c: overlap.top_k_overlap(c, _one(c), 10, strategy, exclude=1).select("dataset_id", "overlap")


def _covered(strategy: str, delta: float = 0) -> Callable[[DataFrame], DataFrame]:
    return lambda c: top_k_coverage(c.drop("source_id"), _one(c), 3, delta, strategy, exclude=1)


PROFILE = ("dataset_id", "min_cx", "min_cy", "max_cx", "max_cy", "pivot_x", "pivot_y", "radius", "n_cells")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "grid_cells": _on_cells(lambda c: c.drop("source_id")),
    "grid_resolve": _on_cells(_resolved),
    "ingest_validity": _validity,
    "rectangle_relations": _rectangles,
    "dataset_profile": _on_cells(lambda c: _rounded(profiles(c), "pivot_x", "pivot_y", "radius").select(*PROFILE)),
    "lake_profile": _on_cells(lambda c: _rounded(source_profiles(c), "pivot_x", "pivot_y", "radius")),
    "dataset_corners": _on_cells(lambda c: corners(profiles(c), GRID).select("dataset_id", "west", "south", "east", "north")),
    "posting_list": _on_cells(index.posting_counts),
    "posting_arrays": _on_cells(lambda c: index.posting_lists(c).select("source_id", "cell_id", "n_datasets", F.concat_ws(",", "dataset_ids").alias("ids"))),
    "positional_posting": _on_cells(index.positional_lists),
    "positional_overlap": _on_cells(lambda c: index_overlap(c.drop("source_id"))),
    "index_size": _on_cells(lambda c: index.index_size(p := profiles(c), index.tree_nodes(index.leaves(p)), c), keep=True),
    "mbr_candidates": _on_cells(lambda c: box_candidates(profiles(c), _one(c)).select("dataset_id", "common")),
    "ball_candidates": _on_cells(lambda c: _rounded(ball_candidates(profiles(c), _one(c), 3), "gap").select("dataset_id", "gap")),
    "coverage_candidates": _on_cells(lambda c: coverage_candidates(c, _one(c), 3).select("dataset_id")),
    "coverage_leaf_candidates": _on_cells(lambda c: coverage_candidates(c, _one(c), 3, capacity=10).select("dataset_id"), keep=True),
    "cells_cache": _cached,
    "graph_cache": _cached_graph,
    "overlap_exclude_source": _on_cells(lambda c: overlap.top_k_overlap(s := _shared_ids(c), _one(s), 10, exclude=("S0", 1))),
    "overlap_graph_sources": _on_cells(lambda c: overlap_graph(_shared_ids(c)), keep=True),
    "overlap_upper_bound": _on_cells(lambda c: overlap.upper_bounds(c, _one(c)).select("dataset_id", "bound")),
    **{f"overlap_{s}": _on_cells(_best(s), keep=s in ("mbr_bound", "ibtree", "slice", "rtree")) for s in overlap.STRATEGIES},
    "overlap_batch": _on_cells(lambda c: overlap.overlap_batch(s := c.drop("source_id"), s, 3), keep=True),
    "overlap_graph": _on_cells(lambda c: overlap_graph(c.drop("source_id")), keep=True),
    "overlap_graph_sorted": _on_cells(lambda c: ranked_graph(c.drop("source_id")), keep=True),
    "overlap_graph_json": _on_cells(lambda c: graph_from_json(cells_json(c.drop("source_id"))).select("src", F.col("dst").cast("long").alias("dst"), "w"), keep=True),
    "connected_d0": _on_cells(lambda c: connected(c.where("dataset_id != 1"), _one(c), 0, keys=("dataset_id",))),
    "connected_d3": _on_cells(lambda c: connected(c.where("dataset_id != 1"), _one(c), 3, keys=("dataset_id",))),
    **{f"coverage_{s}": _on_cells(_covered(s)) for s in ("sg", "gasm", "bounds", "gadm")},
    **{f"coverage_{s}_d3": _on_cells(_covered(s, 3)) for s in ("sg", "gasm", "bounds", "gadm")},
    "global_coverage": _global,
    "source_candidates_overlap": lambda spark, d: federation.source_candidates(*_federated(spark, d)),
    "source_candidates_coverage": lambda spark, d: federation.source_candidates(*_federated(spark, d), delta=0),
    "federated_overlap": lambda spark, d: federation.federated_overlap(*_federated(spark, d), 10),
    "federated_coverage": lambda spark, d: federation.federated_coverage(*_federated(spark, d), 3, 0, exclude=1),
    "update_upsert": _upserted,
    "update_delete": _deleted,
    "update_moved": _moved,
    "update_upsert_sources": _upserted_sources,
    "update_moved_sources": lambda spark, d: _moved(spark, d, sources=True),
    "update_leaves": _new_leaves,
    "standing_delta": _entered,
    "standing_coverage": _entered_coverage,
    "streaming_updates": lambda spark, d: _streamed(spark, d, k=5),
    "streaming_coverage": _streamed_coverage,
    "kd_leaves": _on_cells(lambda c: index.leaves(profiles(c)).groupBy("leaf_id").agg(F.count("*").alias("n_datasets")), keep=True),
    "tree_nodes": _on_cells(lambda c: index.tree_nodes(index.leaves(profiles(c))), keep=True),
}


def index_overlap(c: DataFrame) -> DataFrame:
    return overlap.positional_overlaps(c, _one(c))


# The same in SQL ----------------------------------------------------------------------------

_NAMES = {n: n for n in ("lineitem", "supplier", "events")}
_PTS = "pts as materialized (" + POINTS.format(**_NAMES) + ")"
_CELLS = _PTS + """, cells as materialized (select source_id, dataset_id, cast(floor((lng+180)/0.087890625e0) as bigint) as cx, cast(floor((lat+90)/0.0439453125e0) as bigint) as cy, count(*) as density
 from pts where lng>-180 and lng<180 and lat>-90 and lat<90 group by 1,2,3,4), q as materialized (select cx, cy from cells where dataset_id = 1)"""
_BOX = "min(cx) as min_cx, min(cy) as min_cy, max(cx) as max_cx, max(cy) as max_cy"
_BALL = "(min_cx+max_cx)/2e0 as pivot_x, (min_cy+max_cy)/2e0 as pivot_y, sqrt(cast((max_cx-min_cx)*(max_cx-min_cx)+(max_cy-min_cy)*(max_cy-min_cy) as double))/2e0 as radius"
_BOXES = f"boxes as (select *, {_BALL} from (select dataset_id, {_BOX}, count(*) as n_cells from cells group by 1)), qb as (select *, {_BALL} from (select {_BOX} from q))"
_MEET = "b.min_cx<=qb.max_cx and qb.min_cx<=b.max_cx and b.min_cy<=qb.max_cy and qb.min_cy<=b.max_cy"
_GAP = "sqrt((b.pivot_x-qb.pivot_x)*(b.pivot_x-qb.pivot_x)+(b.pivot_y-qb.pivot_y)*(b.pivot_y-qb.pivot_y))-b.radius-qb.radius"
_OVERLAP = f"with {_CELLS} select dataset_id, count(*) as overlap from cells join q using (cx, cy) where dataset_id != 1 group by 1 order by 2 desc, 1 limit 10"
_EDGES = "edges as materialized (select a.dataset_id as src, b.dataset_id as dst, count(*) as w from cells a join cells b using (cx, cy) where a.dataset_id != b.dataset_id group by 1, 2)"
_NEAR = "(select distinct cx+dx as cx, cy+dy as cy from {m} cross join (values (-1),(0),(1)) x(dx) cross join (values (-1),(0),(1)) y(dy))"


#: What is within 3 cells.
_NEAR_3 = "(select distinct cx+dx as cx, cy+dy as cy from {m} cross join (select unnest(range(-3, 4)) as dx) x cross join (select unnest(range(-3, 4)) as dy) y where dx*dx+dy*dy <= 9)"


def _picks(cells: str = "cells", near: str = _NEAR, k: int = 3, p: str = "", skip: str = "dataset_id != 1", kind: str = "dataset_id") -> tuple[str, str]:
    """Common table expressions of the greedy picks from q, and the query of the picks."""
    parts = [f"{p}m0 as materialized (select distinct cx, cy from q)"]
    for i in range(1, k + 1):
        chosen = "".join(f" and dataset_id not in (select dataset_id from {p}p{j})" for j in range(1, i))
        parts.append(f"{p}r{i} as materialized (select distinct dataset_id from {cells} join {near.format(m=f'{p}m{i - 1}')} n using (cx, cy) where {skip}{chosen})")
        parts.append(f"{p}p{i} as materialized (select dataset_id, count(*) as gain from {cells} c where dataset_id in (select dataset_id from {p}r{i}) and not exists (select 1 from {p}m{i - 1} m where m.cx=c.cx and m.cy=c.cy) group by 1 order by 2 desc, 1 limit 1)")
        parts.append(f"{p}m{i} as materialized (select cx, cy from {p}m{i - 1} union select cx, cy from {cells} where dataset_id in (select dataset_id from {p}p{i}))")
    return ", ".join(parts), " union all ".join(f"select cast({i} as bigint) as step, dataset_id, (select count(*) from {p}m{i}) as coverage from {p}p{i}" for i in range(1, k + 1))


def _greedy_sql(near: str = _NEAR) -> str:
    tables, picks = _picks(near=near)
    return f"with {_CELLS}, {tables} {picks}"


def _graph_greedy_sql(near: str = _NEAR, k: int = 3) -> str:
    near = near.format(m="q")
    parts = [f"with {_CELLS}, {_EDGES}, sizes as (select dataset_id, count(*) as size from cells group by 1), shared as (select dataset_id, count(*) as w from cells join q using (cx, cy) group by 1), open_ as materialized (select r.dataset_id, coalesce(s.w, 0) as w from (select distinct dataset_id from cells join {near} n using (cx, cy) where dataset_id != 1) r left join shared s using (dataset_id))"]
    for i in range(1, k + 1):
        more = "".join(f" union all select dst, w from edges where src in (select dataset_id from p{j})" for j in range(1, i))
        chosen = "".join(f" and dataset_id not in (select dataset_id from p{j})" for j in range(1, i))
        parts.append(f"p{i} as materialized (select dataset_id, max(size-w) as gain from (select dataset_id, w from open_{more}) o join sizes using (dataset_id) where size-w > 0 and dataset_id != 1{chosen} group by 1 order by 2 desc, 1 limit 1)")
    totals = ["(select count(*) from q)" + "".join(f" + (select gain from p{j})" for j in range(1, i + 1)) for i in range(1, k + 1)]
    return ", ".join(parts) + " " + " union all ".join(f"select cast({i} as bigint) as step, dataset_id, cast({totals[i - 1]} as bigint) as coverage from p{i}" for i in range(1, k + 1))


_THETA = "case source_id " + " ".join(f"when '{s}' then {t}" for s, t in THETAS.items()) + " else 12 end"
_FED = f"""{_PTS}, placed as (select *, {_THETA} as theta from pts where lng>-180 and lng<180 and lat>-90 and lat<90),
 cells as materialized (select source_id, dataset_id, theta, cast(floor((lng+180)/(360e0/power(2e0,theta))) as bigint) as cx, cast(floor((lat+90)/(180e0/power(2e0,theta))) as bigint) as cy from placed group by 1,2,3,4,5),
 q as materialized (select distinct t.theta, cast(floor((lng+180)/(360e0/power(2e0,t.theta))) as bigint) as cx, cast(floor((lat+90)/(180e0/power(2e0,t.theta))) as bigint) as cy from (select * from placed where dataset_id=1) p cross join (select distinct theta from placed) t),
 b as (select *, {_BALL} from (select source_id, theta, {_BOX} from cells group by 1,2)), qb as (select *, {_BALL} from (select theta, {_BOX} from q group by 1)),
 near as (select source_id from b join qb using (theta) where {_MEET}), close as (select source_id from b join qb using (theta) where {_GAP} <= sqrt(2e0))"""


def _federated_greedy_sql(k: int = 3) -> str:
    parts = [f"with {_FED}, kept as materialized (select * from cells where source_id in (select source_id from close)), m0 as materialized (select distinct source_id, q.cx, q.cy from q join (select distinct source_id, theta from kept) s using (theta))"]
    for i in range(1, k + 1):
        chosen = "".join(f" and (c.source_id, c.dataset_id) not in (select (source_id, dataset_id) from p{j})" for j in range(1, i))
        around = f"(select distinct source_id, cx+dx as cx, cy+dy as cy from m{i - 1} cross join (values (-1),(0),(1)) x(dx) cross join (values (-1),(0),(1)) y(dy))"
        parts.append(f"r{i} as materialized (select distinct c.source_id, c.dataset_id from kept c join {around} n using (source_id, cx, cy) where c.dataset_id != 1{chosen})")
        parts.append(f"p{i} as materialized (select source_id, dataset_id, gain from (select *, row_number() over (partition by source_id order by gain desc, dataset_id) as r from (select c.source_id, c.dataset_id, count(*) as gain from kept c join r{i} using (source_id, dataset_id) where not exists (select 1 from m{i - 1} m where m.source_id=c.source_id and m.cx=c.cx and m.cy=c.cy) group by 1, 2)) where r=1)")
        parts.append(f"m{i} as materialized (select source_id, cx, cy from m{i - 1} union select source_id, cx, cy from kept join p{i} using (source_id, dataset_id))")
    rows = " union all ".join(f"select source_id, cast({i} as bigint) as step, dataset_id, (select count(*) from m{i} m where m.source_id=p{i}.source_id) as coverage from p{i}" for i in range(1, k + 1))
    return ", ".join(parts) + f" select * from ({rows}) order by coverage desc, source_id, dataset_id limit {k}"


_CH = "pts as materialized (" + CHANGES.format(**_NAMES) + f"""), late as (select distinct dataset_id from pts where ts >= timestamp '{CUTOFF}'),
 g as (select dataset_id, ts, cast(floor((lng+180)/0.087890625e0) as bigint) as cx, cast(floor((lat+90)/0.0439453125e0) as bigint) as cy from pts),
 before as materialized (select distinct dataset_id, cx, cy from g where ts < timestamp '{CUTOFF}'),
 after as materialized (select * from before where dataset_id not in (select dataset_id from late) union all select distinct dataset_id, cx, cy from g where dataset_id in (select dataset_id from late))"""


def _top_sql(table: str, k: int = 5) -> str:
    return f"(select a.dataset_id, count(*) as overlap from {table} a join (select cx, cy from {table} where dataset_id=1) q using (cx, cy) where a.dataset_id != 1 group by 1 order by 2 desc, 1 limit {k})"


def _leaves_sql(levels: int = 24, capacity: int = 10, tables: str = "") -> str:
    """The tree level by level; a leaf stays as it is."""
    parts = [f"with {tables or _CELLS}, {_BOXES}, l0 as (select *, cast(1 as bigint) as node from boxes)"]
    for i in range(1, levels + 1):
        parts.append(f"s{i} as (select *, count(*) over (partition by node) as n, case when pivot_x >= (min(min_cx) over (partition by node)+max(max_cx) over (partition by node))/2e0 then 1 else 0 end as r from l{i - 1})")
        parts.append(f"t{i} as (select *, sum(r) over (partition by node) as nr from s{i})")
        parts.append(f"l{i} as materialized (select dataset_id, min_cx, min_cy, max_cx, max_cy, pivot_x, case when n > {capacity} and nr > 0 and nr < n then node*2+r else node end as node from t{i})")
    return ", ".join(parts) + f", leafed as (select * from l{levels})"


def _entered_picks() -> str:
    (old, before), (new, after) = _picks("before", _NEAR_3, p="o"), _picks("after", _NEAR_3, p="n")
    return f"with {_CH}, q as materialized (select cx, cy from before where dataset_id = 1), {old}, {new} select * from ({after}) a where dataset_id not in (select dataset_id from ({before}) b)"


_CH_TWO = _CH.replace("select user_id as dataset_id, ts,", "select concat('E', user_id % 2) as source_id, cast(floor(user_id/2) as bigint) as dataset_id, ts,").replace("select distinct dataset_id", "select distinct source_id, dataset_id").replace("g as (select dataset_id", "g as (select source_id, dataset_id")
_CH_TWO = _CH_TWO.replace("dataset_id not in (select dataset_id from late)", "(source_id, dataset_id) not in (select (source_id, dataset_id) from late)").replace("dataset_id in (select dataset_id from late)", "(source_id, dataset_id) in (select (source_id, dataset_id) from late)")
_SHARED = f"{_CELLS}, two as materialized (select distinct source_id, dataset_id % 7 as dataset_id, cx, cy from cells)"
_ENTERED = f"with {_CH} select * from {_top_sql('after')} n where dataset_id not in (select dataset_id from {_top_sql('before')})"
_ROWS = ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in r) + ")" for r in RAW)
_RECT = ", ".join(f"('{r[0]}', " + ", ".join(f"{v}e0" for v in r[1:]) + ")" for r in RECTANGLES)

SQL: dict[str, str] = {
    "grid_cells": f"with {_CELLS} select dataset_id, cx, cy, cy*4096+cx as cell_id, density from cells",
    "grid_resolve": f"with {_CELLS} select distinct cy*4096+cx as cell_id, cx, cy, cx*0.087890625e0-180e0 as lng, cy*0.0439453125e0-90e0 as lat from cells",
    "ingest_validity": f"""with raw(dataset_id, x, y) as (values {_ROWS}), ok as (select dataset_id, try_cast(x as double) as lng, try_cast(y as double) as lat from raw where regexp_full_match(x, '-?[0-9]+([.][0-9]+)?')),
 kept as (select dataset_id, floor((lng+180)/0.087890625e0) as cx, floor((lat+90)/0.0439453125e0) as cy from ok where lng>-180 and lng<180 and lat>-90 and lat<90)
 select r.dataset_id, n_raw, coalesce(n_kept, 0) as n_kept, coalesce(n_cells, 0) as n_cells from (select dataset_id, count(*) as n_raw from raw group by 1) r left join (select dataset_id, count(*) as n_kept, count(distinct (cx, cy)) as n_cells from kept group by 1) k using (dataset_id)""",
    "rectangle_relations": f"""with r(id, lx, ly, hx, hy) as (values {_RECT}) select a.id as a_id, b.id as b_id, a.lx<=b.hx and b.lx<=a.hx and a.ly<=b.hy and b.ly<=a.hy as meets,
 greatest(least(a.hx,b.hx)-greatest(a.lx,b.lx), 0e0)*greatest(least(a.hy,b.hy)-greatest(a.ly,b.ly), 0e0) as common_area, a.lx<=b.lx and a.ly<=b.ly and a.hx>=b.hx and a.hy>=b.hy as contains,
 least(a.lx,b.lx) as min_cx, least(a.ly,b.ly) as min_cy, greatest(a.hx,b.hx) as max_cx, greatest(a.hy,b.hy) as max_cy, (greatest(a.hx,b.hx)-least(a.lx,b.lx))*(greatest(a.hy,b.hy)-least(a.ly,b.ly)) as union_area from r a join r b on a.id<b.id""",
    "dataset_profile": f"with {_CELLS}, {_BOXES} select dataset_id, min_cx, min_cy, max_cx, max_cy, round(pivot_x,6) as pivot_x, round(pivot_y,6) as pivot_y, round(radius,6) as radius, n_cells from boxes",
    "lake_profile": f"with {_CELLS} select source_id, min_cx, min_cy, max_cx, max_cy, n_datasets, round(pivot_x,6) as pivot_x, round(pivot_y,6) as pivot_y, round(radius,6) as radius from (select *, {_BALL} from (select source_id, {_BOX}, count(distinct dataset_id) as n_datasets from cells group by 1))",
    "dataset_corners": f"with {_CELLS}, {_BOXES} select dataset_id, min_cx*0.087890625e0-180e0 as west, min_cy*0.0439453125e0-90e0 as south, max_cx*0.087890625e0-180e0 as east, max_cy*0.0439453125e0-90e0 as north from boxes",
    "posting_list": f"with {_CELLS} select source_id, cy*4096+cx as cell_id, count(distinct dataset_id) as n_datasets, min(dataset_id) as first_id, max(dataset_id) as last_id from cells group by 1, 2",
    "posting_arrays": f"with {_CELLS} select source_id, cy*4096+cx as cell_id, count(distinct dataset_id) as n_datasets, string_agg(cast(dataset_id as varchar), ',' order by dataset_id) as ids from cells group by 1, 2",
    "positional_posting": f"with {_CELLS} select cy*4096+cx as cell_id, source_id, dataset_id, row_number() over (partition by dataset_id order by cy*4096+cx) as position, count(*) over (partition by dataset_id) as size from cells",
    "positional_overlap": f"with {_CELLS}, l as (select cx, cy, dataset_id, row_number() over (partition by dataset_id order by cy*4096+cx) as position, count(*) over (partition by dataset_id) as size from cells) select dataset_id, size, count(*) as overlap, min(position) as first, max(position) as last from l join q using (cx, cy) group by 1, 2",
    "index_size": f"{_leaves_sql()}, nodes as (select distinct node >> i as node from (select node, unnest(range(0, 40)) as i from leafed) where node >> i > 0) select cast(36*((select count(*) from leafed)+(select count(*) from nodes)) as bigint) as tree_bytes, cast(8*count(distinct (source_id, cx, cy))+4*count(*) as bigint) as list_bytes from cells",
    "mbr_candidates": f"with {_CELLS}, {_BOXES} select b.dataset_id, (least(b.max_cx,qb.max_cx)-greatest(b.min_cx,qb.min_cx)+1)*(least(b.max_cy,qb.max_cy)-greatest(b.min_cy,qb.min_cy)+1) as common from boxes b, qb where {_MEET}",
    "ball_candidates": f"with {_CELLS}, {_BOXES} select b.dataset_id, round({_GAP},6) as gap from boxes b, qb where {_GAP} <= 3e0",
    "coverage_candidates": f"with {_CELLS}, {_BOXES} select b.dataset_id from boxes b, qb where b.min_cx<=qb.max_cx+3 and qb.min_cx<=b.max_cx+3 and b.min_cy<=qb.max_cy+3 and qb.min_cy<=b.max_cy+3 and {_GAP} <= 3e0",
    "coverage_leaf_candidates": _on_cells(lambda c: coverage_candidates(c, _one(c), 3, capacity=10).select("dataset_id"), keep=True),
    "cells_cache": _cached,
    "graph_cache": _cached_graph,
    "overlap_exclude_source": _on_cells(lambda c: overlap.top_k_overlap(s := _shared_ids(c), _one(s), 10, exclude=("S0", 1))),
    "overlap_graph_sources": _on_cells(lambda c: overlap_graph(_shared_ids(c)), keep=True),
    "overlap_upper_bound": f"""with {_CELLS}, {_BOXES}, c as (select b.dataset_id, greatest(b.min_cx,qb.min_cx) as lx, least(b.max_cx,qb.max_cx) as hx, greatest(b.min_cy,qb.min_cy) as ly, least(b.max_cy,qb.max_cy) as hy from boxes b, qb where {_MEET}),
 t as (select c.dataset_id, count(*) as n from c join cells d on c.dataset_id=d.dataset_id and d.cx between lx and hx and d.cy between ly and hy group by 1), m as (select c.dataset_id, count(*) as n from c join q on q.cx between lx and hx and q.cy between ly and hy group by 1)
 select t.dataset_id, least(t.n, m.n) as bound from t join m using (dataset_id)""",
    **{f"overlap_{s}": _OVERLAP for s in overlap.STRATEGIES},
    "overlap_batch": f"with {_CELLS}, {_EDGES} select query_id, rank, dataset_id, overlap from (select src as query_id, dst as dataset_id, w as overlap, row_number() over (partition by src order by w desc, dst) as rank from edges) where rank <= 3",
    "overlap_graph": f"with {_CELLS}, {_EDGES} select src, dst, w from edges",
    "overlap_graph_sorted": f"with {_CELLS}, {_EDGES} select src, dst, w, row_number() over (partition by src order by w desc, dst) as rank from edges",
    "overlap_graph_json": f"with {_CELLS}, {_EDGES} select src, dst, w from edges",
    "connected_d0": f"with {_CELLS} select distinct dataset_id from cells join {_NEAR.format(m='q')} n using (cx, cy) where dataset_id != 1",
    "connected_d3": f"with {_CELLS}, n as (select distinct cx+dx as cx, cy+dy as cy from q cross join (select unnest(range(-3, 4)) as dx) x cross join (select unnest(range(-3, 4)) as dy) y where dx*dx+dy*dy <= 9) select distinct dataset_id from cells join n using (cx, cy) where dataset_id != 1",
    **{f"coverage_{s}": _greedy_sql() for s in ("sg", "gasm", "bounds")},
    "coverage_gadm": _graph_greedy_sql(),
    **{f"coverage_{s}_d3": _greedy_sql(_NEAR_3) for s in ("sg", "gasm", "bounds")},
    "coverage_gadm_d3": _graph_greedy_sql(_NEAR_3),
    "global_coverage": "with {}, every as materialized (select concat(source_id, '/', dataset_id) as dataset_id, cx, cy from cells_), {} {}".format(_FED.replace("cells as materialized", "fed as materialized").replace("from cells", "from fed").replace(" q as materialized", " fq as materialized").replace("from q ", "from fq ") + ", cells_ as (select * from fed where theta = 12), q as materialized (select cx, cy from fq where theta = 12)", *_picks("every", skip="true")),
    "cells_cache": f"with {_CELLS} select dataset_id, cx, cy, cy*4096+cx as cell_id, density from cells",
    "graph_cache": f"with {_CELLS}, {_EDGES} select src, dst, w from edges",
    "overlap_exclude_source": f"with {_SHARED} select source_id, dataset_id, count(*) as overlap from two join (select distinct cx, cy from two where dataset_id = 1) q using (cx, cy) where not (source_id = 'S0' and dataset_id = 1) group by 1, 2 order by 3 desc, 2, 1 limit 10",
    "overlap_graph_sources": f"with {_SHARED} select a.dataset_id as src, a.source_id as src_source, b.dataset_id as dst, b.source_id as dst_source, count(*) as w from two a join two b using (cx, cy) where (a.source_id, a.dataset_id) != (b.source_id, b.dataset_id) group by 1, 2, 3, 4",
    "coverage_leaf_candidates": f"with {_CELLS}, {_BOXES} select b.dataset_id from boxes b, qb where b.min_cx<=qb.max_cx+3 and qb.min_cx<=b.max_cx+3 and b.min_cy<=qb.max_cy+3 and qb.min_cy<=b.max_cy+3 and {_GAP} <= 3e0",
    "update_upsert_sources": f"with {_CH_TWO} select a.source_id, a.dataset_id, count(*) as overlap from after a join (select cx, cy from after where source_id = 'E1' and dataset_id = 0) q using (cx, cy) where not (a.source_id = 'E1' and a.dataset_id = 0) group by 1, 2 order by 3 desc, 2, 1 limit 5",
    "update_moved_sources": f"with {_CH_TWO}, o as (select source_id, dataset_id, {_BOX} from before group by 1, 2), n as (select source_id, dataset_id, {_BOX} from after group by 1, 2) select n.source_id, n.dataset_id from n left join o using (source_id, dataset_id) where o.min_cx is distinct from n.min_cx or o.min_cy is distinct from n.min_cy or o.max_cx is distinct from n.max_cx or o.max_cy is distinct from n.max_cy",
    "update_leaves": f"{_leaves_sql(tables=_CH + ', cells as (select * from after), q as (select cx, cy from after where dataset_id = 1)')} select node as leaf_id, count(*) as n_datasets from leafed group by 1",
    "standing_coverage": _entered_picks(),
    "streaming_coverage": _entered_picks(),
    "source_candidates_overlap": f"with {_FED} select source_id from near",
    "source_candidates_coverage": f"with {_FED} select source_id from close",
    "federated_overlap": f"with {_FED} select source_id, dataset_id, overlap from (select *, row_number() over (partition by source_id order by overlap desc, dataset_id) as r from (select c.source_id, c.dataset_id, count(*) as overlap from cells c join q using (theta, cx, cy) where c.source_id in (select source_id from near) group by 1, 2)) where r <= 10 order by overlap desc, source_id, dataset_id limit 10",
    "federated_coverage": _federated_greedy_sql(),
    "update_upsert": f"with {_CH} select * from {_top_sql('after')} t",
    "update_delete": f"with {_CH}, less as (select * from before where not (dataset_id % 4 = 1 and dataset_id != 1)) select * from {_top_sql('less')} t",
    "update_moved": f"with {_CH}, o as (select dataset_id, {_BOX} from before group by 1), n as (select dataset_id, {_BOX} from after group by 1) select n.dataset_id from n left join o using (dataset_id) where o.min_cx is distinct from n.min_cx or o.min_cy is distinct from n.min_cy or o.max_cx is distinct from n.max_cx or o.max_cy is distinct from n.max_cy",
    "standing_delta": _ENTERED,
    "streaming_updates": _ENTERED,
    "kd_leaves": f"{_leaves_sql()} select node as leaf_id, count(*) as n_datasets from leafed group by 1",
    "tree_nodes": f"{_leaves_sql()}, above as (select node >> i as node, i = 0 as own, min_cx, min_cy, max_cx, max_cy from (select *, unnest(range(0, 40)) as i from leafed) where node >> i > 0) select node, bool_or(own) as is_leaf, min(min_cx) as min_cx, min(min_cy) as min_cy, max(max_cx) as max_cx, max(max_cy) as max_cy, count(*) as n_datasets from above group by 1",
}
