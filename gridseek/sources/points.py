"""From files of points to the table of cells that all searches run on.

cells(source_id, dataset_id, cx, cy, cell_id, density): the distinct cells of each dataset and how many
of its points lie in each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.functions.grid import NUMBER, Grid

#: Most columns that a file of points may have.
WIDEST = 64


@dataclass(frozen=True)
class Layout:
    """Places of the two coordinates among a source's columns, from 0."""

    x: int = 0
    y: int = 1


#: Sources that are laid out in their own way; a name that ends in * is a beginning.
LAYOUTS = {"argoverse*": Layout(6, 7), "baidu": Layout(1, 2)}


def layout_of(source_id: str, layouts: dict[str, Layout] | None = None) -> Layout:
    """The layout of a source: by its name, by the longest fitting beginning, or the first two columns."""
    known = LAYOUTS if layouts is None else layouts
    if source_id in known:
        return known[source_id]
    starts = [k for k in known if k.endswith("*") and source_id.startswith(k[:-1])]
    return known[max(starts, key=len)] if starts else Layout()


def read_csv_raw(spark: SparkSession, path: str, source_id: str, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """raw(source_id, dataset_id, x, y) of a folder of CSV files with a header line; texts as they stand.

    The columns are picked by place, so that headers may differ from file to file. A dataset's id is its
    file's name.
    """
    at = layout_of(source_id, layouts)
    if max(at.x, at.y) >= WIDEST:
        raise ValueError(f"coordinates are looked for in the first {WIDEST} columns")
    names = [f"_{i}" for i in range(max(at.x, at.y) + 1)]
    rows = spark.read.csv(path, header=True, enforceSchema=True, schema=", ".join(f"{n} string" for n in names), mode="PERMISSIVE")
    return rows.select(F.lit(source_id).alias("source_id"), F.col("_metadata.file_name").alias("dataset_id"), F.col(names[at.x]).alias("x"), F.col(names[at.y]).alias("y"))


def valid_points(raw: DataFrame, grid: Grid | None = None) -> DataFrame:
    """Points of text columns x and y: rows whose x is a plain number, whose y can be read and that lie strictly inside.

    Other rows go, each by itself.
    """
    grid = grid or Grid()
    lng, lat = F.col("x").try_cast("double"), F.col("y").try_cast("double")
    points = raw.where(F.col("x").rlike(NUMBER)).withColumns({"lng": lng, "lat": lat}).drop("x", "y")
    return points.where(grid.inside(F.col("lng"), F.col("lat")))


def read_csv_points(spark: SparkSession, path: str, source_id: str, layouts: dict[str, Layout] | None = None) -> DataFrame:
    return valid_points(read_csv_raw(spark, path, source_id, layouts))


def gridded(points: DataFrame, grid: Grid) -> DataFrame:
    """points inside the extent with cx, cy and cell_id in place of lng and lat."""
    cx, cy = grid.cx(F.col("lng")), grid.cy(F.col("lat"))
    inside = points.where(grid.inside(F.col("lng"), F.col("lat")))
    return inside.withColumns({"cx": cx, "cy": cy}).withColumn("cell_id", grid.cell_id(F.col("cx"), F.col("cy"))).drop("lng", "lat")


def cells_of(points: DataFrame, grid: Grid) -> DataFrame:
    """cells of points(source_id, dataset_id, lng, lat): one aggregation, partly before its shuffle."""
    keys = [c for c in ("source_id", "dataset_id") if c in points.columns]
    counted = gridded(points, grid).groupBy(*keys, "cx", "cy").agg(F.count("*").alias("density"))
    return counted.select(*keys, "cx", "cy", grid.cell_id(F.col("cx"), F.col("cy")).alias("cell_id"), "density")


def write_cells(cells: DataFrame, path: str, theta: int) -> None:
    """The cache of a grid: by source, and sorted so that a box reads few row groups."""
    out = cells.withColumn("theta", F.lit(theta)).repartitionByRange("source_id", "cx", "cy").sortWithinPartitions("source_id", "cx", "cy")
    # other resolutions stay
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("theta", "source_id").parquet(path)


def read_cells(spark: SparkSession, path: str, theta: int) -> DataFrame:
    cells = spark.read.parquet(path).where(F.col("theta") == theta)
    return cells.select(F.col("source_id").cast("string").alias("source_id"), "dataset_id", "cx", "cy", "cell_id", "density")


def stored_or_made(spark: SparkSession, path: str, make: Callable[[], DataFrame], options: dict[str, str] | None = None) -> DataFrame:
    """The table at path; where there is none, make() is written there first, with the options of the writer."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.options(**(options or {})).parquet(path)
        return spark.read.parquet(path)


def load_or_make_cells(spark: SparkSession, path: str, theta: int, points: Callable[[], DataFrame]) -> DataFrame:
    """The cells that are stored at path for that resolution; where there are none, those of the points are made and stored beside other resolutions."""
    try:
        known = read_cells(spark, path, theta)
        if not known.isEmpty():
            return known
    except AnalysisException:
        pass
    write_cells(cells_of(points(), Grid(theta)), path, theta)
    return read_cells(spark, path, theta)
