"""The overlap graph: datasets that share cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridseek.operators.overlap import CROWD
from gridseek.operators.pairs import neighbours
from gridseek.sources.points import stored_or_made


def _edges(found: DataFrame, *more: str) -> DataFrame:
    """neighbours as src, dst, w, with sources also src_source and dst_source."""
    names = [(c, end) for c, end in (("source_id", "_source"), ("dataset_id", "")) if c in found.columns]
    return found.select(*[F.col(f"of_{c}").alias(f"src{end}") for c, end in names], *[F.col(c).alias(f"dst{end}") for c, end in names], "w", *more)


def overlap_graph(cells: DataFrame) -> DataFrame:
    """edges(src, dst, w), with sources also src_source and dst_source: both directions of each two datasets that share w > 0 cells.

    Pairs are counted block by block and never shuffled: all edges of a src come from one task.
    """
    return _edges(neighbours(cells, size=CROWD))


def load_or_make_graph(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """The graph that is stored at path; where there is none it is made of the cells and stored.

    Each two datasets are stored once, as low, high (in the order of ids) and w, sorted so that files hold small differences, and
    turned when they are read. Edges (src, dst, w) that were stored in both directions are read as they are.
    """
    stored = stored_or_made(spark, path, lambda: _halves(cells), {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#high": "false"})
    ends = [c for c in stored.columns if c.startswith(("low", "high"))]
    if not ends:
        return stored
    src, dst = ([c for c in ends if c.startswith(side)] for side in ("low", "high"))
    names = [c.replace("low", "src") for c in src] + [c.replace("low", "dst") for c in src]
    way = lambda order: F.struct(*[F.col(c).alias(n) for c, n in zip(order, names)])
    both = stored.select(F.explode(F.array(way([*src, *dst]), way([*dst, *src]))).alias("e"), "w")
    return both.select(*[F.col(f"e.{n}").alias(n) for n in names], "w")


def _halves(cells: DataFrame) -> DataFrame:
    half = _edges(neighbours(cells, size=CROWD, later=True))
    return half.withColumnsRenamed({c: c.replace("src", "low").replace("dst", "high") for c in half.columns})


def sorted_graph(edges: DataFrame) -> DataFrame:
    """edges with rank among the edges of src, from the greatest weight, ties by dst."""
    src, dst = ([c for c in edges.columns if c.startswith(side)] for side in ("src", "dst"))
    order = Window.partitionBy(*src).orderBy(F.desc("w"), *dst)
    return edges.withColumn("rank", F.row_number().over(order).cast("long"))


def ranked_graph(cells: DataFrame) -> DataFrame:
    """sorted_graph of the cells' overlap graph; a task has all edges of its datasets and ranks them."""
    return _edges(neighbours(cells, size=CROWD, order="weight"), "rank")


def graph_json(edges: DataFrame) -> DataFrame:
    """One JSON object {dst: w} for each src, as a file of such a graph has it."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("dst").cast("string").alias("key"), F.col("w").alias("value")))))
    return edges.groupBy("src").agg(F.to_json(pairs).alias("neighbours"))


def cells_json(cells: DataFrame) -> DataFrame:
    """graph_json of the cells' overlap graph, for cells of one source; a task has all edges of its datasets, which are neither shuffled nor sorted again."""
    found = neighbours(cells.drop("source_id"), size=CROWD, order="text", nested=True)
    pairs = F.map_from_entries(F.transform("near", lambda e: F.struct(e["dataset_id"].cast("string").alias("key"), e["w"].alias("value"))))
    return found.select(F.col("of_dataset_id").alias("src"), F.to_json(pairs).alias("neighbours"))


def graph_from_json(rows: DataFrame) -> DataFrame:
    parsed = F.from_json("neighbours", "map<string,bigint>")
    return rows.select("src", F.explode(parsed).alias("dst", "w"))
