"""Standing queries over a stream of points of changed datasets.

Each micro-batch brings all points of the datasets that it changes. Their cells replace the stored
ones; the answer is made anew, and what enters it is appended to a table of changes. Cells are stored in
parts by a hash of their dataset: a batch writes new versions of the parts that it touches, and a small table says which
version of each part a batch ends with. A batch that is run again after a failure starts from the same versions and
overwrites its own output: each change is made exactly once. Versions that neither the last batch nor the one before names are
deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.functions.grid import Grid
from gridseek.operators.coverage import top_k_coverage
from gridseek.operators.keys import keys_of
from gridseek.operators.overlap import top_k_overlap
from gridseek.operators.updates import standing_delta, upsert
from gridseek.plans.lineage import cut, discard
from gridseek.sources.points import cells_of


class StandingQuery:
    """search: a function of the cells that gives the answer. parts: into how many the cells are dealt; it must stay the same for a folder."""

    def __init__(self, spark: SparkSession, folder: str, grid: Grid, search: Callable[[DataFrame], DataFrame], parts: int = 64) -> None:
        self.spark, self.folder, self.grid, self.search, self.parts = spark, folder, grid, search, parts

    def _part(self, cells: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*keys_of(cells)), F.lit(self.parts)).cast("int")

    def _path(self, part: int, version: int) -> str:
        return f"{self.folder}/cells/{version}/part={part}"

    def _write(self, cells: DataFrame, batch: int) -> None:
        cells.withColumn("part", self._part(cells)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/cells/{batch}")

    def _named(self, batch: int) -> dict[int, int]:
        """The version of each part after a batch: as many rows as parts."""
        return {r["part"]: r["version"] for r in self.spark.read.parquet(f"{self.folder}/versions/{batch}").collect()}

    def _name(self, batch: int, versions: dict[int, int]) -> None:
        self.spark.createDataFrame(sorted(versions.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{batch}")

    def _read(self, versions: dict[int, int]) -> DataFrame:
        empty = self.spark.read.parquet(f"{self.folder}/columns")
        if not versions:
            return empty
        return self.spark.read.schema(empty.schema).parquet(*[self._path(p, v) for p, v in sorted(versions.items())])

    def _touched(self, cells: DataFrame) -> list[int]:
        return [r[0] for r in cells.select(self._part(cells)).distinct().collect()]  # parts at most

    def start_with(self, cells: DataFrame) -> None:
        """Version -1: what is known before the stream."""
        known = cut(cells)
        known.limit(0).write.mode("overwrite").parquet(f"{self.folder}/columns")
        self._write(known, -1)
        self._name(-1, dict.fromkeys(self._touched(known), -1))

    def cells(self, batch: int) -> DataFrame:
        return self._read(self._named(batch))

    def answer(self, batch: int) -> DataFrame:
        return self.search(self.cells(batch))

    def __call__(self, points: DataFrame, batch: int) -> None:
        changed, old = cut(cells_of(points, self.grid)), self._named(batch - 1)
        touched = self._touched(changed)
        if touched:
            self._write(upsert(self._read({p: old[p] for p in touched if p in old}), changed), batch)
        self._name(batch, {**old, **dict.fromkeys(touched, batch)})
        entered = standing_delta(self.answer(batch - 1), self.answer(batch)).withColumn("batch", F.lit(batch).cast("long"))
        entered.write.mode("overwrite").parquet(f"{self.folder}/entered/batch={batch}")
        try:
            before = self._named(batch - 2)
        except AnalysisException:  # the first batch
            return
        for part, version in before.items():
            if old.get(part) != version:
                discard(self.spark, self._path(part, version))

    def run(self, points: DataFrame) -> None:
        """Handles all that is there of a streaming DataFrame of points and stops."""
        stream = points.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True)
        stream.start().awaitTermination()

    def entered(self) -> DataFrame:
        """The rows of the answer and batch of all that has entered it."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/entered")


class StandingOverlap(StandingQuery):
    """query: a function of the cells that gives the query's cells, for a query may be a dataset that changes itself."""

    def __init__(self, spark: SparkSession, folder: str, grid: Grid, query: Callable[[DataFrame], DataFrame], k: int = 10, exclude: object = None) -> None:
        super().__init__(spark, folder, grid, lambda cells: top_k_overlap(cells, query(cells), k, exclude=exclude))


class StandingCoverage(StandingQuery):
    """The same for a coverage query."""

    def __init__(self, spark: SparkSession, folder: str, grid: Grid, query: Callable[[DataFrame], DataFrame], k: int = 10, delta: float = 0, exclude: object = None, strategy: str = "sg") -> None:
        super().__init__(spark, folder, grid, lambda cells: top_k_coverage(cells, query(cells), k, delta, strategy, exclude))
