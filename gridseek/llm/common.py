"""Helpers shared by the training-text operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: White space of the word rules: space and U+0009 to U+000D.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table of a data folder, which any path that Spark reads may name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on a single machine, where none is set, a temporary one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridseek-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts lineage with a table in the shared folder, so that a lost executor costs no recomputation.

    Unlike a checkpoint the table is compressed, has sizes that the planner knows, and brings no
    predicates of its plan along. It is deleted when the program ends. With rows, the result is counted on the
    executors' disks first and written in files of about so many rows, however many partitions it comes from: a
    loop over small tables would else write a file for each of them, and each file costs more than its rows.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if rows:
        df = df.persist(StorageLevel.DISK_ONLY)
        df.coalesce(max(1, -(-df.count() // rows))).write.parquet(path)
        df.unpersist()
    else:
        df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def stored(df: DataFrame) -> DataFrame:
    """Like durable(), and lets go of what led here: its shuffle files go as soon as the driver has collected its garbage."""
    spark = df.sparkSession
    out = durable(df)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of durable() or stored() that nothing reads any more."""
    for table_ in tables:
        _delete(table_.sparkSession, _paths.pop(table_))


def plain(key: str) -> Column:
    """A one-to-one image of a long key by which nothing is partitioned yet: a join on it shuffles both sides, of which Spark can split hot keys."""
    return F.col(key).bitwiseXOR(F.lit(1))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Whole texts go to Python by so many rows and bytes at once at most (one row may be larger), so that a worker's memory stays small; lower settings stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_keys() -> dict[str, Column]:
    """Two hashes of the text, which tell rows of one doc_id, or of none, apart."""
    return {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}


def by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of docs, with all their columns, that are among rows(doc_id, t1, t2) (left_semi) or aren't (left_anti); null ids are equal."""
    names = fresh(docs, "id", "t1", "t2", "null")
    id_, t1, t2, null = names
    own = docs.withColumns({t1: F.xxhash64("text"), t2: F.xxhash64(F.lit(1), "text"), null: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    wanted = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("doc_id").isNull().alias(null)).distinct()
    return own.join(wanted, names, how).select(*[own[c] for c in docs.columns])


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is among ids (left_semi) or isn't (left_anti)."""
    (key,) = fresh(docs, "id")
    right = ids.select(F.col("doc_id").alias(key))
    return docs.join(right, docs["doc_id"] == right[key], how)
