"""Mixing sources to target weights with a low-discrepancy schedule.

Slot j of the schedule gets the point frac((j + 1/2) * golden ratio), and the cumulated weights say
whose it is. A source's slots are ranked; its documents, shuffled and laid end to end, are cut to
blocks of equal words; slot r takes block r, and once all are taken, the first again. The last slot
of a source takes what its target still needs. The schedule's error is a few slots a source: slots
beyond the target go, and missing ones follow at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.llm.common import SPACE_WORD, durable

GOLDEN = 0.6180339887498949
#: Documents that one running sum covers, and slots.
RANGE = 1000
#: Weights of the sources by code point, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, n_docs, target, low and high (its part of the schedule), one row for each source.

    A target reaches its limit exactly if limit / weight is at most the level at which the others
    share the rest; sources in order of that ratio are limited up to some point, which running sums find.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    # the level if all before are limited and none from here on
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = limited.withColumn("level", level).withColumn("over", F.col("limit") / F.col("weight") <= F.col("level"))
    # the first that isn't limited has the level of all others
    common = F.min(F.when(~F.col("over"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    target = levels.withColumn("common", common).withColumn("target", F.coalesce(F.least("limit", F.col("weight") * F.col("common")), F.col("limit")))
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    high = F.try_divide(F.sum("target").over(up), F.sum("target").over(everything))
    placed = target.withColumn("high", F.coalesce(high, F.lit(0.0)))
    return placed.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("rank")), F.lit(0.0))).select("source", "rank", "source_size", "n_docs", "target", "low", "high")


def _offsets(docs: DataFrame, keys: list[str], value: str, total: str) -> DataFrame:
    """docs with `start`, the sum of value before each row within its source, in the order of keys.

    Two steps, so that a source of any size spreads out: running sums within ranges of about RANGE
    rows, and running sums of the ranges' totals.
    """
    ranged = docs.withColumn("range", F.floor(F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)) * F.ceil(F.col(total) / F.lit(float(RANGE)))).cast("long"))
    sums = ranged.groupBy("rank", "range").agg(F.sum(value).alias("all"))
    first = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("rank", "range", F.coalesce(F.sum("all").over(first), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("before", F.coalesce(F.sum(value).over(within), F.lit(0))).join(base, ["rank", "range"]).withColumn("start", F.col("base") + F.col("before"))


def schedule(targets: DataFrame, n_slots: int, block: int) -> DataFrame:
    """slot, rank of the source and turn (the slot's number within its source, from 0).

    Each source has as many slots as its target needs, targets being in words and slots of block words.
    [0, 1) is cut to as many equal cells as there are sources: a point is looked up among the sources of its cell only,
    and no source's row comes to the driver.
    """
    words, size = F.round("target").cast("long"), F.col("source_size")
    # each pass over the source ends with a block that may be short
    passes, rest = F.floor(words / size).cast("long"), words % size
    need = passes * F.ceil(size / F.lit(float(block))) + F.ceil(rest / F.lit(float(block)))
    some = targets.where("target > 0").select("rank", "low", "high", need.cast("long").alias("need"))
    n, last = some.agg(F.count("*"), F.max("rank")).first()
    cell = lambda x: F.least(F.floor(x * n).cast("long"), F.lit(n - 1).cast("long"))
    point = ((F.col("id") + 0.5) * GOLDEN) % 1.0
    high = F.when(F.col("rank") == last, 2.0).otherwise(F.col("high"))  # sums may end a little below 1
    parts = some.withColumn("high", high).withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = targets.sparkSession.range(n_slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    slots = points.join(parts, "cell").where("point >= low and point < high").select("slot", "rank", "need", F.floor(F.col("slot") / (4 * RANGE)).alias("range"))
    counts = slots.groupBy("rank", "range").agg(F.count("*").alias("n"))
    first = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("rank", "range", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    turn = F.col("base") + F.row_number().over(Window.partitionBy("rank", "range").orderBy("slot")) - 1
    ranked = slots.join(base, ["rank", "range"]).withColumn("turn", turn).where("turn < need").select("slot", "rank", "turn")
    have = counts.groupBy("rank").agg(F.sum("n").alias("have"))
    short = some.join(have, "rank", "left").select("rank", "need", F.coalesce("have", F.lit(0)).alias("have")).where("have < need")
    more = short.select("rank", F.explode(F.sequence("have", F.col("need") - 1)).alias("turn"))
    return ranked.unionByName(more.select((F.lit(n_slots) + F.col("turn")).alias("slot"), "rank", F.col("turn").cast("long").alias("turn")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row of docs.

    size counts words between white space; null and empty texts have none and are taken 0 times. The
    sources, by code point with null last, have the weights in turn and share `share` of all words; a
    target ends at `most` times its source's size, and what it leaves is shared anew. taken sums the
    words of the document in the blocks of its source's slots, repeats counted: at most `most` times
    its size where that is a whole number. The shuffle is a hash of the id, so that reruns agree;
    rows that repeat an id and a text are taken in turn. Other columns take no part.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    sizes = durable(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"), F.xxhash64("text", F.lit(seed)).alias("tie")))
    targets = durable(_targets(sizes, weights, share, most))
    known = sizes.join(targets.select(F.col("source").alias("s"), "rank", "source_size", "n_docs", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = durable(_offsets(known, ["order", "doc_id", "tie", "size"], "size", "n_docs").select("doc_id", "source", "size", "rank", "source_size", "target", "start"))

    total = targets.agg(F.sum("target")).first()[0] or 0
    slots = schedule(targets, int(round(total)) // block, block)
    # a block: how often it is taken whole, and the words of the one time that it is taken in part
    own = targets.where("target > 0").select("rank", "source_size", F.round("target").cast("long").alias("words"))
    blocks = F.ceil(F.col("source_size") / F.lit(float(block))).cast("long")
    turns = slots.join(own, "rank").withColumn("blocks", blocks)
    # turns of whole passes take blocks by their own length, so the words before a turn are known
    at = turns.withColumn("block", F.col("turn") % F.col("blocks")).withColumn("done", F.floor(F.col("turn") / F.col("blocks")) * F.col("source_size") + F.col("block") * block)
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    use = at.withColumn("use", F.greatest(F.lit(0), F.least(length, F.col("words") - F.col("done")))).where("use > 0")
    taken = use.groupBy("rank", "block").agg(F.count("*").alias("times"), F.collect_list("use").alias("uses"))

    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = laid.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    got = F.aggregate("uses", F.lit(0).cast("long"), lambda acc, u: acc + F.greatest(F.lit(0).cast("long"), F.least(high, u) - low))
    words = spread.join(taken, ["rank", "block"]).groupBy("rank", "start").agg(F.sum(got).alias("got"))
    counted = laid.where("size > 0").join(words, ["rank", "start"], "left").unionByName(laid.where("size = 0").withColumn("got", F.lit(0).cast("long")))
    return counted.select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
