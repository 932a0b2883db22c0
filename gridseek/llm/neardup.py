"""Near-duplicate documents by a chosen-path set similarity join.

Documents of the same words are one class first. Independent trees then branch the classes: at each
level a class goes to the child that its minwise token of that level names, so that two classes of
similarity s stay together with probability s. A node of one class ends, a small node is compared
whole, and a large one branches on. A node is first compared with its first member, a large one at
full depth with its central members. If its members are then in one component, no further
comparison could change the result. Else a small node is compared between its components, and the
members of large ones are joined exactly: two sets of that similarity share a token among the first
few of each in any common order of all tokens, and tokens of a single set come first in ours.
Links are confirmed on full shingle sets, for pairs that agree in enough minwise tokens (a link of
similarity 0.85 misses that with probability below 1e-6). The number of trees follows the similarity (10 of depth 3 for 0.85, 13
for 0.80), so that a link meets in no tree with probability of at most 1e-4.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.llm import kernels as K
from gridseek.llm.common import bounded_batches, by_id, durable, plain
from gridseek.llm.components import components

#: Members of a node that is compared whole; central members that a large one is compared with.
SMALL, CENTRAL = 16, 2
#: Rows of a file of what is cut off on the way.
ROWS = 1 << 17
#: The same for whole sets, which are wider.
SETS = 1 << 12
#: Numbers of sets from which a token counts as more frequent, as far as there are such tokens.
OFTEN = (2, 4, 16, 64, *(8**i for i in range(3, 13)))


def _shingled(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: distinct shingles in order of (text, hash), their number for each text, two hashes of the words, number of words."""
    for _, _, data, offsets in K.chunks(column):
        data = K.LOWER[data]
        starts, ends, text = K.words(data, offsets, K.SOLID)
        per = np.bincount(text, minlength=len(offsets) - 1)
        last = np.cumsum(per)
        first = last - per
        words = K.span_hashes(data, starts, ends)
        whole = K.run_hashes(words, first, last)
        h = K.grams(words, width)
        full = text[: len(h)] == text[width - 1 :] if len(h) else np.zeros(0, bool)
        few = np.flatnonzero((per > 0) & (per < width))
        of, h = np.concatenate([text[: len(h)][full], few]), np.concatenate([h[full], whole[0][few]])
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
        yield h[new], np.bincount(of[new], minlength=len(per)), *whole, per


def _signed(docs: DataFrame, width: int, n: int, seed: int) -> DataFrame:
    """doc_id, two hashes of the words, n_shingles and n minwise tokens (none without shingles)."""
    rng = np.random.default_rng(seed)
    salts, odd = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    odd = odd * K.U(2) + K.U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sizes, signs = [], [], [], []
            for h, size, x, y, _ in _shingled(batch.column("text"), width):
                some = size > 0
                at = (np.cumsum(size) - size)[some]
                sign = np.zeros((int(some.sum()), n), dtype=np.int64)
                for i in range(n if len(h) else 0):
                    sign[:, i] = np.minimum.reduceat((h ^ salts[i]) * odd[i], at).view(np.int64)
                a.append(x), b.append(y), sizes.append(size), signs.append(sign.ravel())
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum((size > 0) * n))
            flat = np.concatenate(signs) if signs else np.zeros(0, np.int64)
            out = [pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out, pa.array(size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "k1", "k2", "n", "sign"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, sign array<long>")


def _sets(docs: DataFrame, width: int, wanted: K.Bloom) -> DataFrame:
    """id and shingles (8 bytes each, in order) of at least the documents that are wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.value.has(batch.column("key").to_numpy().view(K.U))))
            hashes, sizes = [], []
            for h, size, *_ in _shingled(batch.column("text"), width):
                hashes.append(h), sizes.append(size)
            ends = np.append(0, np.cumsum(np.concatenate(sizes) if sizes else [])).astype(np.int32) * 8
            raw = np.concatenate(hashes).tobytes() if hashes else b""
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])], names=["id", "shingles"])

    return docs.withColumn("key", F.xxhash64("doc_id")).mapInArrow(run, "id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=K.U) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same) and len(x) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _pairs(frame: DataFrame, one: str, n_one: str, other: str, n_other: str, percent: int) -> DataFrame:
    """Distinct pairs, less those whose sets are too different in size to reach the similarity."""
    near = frame.where(100 * F.least(n_one, n_other) >= percent * F.greatest(n_one, n_other))
    return near.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).where("a < b").distinct()


def _agreeing(pairs: DataFrame, signs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs that agree in no fewer minwise tokens than five standard deviations below the expectation at the similarity."""
    share = percent / 100
    least = int(n * share - 5 * (n * share * (1 - share)) ** 0.5)
    a, b = (signs.select(F.col("id").alias(c), F.col("sign").alias(f"sign_{c}")) for c in ("a", "b"))
    same = F.aggregate(F.zip_with("sign_a", "sign_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(same >= least).select("a", "b")


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int, bloom_bits: int) -> DataFrame:
    """Pairs (id, other) of members(id, component) in different components that can reach the similarity.

    A set of n tokens shares at least percent of them with any partner, so that a partner has one of its
    first n - ceil(n * percent / 100) + 1. The order of all tokens: the rarest first, in steps of OFTEN,
    and then by value. Where the first common token stands in either set bounds how many can follow.
    """
    spark = members.sparkSession

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column("shingles")[i].as_buffer(), dtype=np.int64))], names=["token"])

    own = sets.join(members, "id")
    counts = durable(own.select("shingles").mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("often")).where(F.col("often") >= OFTEN[0]), ROWS)
    most = counts.agg(F.max("often")).first()[0] or 0
    steps = spark.sparkContext.broadcast([K.Bloom.of(counts.where(F.col("often") >= least), "token", bloom_bits) for least in OFTEN if least <= most])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, place, sizes = [], [], [], []
            for i in range(len(batch)):
                h = np.frombuffer(batch.column("shingles")[i].as_buffer(), dtype=K.U)
                step = np.sum([np.zeros(len(h), bool), *(b.has(h) for b in steps.value)], axis=0)
                first = np.lexsort((h, step))[: len(h) - -(-len(h) * percent // 100) + 1]
                met = np.flatnonzero(step[first] > 0)  # others are of this set only
                out.append(h[first[met]])
                place.append(met)
                at.append(np.full(len(met), i))
                sizes.append(np.full(len(met), len(h)))
            rows, place, sizes = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (at, place, sizes))
            token = (np.concatenate(out) if out else np.zeros(0, K.U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), sizes, batch.column("component").take(rows), place, pa.array(token)], names=["id", "n", "component", "place", "token"])

    lists = durable(own.select("id", "component", "shingles").mapInArrow(firsts, "id long, n long, component long, place long, token long"), ROWS)
    # those outside the token's main component against all others
    parts = lists.groupBy("token", "component").agg(F.count("*").alias("m"))
    main = parts.groupBy("token").agg(F.max_by("component", "m").alias("main"), F.count("*").alias("parts")).where("parts > 1").select(plain("token").alias("key"), "main")
    apart = durable(lists.withColumn("key", plain("token")).join(main, "key").drop("key"), ROWS)
    # two of them meet once only
    outside = apart.where("component != main").select("token", F.col("id").alias("other"), F.col("n").alias("n_other"), F.col("component").alias("theirs"), F.col("place").alias("their_place"))
    common = F.least(F.col("n") - F.col("place"), F.col("n_other") - F.col("their_place"))
    near = (F.col("component") != F.col("theirs")) & (100 * common >= percent * (F.col("n") + F.col("n_other") - common))
    once = (F.col("component") == F.col("main")) | (F.col("id") < F.col("other"))
    return _pairs(apart.join(outside, "token").where(near & once), "id", "n", "other", "n_other", percent)


def _node_sizes(rows: DataFrame) -> DataFrame:
    """rows of nodes of two members at least, with the node's size."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select(plain("node").alias("key"), "size")
    return rows.withColumn("key", plain("node")).join(sizes, "key").drop("key")


def _central(large: DataFrame, n: int) -> DataFrame:
    """node and hub: the members that share a node with the most others over all trees, which estimates the mean similarity."""
    score = large.select("node", "id").join(large.groupBy("id").agg(F.sum("size").alias("score")), "id")
    # the best few of each node: first in slices of the node, then among these
    sliced = score.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.desc("score"), F.asc("id")]
    some = sliced.withColumn("r", F.row_number().over(Window.partitionBy("node", "slice").orderBy(*order))).where(F.col("r") <= n)
    return some.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("r") <= n).select("node", F.col("id").alias("hub"))


def trees_for(percent: int, depth: int, miss: float = 1e-4) -> int:
    """The least number of trees of that depth in which a pair at the threshold meets in none with probability miss at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** depth)))) if 0 < percent < 100 else 1


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, trees: int | None = None, depth: int = 3, seed: int = 7, bloom_bits: int = 1 << 28) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Documents of no words, and null texts, are linked with nothing. Rows that repeat an id are one
    document, linked with whatever one of its texts is like. Rows of a null id are linked with nothing, have a
    null component and are kept. Other columns of docs take no part. Unless given, trees is the least
    number for a miss of 1e-4 at percent.
    """
    trees = trees or trees_for(percent, depth)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounded_batches(docs.sparkSession)
    signed = durable(_signed(texts, width, trees * depth, seed))
    own = signed.where("doc_id is not null and n > 0")
    found = _linked(texts, own, percent, width, trees, depth, bloom_bits)
    # all documents of a class have the component of the class
    classes = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    whole = classes.join(found, "id", "left").select(plain("k1").alias("key"), "k2", F.coalesce("component", "id").alias("component"))
    joined = own.select("doc_id", plain("k1").alias("key"), "k2").join(whole, ["key", "k2"]).select("doc_id", "component")
    return _resolved(signed, own, joined)


def _linked(texts: DataFrame, own: DataFrame, percent: int, width: int, trees: int, depth: int, bloom_bits: int) -> DataFrame:
    """id and component of the classes of documents of the same words that are linked with others; a class has its least id."""
    signs = durable(own.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("sign").alias("sign")).select("id", "n", "sign"), ROWS)

    def token(tree, level: int):
        """Beyond its own levels a tree takes those of the next trees."""
        return F.element_at("sign", (F.pmod(tree + level // depth, F.lit(trees)) * depth + level % depth + 1).cast("int"))

    # the path of a class in each tree, and then only this
    rows = signs.select("id", "n", "sign", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    for level in range(depth):
        rows = rows.withColumn(f"p{level}", F.xxhash64(F.col(f"p{level - 1}") if level else F.col("tree"), token(F.col("tree"), level)))
    rows = rows.drop("sign")
    names, done = ("node", "id", "n", "tree", "size"), []
    for level in range(depth):
        sized = _node_sizes(rows.withColumn("node", F.col(f"p{level}")))
        if level == depth - 1:
            done.append(sized.select(*names))
            break
        sized = durable(sized.drop(f"p{level}"), ROWS)
        done.append(sized.where(F.col("size") <= SMALL).select(*names))
        rows = sized.where(F.col("size") > SMALL).drop("node", "size")
    nodes = done[0]
    for x in done[1:]:
        nodes = nodes.unionAll(x)
    nodes = durable(nodes, ROWS)

    def confirmed(pairs: DataFrame) -> DataFrame:
        agreeing = durable(_agreeing(pairs, signs, trees * depth, percent), ROWS)
        return durable(_confirmed(agreeing, of(agreeing.select(F.explode(F.array("a", "b")).alias("id"))), percent).distinct(), ROWS)

    def of(ids: DataFrame) -> DataFrame:
        wanted = K.Bloom.of(ids.select(F.xxhash64("id").alias("key")).distinct(), "key", bloom_bits)
        return durable(_sets(texts.where("doc_id is not null"), width, wanted), SETS)

    # each member with its node's first or central members
    small, large = nodes.where(F.col("size") <= SMALL), nodes.where(F.col("size") > SMALL)
    hubs = small.groupBy("node").agg(F.min("id").alias("hub"))
    if not large.isEmpty():
        hubs = hubs.unionAll(_central(large, CENTRAL))
    hubs = hubs.join(signs.select(F.col("id").alias("hub"), F.col("n").alias("n_hub")), "hub")
    tried = durable(_pairs(nodes.join(hubs, "node"), "id", "n", "hub", "n_hub", percent), ROWS)
    links = confirmed(tried)
    found = components(links)

    # what is left: nodes whose members are not in one component
    known = durable(nodes.join(found, "id", "left").select("node", "id", "n", "size", F.coalesce("component", "id").alias("component")), ROWS)
    apart = known.groupBy("node").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select(plain("node").alias("key"))
    left = durable(known.withColumn("key", plain("node")).join(apart, "key").drop("key"), ROWS)
    one = left.where(F.col("size") <= SMALL)
    other = one.select("node", F.col("id").alias("other"), F.col("n").alias("n_other"), F.col("component").alias("theirs"))
    pairs = _pairs(one.join(other, "node").where("id < other and component != theirs"), "id", "n", "other", "n_other", percent)
    members = left.where(F.col("size") > SMALL).select("id", "component").distinct()
    if not members.isEmpty():
        pairs = pairs.unionAll(_rare_pairs(members, of(members), percent, bloom_bits)).distinct()
    # a table of its own: what was tried is taken out of different pairs, not of each token that makes them
    more = confirmed(durable(pairs, ROWS).join(tried, ["a", "b"], "left_anti"))
    return found if more.isEmpty() else components(links.unionAll(more))


def _resolved(signed: DataFrame, own: DataFrame, joined: DataFrame) -> DataFrame:
    """A row for each row of signed. Rows that repeat an id may be in several classes, which it joins."""
    first, last = (F.struct("k1", "k2"),) * 2
    unlike = own.groupBy("doc_id").agg(F.min(first).alias("x"), F.max(last).alias("y")).where("x != y").select("doc_id")
    if not unlike.isEmpty():
        joined = durable(joined)
        least = joined.groupBy("doc_id").agg(F.min("component").alias("component"), F.max("component").alias("other")).where("component < other")
        ends = joined.join(least.select("doc_id", F.col("component").alias("least")), "doc_id").select(F.col("component").alias("a"), F.col("least").alias("b"))
        merged = components(ends).withColumnRenamed("component", "whole").withColumnRenamed("id", "component")
        joined = joined.join(merged, "component", "left").select("doc_id", F.coalesce("whole", "component").alias("component"))
    least = joined.groupBy("doc_id").agg(F.min("component").alias("component"))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(least, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one document of each component, the one of the smallest id."""
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    return by_id(docs, kept, "left_semi").unionAll(docs.where(docs["doc_id"].isNull()))
