"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart by their first `width` bytes only, and suffixes that are equal so far form a
group. Most-significant-digit passes split the groups; a group of one is done and leaves:

1. The first digit is a `gram`-byte piece of the window: the one of the least hash, which the
   window's bytes alone fix. Neighbouring windows share it, so that one row stands for a run of
   suffixes. Digits that occur once leave here.
2. All bytes around the digit sort the runs of a group into classes. Runs of one class are equal, so
   that all but its earliest are repeats. Where the class is the whole group, that is all.
3. Else the earliest run of each class goes on, with its bytes, in parts of `part` windows. The digit
   is then what all windows of a part hold; again single digits leave and equal parts form classes.
4. What is left goes on window by window, with all its bytes as the last digit.

Equal groups are then exactly the repeated windows. Bytes are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm import kernels as K
from gridseek.llm.common import bounded_batches, discard, plain, stored

#: Bytes that are handled at once, so that the arrays stay in the processor's cache.
PIECE_BITS = 17
PIECE = 1 << PIECE_BITS
LEAST = -(1 << 63)


def _pieces(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place of the piece in it, bytes, offsets): runs of whole texts, or parts of one long text that overlap by width - 1."""
    for i, _, data, offsets in K.chunks(column, PIECE):
        if len(offsets) > 2 or len(data) <= PIECE:
            yield i, 0, data, offsets
        else:
            for at in range(0, len(data) - width + 1, PIECE - width + 1):
                piece = data[at : at + PIECE]
                yield i, at, piece, np.array([0, len(piece)])


class _Runs:
    """The runs of windows that share their digit, in one piece.

    part: 0 for whole runs with the gram as the digit; else parts of so many windows by their distance
    to the gram, with the bytes that all windows of the part hold as the digit.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int, part: int) -> None:
        self.width, n = width, len(data)
        self.up, self.down = K.powers(K.BASE, PIECE + 1), K.powers(K.BASE2, PIECE + 1)
        plus = data.astype(K.U) + K.U(1)
        self.totals = []
        for base in (self.up, self.down):
            total = np.zeros(n + 1, dtype=K.U)
            np.cumsum(plus * base[0][:n], out=total[1:])
            self.totals.append(total)
        if n < width:
            self.first = self.last = self.at = self.text = np.zeros(0, dtype=np.int64)
            self.digit = np.zeros(0, dtype=K.U)
            return
        hashes = K.mix((self.totals[0][gram:] - self.totals[0][:-gram]) * self.up[1][: n - gram + 1])
        keys = (hashes & K.U(K.MASK ^ (PIECE - 1))) | np.arange(len(hashes), dtype=K.U)
        at = (K.sliding_min(keys, width - gram + 1) & K.U(PIECE - 1)).astype(np.int64)
        lengths = np.diff(offsets)
        end = np.repeat(offsets[1:], lengths)[: len(at)]
        whole = np.flatnonzero(end - np.arange(len(at)) >= width)
        at = at[whole]
        away = (at - whole) // part if part else at
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1) | (away[1:] != away[:-1])
        new = np.flatnonzero(new)
        self.first = whole[new]
        self.last = whole[np.append(new[1:], len(whole)) - 1] if len(new) else whole
        self.at = at[new]
        self.text = np.searchsorted(offsets, self.first, side="right") - 1
        if part:
            start = self.at - away[new] * part
            self.digit = K.mix(self.spans(start, start + width - part + 1)[0] ^ away[new].astype(K.U))
        else:
            self.digit = hashes[self.at]

    def spans(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of bytes low to high."""
        size = (high - low).astype(K.U)
        return tuple(K.mix((t[high] - t[low]) * p[1][low] + size) for t, p in zip(self.totals, (self.up, self.down)))

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all bytes of each run and of the digit's place in it."""
        a, b = self.spans(self.first, self.last + self.width)
        place = (self.at - self.first).astype(K.U)
        return K.mix(a ^ place), b


def _digits(column: pa.Array, width: int, gram: int, part: int) -> pa.RecordBatch:
    """Each digit, how often it occurs, and the least and greatest hash of what is around it."""
    digits, rounds = [], []
    for _, _, data, offsets in _pieces(column, width):
        runs = _Runs(data, offsets, width, gram, part)
        if len(runs.digit):
            digits.append(runs.digit)
            rounds.append(runs.around()[0])
    digit, around = (np.concatenate(x) if x else np.zeros(0, K.U) for x in (digits, rounds))
    around = around.view(np.int64)  # in the order in which SQL compares them
    order = np.lexsort((around, digit))
    digit, around = digit[order], around[order]
    new = np.flatnonzero(np.append(True, digit[1:] != digit[:-1])) if len(digit) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(digit))[: len(new)]
    columns = (digit[new].view(np.int64), ends - new, around[new], around[ends - 1])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["digit", "n", "low", "high"])


def _found(texts: DataFrame, column: str, width: int, gram: int, part: int, bloom_bits: int) -> tuple:
    """Bloom filters, sent to all executors, of the digits that occur twice or more and of those with unlike bytes around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digits(batch.column(column), width, gram, part)

    found = (
        texts.select(column)
        .mapInArrow(run, "digit long, n long, low long, high long")
        .groupBy("digit")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where("n > 1")
        .select("digit", (F.col("low") != F.col("high")).alias("mixed"))
    )
    found = stored(found)
    filters = tuple(texts.sparkSession.sparkContext.broadcast(K.Bloom.of(x, "digit", bloom_bits)) for x in (found, found.where("mixed")))
    discard(found)
    return filters


def _runs(column: pa.Array, width: int, gram: int, twice: K.Bloom, mixed: K.Bloom) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, key, key, mixed, again) of runs whose digit occurs twice; again: an equal one is before in the text."""
    out: list[tuple[np.ndarray, ...]] = []
    for i, at, data, offsets in _pieces(column, width):
        runs = _Runs(data, offsets, width, gram, 0)
        keep = np.flatnonzero(twice.has(runs.digit))
        if len(keep):
            start = offsets[runs.text[keep]] - at
            a, b = runs.around()
            out.append((i + runs.text[keep], runs.first[keep] - start, runs.last[keep] - start, a[keep], b[keep], mixed.has(runs.digit[keep])))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, K.U, K.U, bool, bool))
    text, low, high, a, b, many = (np.concatenate(x) for x in zip(*out))
    order, again = _again(text, low, a, b)
    text, low, high, a, b, many = (x[order] for x in (text, low, high, a, b, many))
    return text, low, high, a, b, many, again


def _parts(column: pa.Array, width: int, gram: int, part: int, twice: K.Bloom, mixed: K.Bloom) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, key, key) of parts whose digit occurs twice: whole, or window by window where it is mixed."""
    out: list[tuple[np.ndarray, ...]] = []
    for i, _, data, offsets in _pieces(column, width):
        runs = _Runs(data, offsets, width, gram, part)
        keep = np.flatnonzero(twice.has(runs.digit))
        if not len(keep):
            continue
        many = mixed.has(runs.digit[keep])
        one, each = keep[~many], keep[many]
        start = offsets[runs.text]
        a, b = runs.around()
        out.append((i + runs.text[one], runs.first[one] - start[one], runs.last[one] - start[one], a[one], b[one]))
        size = runs.last[each] - runs.first[each] + 1
        run = np.repeat(each, size)
        p = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + runs.first[run]
        out.append((i + runs.text[run], p - start[run], p - start[run], *runs.spans(p, p + width)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, K.U, K.U))
    return tuple(np.concatenate(x) for x in zip(*out))


def _again(text: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and in that order whether an equal one is before in the same text."""
    order = np.lexsort((low, b, a, text))
    text, a, b = text[order], a[order], b[order]
    again = np.zeros(len(text), dtype=bool)
    again[1:] = (text[1:] == text[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, again


def _packed(low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The first window and the number of further ones (7 bits): less to shuffle."""
    return pa.array(low << 7 | (high - low))


ROW, NAMES = "doc_id long, text_hash long, at long, a long, b long, mixed boolean, again boolean", ["doc_id", "text_hash", "at", "a", "b", "mixed", "again"]


def repeats(docs: DataFrame, width: int = 100, gram: int = 32, part: int = 17, bloom_bits: int = 1 << 28) -> DataFrame:
    """doc_id (null: the least long), text_hash, low and high of runs of windows (first bytes) that also start earlier.

    Earlier: in a document of smaller doc_id (null is the smallest), or before in the same row. Rows
    of equal doc_id are not earlier than each other. Null and empty texts have no windows.
    """
    if width - gram >= 127:
        raise ValueError("runs may have 127 windows at most")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text")).withColumn("id_hash", F.xxhash64("doc_id"))
    twice, mixed = _found(texts, "text", width, gram, 0, bloom_bits)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, low, high, a, b, many, again = _runs(batch.column("text"), width, gram, twice.value, mixed.value)
            ids, hashes = (batch.column(c).to_numpy()[text] for c in ("doc_id", "text_hash"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), _packed(low, high), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(many), pa.array(again)], names=NAMES)

    rows = stored(texts.mapInArrow(runs, ROW))
    classes = stored(rows.where("not again").groupBy("a", "b").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.bool_or("mixed").alias("mixed")))

    def after(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Those that are not in the earliest document of their class, or follow an equal one in it."""
        ahead = rows.where("not again").select("doc_id", "text_hash", "at", "a", "b")
        later = ahead.join(classes.where("latest > earliest").select("a", "b", "earliest"), ["a", "b"]).where("doc_id > earliest")
        names = ("doc_id", "text_hash", "at")
        return stored(later.select(*names).unionAll(rows.where("again").select(*names)))

    outer = after(rows, classes)

    # the earliest run of each class of a mixed group, with its bytes: one row for each document
    chosen = spark.sparkContext.broadcast(K.Bloom.of(classes.where("mixed").select(F.col("a").bitwiseXOR(F.xxhash64("earliest")).alias("key")), "key", bloom_bits))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            text, low, high, a, _, many, again = _runs(column, width, gram, twice.value, mixed.value)
            keep = np.flatnonzero(many & ~again)
            keep = keep[chosen.value.has(a[keep] ^ batch.column("id_hash").to_numpy().view(K.U)[text[keep]])]
            text, low, high = text[keep], low[keep], high[keep]
            order = np.lexsort((low, text))
            text, low, high = text[order], low[order], high[order]
            some, sizes = np.unique(text, return_counts=True)
            raw = {i: memoryview(column[i].as_buffer()) for i in some.tolist()}
            held = pa.array([bytes(raw[i][x : y + width]) for i, x, y in zip(text.tolist(), low.tolist(), high.tolist())], pa.binary())
            each = pa.StructArray.from_arrays([pa.array(low), held], names=["low", "bytes"])
            ids, hashes = (pa.array(batch.column(c).to_numpy()[some]) for c in ("doc_id", "text_hash"))
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), each)], names=["doc_id", "text_hash", "runs"])

    discard(rows, classes)
    held = stored(texts.mapInArrow(bytes_of, "doc_id long, text_hash long, runs array<struct<low:long,bytes:binary>>"))
    twice_in, mixed_in = _found(held.select(F.explode("runs.bytes").alias("bytes")), "bytes", width, gram, part, bloom_bits)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            flat = lists.flatten()
            run, low, high, a, b = _parts(flat.field("bytes"), width, gram, part, twice_in.value, mixed_in.value)
            of = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())[run]
            base = flat.field("low").to_numpy()[run]
            low, high = base + low, base + high
            order, again = _again(of, low, a, b)
            ids, hashes = (batch.column(c).to_numpy()[of[order]] for c in ("doc_id", "text_hash"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), _packed(low[order], high[order]), pa.array(a[order].view(np.int64)), pa.array(b[order].view(np.int64)), pa.array(again), pa.array(again)], names=NAMES)

    split = stored(held.mapInArrow(parts, ROW))
    parts_of = stored(split.where("not again").groupBy("a", "b").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).where("latest > earliest"))
    inner = after(split, parts_of)
    discard(held, split, parts_of)
    low = F.shiftright("at", 7)
    return outer.unionAll(inner).select("doc_id", "text_hash", low.alias("low"), (low + F.col("at").bitwiseAND(F.lit(127))).alias("high"))


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of byte spans."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
    return low[new], reach[np.append(new[1:], len(low)) - 1]


def without_repeats(docs: DataFrame, width: int = 100, gram: int = 32, part: int = 17, bloom_bits: int = 1 << 28) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary): each text without its repeated strings.

    Every row of docs gives one row. Null and empty texts stay empty. What is left is bytes: a cut may
    fall within a character. Rows that repeat an id and a text count as one document and get the same
    result. Other columns of docs take no part.
    """
    # a set, for rows that repeat an id and a text all have the same runs
    runs = repeats(docs, width, gram, part, bloom_bits).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"own": F.coalesce("doc_id", F.lit(LEAST)).cast("long"), "key": F.xxhash64("text").bitwiseXOR(F.lit(1))})
    joined = own.join(runs.select(F.col("doc_id").alias("own"), plain("text_hash").alias("key"), "runs"), ["own", "key"], "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column("runs")
            flat = lists.flatten()
            low, high = (flat.field(i).to_numpy() for i in (0, 1))
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            at = np.cumsum(sizes) - sizes
            for text, i, n in zip(batch.column("text").cast(pa.binary()), at, sizes):
                raw = text.as_buffer()
                size, removed, spans = raw.size, 0, 0
                kept: list = [raw] if size else []
                if n:
                    a, b = _merged(low[i : i + n], high[i : i + n] + width)
                    removed, spans = int((b - a).sum()), len(a)
                    view = memoryview(raw)
                    kept = [view[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), size])]
                data = b"".join(kept)
                out.append((size, removed, spans, hashlib.sha256(data).hexdigest(), data))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
