"""Repeated runs of lines by winnowing over line hashes.

Lines that hold more than white space are hashed. Of each `window` consecutive ones the least hash is
kept (the leftmost of equal ones) as the fingerprint of the window, so that equal windows have equal
fingerprints at equal places. Positions of a fingerprint are joined by it, and those that occur once leave. To join each
two positions would make all pairs of a common line; instead a position is matched, for each of the windows that it stands
for, with the earliest position that has the same window (by a 128-bit hash of its lines). The match is extended line by line to both sides,
as far as the lines around the two positions reach, and overlapping matches are one run, which is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.llm import kernels as K
from gridseek.llm.common import bounded_batches, durable, fresh, plain

LEAST = -(1 << 63)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each line that isn't blank."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, side="right") - 1
    after = np.append(breaks, len(data))
    ends = np.minimum(after[np.searchsorted(after, starts)], offsets[text + 1])
    solid = np.append(0, np.cumsum(K.SOLID[data]))
    keep = solid[ends] > solid[starts]
    return starts[keep], ends[keep], text[keep]


PRINT = pa.struct([("first", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("again", pa.bool_())])


def _prints(column: pa.Array, window: int, words: int | None) -> tuple[np.ndarray, list[pa.Array]]:
    """The text of each fingerprint, and: fingerprint, lines of its windows, first line of those around it, their hashes, and its windows.

    A window has its first line, two hashes, and whether an equal one is before it in the text. With words also shorter
    runs of so many words, and whole texts of fewer lines, each its own fingerprint with no lines around.
    """
    found: list[tuple[np.ndarray, ...]] = []  # windows: text, first line, lines, fingerprint, leads, hashes
    around: list[tuple[np.ndarray, ...]] = []  # lines around each fingerprint: first one, number, and hashes
    for i, _, data, offsets in K.chunks(column):
        starts, ends, text = _lines(data, offsets)
        h, again_h = K.span_hashes(data, starts, ends), K.span_hashes(data, starts, ends, K.BASE2)
        per = np.bincount(text, minlength=len(offsets) - 1)
        before = np.cumsum(per) - per
        for size in range(window if words is None else 1, window + 1):
            n = len(starts) - size + 1
            if n <= 0:
                continue
            a, b = (K.grams(x, size, K.BASE2) for x in (h, again_h))
            whole = np.flatnonzero(text[:n] == text[size - 1 :])
            if size == window:
                place = np.argmin(np.stack([h[j : j + n] for j in range(window)]), axis=0) + np.arange(n)
                at = place[whole]
                leads = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
                lead = at[leads]
                low = np.maximum(lead - window + 1, before[text[lead]])
                high = np.minimum(lead + window, before[text[lead]] + per[text[lead]])
                run = np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
                kinds = [(whole, h[at], leads, K.U(0), (low - before[text[lead]], high - low, h[run]))]
            else:
                spaced = K.words(data, offsets, K.SOLID)[0]
                long = np.searchsorted(spaced, ends[whole + size - 1]) - np.searchsorted(spaced, starts[whole]) >= words
                kinds = []
                for some, kind in ((long, size), (per[text[whole]] == size, window + size)):
                    at, own = whole[some], K.mix(np.array([kind], dtype=K.U))[0]
                    none = (at - before[text[at]], np.zeros(len(at), np.int64), np.zeros(0, K.U))
                    kinds.append((at, a[at] ^ own, np.ones(len(at), bool), own, none))
            for at, prints, leads, own, lines in kinds:
                found.append((i + text[at], at - before[text[at]], np.full(len(at), size), prints, leads, a[at] ^ own, b[at] ^ own))
                around.append(lines)
    if not found:
        found, around = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, K.U, bool, K.U, K.U))], [tuple(np.zeros(0, t) for t in (np.int64, np.int64, K.U))]
    text, first, size, prints, leads, a, b = (np.concatenate(x) for x in zip(*found))
    low, count, hashes = (np.concatenate(x) for x in zip(*around))
    order = np.lexsort((first, b, a, text))
    again = np.zeros(len(text), dtype=bool)
    x, y = order[1:], order[:-1]
    again[x] = (text[x] == text[y]) & (a[x] == a[y]) & (b[x] == b[y])
    lead = np.flatnonzero(leads)
    windows = pa.StructArray.from_arrays([pa.array(v) for v in (first, a.view(np.int64), b.view(np.int64), again)], fields=list(PRINT))
    lists = [pa.ListArray.from_arrays(pa.array(np.append(e, len(v)), pa.int32()), v) for e, v in ((np.cumsum(count) - count, pa.array(hashes.view(np.int64))), (lead, windows))]
    return text[lead], [pa.array(prints[lead].view(np.int64)), pa.array(size[lead]), pa.array(low), *lists]


def _reach(mine: tuple[str, str], theirs: tuple[str, str], step: int, start: Column, most: int) -> Column:
    """How many lines from `start` on, in steps to one side, are the same around both: (lines, place of the window in them)."""

    def equal(i: Column) -> Column:
        x, y = (F.get(F.col(lines), F.col(at) + start + i * step) for lines, at in (mine, theirs))
        return F.coalesce(x == y, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0), lambda n, i: F.when((n == i) & equal(i), n + 1).otherwise(n))


def line_deduplicated(docs: DataFrame, window: int = 3, words: int | None = None) -> DataFrame:
    """docs with each text less its repeated runs of at least `window` lines, and n_lines and n_removed (lines that aren't blank).

    A line goes if it is in a window of lines that also starts earlier: in a document of smaller
    doc_id (null is the smallest), or before in the same text. With words, a run of fewer lines that hold so
    many words between white space is a window too, and so is a text of fewer lines than window, which repeats
    whole texts only. Rows of equal doc_id are not earlier than
    each other. Blank lines take no part and stay. A null text stays null and an empty one empty, with
    no lines. All columns of docs stay; those named n_lines and n_removed get new values.
    """
    bounded_batches(docs.sparkSession)
    ids = F.coalesce(F.col("doc_id"), F.lit(LEAST)).cast("long")
    texts = docs.select(ids.alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, columns = _prints(batch.column("text"), window, words)
            own = [pa.array(batch.column(c).to_numpy()[text]) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=["doc_id", "text_hash", "print", "size", "low", "lines", "windows"])

    prints = durable(texts.mapInArrow(run, "doc_id long, text_hash long, print long, size long, low long, lines array<long>, windows array<struct<first:long,a:long,b:long,again:boolean>>"))
    shared = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select(plain("print").alias("key"))
    joined = prints.withColumn("key", plain("print")).join(shared, "key")
    met = durable(joined.select("doc_id", "text_hash", "size", "low", "lines", F.explode("windows").alias("w")).select("doc_id", "text_hash", "size", (F.col("w.first") - F.col("low")).cast("int").alias("at"), "lines", "w.first", "w.a", "w.b", "w.again"))
    ahead = met.where("not again")
    # the earliest holder of each window, with the lines around it
    holder = F.min_by(F.struct(F.col("at").alias("their_at"), F.col("lines").alias("their_lines")), F.struct("doc_id", "text_hash", "first"))
    groups = ahead.groupBy("a", "b").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), holder.alias("holder")).where("latest > earliest").select(plain("a").alias("key"), "b", "earliest", "holder.*")
    matched = ahead.withColumn("key", plain("a")).join(groups, ["key", "b"]).where("doc_id > earliest")
    sides = [_reach(("lines", "at"), ("their_lines", "their_at"), step, start, window - 1) if window > 1 else F.lit(0) for step, start in ((-1, F.lit(-1)), (1, F.col("size").cast("int")))]
    extended = matched.select("doc_id", "text_hash", (F.col("first") - sides[0]).alias("first"), (F.col("size") + sides[0] + sides[1]).alias("size"))
    repeats = extended.unionAll(met.where("again").select("doc_id", "text_hash", "first", "size"))
    own_id, own_hash, runs, done = fresh(docs, "own_id", "own_hash", "runs", "done")
    # a set, for rows that repeat an id and a text all have the same runs
    found = repeats.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("first") * (2 * window) + F.col("size") - 1).alias(runs)).select(F.col("doc_id").alias(own_id), plain("text_hash").alias(own_hash), runs)
    joined = docs.withColumns({own_id: ids, own_hash: F.xxhash64("text").bitwiseXOR(F.lit(1))}).join(found, [own_id, own_hash], "left")

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, r, window) for t, r in zip(texts, runs)], columns=["text", "n_lines", "n_removed"])

    out = joined.withColumn(done, cut("text", runs))
    return out.withColumns({c: F.col(done)[c] for c in ("text", "n_lines", "n_removed")}).drop(own_id, own_hash, runs, done)


def _cut(text: str | None, runs, window: int) -> tuple[str | None, int, int]:
    if not text:
        return text, 0, 0
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, _, _ = _lines(data, np.array([0, len(data)]))
    if runs is None or not len(runs):
        return text, len(starts), 0
    first, more = np.divmod(np.asarray(runs), 2 * window)  # first line, and lines after it
    run = np.arange(2 * window)
    gone = np.unique((first[:, None] + run)[run <= more[:, None]])
    lines = raw.split(b"\n")
    at = np.searchsorted(np.append(0, np.flatnonzero(data == 10) + 1), starts)  # numbers of the lines that aren't blank
    drop = set(at[gone].tolist())
    return b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode(), len(starts), len(drop)
