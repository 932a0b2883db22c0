"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A window is
`window` consecutive words of an item. From both sides the least k-gram hash of each window of
k-grams is kept; equal windows keep equal ones, so that each shared window is met through at least
one join of fingerprints. Each met pair is then extended word by word to both sides. An item of
fewer words is one window by itself, met through the hash of all its words.

A Bloom filter of the items' fingerprints lets few others of the documents reach the shuffle. Its
number of bits has a bound; with too many items it lets more pass and the join does the work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm import kernels as K
from gridseek.llm.common import bounded_batches, by_row, durable, text_keys

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = pa.struct([("h", pa.int64()), ("len", pa.int32()), ("pos", pa.int32()), ("lead", pa.int32()), ("ctx", pa.string())])
SCANNED = "rid long, n_words long, found array<struct<h:long,len:int,pos:int,lead:int,ctx:string>>"


def _scan(column: pa.Array, window: int, k: int, short: list[int], bloom: K.Bloom | None) -> tuple[np.ndarray, pa.Array]:
    """For each text its number of words, and its fingerprints with the words around them.

    short: lengths of whole items below the window that are looked for. bloom: keeps the fingerprints
    that it has; without one (for items) all stay, and of texts below the window the whole.
    """
    n_words, counts, rows = [], [], []
    for _, _, data, offsets in K.chunks(column):
        data = K.LOWER[data]
        starts, ends, text = K.words(data, offsets, K.ALNUM)
        per = np.bincount(text, minlength=len(offsets) - 1)
        n_words.append(per)
        first = np.cumsum(per) - per
        hashes = K.span_hashes(data, starts, ends)
        got: list[tuple[np.ndarray, int]] = []  # positions and lengths

        def met(h: np.ndarray, at: np.ndarray) -> np.ndarray:
            return at if bloom is None else at[bloom.has(h[at])]

        of: dict[int, np.ndarray] = {}
        if len(starts) >= window:
            h = K.grams(hashes, k)
            whole = text[: len(starts) - window + 1] == text[window - 1 :]
            of[window] = h
            got.append((met(h, np.flatnonzero(K.winnow(h, whole, window - k + 1))), window))
        for n in short:
            if len(starts) >= n:
                h = K.grams(hashes, n) ^ K.U(n)
                whole = text[: len(starts) - n + 1] == text[n - 1 :]
                if bloom is None:
                    whole &= per[text[: len(whole)]] == n
                of[n] = h
                got.append((met(h, np.flatnonzero(whole)), n))
        count = np.zeros(len(per), dtype=np.int64)
        for at, n in got:
            count += np.bincount(text[at], minlength=len(per))
        counts.append(count)
        own = []
        for at, n in got:
            t = text[at]
            around, size = (window - k, k) if n == window else (0, n)
            low, high = np.maximum(at - around, first[t]), np.minimum(at + size - 1 + around, first[t] + per[t] - 1)
            own.append((t, of[n][at].view(np.int64), np.full(len(at), n), at - first[t], at - low, starts[low], ends[high]))
        if own:
            t, h, n, pos, lead, low, high = (np.concatenate(x) for x in zip(*own))
            order = np.argsort(t, kind="stable")
            raw = data.tobytes()
            ctx = [raw[a:b].decode() for a, b in zip(low[order].tolist(), high[order].tolist())]
            rows.append(pa.StructArray.from_arrays([pa.array(h[order]), pa.array(n[order], pa.int32()), pa.array(pos[order], pa.int32()), pa.array(lead[order], pa.int32()), pa.array(ctx, pa.string())], fields=list(FOUND)))
    flat = pa.concat_arrays(rows) if rows else pa.array([], FOUND)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
    return (np.concatenate(n_words) if n_words else np.zeros(0, np.int64)), lists


def _scanned(texts: DataFrame, window: int, k: int, short: list[int], bloom: K.Bloom | None) -> DataFrame:
    """rid, n_words and fingerprints of (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = _scan(batch.column("text"), window, k, short, bloom)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(n, pa.int64()), found], names=["rid", "n_words", "found"])

    return texts.select("rid", "text").mapInArrow(run, SCANNED)


def _extended(window: int, k: int):
    """Extends each pair of equal fingerprints to both sides; spans below the window go."""

    def common(a: list[str], b: list[str]) -> int:
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, words = [], {}

            def split(text: str) -> list[str]:
                if text not in words:
                    words[text] = WORD.findall(text)
                return words[text]

            for rid, item, n, pos, lead, ctx, i_lead, i_ctx in pdf[["rid", "item_id", "len", "pos", "lead", "ctx", "i_lead", "i_ctx"]].itertuples(index=False):
                a, b = split(ctx), split(i_ctx)
                right = common(a[lead:], b[i_lead:])
                left = common(a[:lead][::-1], b[:i_lead][::-1])
                if (n == window and right >= k and left + right >= window) or (n < window and left == lead == 0 and right == n == len(b)):
                    out.append((rid, item, pos - left, pos + right))
            yield pd.DataFrame(out, columns=["rid", "item_id", "low", "high"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, bloom_bits: int = 1 << 28) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row for each row of docs.

    A null or empty text has no words and no hits; so has an item, which occurs nowhere. Items of
    a null id count for n_hit, not for n_items. Repeated rows of docs each get their row; repeated
    items count once by their id. Other columns take no part. docs may be of any size, and so may
    benchmark: its fingerprints are shuffled, never collected.
    """
    return _judged(docs, benchmark, window, k, bloom_bits).drop("t1", "t2")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, bloom_bits: int = 1 << 28) -> DataFrame:
    """contamination() with the hashes of each row's text."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").alias("rid"), "text")
    prints = durable(_scanned(items, window, k, list(range(1, window)), None).select(F.col("rid").alias("item_id"), F.explode("found").alias("f")).select("item_id", "f.*"))
    bloom = K.Bloom.of(prints, "h", bloom_bits)
    short = sorted(r.len for r in prints.where(F.col("len") < window).select("len").distinct().collect())  # below window rows
    marked = docs.select("doc_id", "text").withColumns(text_keys()).withColumn("rid", F.monotonically_increasing_id())
    # one pass gives the words and the fingerprints of each row; the row's number holds because this pass is kept
    scanned = durable(_kept(marked, window, k, short, bloom))
    met = (
        scanned.where(F.size("found") > 0)
        .select("rid", F.explode("found").alias("f"))
        .select("rid", "f.*")
        .join(prints.select("h", "len", "item_id", F.col("lead").alias("i_lead"), F.col("ctx").alias("i_ctx")), ["h", "len"])
        .select("rid", "item_id", "len", "pos", "lead", "ctx", "i_lead", "i_ctx")
    )
    kind = benchmark.schema["item_id"].dataType.simpleString()
    spans = durable(met.mapInPandas(_extended(window, k), f"rid long, item_id {kind}, low int, high int").distinct())
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("low", "high"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["high"]).alias("end")),
        lambda acc: acc["n"],
    )
    hits = spans.select("rid", "low", "high").distinct().groupBy("rid").agg(covered.alias("n_hit"))
    names = F.sort_array(F.collect_list(F.col("item_id").cast("string")))
    found = spans.select("rid", "item_id").distinct().groupBy("rid").agg(F.count("item_id").alias("n_items"), F.array_join(names, ",").alias("items"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return (
        scanned.select("rid", "doc_id", "n_words", "t1", "t2")
        .join(hits, "rid", "left")
        .join(found, "rid", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.col("items"), F.lit("")), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
            "t1",
            "t2",
        )
    )


def _kept(marked: DataFrame, window: int, k: int, short: list[int], bloom: K.Bloom) -> DataFrame:
    kind = marked.schema["doc_id"].dataType.simpleString()
    shared = marked.sparkSession.sparkContext.broadcast(bloom)
    same = ("rid", "doc_id", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = _scan(batch.column("text"), window, k, short, shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(n, pa.int64()), found], names=[*same, "n_words", "found"])

    return marked.mapInArrow(run, SCANNED.replace("rid long,", f"rid long, doc_id {kind}, t1 long, t2 long,"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows whose text holds a window of an item, whatever their id is or others of that id hold."""
    return by_row(docs, _judged(docs, benchmark, window).where("contaminated").select("doc_id", "t1", "t2"), "left_anti")
