"""Toxic passages as maximum-scoring segments of token log-odds.

A word stands for its most telling feature: itself or one of its beginnings. Features are 64-bit hashes, counted
by Spark, so that no table is of a fixed size. Their log-odds between toxic and clean documents have a Dirichlet prior in
proportion to the counts in all documents; only features whose likelihood ratio is significant
score, and of these only such as keep being significant when each pair of neighbouring words counts once,
and have pairs enough for the texts that hold them. Labelled copies, which are texts of the same words in the same
order, count as one text in all of this: they say nothing new. Each other word costs `drift`. A linear-time scan finds all maximal segments. A Gumbel
distribution, fitted to the best segments of clean documents less their expected growth with the
logarithm of the length, turns segment scores to p-values; a logistic curve over the summed evidence of
the significant segments gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.llm import kernels as K
from gridseek.llm.common import bounded_batches, by_row, discard, durable, text_keys

BEGINNINGS = (3, 4, 5, 6)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes of the features that score
    weights: np.ndarray  # their log-odds
    drift: float
    location: float = 0.0
    spread: float = 1.0
    intercept: float = -4.0
    slope: float = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, number of words of each text, text of each word, hashes of each word's features) for runs of texts."""
    for i, _, data, offsets in K.chunks(column, K.CHUNK // 2):
        data = K.LOWER[data]
        starts, ends, text = K.words(data, offsets, K.ALNUM)
        up, down = K.powers(K.BASE, len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=K.U)
        np.cumsum((data.astype(K.U) + K.U(1)) * up[: len(data)], out=total[1:])
        hashes = np.empty((1 + len(BEGINNINGS), len(starts)), dtype=K.U)
        for row, n in enumerate((0, *BEGINNINGS)):
            to = np.minimum(starts + n, ends) if n else ends
            # a word of up to n bytes is its own beginning, told from the word by n
            hashes[row] = K.mix((total[to] - total[starts]) * down[starts] + (to - starts).astype(K.U) + K.U(n * 0x10001))
        yield i, np.bincount(text, minlength=len(offsets) - 1), text, hashes


def _wordings(per: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of the words of each text in their order; copies have equal ones."""
    first = np.cumsum(per) - per
    place = np.arange(hashes.shape[1]) - np.repeat(first, per)
    h = K.mix(K.mix(hashes[0]) + place.astype(K.U))
    total = np.zeros(len(h) + 1, dtype=K.U)
    np.cumsum(h, out=total[1:])
    return (total[first + per] - total[first]).view(np.int64)


class _Known:
    """Finds the few features that matter among all of a text: by leading bits first, then by the whole hash."""

    def __init__(self, features: np.ndarray) -> None:
        self.features = np.sort(features.view(K.U))
        self.shift = K.U(64 - min(24, max(12, int(len(features)).bit_length() + 6)))
        self.leading = np.zeros(1 << int(64 - self.shift), dtype=bool)
        self.leading[self.features >> self.shift] = True

    def among(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and place among the sorted features of each hit."""
        row, word = np.nonzero(self.leading[hashes >> self.shift])
        h = hashes[row, word]
        at = np.minimum(np.searchsorted(self.features, h), max(0, len(self.features) - 1))
        hit = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
        return word[hit], at[hit]


def _labelled(docs: DataFrame, frame: DataFrame) -> DataFrame:
    """wording, toxic and text of the labelled documents, copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wording = np.zeros(len(batch), dtype=np.int64)
            for i, per, _, hashes in _features(batch.column("text")):
                wording[i : i + len(per)] = _wordings(per, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(wording), batch.column("toxic"), batch.column("text")], names=["wording", "toxic", "text"])

    # of the bounded sample only: a join with it is enough
    rows = docs.join(F.broadcast(frame), "doc_id").select("text", "toxic").mapInArrow(run, "wording long, toxic long, text string")
    # copies have the same features, whichever of them stays
    return durable(rows.groupBy("wording", "toxic").agg(F.first("text").alias("text")))


def _telling(labelled: DataFrame, n_toxic: int, n_clean: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that toxic texts hold significantly more often, sorted, and the numbers of toxic and of clean texts with each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text, hashes in _features(batch.column("text")):
                of = np.broadcast_to(text, hashes.shape).ravel()
                # each feature of a text once
                _, once = np.unique(K.mix(hashes.ravel() ^ K.mix(of.astype(K.U))), return_index=True)
                feature, n = np.unique(hashes.ravel()[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n)], names=["feature", "toxic"])

    # fewer toxic texts are not significant even if no clean text has the feature
    fewest = least / (2 * math.log((n_toxic + n_clean) / n_toxic)) if n_clean else math.inf
    held = labelled.where("toxic = 1").select("text").mapInArrow(each, "feature long, toxic long").groupBy("feature").agg(F.sum("toxic").alias("toxic"))
    rows = held.where(F.col("toxic") >= fewest).toArrow()
    features, toxic = rows["feature"].to_numpy(), rows["toxic"].to_numpy()
    order = np.argsort(features.view(K.U))
    features, toxic = features[order], toxic[order]
    clean, _ = _occurrences(labelled.where("toxic = 0"), features, texts=True)
    more = (toxic * n_clean > clean * n_toxic) & (_ratio(toxic, clean, n_toxic, n_clean) >= least)
    return features[more], toxic[more], clean[more]


def _occurrences(docs: DataFrame, features: np.ndarray, texts: bool = False) -> tuple[np.ndarray, int]:
    """Occurrences of each of the sorted features, and of all features, in docs. texts: of each text once."""
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        n = np.zeros(len(known.features) + 1, dtype=np.int64)
        for batch in batches:
            for _, _, text, hashes in _features(batch.column("text")):
                word, place = known.among(hashes)
                if texts:
                    place = np.unique(text[word].astype(np.int64) * len(n) + place) % len(n)
                n[:-1] += np.bincount(place, minlength=len(n) - 1)
                n[-1] += hashes.size
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(features) + 1, dtype=np.int64)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def _ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Likelihood ratio of the two counts against the share of toxic documents."""
    both, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0))


def _odds(seen: np.ndarray, total: int, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float) -> np.ndarray:
    """Log-odds with the Dirichlet prior, 0 where they are low."""
    alpha = prior * seen / max(1, total) + 1e-2
    odds = np.log((toxic + alpha) / (n_toxic + prior)) - np.log((clean + alpha) / (n_clean + prior))
    return np.where(odds > 1, np.minimum(odds, 8), 0).astype(np.float32)


def _lasting(labelled: DataFrame, features: np.ndarray, n_toxic: int, n_clean: int, least: float) -> np.ndarray:
    """By feature: distinct pairs of the word before and the word after in toxic labelled texts, 0 if these are not significantly more than in clean ones."""
    shared = labelled.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in batches:
            kind = batch.column("toxic").to_numpy(zero_copy_only=False)
            found = [np.zeros((0, 3), dtype=np.int64)]
            for i, _, text, hashes in _features(batch.column("text")):
                before, after = np.zeros((2, len(text)), dtype=K.U)
                same = text[1:] == text[:-1]
                before[1:][same], after[:-1][same] = hashes[0, :-1][same], hashes[0, 1:][same]
                word, place = known.among(hashes)
                pair = K.mix(K.mix(before[word]) + after[word]).view(np.int64)
                found.append(np.unique(np.stack([place, pair, kind[i + text[word]]], axis=1), axis=0))
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, j]) for j in range(3)], names=["place", "pair", "toxic"])

    pairs = labelled.select("toxic", "text").mapInArrow(run, "place long, pair long, toxic long").distinct()
    counts = pairs.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).toArrow()
    out = np.zeros((2, len(features)), dtype=np.int64)
    for row, c in enumerate(("toxic", "clean")):
        out[row][counts["place"].to_numpy()] = counts[c].to_numpy()
    return np.where(_ratio(out[0], out[1], n_toxic, n_clean) >= least, out[0], 0)


def _model(docs: DataFrame, frame: DataFrame, drift: float, prior: float, least: float, diverse: float) -> Model:
    """Features that score and their weights; counts of labelled texts are of different texts."""
    labelled = _labelled(docs, frame)
    size = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}  # two rows
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic:
        discard(labelled)
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0, np.float32), drift)
    features, toxic, clean = _telling(labelled, n_toxic, n_clean, least)
    weights = _odds(*_occurrences(docs, features), toxic, clean, n_toxic, n_clean, prior)
    some = weights > 0
    features, weights, toxic = features[some], weights[some], toxic[some]
    pairs = _lasting(labelled, features, n_toxic, n_clean, least)
    discard(labelled)
    good = (pairs > 0) & (pairs >= diverse * toxic)
    return Model(features[good], weights[good], drift)


def maximal_segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after the last, score): positive scores at given words, -drift at all others.

    Each candidate keeps the running total before and after it. A new one joins the nearest candidate
    on its left with a lower total before it, if the total after that is no higher than its own.
    """
    found: list[list[float]] = []  # first, end, total before, total after
    total, last = 0.0, 0
    for p, s in zip(at, scores):
        total -= drift * (p - last)
        last = p + 1
        new = [p, p + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in found]


def _segments(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, t1, t2, n_words, segments and wording of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.drift))
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = ("doc_id", "held_out", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, drift = shared.value
        known = _Known(features)
        for batch in batches:
            n_words, wording = np.zeros((2, len(batch)), dtype=np.int64)
            segments: list[list] = [[] for _ in range(len(batch))]
            for i, per, text, hashes in _features(batch.column("text")):
                n_words[i : i + len(per)], wording[i : i + len(per)] = per, _wordings(per, hashes)
                best = np.zeros(len(text), np.float32)
                word, place = known.among(hashes)
                np.maximum.at(best, word, weights[place])
                some = np.flatnonzero(best > 0)
                first = np.cumsum(per) - per
                of = text[some]
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
                for a, b in zip(cuts, [*cuts[1:], len(of)]):
                    t = of[a]
                    segments[i + t] = [{"low": x, "high": y, "score": s} for x, y, s in maximal_segments((some[a:b] - first[t]).tolist(), best[some[a:b]].tolist(), drift)]
            found = pa.array(segments, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(n_words), found, pa.array(wording)], names=[*same, "n_words", "segments", "wording"])

    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, t1 long, t2 long, n_words long, segments array<struct<low:int,high:int,score:double>>, wording long")


def _evidence(model: Model, significant: float) -> Column:
    """Sum of -ln p over the significant segments; p = 1 - exp(-exp(-z))."""
    length = F.ln(1 + F.col("n_words"))

    def surprise(s: Column) -> Column:
        z = (s["score"] - length - model.location) / model.spread
        return F.when(z > 30, z).otherwise(-F.ln(1 - F.exp(-F.exp(-F.greatest(z, F.lit(-5.0))))))

    return F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.when(surprise(s) >= -math.log(significant), surprise(s)).otherwise(F.lit(0.0)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.5 * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + 0.5 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 200_000, drift: float = 0.05, prior: float = 50.0, least: float = 18.0, diverse: float = 0.4, significant: float = 0.05) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and segments of each row of docs.

    Labels are learned from at most `sample` rows (those of the least hash of their id) whose
    documents are not held out, with all texts that have such an id, copies once; counts for the prior and scores are of all documents. Null and empty
    texts have no words, no segments and the lowest score. Rows of a null id are scored and not held
    out. Labels that are null or of a null id take no part; of repeated ones the greatest counts.
    Without labels of both kinds every score is low. Other columns take no part.
    """
    return _scored(docs, labels, sample, drift, prior, least, diverse, significant).drop("t1", "t2")


def _scored(docs: DataFrame, labels: DataFrame, sample: int = 200_000, drift: float = 0.05, prior: float = 50.0, least: float = 18.0, diverse: float = 0.4, significant: float = 0.05) -> DataFrame:
    """toxicity() with the hashes of each row's text."""
    bounded_batches(docs.sparkSession)
    # texts only, with the id to find labels by
    texts = docs.select("doc_id", F.col("text"), held_out(F.col("doc_id")).alias("held_out")).withColumns(text_keys())
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = own.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas().sort_values("doc_id")
    ids, toxic = train["doc_id"].to_numpy(dtype=np.int64), (train["toxic"].to_numpy() > 0).astype(np.int64)
    numbered = texts.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    frame = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": ids, "toxic": toxic}), "doc_id long, toxic long")
    model = _model(numbered, frame, drift, prior, least, diverse)
    scanned = durable(_segments(texts, model))
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0)).alias("best")
    seen_train = scanned.join(F.broadcast(frame), "doc_id")
    # of at most `sample` rows, copies once, in one order, so that sums come out the same
    clean = seen_train.where("toxic = 0").select("wording", (best - F.ln(1 + F.col("n_words"))).alias("z")).distinct().orderBy("wording", "z").limit(sample).toPandas().sort_values(["wording", "z"])["z"].to_numpy()
    if len(clean) > 1:
        model.spread = max(0.5, float(clean.std(ddof=1)) * math.sqrt(6) / math.pi)
        model.location = float(clean.mean()) - 0.5772156649 * model.spread
    evidence = F.ln(1 + _evidence(model, significant))
    fit = seen_train.select("wording", "toxic", evidence.alias("x")).distinct().orderBy("wording", "toxic", "x").limit(sample).toPandas().sort_values(["wording", "toxic", "x"])
    if fit["toxic"].nunique() == 2:
        model.intercept, model.slope = _logistic(fit["x"].to_numpy(), fit["toxic"].to_numpy(dtype=float))
    score = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * evidence)))
    return scanned.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.7).cast("int")).select("doc_id", "held_out", "score", "predicted", "n_words", "segments", "t1", "t2")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is predicted toxic, whatever their id is or others of that id hold."""
    return by_row(docs, _scored(docs, labels).where("predicted = 1").select("doc_id", "t1", "t2"), "left_anti")
