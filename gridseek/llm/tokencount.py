"""Exact token counts at every prefix of a text, by dynamic programming over BPE pieces.

BPE has two properties that the program rests on. The pieces of a text up to any piece end are the
pieces of that prefix; and a sequence of pieces is a text's encoding exactly if each two neighbours,
joined and encoded, come back as these two. So for each prefix one piece alone can be the last, and
count(prefix) = count(prefix without that piece) + 1. The pieces that end a prefix are those that end
the longest ending with which a piece begins; this ending follows from the one before and the next
character. A text never merges over an edge between two characters that stand side by side in no
piece, such as another character and the blank mark, or a letter and a stop; what lies between edges
at which kinds of characters change is handled once and remembered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import TypeAlias

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import bounded_batches

MARK = "▁"
#: Segments, pairs and steps from ending to ending that a worker remembers, and the longest segment that it remembers.
REMEMBERED, PAIRS, STEPS, LONGEST = 800_000, 1_000_000, 500_000, 64
#: Characters of text that count_all gets at once.
GROUP = 1 << 20
#: The score of two parts that make no piece.
NEVER = -math.inf

Merging: TypeAlias = list[tuple[float, str, str]]
Ending: TypeAlias = "tuple[dict[str, Ending], list[tuple[int, int, dict[int, bool]]], str]"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _edges(pieces: Iterable[str]) -> str:
    """A pattern of segments: blank marks and then characters of one kind, or one of no kind. Characters that stand side by side in a piece are of one kind."""
    kinds: dict[str, set[str]] = {}
    for piece in pieces:
        own = piece.lstrip(MARK)
        if len(own) > 1:
            kind = set().union(own, *(kinds.get(c, ()) for c in own))
            kinds.update(dict.fromkeys(kind, kind))
    apart = {id(k): "".join(map(re.escape, sorted(k))) for k in kinds.values()}
    return f"{MARK}*+(?:{''.join(f'[{k}]+|' for k in apart.values())}[^{MARK}])|{MARK}+"


class PrefixCounter:
    """Token counts of prefixes as the sentencepiece library gives them for a BPE model with byte fallback."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with the identity normalization is needed")
        self.dummy = MARK if spec.add_dummy_prefix else ""
        self.fallback = model.trainer_spec.byte_fallback
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a blank after another character")
        self.split = re.compile(_edges(self.score)).findall
        self.pieces = ["", *(p for p in self.score if self._merging(p)[-1][1] == p)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i}
        self.begins = {p[:i] for p in self.pieces for i in range(len(p) + 1)}
        self.endings: dict[str, Ending] = {}
        self.merging: dict[int, Merging] = {}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.start = self._ending("")
        self.n_pairs = self.n_steps = 0
        self.known: dict[str, int] = {}

    def _merging(self, text: str) -> Merging:
        """Plain merging: the pair of the best score first, the leftmost of equal ones. Before each merge and after the last: its score, the first part, the last part."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        out = []
        while (best := max(scores, default=NEVER)) > NEVER:
            out.append((best, parts[0], parts[-1]))
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
        return [*out, (NEVER, parts[0], parts[-1])]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two pieces, joined and encoded, come back: both merge as if alone, until a merge over their edge has the best score."""
        for p in (left, right):
            if p not in self.merging:
                self.merging[p] = self._merging(self.pieces[p])
        lefts, rights, score = iter(self.merging[left]), iter(self.merging[right]), self.score.get
        (a, _, x), (b, y, _) = next(lefts), next(rights)
        while True:
            over = score(x + y, NEVER)
            if over > a and over >= b:
                return False
            if a >= b:
                if a == NEVER:
                    return True
                a, _, x = next(lefts)
            else:
                b, y, _ = next(rights)

    def _pair(self, left: int, right: int) -> bool:
        if self.n_pairs >= PAIRS:
            for fits in self.pairs.values():
                fits.clear()
                fits[0] = True
            self.n_pairs = 0
        self.n_pairs += 1
        got = self.pairs[right][left] = self._fit(left, right)
        return got

    def _ending(self, text: str) -> Ending:
        """The longest ending of text with which a piece begins: what follows it by the next character, the pieces that end it, longest first, and itself.

        A piece is its length, its id and what is known of the pieces before it; before the first, 0 stands.
        """
        while text not in self.begins:
            text = text[1:]
        if text not in self.endings:
            found = [(len(text) - j, piece) for j in range(len(text)) if (piece := self.ids.get(text[j:]))]
            self.endings[text] = {}, [(length, piece, self.pairs.setdefault(piece, {0: True})) for length, piece in found], text
        return self.endings[text]

    def _step(self, ending: Ending, char: str) -> Ending:
        if char not in self.begins:
            return self.start
        if self.n_steps >= STEPS:
            for follows, _, _ in self.endings.values():
                follows.clear()
            self.n_steps = 0
        self.n_steps += 1
        got = ending[0][char] = self._ending(ending[2] + char)
        return got

    def segment(self, text: str, counts: list[int] | None = None, last: list[int] | None = None, endings: list[Ending] | None = None) -> list[int]:
        """Counts of all prefixes of one segment, the empty one first.

        counts, last and endings: those of a prefix, from which the program goes on. All are changed.
        """
        counts, last, endings = counts or [0], last or [0], endings or [self.start]
        ending, at = endings[-1], len(counts) - 1
        for char in text[at:]:
            at += 1
            ending = ending[0].get(char) or self._step(ending, char)
            endings.append(ending)
            for length, piece, fits in ending[1]:
                before = last[at - length]
                fit = fits.get(before)
                if fit or fit is None and self._pair(before, piece):
                    counts.append(counts[at - length] + 1)
                    last.append(piece)
                    break
            else:  # a character outside the vocabulary: its bytes, or one unknown; nothing merges with it
                counts.append(counts[at - 1] + (len(char.encode()) if self.fallback else 1))
                last.append(0)
        return counts

    def _segments(self, text: str) -> list[str]:
        return self.split(self.dummy + text.replace(" ", MARK))

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; the last entry of prefixes(text)."""
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. New segments are handled in order, each from its common start with the one before."""
        split = [self._segments(t) if t else [] for t in texts]
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        long, counts, last, endings, before = {}, [0], [0], [self.start], ""
        for part in sorted(set().union(*split).difference(known)):
            same = 0
            for a, b in zip(before, part):
                if a != b:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :], endings[same + 1 :]
            (known if len(part) <= LONGEST else long)[part] = self.segment(part, counts, last, endings)[-1]
            before = part
        if long:
            return [sum(known[p] if p in known else long[p] for p in parts) for parts in split]
        return [sum(map(known.__getitem__, parts)) for parts in split]

    def prefixes(self, text: str | None) -> list[int]:
        """Tokens of text[:i] for each i from 0 to its length in characters."""
        if not text:
            return [0]
        counts = [0]
        for part in self._segments(text):
            base = counts[-1]
            counts += [base + n for n in self.segment(part)[1:]]
        return [0, *counts[1 + len(self.dummy) :]]

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most budget tokens."""
        counts = self.prefixes(text)
        return (text or "")[: max(i for i, n in enumerate(counts) if n <= budget)]


def counter(model_path: str, _made: dict = {}) -> PrefixCounter:  # noqa: B006  kept in each worker
    if model_path not in _made:
        _made[model_path] = PrefixCounter(model_path)
    return _made[model_path]


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to doc_id.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids stay as they are;
    other columns of docs take no part. A text is handled as a whole, whatever its length.
    """
    path = model_path or default_model()
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in batches:
            counts, i = [], 0
            while i < len(texts):  # about a megabyte of text at once
                size, j = 0, i
                while j < len(texts) and (j == i or size < GROUP):
                    size += len(texts.iat[j])
                    j += 1
                counts += own.count_all(texts.iloc[i:j].tolist())
                i = j
            yield pd.Series(counts, dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(F.col("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def prefix_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and counts: element i (from 0) has the tokens of the first i characters of the text.

    The first entry is 0, so that null and empty texts have the one entry.
    """
    path = model_path or default_model()
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def prefixes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in batches:
            yield pd.Series([own.prefixes(t) for t in texts])

    return docs.select("doc_id", prefixes(F.coalesce(F.col("text"), F.lit(""))).alias("counts"))


def truncated(docs: DataFrame, budget: int, model_path: str | None = None) -> DataFrame:
    """docs with each text cut to its longest prefix of at most budget tokens; null stays null."""
    path = model_path or default_model()
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in batches:
            yield pd.Series([None if t is None else own.truncate(t, budget) for t in texts], dtype=pd.ArrowDtype(pa.string()))

    return docs.withColumn("text", cut("text"))
