"""NumPy kernels over Arrow text buffers: words, hashes, sliding minima and a Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Odd bases of the polynomial hashes modulo 2**64.
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
#: Bytes of text that a kernel handles at once; one document may be longer.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Bytes of words that only white space parts.
SOLID = np.ones(256, dtype=bool)
SOLID[32] = SOLID[9:14] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHUNK + 1)

        def of(b: int) -> np.ndarray:
            out = np.full(size, b, dtype=U)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers[base] = of(base), of(pow(base, -1, 1 << 64))
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets into them) for runs of whole texts; null is empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    done = 0
    for part in parts:
        part = part.fill_null("") if part.null_count else part
        if not len(part):
            continue
        width = np.int64 if pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type) else np.int32
        offsets = np.frombuffer(part.buffers()[1], dtype=width)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2] or b"", dtype=np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield done + i, done + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        done += len(part)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of word bytes; runs end with their text."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def grams(values: np.ndarray, k: int, base: int = BASE2) -> np.ndarray:
    """A hash of each k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for j in range(k):
        out *= U(base)
        out += values[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def winnow(values: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Marks each value that is the least of some window of w values; ties all count. whole: windows that count."""
    picked = np.zeros(len(values), dtype=bool)
    if len(values) < w:
        return picked
    least = sliding_min(values, w)
    for j in range(w):
        picked[j : j + len(least)] |= whole & (values[j : j + len(least)] == least)
    return picked


class Bloom:
    """A Bloom filter of a fixed number of bits, however many keys it gets: more keys only let more pass."""

    def __init__(self, bits: int, packed: np.ndarray) -> None:
        self.bits, self.packed = bits, packed

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], dtype=U))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for shift in (0, 32):
            at = (keys >> U(shift)) & U(self.bits - 1)
            out &= (self.packed[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) != 0
        return out

    @staticmethod
    def of(keys: DataFrame, column: str, most: int = 1 << 28) -> Bloom:
        """16 bits for each key, up to `most` bits: the proven bound of what is collected and broadcast.

        Each 64-bit word of the filter is one group of an aggregation, so that at most bits / 64 rows reach the driver.
        """
        bits = min(most, 1 << max(16, (16 * keys.count()).bit_length()))
        key = F.col(column)
        at = [F.shiftrightunsigned(key, s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)]
        bit = F.explode(F.array(*at)).alias("bit")
        found = (
            keys.select(bit)
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value"))
            .toArrow()
        )
        packed = np.zeros(bits // 64, dtype=U)
        packed[found["word"].to_numpy()] = found["value"].to_numpy().view(U)
        return Bloom(bits, packed)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of 64-bit values, of different kinds: a polynomial, and a sum over mixes of each value with its place."""
    up, down = powers(BASE, len(values) + 1)
    size = (ends - starts).astype(U)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(mix(values + U(BASE)) * up[: len(values)], out=total[1:])
    one = mix((total[ends] - total[starts]) * down[starts] + size)
    place = np.zeros(len(values), dtype=np.int64)
    per = ends - starts
    inside = np.repeat(starts, per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    place[inside] = inside - np.repeat(starts, per)
    np.cumsum(mix(values ^ mix(place.astype(U) + U(BASE2))), out=total[1:])
    return one, mix(total[ends] - total[starts] + size)
