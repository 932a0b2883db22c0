"""How many cells each two datasets share, counted block by block.

A row for each two datasets of each cell would be the square of a cell's datasets, and to add them up by a
shuffle needs more disk than any answer. So datasets are put in blocks of near ones, each cell of a block is one
list of its datasets, and a task gets a block's lists with those of all blocks that share cells with it: it
counts in memory, by matrix products where lists are long, and has the whole answer of each of its datasets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.operators.keys import keys_of
from gridseek.plans.lineage import cut, settled
from gridseek.plans.sizes import small_side

#: Most cells of a block's datasets together, unless it is of one dataset.
MOST_CELLS = 1 << 21
#: Most counters that a task holds at once.
COUNTERS = 1 << 23
#: Cells of one product; pairs that are counted one by one at once; rows of a batch that goes out.
TILE, EXPANDED, BATCH = 1024, 1 << 20, 1 << 16
#: A cell goes into the product if its pairs are at least one in so many of all pairs of both blocks.
SPARSE = 512


def _spread(x: Column) -> Column:
    """The 31 lower bits of x with a gap after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _dealt(size: int):
    """Rows in order of place get a block and a place in it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, place, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, places = [], []
            for n in batch.column("n").to_pylist():
                if place and (place == size or held + n > MOST_CELLS):
                    block, place, held = block + 1, 0, 0
                blocks.append(block)
                places.append(place)
                place, held = place + 1, held + n
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("n", "z")}
            yield pa.RecordBatch.from_pydict(columns | {"block": pa.array(blocks, pa.int64()), "place": pa.array(places, pa.int16())})

    return deal


def _placed(own: DataFrame, keys: list[str], size: int) -> tuple[DataFrame, int]:
    """keys, block and place of each dataset, and the number of blocks. Blocks are numbered from 0 and hold up to size datasets that lie near each other."""
    middle = [F.shiftright(F.min(c) + F.max(c), 1).bitwiseAND(F.lit((1 << 31) - 1).cast("long")) for c in ("cx", "cy")]
    z = _spread(middle[0]).bitwiseOR(F.shiftleft(_spread(middle[1]), 1))
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keys)
    ordered = own.groupBy(*keys).agg(F.count("*").alias("n"), z.alias("z")).repartitionByRange("z", *keys).sortWithinPartitions("z", *keys)
    placed = settled(ordered.mapInArrow(_dealt(size), f"{kinds}, block long, place short"))
    found = sorted(r["block"] for r in placed.select("block").distinct().collect())  # one row for each block
    numbers = own.sparkSession.createDataFrame([(b, i) for i, b in enumerate(found)], "block long, number int")
    return placed.join(F.broadcast(numbers), "block").select(*keys, F.col("number").alias("block"), "place"), len(found)


def _encoded(size: int):
    """(block, cell, place) of whole blocks to a row for each block and cell: its places as 16-bit numbers, or as bits where those are shorter."""
    wide = -(-size // 8)

    def rows(block: int, cells: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, at = np.unique(cells, return_inverse=True)
        code = np.unique(at * size + places)
        at, places = np.divmod(code, size)
        n = np.bincount(at, minlength=len(names))
        long = 2 * n >= wide
        some = long[at]
        for first in range(0, len(chosen := np.flatnonzero(long)), TILE):
            part = chosen[first : first + TILE]
            lo, hi = np.searchsorted(at, [part[0], part[-1] + 1])
            inside = some[lo:hi]
            bits = np.zeros((len(part), size), np.uint8)
            bits[np.searchsorted(part, at[lo:hi][inside]), places[lo:hi][inside]] = 1
            yield packed(block, names[part], np.full(len(part), wide), np.packbits(bits, axis=1))
        if not long.all():
            yield packed(block, names[~long], 2 * n[~long], places[~some].astype("<u2"))

    def packed(block: int, cells: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(cells), block, np.int32)), "cell": pa.array(cells.astype(np.int64)), "list": lists})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cells, places = batch.column("cell").to_numpy(), batch.column("place").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if held and blocks[lo] != block:
                        yield from rows(block, *map(np.concatenate, zip(*held)))
                        held = []
                    block = int(blocks[lo])
                    held.append((cells[lo:hi], places[lo:hi].astype(np.int64)))
        if held:
            yield from rows(block, *map(np.concatenate, zip(*held)))

    return encode


class _Lists:
    """Lists of a block's datasets by cell, in order of cells."""

    def __init__(self, cells: pa.Array, lists: pa.Array, size: int) -> None:
        order = np.argsort(cells.to_numpy())
        self.size, self.wide = size, -(-size // 8)
        self.cells = cells.to_numpy()[order]
        ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        self.data = np.frombuffer(lists.buffers()[2], np.uint8)
        self.start, lengths = ends[:-1][order].astype(np.int64), np.diff(ends)[order]
        self.long = lengths == self.wide
        self.n = (lengths // 2).astype(np.int64)
        step = np.arange(self.wide)
        for first in range(0, len(at := np.flatnonzero(self.long)), TILE):
            part = at[first : first + TILE]
            self.n[part] = np.bitwise_count(self.data[self.start[part][:, None] + step]).sum(axis=1)

    def bits(self, which: np.ndarray) -> np.ndarray:
        """Cells by datasets, 1 where the dataset has the cell."""
        out = np.zeros((len(which), self.size), np.uint8)
        long = self.long[which]
        out[long] = np.unpackbits(self.data[self.start[which[long]][:, None] + np.arange(self.wide)], axis=1, count=self.size)
        row, place = self._short(which[~long])
        out[np.flatnonzero(~long)[row], place] = 1
        return out

    def _short(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[which]
        row = np.repeat(np.arange(len(which)), n)
        at = self.start[which][row] + 2 * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        return row, self.data[at].astype(np.int64) | self.data[at + 1].astype(np.int64) << 8

    def entries(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of which, place), by row."""
        long = self.long[which]
        if not long.any():
            return self._short(which)
        row, place = self._short(which[~long])
        found = [(np.flatnonzero(~long)[row], place)]
        at = np.flatnonzero(long)
        for first in range(0, len(at), TILE):
            part = at[first : first + TILE]
            bits = np.unpackbits(self.data[self.start[which[part]][:, None] + np.arange(self.wide)], axis=1, count=self.size)
            r, p = np.nonzero(bits)
            found.append((part[r], p))
        row, place = map(np.concatenate, zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], place[order]


def _count(out: np.ndarray, one: _Lists, other: _Lists, first: int) -> None:
    """Adds to out (datasets first, first + 1, ... of one by those of other) the cells that they share."""
    last, size = first + len(out), other.size
    mine = np.searchsorted(one.cells, other.cells)
    pairs = one.n[mine] * other.n
    dense = pairs * SPARSE >= one.size * size
    for lo in range(0, len(which := np.flatnonzero(dense)), TILE):
        part = which[lo : lo + TILE]
        # at most TILE in a product, which floats hold exactly
        out += (one.bits(mine[part])[:, first:last].T.astype(np.float32) @ other.bits(part).astype(np.float32)).astype(np.int32)
    which = np.flatnonzero(~dense)
    groups = np.cumsum(pairs[which]) // EXPANDED
    for part in np.split(which, np.flatnonzero(np.diff(groups)) + 1) if len(which) else ():
        row, a = one.entries(mine[part])
        kept = (a >= first) & (a < last)
        row, a = row[kept], a[kept] - first
        n = np.bincount(row, minlength=len(part))
        start = np.cumsum(n) - n
        row, b = other.entries(part)
        times = n[row]
        at = np.repeat(start[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        code, often = np.unique(a[at] * size + np.repeat(b, times), return_counts=True)
        out.reshape(-1)[code] += often.astype(np.int32)


def _met(size: int, keys: list[str], order: str, best: int | None, nested: bool, later: bool):
    """A block's own names and lists and those of all blocks that it meets, to its datasets' neighbours."""

    def names(rows: pa.Table) -> pa.Table:
        return rows.select([*keys, "block", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if every is None:
            return
        for at in np.unique(every.column("at").to_numpy()):
            yield from block(every.filter(pa.array(every.column("at").to_numpy() == at)))

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        listed = ~np.asarray(rows.column("list").is_null())
        own = rows.column("own").to_numpy().astype(bool)
        of = lambda which: _Lists(*(rows.filter(pa.array(which)).column(c).combine_chunks() for c in ("cell", "list")), size)
        mine, asked = of(listed & own), names(rows.filter(pa.array(~listed & own)))
        theirs = names(rows.filter(pa.array(~listed & ~own)))
        if not len(theirs):
            return
        shown = theirs.append_column("text", theirs.column("dataset_id").cast(pa.string())) if order == "text" else theirs
        sort = {"text": ["text"], "best": [*reversed(keys)]}.get(order, keys)
        theirs = theirs.take(pa.compute.sort_indices(shown, [(c, "ascending") for c in sort])).combine_chunks()
        blocks, number = np.unique(theirs.column("block").to_numpy(), return_inverse=True)
        column = number * size + theirs.column("place").to_numpy()
        in_blocks = rows.column("block").to_numpy()
        others = [of(listed & ~own & (in_blocks == b)) for b in blocks]
        where = {k: i for i, k in enumerate(zip(*(theirs.column(c).to_pylist() for c in keys)))}
        asked = asked.sort_by("place").combine_chunks()
        itself = [where.get(k, -1) for k in zip(*(asked.column(c).to_pylist() for c in keys))]
        step = max(1, COUNTERS // (len(blocks) * size))
        for first in range(0, len(asked), step):
            counts = np.zeros((min(step, len(asked) - first), len(blocks) * size), np.int32)
            for i, other in enumerate(others):
                part = np.zeros((len(counts), size), np.int32)
                _count(part, mine, other, first)
                counts[:, i * size : (i + 1) * size] = part
            yield from out(asked, theirs, counts, column, itself, first)

    def out(asked: pa.Table, theirs: pa.Table, counts: np.ndarray, column: np.ndarray, itself: list[int], first: int) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for i in range(len(counts)):
            w = counts[i][column]
            if itself[first + i] >= 0:
                w[0 if later else itself[first + i] : itself[first + i] + 1] = 0
            found = np.flatnonzero(w)
            if order in ("weight", "best"):
                w_ = -w[found]
                found = found[np.argsort(w_.astype(np.int16) if len(w_) and w_.min() > -(1 << 15) else w_, kind="stable")][:best]
            if len(found):
                held.append((first + i, found, w[found]))
                n += len(found)
            if n >= BATCH or held and i == len(counts) - 1:
                yield from batches(asked, theirs, held)
                held, n = [], 0

    def batches(asked: pa.Table, theirs: pa.Table, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        who, many = np.array([h[0] for h in held]), np.array([len(h[1]) for h in held])
        found, w = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]).astype(np.int64)
        near = {c: theirs.column(c).chunk(0).take(pa.array(found)) for c in keys} | {"w": pa.array(w)}
        if nested:
            ends = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(near.values()), list(near)))
            yield pa.RecordBatch.from_pydict({f"of_{c}": asked.column(c).chunk(0).take(pa.array(who)) for c in keys} | {"near": lists})
            return
        of = pa.array(np.repeat(who, many))
        rank = pa.array(np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many) + 1)
        flat = pa.RecordBatch.from_pydict({f"of_{c}": asked.column(c).chunk(0).take(of) for c in keys} | near | {"rank": rank})
        for lo in range(0, len(flat), BATCH):
            yield flat.slice(lo, BATCH)

    return meet


def neighbours(cells: DataFrame, queries: DataFrame | None = None, size: int = 2048, order: str = "id", best: int | None = None, nested: bool = False, later: bool = False) -> DataFrame:
    """For each dataset of queries (cells, if not given) all others of cells that share w > 0 cells with it.

    Columns of_dataset_id, dataset_id, w and rank (from 1, by order), with sources also of_source_id and source_id; nested: one row for
    each dataset of queries, the others in an array `near`. order: id (source first), text (the id's), weight (greatest first, ties as by
    id) or best (ties by id before source); best: only so many of each. later: only those that follow in
    the order of ids, so that each two come once. Rows of null ids or cells have no part. size: most datasets of a block.
    """
    keys = keys_of(cells) if queries is None else keys_of(cells, queries)
    spark = cells.sparkSession

    def sides(frame: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        own = frame.select(*keys, "cx", "cy").dropna()
        placed, n = _placed(own, keys, size)
        cell = (F.col("cx") * F.lit(1 << 32) + F.col("cy")).alias("cell")
        entries = own.join(small_side(placed), keys).select("block", cell, "place").repartition("block").sortWithinPartitions("block")
        return placed, cut(entries.mapInArrow(_encoded(size), "block int, cell long, list binary")), n

    placed, lists, n = sides(cells)
    asked, asked_lists, n_asked = (placed, lists, n) if queries is None else sides(queries)
    kinds = {c: cells.schema[c].dataType.simpleString() for c in keys}
    near = ", ".join(f"`{c}`: {k}" for c, k in kinds.items())
    schema = ", ".join(f"of_{c} {k}" for c, k in kinds.items()) + (f", near array<struct<{near}, w: bigint>>" if nested else ", " + near.replace(":", "") + ", w long, rank long")
    if not n or not n_asked:
        return spark.createDataFrame([], schema)
    routes = asked_lists.select(F.col("block").alias("at"), "cell")
    met = lists.select("block", "cell").join(routes, "cell").select("at", "block").distinct()
    none = {c: F.lit(None).cast(k) for c, k in kinds.items()}

    def rows(frame: DataFrame, own: bool, named: bool) -> DataFrame:
        ids = [F.col(c) if named else none[c].alias(c) for c in keys]
        place = F.col("place") if named else F.lit(None).cast("short").alias("place")
        listed = [F.lit(None).cast("long").alias("cell"), F.lit(None).cast("binary").alias("list")] if named else ["cell", "list"]
        return frame.select("at", F.lit(own).alias("own"), "block", *listed, place, *ids)

    parts = [
        rows(asked.withColumn("at", F.col("block")), True, True),
        rows(asked_lists.withColumn("at", F.col("block")), True, False),
        rows(placed.join(met, "block"), False, True),
        rows(lists.join(routes, "cell"), False, False),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.repartitionById(n_asked, F.col("at")).mapInArrow(_met(size, keys, order, best, nested, later), schema)
