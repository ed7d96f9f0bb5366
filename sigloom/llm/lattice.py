"""Near-duplicates of vectors by lattice hashing.

Unit vectors are turned at random and cut into eights of coordinates, one table each: a random projection. In a table every
vector is filed under the E8 lattice cells, its own and neighbouring ones, that come within PROBE of its projection. Two
vectors with the least cosine or more are near each other in one of the tables at least, as the squares of their distances in all
tables add up to that of the whole: nearer than the reach, so that the cell of the point halfway has both. None is missed. A pair counts
in the first such table and in that cell alone, so no pairs leave a task: a cell gives counts and one link for each vector.

Cells are first gone through with eight bytes for each vector, its place in the cell. Only those that come near another one there are then
compared with whole vectors.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.util import Scratch, components

LEAST_COSINE = 0.98
#: The distance, in units of the lattice (cells reach from 0.71 to 1), up to which neighbouring cells are probed. More: smaller cells, more of them for each vector.
PROBE = 0.25
#: Vectors of a cell that are compared at once; cells with more are cut into parts, and each two parts meet in a block of their own.
BLOCK = 2000
#: Groups up to this size are compared by shifting, many groups at a time.
SMALL = 24
PAIRS = 100_000
#: Steps of a unit of the lattice in which places are noted, and how far two places noted so can be off, together.
STEPS = 64
ROUNDED = 2 * 8**0.5 / (2 * STEPS) + 1e-6
#: Low bits of a cell's number that name its table.
TABLE_BITS = 12
#: Slack of the first comparison, which is made in another order of adding.
SLACK = 1e-9


def nearest(x: np.ndarray) -> np.ndarray:
    """Twice the E8 point (integers) nearest to each row of x: the nearer of those of D8 and of D8 moved by one half."""

    def of_d8(y: np.ndarray) -> np.ndarray:
        out = np.round(y)
        odd = np.flatnonzero(out.sum(axis=1) % 2 != 0)
        off = y[odd] - out[odd]
        at = np.abs(off).argmax(axis=1)
        out[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1, -1)
        return out

    whole, half = of_d8(x), of_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return (2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


@functools.cache
def around() -> list[tuple[float, np.ndarray]]:
    """(length, points) of the E8 points of squared length 2, 4 and 6: all whose cells can come within 0.32 of a point of the cell at 0."""
    whole = np.array([v for v in itertools.product((-2, -1, 0, 1, 2), repeat=8) if sum(x * x for x in v) <= 6], dtype=np.float64)
    half = np.array(list(itertools.product((-1.5, -0.5, 0.5, 1.5), repeat=8)))
    every = np.concatenate([whole, half])
    every = every[every.sum(axis=1) % 2 == 0]
    size = (every**2).sum(axis=1)
    return [(s**0.5, every[size == s]) for s in (2, 4, 6)]


def cells(x: np.ndarray, probe: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, twice the lattice point) of every cell that may come within probe of a row of x: the line halfway to it must."""
    own = nearest(x)
    y = x - own / 2
    rows, points = [np.arange(len(x))], [own]
    far = np.sqrt((y**2).sum(axis=1))
    for length, others in around():
        some = np.flatnonzero(far >= length / 2 - probe - 1e-9)
        row, at = np.nonzero(y[some] @ others.T >= length * (length / 2 - probe) - 1e-9)
        rows.append(some[row])
        points.append(own[some[row]] + (2 * others[at]).astype(np.int64))
    return np.concatenate(rows), np.concatenate(points)


def hashed(points: np.ndarray, table: int | np.ndarray) -> np.ndarray:
    """A number for each lattice point of a table, which ends in the table's."""
    tables = np.asarray(table).astype(np.uint64) + np.zeros(len(points), dtype=np.uint64)
    out = tables * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(points.shape[1]):
        out = (out ^ points[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(TABLE_BITS) << np.uint64(TABLE_BITS) | tables).view(np.int64)


@functools.cache
def turn(width: int) -> np.ndarray:
    """A random rotation of so many coordinates, to as many or up to seven zeros more."""
    full = -(-width // 8) * 8
    return np.linalg.qr(np.random.default_rng(8).standard_normal((full, full)))[0][:width]


class Tables:
    """The tables of one width and least cosine."""

    def __init__(self, width: int, least: float, probe: float):
        self.turn, self.least, self.probe = turn(width), least, probe
        self.tables = self.turn.shape[1] // 8
        self.reach = ((2 - 2 * least + SLACK) / self.tables) ** 0.5
        self.scale = 2 * probe / self.reach

    def turned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and what they are in the tables."""
        unit = vectors / np.abs(vectors).max(axis=1)[:, None]
        unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
        return unit, unit @ self.turn

    def filed(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, cells, places) of all cells of each table; a place is eight steps from the cell's middle in one number."""
        at = self.turned(vectors)[1]
        for t in range(self.tables):
            own = at[:, 8 * t : 8 * t + 8] * self.scale
            row, points = cells(own, self.probe)
            yield row, hashed(points, t), np.round((own[row] - points / 2) * STEPS).astype(np.int8).view(np.int64)[:, 0]

    def near(self, vectors: np.ndarray, group: np.ndarray, table: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of rows of one group, which is a cell's: those that count in this cell. Rows of a group are next to each other."""
        unit, at = self.turned(vectors)
        own = np.take_along_axis(at, 8 * table[:, None].astype(np.int64) + np.arange(8), axis=1)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        size_of = np.repeat(sizes, sizes)

        def counted(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs those that are linked, and count in this table and this cell: the cheapest test first."""
            for low in range(0, len(i), PAIRS):
                a, b = i[low : low + PAIRS], j[low : low + PAIRS]
                some = ((own[a] - own[b]) ** 2).sum(axis=1) <= self.reach**2
                a, b = a[some], b[some]
                some = np.einsum("ij,ij->i", unit[a], unit[b]) >= self.least
                a, b = a[some], b[some]
                some = hashed(nearest((own[a] + own[b]) * (self.scale / 2)), table[a]) == cell[a]
                a, b = a[some], b[some]
                apart = ((at[a] - at[b]) ** 2).reshape(len(a), self.tables, 8).sum(axis=2)
                some = np.argmax(apart <= self.reach**2, axis=1) == table[a]
                yield a[some], b[some]

        for shift in range(1, SMALL):
            i = np.flatnonzero((group[shift:] == group[:-shift]) & (size_of[:-shift] <= SMALL))
            yield from counted(i, i + shift)
        norm = (own**2).sum(axis=1)
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            step = max(1, PAIRS * 4 // size)
            for low in range(start, start + size, step):
                one, two = slice(low, min(low + step, start + size)), slice(start, start + size)
                near = norm[one, None] + norm[None, two] - 2 * own[one] @ own[two].T <= self.reach**2 + SLACK
                near &= unit[one] @ unit[two].T >= self.least - SLACK
                i, j = np.nonzero(near)
                i, j = i + low, j + start
                yield from counted(i[i < j], j[i < j])


def joined(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by the links."""
    least = np.arange(nodes)
    while True:
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
        least = least[least]
        if (least == before).all():
            return least


def numbers(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).astype(np.float64).reshape(len(column), -1)


def file_vectors(vectors: DataFrame, kind: str, least: float, probe: float) -> DataFrame:
    """(kin, cell, node, place) of vectors (node, kin, width, vec), for every cell; kin is alike for vectors that are compared."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                of = np.flatnonzero(widths == width)
                step = max(1, 2_000_000 // int(width) // 8)
                for low in range(0, len(of), step):
                    own = batch.take(pa.array(of[low : low + step]))
                    for row, cell, place in Tables(int(width), least, probe).filed(numbers(own.column("vec"), kind)):
                        some = pa.array(row)
                        yield pa.RecordBatch.from_arrays([own.column("kin").take(some), pa.array(cell), own.column("node").take(some), pa.array(place)], names=["kin", "cell", "node", "place"])

    return vectors.select("node", "kin", "width", "vec").mapInArrow(file, "kin int, cell long, node long, place long")


def in_blocks(filed: DataFrame, keys: list[str], block: int, scratch: Scratch, name: str) -> DataFrame:
    """filed with part, one, two: the parts of a cell (of those keys) that meet, and the row's own. Cells of more than a block are cut by hash, so that no task gets one whole."""
    sizes = filed.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > block)
    sizes = scratch.write(sizes.select(*keys, F.ceil(F.col("c") / block).cast("int").alias("parts")), name)
    parted = filed.join(sizes, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = parted.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(*filed.columns, "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))


def each_group(blocks: DataFrame, keys: list[str], found: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """found(rows, group) over whole groups of equal keys, many at a time: group counts them up. A task's rows come in the keys' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def started(rows: pa.RecordBatch) -> np.ndarray:
            new = np.zeros(len(rows), dtype=bool)
            new[:1] = True
            for k in keys:
                x = rows.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= x[1:] != x[:-1]
            return new

        held: list[pa.RecordBatch] = []
        for batch in (*(b for b in batches if len(b)), None):
            whole = pa.Table.from_batches(held + ([batch] if batch is not None else [])).combine_chunks().to_batches() if held or batch is not None else []
            if not whole:
                continue
            new = started(whole[0])
            last = int(np.flatnonzero(new)[-1]) if batch is not None else len(new)  # the last group may go on
            held = [whole[0].slice(last)] if batch is not None else []
            if last and (out := found(whole[0].slice(0, last), np.cumsum(new[:last]))) is not None:
                yield out

    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def neighbours(filed: DataFrame, probe: float, block: int, scratch: Scratch) -> DataFrame:
    """(cell, node): the rows of filed whose place is within reach of another one's in their cell, or a little farther, as places are rounded."""
    most = (2 * probe + ROUNDED) ** 2 * STEPS**2

    def found(rows: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
        places = rows.column("place").to_numpy().view(np.int8).reshape(len(rows), 8).astype(np.float32)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        size_of, live = np.repeat(sizes, sizes), np.zeros(len(group), dtype=bool)
        for shift in range(1, SMALL):
            i = np.flatnonzero((group[shift:] == group[:-shift]) & (size_of[:-shift] <= SMALL))
            i = i[((places[i] - places[i + shift]) ** 2).sum(axis=1) <= most]
            live[i] = live[i + shift] = True
        norm = (places**2).sum(axis=1)
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            own = slice(start, start + size)
            for low in range(start, start + size, 1000):
                some = slice(low, min(low + 1000, start + size))
                near = norm[some, None] + norm[None, own] - 2 * places[some] @ places[own].T <= most
                near[np.arange(some.stop - low), np.arange(some.stop - low) + low - start] = False
                live[some] |= near.any(axis=1)
        if not live.any():
            return None
        at = pa.array(np.flatnonzero(live))
        return pa.RecordBatch.from_arrays([rows.column("cell").take(at), rows.column("node").take(at)], names=["cell", "node"])

    blocks = in_blocks(filed, ["kin", "cell"], block, scratch, "filed-sizes")
    return each_group(blocks, ["kin", "cell", "one", "two"], found, "cell long, node long").distinct()


def compare(filed: DataFrame, kind: str, least: float, probe: float, block: int, scratch: Scratch) -> DataFrame:
    """(node, link, n): how many vectors, copies counted each, a node of filed (label, width, cell, node, copies, vec) is linked to, by the smallest node that it reaches in a block."""

    def found(rows: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
        some = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(some):
            return None
        rows, group = rows.take(pa.array(some)), group[some]
        node, copies, widths, cell, part, one, two = (rows.column(k).to_numpy() for k in ("node", "copies", "width", "cell", "part", "one", "two"))
        tab, n, left, right = cell & (2**TABLE_BITS - 1), np.zeros(len(node), dtype=np.int64), [], []
        for width in np.unique(widths):
            of = np.flatnonzero(widths == width)
            vectors = numbers(rows.column("vec").take(pa.array(of)), kind)
            for i, j in Tables(int(width), least, probe).near(vectors, group[of], tab[of], cell[of]):
                i, j = of[i], of[j]
                apart = (one[i] == two[i]) | (part[i] != part[j])  # within a part they meet in its own block
                i, j = i[apart], j[apart]
                np.add.at(n, i, copies[j])
                np.add.at(n, j, copies[i])
                least_of = joined(len(node), i, j)
                linked = np.flatnonzero(least_of != np.arange(len(node)))
                left.append(linked)
                right.append(least_of[linked])
        if not n.any():
            return None
        reached, own = joined(len(node), np.concatenate(left), np.concatenate(right)), np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(n[own]), pa.array(node[reached[own]])], names=["node", "n", "link"])

    keys = ["label", "width", "cell"]
    blocks = in_blocks(filed, keys, block, scratch, "live-sizes")
    return each_group(blocks, [*keys, "one", "two"], found, "node long, n long, link long").groupBy("node", "link").agg(F.sum("n").alias("n"))


def packed(column: str, kind: str):
    """A list of numbers as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(kind)).tobytes()
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            size = np.dtype(kind).itemsize
            vecs = [flat[a * size : b * size] for a, b in zip(ends[:-1], ends[1:])]
            rest = [c for c, name in zip(batch.columns, batch.schema.names) if name != column]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(vecs, pa.binary())], names=[*(n for n in batch.schema.names if n != column), "vec"])

    return pack


def link_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE, probe: float = PROBE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of table.

    Only vectors with equal labels and of equal width are compared. Those with a null label, that are null, empty or zero or hold null or non-finite
    numbers link with nothing and are their own component. Equal vectors are links like others; only one of them is compared. Rows with a repeated
    vec_id count each; those without one link but give no component its name (kept is false for them). Other columns are ignored; an empty table gives none.
    least: from 0.5 up to 1; probe: up to 0.32.
    """
    if not (0.5 <= least <= 1 and 0 < probe <= 0.32):
        raise ValueError("least is to be from 0.5 to 1, probe over 0 and at most 0.32")
    spark = table.sparkSession
    scratch = Scratch(spark)
    wide = table.schema[embedding].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if wide else ("<f8", "double")
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast(f"array<{number}>").alias("embedding"))
    fine = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = scratch.write(rows.select("vec_id", "label", "embedding", F.coalesce(fine, F.lit(False)).alias("fine")), "vectors")
    numbered = rows.filter("fine").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    numbered = numbered.select(F.monotonically_increasing_id().alias("node"), "copies", "first", "label", F.size("embedding").alias("width"), "embedding")
    distinct = scratch.write(numbered, "distinct")
    vectors = distinct.select("node", "copies", "label", F.hash("label", "width").alias("kin"), "width", "embedding")
    vectors = scratch.write(vectors.mapInArrow(packed("embedding", kind), f"node long, copies long, label {rows.schema['label'].dataType.simpleString()}, kin int, width int, vec binary"), "packed")
    live = scratch.write(neighbours(file_vectors(vectors, kind, least, probe), probe, block, scratch), "live")
    filed = live.join(vectors.drop("kin"), "node").select("label", "width", "cell", "node", "copies", "vec")
    found = scratch.write(compare(filed, kind, least, probe, block, scratch), "links")
    comps = components(found.select(F.col("node").alias("a"), F.col("link").alias("b")), scratch)
    own = distinct.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(comps, "node", "left")
    own = own.select("label", "embedding", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    own = scratch.write(own, "own")
    named = own.join(own.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("label", "embedding", "n_links", "component_id")
    linked = rows.filter("fine").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
