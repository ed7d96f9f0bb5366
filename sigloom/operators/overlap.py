"""A minimizer index of sequences: which of them hold, or overlap, another one exactly.

A pair is equivalent if one holds the other, or a suffix of one is a prefix of the other over t letters at least, t being a share of the
shorter one's m. In each case the longer one holds the first or the last t letters of the shorter one as they are. Shorter ones are
filed by size classes under the minimizers of their first and last T letters (T: the least t of the class), longer ones under the minimizers of all
their windows of T letters: of a window's pieces of K letters the one with the least hash, so that like windows have like minimizers.
A minimizer that two have in common fixes how they lie to each other, and the letters there decide. Where both are as long, either may take
the shorter one's part, so the last letters are filed by those alone that can meet a longer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.labels import checkpointed

SHARE = 0.8
#: Up to this size every t is a class; from there on a class reaches SPREAD times as far.
SINGLE, SPREAD = 12, 1.15
#: Letters that a task looks at at once.
CELLS = 1_000_000
#: Letters in a row that are held against the keys at once: what is made of them stays in the processor's cache.
IN_ROW = 32_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Up to so many keys of the shorter ones are sent to every task, which then files no other ones; more are joined alone.
SENT_KEYS = 500_000


def least_overlap(m: int, share: float = SHARE) -> int:
    return max(1, int(m * share))


def class_size(t: int) -> int:
    """T of the class of t."""
    size = min(t, SINGLE)
    while (further := int(size * SPREAD) + 1) <= t and size >= SINGLE:
        size = further
    return size


def piece(size: int) -> int:
    """K: letters of a window's pieces."""
    return max(min(size, SINGLE), 2 * size // 3)


def doublings(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """Plain hashes of the 1, 2, 4, ... letters from each place of each row on, up to so many."""
    out, done, power = [codes.astype(np.uint64) + np.uint64(1)], 1, int(MULTIPLIER)
    while 2 * done <= most:
        whole = out[-1]
        out.append(whole[:, : whole.shape[1] - done] * np.uint64(power) + whole[:, done:])
        power, done = power * power % 2**64, 2 * done
    return out


def hashed_pieces(codes: np.ndarray, size: int, doubled: list[np.ndarray] | None = None) -> np.ndarray:
    """A mixed hash of the pieces of so many letters at each place of each row; doubled: the doublings up to that size, where they are at hand."""
    doubled = doublings(codes, size) if doubled is None else doubled
    out, at, count = None, 0, codes.shape[1] - size + 1
    for k in range(size.bit_length()):  # pieces of doubled sizes, put together
        if size >> k & 1:
            part = doubled[k][:, at : at + count]
            out = part if out is None else out * np.uint64(pow(int(MULTIPLIER), 1 << k, 2**64)) + part
            at += 1 << k
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def minimizers(codes: np.ndarray, size: int) -> np.ndarray:
    """The place of the minimizer of each window of so many letters of each row, the first of equal ones."""
    k = piece(size)
    return np.lib.stride_tricks.sliding_window_view(hashed_pieces(codes, k), size - k + 1, axis=1).argmin(axis=2) + np.arange(codes.shape[1] - size + 1)


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letters as a matrix) of the texts of each length, some at a time."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    for m in np.unique(lengths):
        at = np.flatnonzero(lengths == m)
        for own in np.array_split(at, -(-len(at) * int(m) // CELLS)):
            yield own, np.array([texts[i] for i in own], dtype=f"U{m}").view(np.uint32).reshape(len(own), m)


def filed(seqs: DataFrame, classes: list[int] | None, share: float = SHARE, longest: int | None = None) -> DataFrame:
    """(key, node, place, m) of seqs (node, seq): under the minimizers of all windows of the classes' sizes, or where classes is null under those of both ends.

    longest: the size of the longest one to be met; the last letters of one as long are left out.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at, codes in by_length(batch.column(1).to_pylist()):
                m = codes.shape[1]
                own = class_size(least_overlap(m, share))
                for size in [own] if classes is None else [c for c in classes if c <= m]:
                    found, k = hashed_pieces(codes, piece(size)), piece(size)
                    if classes is None:
                        first, last = minimizers(codes[:, :size], size), minimizers(codes[:, m - size :], size) + (m - size)
                        places = first if m == longest else np.concatenate([first, last], axis=1)
                    else:
                        places = minimizers(codes, size)
                    held = np.zeros((len(codes), m - k + 1), dtype=bool)
                    held[np.arange(len(codes))[:, None], places] = True
                    row, place = np.nonzero(held)
                    key = (found[row, place] ^ np.uint64(size)) * MULTIPLIER
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes[at[row]]), pa.array(place.astype(np.int32)), pa.array(np.full(len(row), m, dtype=np.int32))], names=["key", "node", "place", "m"])

    return seqs.select("node", "seq").mapInArrow(file, "key long, node long, place int, m int")


def held_pieces(seqs: DataFrame, classes: list[int], keys: np.ndarray) -> DataFrame:
    """As filed, under the keys (sorted) alone, and under all places that have one: texts are gone through in a row, whatever their number and sizes."""
    sent = seqs.sparkSession.sparkContext.broadcast(keys)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value
        bits = min(22, max(12, int(len(keys) * 32).bit_length()))  # most places are told by a few bits of their key
        seen, rest = np.zeros(1 << bits, dtype=bool), np.uint64(64 - bits)
        seen[(keys.view(np.uint64) >> rest).astype(np.int64)] = True
        for batch in batches:
            nodes, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if not texts:
                continue
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            ends = np.cumsum(sizes)
            flat = np.array("".join(texts), dtype=f"U{max(1, int(sizes.sum()))}").reshape(1).view(np.uint32)
            most = max(map(piece, classes))
            for first in range(0, len(flat), IN_ROW):
                block = flat[None, first : first + IN_ROW + most - 1]
                doubled = doublings(block, most)
                for size in classes:
                    k = piece(size)
                    if block.shape[1] < k:
                        continue
                    key = (hashed_pieces(block, k, doubled)[0, :IN_ROW] ^ np.uint64(size)) * MULTIPLIER
                    some = np.flatnonzero(seen[(key >> rest).astype(np.int64)])
                    found = key[some].view(np.int64)
                    some = some[keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found]
                    if not len(some):
                        continue
                    row = np.searchsorted(ends, some + first, "right")
                    inside = (some + first + k <= ends[row]) & (size <= sizes[row])
                    some, row = some[inside], row[inside]
                    place = some + first - (ends - sizes)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(nodes[row]), pa.array(place.astype(np.int32)), pa.array(sizes[row].astype(np.int32))], names=["key", "node", "place", "m"])

    return seqs.select("node", "seq").mapInArrow(file, "key long, node long, place int, m int")


def codes_of(seqs: pa.StringArray, m: int) -> np.ndarray:
    """The letters of texts of m letters as a matrix: where all are of one byte, the bytes as they lie."""
    offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int64 if pa.types.is_large_string(seqs.type) else np.int32)[seqs.offset : seqs.offset + len(seqs) + 1]
    if offsets[-1] - offsets[0] == len(seqs) * m:
        return np.frombuffer(seqs.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(seqs), m)
    return np.array(seqs.to_pylist(), dtype=f"U{m}").view(np.uint32).reshape(len(seqs), m)


def placed_minimizers(seqs: DataFrame, m: int, size: int) -> DataFrame:
    """(key, seq, place, kind) of texts (seq) of m letters: under the minimizers of their windows of so many letters; kind 1: of the first window, 2: of a later one, 3: of both."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = piece(size)
        for batch in batches:
            for first in range(0, batch.num_rows, max(1, CELLS // m)):
                seqs = batch.column(0).slice(first, max(1, CELLS // m))
                codes = codes_of(seqs, m)
                found = hashed_pieces(codes, k)
                places = np.lib.stride_tricks.sliding_window_view(found, size - k + 1, axis=1).argmin(axis=2) + np.arange(m - size + 1)
                kind = np.zeros(found.shape, dtype=np.int8)
                np.put_along_axis(kind, places[:, 1:], 2, axis=1)
                kind[np.arange(len(codes)), places[:, 0]] |= 1
                row, place = np.nonzero(kind)
                columns = [pa.array(found[row, place].view(np.int64)), seqs.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(kind[row, place].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "seq", "place", "kind"])

    return seqs.select("seq").mapInArrow(file, "key long, seq string, place int, kind int")


def equivalent_of_one_length(seqs: DataFrame, m: int, share: float = SHARE) -> DataFrame:
    """As equivalent_texts, of texts of m letters each among themselves: none holds another one, so that one's last k letters are another's first, with k from t to m - 1.

    The window of t letters that ends one's overlap begins the other, so its minimizer is that of the other's first window. Texts come along with
    the minimizers: a pair is told where they meet. Of the overlaps of a pair only the longest counts, and one the other way round gives its own row.
    """
    size = least_overlap(m, share)
    one = placed_minimizers(seqs, m, size).repartition("key")
    x, y = (one.toDF("key", name, f"{name}_place", f"{name}_kind") for name in ("seq", "other"))
    d = F.col("seq_place") - F.col("other_place")
    laps = lambda a, b, k: F.substr(a, k + 1, F.lit(m)) == F.substr(b, F.lit(1), m - k)
    # Kinds are asked for together, so that one table of minimizers, dealt once, is both sides.
    asked = F.col("seq_kind").bitwiseAND(2) + F.col("other_kind").bitwiseAND(1) == 3
    met = x.join(y, "key").filter(asked & d.between(1, m - size) & (F.col("seq") != F.col("other")) & laps(F.col("seq"), F.col("other"), d))
    shifts = F.sequence(F.lit(1), F.lit(m - size))
    longest = ~F.exists(shifts, lambda k: (k < d) & laps(F.col("seq"), F.col("other"), k))
    back = F.exists(shifts, lambda k: laps(F.col("other"), F.col("seq"), k))
    pair = F.struct("seq", "other")
    rows = met.filter(longest).select(F.explode(F.when(back, F.array(pair)).otherwise(F.array(pair, F.struct(F.col("other").alias("seq"), F.col("seq").alias("other"))))).alias("pair"))
    return rows.select("pair.seq", "pair.other").union(seqs.select("seq", F.col("seq").alias("other")))


def equivalent_texts(a: DataFrame, b: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """(seq, other) of equivalent texts of a and b (seq), which hold each once and no empty one; without b, of a and itself."""
    sides = {"a": a} if b is None else {"a": a, "b": b}
    side = {name: checkpointed(d.select(F.monotonically_increasing_id().alias("node"), "seq")) for name, d in sides.items()}
    lengths = {name: [r[0] for r in d.select(F.length("seq").alias("m")).distinct().collect()] for name, d in side.items()}  # as many as there are lengths
    if b is None and len(lengths["a"]) == 1 and least_overlap(lengths["a"][0], share) < lengths["a"][0]:
        return equivalent_of_one_length(side["a"].select("seq"), lengths["a"][0], share)

    def met(short: str, long: str) -> DataFrame:
        """The candidates (x, y, d) with x the shorter, d letters after y's start."""
        most = max(lengths[long], default=0)
        sizes = sorted({class_size(least_overlap(m, share)) for m in lengths[short] if m <= most})
        some = side[short].filter(F.length("seq") <= most)
        one = checkpointed(filed(some, None, share, most)) if short != long else filed(some, None, share, most)
        keys = one.select("key").distinct().limit(SENT_KEYS + 1).collect() if short != long else []
        if short != long and len(keys) <= SENT_KEYS:
            two = held_pieces(side[long], sizes, np.sort(np.array([r[0] for r in keys], dtype=np.int64))) if keys else filed(side[long].limit(0), sizes, share)
        else:
            two = filed(side[long], sizes, share)
        one = one.select("key", F.col("node").alias("x"), F.col("place").alias("at"), F.col("m").alias("x_m"))
        two = two.select("key", F.col("node").alias("y"), F.col("place").alias("on"), F.col("m").alias("y_m"))
        d = F.col("on") - F.col("at")
        k = F.least(F.col("x_m") + F.least(d, F.lit(0)), F.col("y_m") - F.greatest(d, F.lit(0)))
        fits = (F.col("x_m") <= F.col("y_m")) & (k >= F.greatest(F.lit(1), F.floor(F.col("x_m") * share)))
        if short == long:
            fits = fits & (F.col("x") != F.col("y"))
        return checkpointed(one.join(two, "key").filter(fits).select("x", "y", d.alias("d"), k.alias("k")).distinct())

    def checked(short: str, long: str) -> DataFrame:
        text = lambda name, node: side[name].select(F.col("node").alias(node), F.col("seq").alias(f"{node}_seq"))
        both = met(short, long).join(text(short, "x"), "x").join(text(long, "y"), "y")
        held = F.substr("x_seq", F.greatest(-F.col("d"), F.lit(0)) + 1, F.col("k")) == F.substr("y_seq", F.greatest(F.col("d"), F.lit(0)) + 1, F.col("k"))
        return both.filter(held)

    if b is None:
        one = checkpointed(checked("a", "a").select(F.col("x_seq").alias("seq"), F.col("y_seq").alias("other")))
        # Every text is equivalent to itself; no other pair is one of equal texts.
        return one.union(one.select("other", "seq")).distinct().union(side["a"].select("seq", F.col("seq").alias("other")))
    one = checked("a", "b").select(F.col("x_seq").alias("seq"), F.col("y_seq").alias("other"))
    return one.union(checked("b", "a").select("y_seq", "x_seq")).distinct()


def equivalent_pairs(a: DataFrame, b: DataFrame, share: float = SHARE) -> DataFrame:
    """(id, other) of equivalent sequences of a and b (id, seq). Equal sequences are compared once; null and empty ones are left out."""
    some = lambda d: checkpointed(d.filter("seq <> ''").select("id", "seq"))
    a, b = some(a), some(b)  # what makes the sequences of texts runs once
    pairs = equivalent_texts(a.select("seq").distinct(), b.select("seq").distinct(), share)
    return pairs.join(a, "seq").join(b.select(F.col("id").alias("other_id"), F.col("seq").alias("other")), "other").select("id", F.col("other_id").alias("other"))
