"""Packing by Karmarkar-Karp multiway differencing.

Documents are cut into pieces; groups of pieces are differenced: the two partial partitions with the largest
imbalance are merged, heavy windows against light ones, until one partition is left, whose windows are near equal.
Where the largest exceeds the capacity, the group is done again with one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.tokens import SOME_BYTES, WORD_BPE, chunk_ids
from sigloom.llm.util import in_parts, small_batches, written

CAPACITY = 4096
#: What remains of a document after whole windows is cut to at most so many ids, so that windows can come out equal.
PIECE = 1024
#: Windows of a group on average: the input is dealt into as many groups as that takes.
GROUP_WINDOWS = 256
END_ID = 2


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window (0 to windows-1) of each item, by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    parts: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def of(node: int) -> np.ndarray:
        if node in sums:
            return sums.pop(node)
        start = np.zeros(windows, dtype=np.int64)
        start[0] = sizes[node]
        return start

    last = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = of(a) + of(b)[::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        merged -= merged[-1]
        sums[last] = merged
        parts[last] = (a, b, order, windows - 1 - order)
        heapq.heappush(heap, (-int(merged[0]), last))
        last += 1
    found = np.empty(n, dtype=np.int64)
    labels = {heap[0][1]: np.arange(windows)}
    for node in range(last - 1, n - 1, -1):
        a, b, of_a, of_b = parts[node]
        label = labels.pop(node)
        for child, at in ((a, of_a), (b, of_b)):
            if child < n:
                found[child] = label[np.flatnonzero(at == 0)[0]]
            else:
                own = np.empty(windows, dtype=np.int64)
                own[at] = label
                labels[child] = own
    return found


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most the capacity: the fewest that the total allows, or more until the largest fits."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, count)
        if len(sizes) == 0 or np.bincount(found, weights=sizes, minlength=count).max() <= capacity:
            return found
        count += 1


def pack_group(pieces: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """sequence_id and offset for a group's pieces; sequence ids are the group's number and a running one."""
    pieces = pieces.sort_values(["doc_id", "start", "ids_crc32", "length", "doc_tokens"], ignore_index=True)
    full = pieces["length"].to_numpy() == capacity
    window = np.empty(len(pieces), dtype=np.int64)
    window[full] = np.arange(full.sum())
    window[~full] = windows_for(pieces["length"].to_numpy()[~full], capacity) + full.sum()
    offset = pieces["length"].groupby(window).cumsum() - pieces["length"]
    return pieces.assign(sequence_id=pieces["bucket"] * 2**32 + window, offset=offset.astype("int64"))


def cut_points(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows first, then the rest in pieces."""
    whole = n - n % capacity
    return [(s, capacity) for s in range(0, whole, capacity)] + [(s, min(piece, n - s)) for s in range(whole, n, piece)]


def pieces_of(docs: DataFrame, doc_id: str, text: str, vocabulary: str, capacity: int, piece: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(vocabulary, specials=True)
        end = END_ID.to_bytes(4, "little")
        for batch in in_parts(batches, 1, SOME_BYTES):
            rows: list[tuple] = []
            for key, flow in zip(batch.column(0).to_pylist(), ids.ids_of(batch.column(1))):
                flow += end
                n = len(flow) // 4
                rows += [(key, s, size, zlib.crc32(flow[4 * s : 4 * (s + size)]), n) for s, size in cut_points(n, capacity, piece)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    return source.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = WORD_BPE, capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document's ids end with id 2, so a null or empty text is one piece of length 1. Null or repeated doc_ids are documents like
    others, each row its own. The vocabulary's special tokens in a text are those tokens. Pieces are dealt into groups by a hash of their
    place, so equal rows part, and the number of groups follows the number of ids; no group or document gathers in one task as a whole. Other columns are ignored; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    pieces = written(pieces_of(docs, doc_id, text, vocabulary, capacity, piece).withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (group_windows * capacity)))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long, sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInPandas(lambda pdf: pack_group(pdf, capacity), schema).drop("bucket")
