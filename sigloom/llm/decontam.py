"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Words of documents and items are compared in lower case, without marks at their ends. An item-sized window of a document is
embedded by a random walk whose steps depend on the word at hand, which turns edit distance into Hamming distance; windows
and items that agree on some sample of positions are candidates, and their edit distance decides. These find most passages. All
others follow from the runs of words that the edits must leave whole, so that none is missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.util import in_parts, own_caches, small_batches

#: An item is in a document if a passage differs from it by at most so many edits per word of the item.
EDITS = 0.2
#: Positions of a sample; samples are repeated until a window that agrees with an item on CLOSE of the positions is found with odds of RECALL.
#: Passages near the edit bound agree on less; they are found by the runs that edits leave whole.
SAMPLE, CLOSE, RECALL = 4, 0.6, 0.99
WALKS = 4
#: Items at hand at once; a larger benchmark is gone through in blocks of about so many.
ITEM_BLOCK = 4000
#: Windows embedded at once, and chunks whose words a task remembers.
WINDOWS, CACHE_CHUNKS = 50_000, 400_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SKIP = -2
#: Windows are embedded where they hold a run of words that an item has; a run that edits leave whole has more words than this only in vain.
LONGEST_RUN = 4
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - CLOSE**SAMPLE))


def plain(chunk: bytes) -> str:
    return EDGE.sub("", chunk.decode().lower())


def coin(walk: int, step: int, symbols: np.ndarray) -> np.ndarray:
    """Whether the walk moves on at this step when it sees the symbol: a fixed random bit of all three."""
    x = (symbols.astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((step * 0xC2B2AE3D27D4EB4F + walk * 0x165667B19E3779F9) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1)


def embed(windows: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """The walk's outputs (n x steps) over windows of symbols (n x length); beyond the end it sees -3."""
    n, length = windows.shape
    padded = np.concatenate([windows, np.full((n, steps), -3, dtype=windows.dtype)], axis=1)
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    out = np.empty((n, steps), dtype=np.int64)
    for step in range(steps):
        out[:, step] = padded[rows, at]
        at += coin(walk, step, out[:, step]).astype(np.int64)
    return out


def distance(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The least edit distance between item and a prefix of passage, and that prefix's size (the shortest)."""
    if len(passage) >= len(item) and (passage[: len(item)] == item).all():
        return 0, len(item)
    steps = np.arange(len(passage) + 1)
    row = steps.copy()
    for i, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (passage != word))
        row = np.minimum.accumulate(best - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def least_edits(item: np.ndarray, passage: np.ndarray) -> int:
    """The least edit distance between item and any part of passage."""
    steps = np.arange(len(passage) + 1)
    row = np.zeros(len(steps), dtype=np.int64)
    for i, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (passage != word))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def gram_keys(symbols: np.ndarray, q: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key of the q symbols from each start on."""
    starts = np.arange(len(symbols) - q + 1) if starts is None else starts
    keys = np.zeros(len(starts), dtype=np.uint64)
    for i in range(q):
        keys = (keys ^ (symbols[starts + i].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys


class Items:
    """A block of items, filed by length and by their samples' keys."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = 5):
        words = [(i, [w for w in map(plain, (t or "").encode().split()) if w]) for i, t in rows]
        words = sorted((i, w) for i, w in words if w)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for _, ws in words for x in ws))}
        self.ids = [i for i, _ in words]
        self.items = [np.array([self.vocabulary[x] for x in ws], dtype=np.int64) for _, ws in words]
        self.cache: dict[bytes, int] = {}
        classes: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            classes.setdefault(math.ceil(math.log(len(item)) / math.log(1.1)) if len(item) > 10 else -len(item), []).append(k)
        #: An item with room for k edits falls into k + 1 runs of words, and a passage has one of them as it is.
        self.runs = [min(LONGEST_RUN, len(x) // (int(EDITS * len(x)) + 1)) for x in self.items]
        self.grams = {q: np.unique(np.concatenate([gram_keys(x, q) for x, own in zip(self.items, self.runs) if own == q])) for q in set(self.runs)}
        #: By run size, the runs of which an item's passage has one as it is: keys in order, items, and places within the items.
        self.anchors = {}
        for q in self.grams:
            found = [(k, j * (len(x) // (int(EDITS * len(x)) + 1))) for k, (x, own) in enumerate(zip(self.items, self.runs)) if own == q for j in range(int(EDITS * len(x)) + 1)]
            keys = np.array([gram_keys(self.items[k][o : o + q], q)[0] for k, o in found], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            self.anchors[q] = (keys[order], *np.array(found, dtype=np.int64)[order].T)
        self.lengths = np.array([len(x) for x in self.items], dtype=np.int64)
        self.room = np.array([int(EDITS * len(x)) for x in self.items], dtype=np.int64)
        #: Each item's words, as item and word in one number.
        self.owned = np.unique(np.concatenate([k * len(self.vocabulary) + x for k, x in enumerate(self.items)])) if self.items else np.empty(0, dtype=np.int64)
        rng = np.random.default_rng(seed)
        self.classes = []
        for members in classes.values():
            sizes = [len(self.items[k]) for k in members]
            length, steps = max(sizes), max(2, 2 * min(sizes))
            need = min(s - int(EDITS * s) for s in sizes)
            runs = sorted({self.runs[k] for k in members})
            block = np.full((len(members), length), -3, dtype=np.int64)
            for row, k in zip(block, members):
                row[: len(self.items[k])] = self.items[k]
            samples = [(r % WALKS, rng.choice(steps, min(SAMPLE, steps), replace=False), rng.integers(1, 2**62, min(SAMPLE, steps)) | 1) for r in range(REPEATS)]
            keys = self.keys(block, steps, samples)
            tables = []
            for column in keys.T:
                order = np.argsort(column, kind="stable")
                tables.append((column[order], np.array(members)[order]))
            self.classes.append((length, steps, need, runs, samples, tables))

    @staticmethod
    def keys(windows: np.ndarray, steps: int, samples: list) -> np.ndarray:
        walks = {w: embed(windows, steps, w) for w in sorted({w for w, _, _ in samples})}
        return np.stack([(walks[w][:, places] * factors).sum(axis=1) for w, places, factors in samples], axis=1)

    def symbols(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        for c in set(chunks).difference(self.cache):
            word = plain(c)
            self.cache[c] = self.vocabulary.get(word, -1) if word else SKIP
        return np.fromiter(map(self.cache.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def has_gram(self, flow: np.ndarray, known: np.ndarray, q: int) -> np.ndarray:
        """Where a run of q words begins that some item has."""
        out = np.zeros(len(flow), dtype=bool)
        starts = np.flatnonzero(known[q:] - known[:-q] == q)
        keys = gram_keys(flow, q, starts)
        at = np.minimum(np.searchsorted(self.grams[q], keys), len(self.grams[q]) - 1)
        out[starts[self.grams[q][at] == keys]] = True
        return out

    def anchored(self, flow: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) where a passage may begin that holds one of the item's runs as it is, if enough of the item's words are around; no match is left out."""
        known = np.concatenate([[0], np.cumsum(flow >= 0)])
        for q, (keys, members, offsets) in self.anchors.items():
            starts = np.flatnonzero(known[q:] - known[:-q] == q)
            at = gram_keys(flow, q, starts)
            low, high = np.searchsorted(keys, at, "left"), np.searchsorted(keys, at, "right")
            n = high - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hits = np.unique(np.stack([np.repeat(starts, n) - offsets[which], members[which]]), axis=1)
            for part in range(0, hits.shape[1], WINDOWS // 4):
                place, item = hits[:, part : part + WINDOWS // 4]
                first, last = np.maximum(place - self.room[item], 0), np.minimum(place + self.lengths[item] + 2 * self.room[item], len(flow))
                some = known[last] - known[first] >= self.lengths[item] - self.room[item]
                place, item, first, last = place[some], item[some], first[some], last[some]
                if not len(place):
                    continue
                index = first[:, None] + np.arange(int((last - first).max()))
                words = np.where(index < last[:, None], flow[np.minimum(index, len(flow) - 1)], -1)
                pairs = item[:, None] * len(self.vocabulary) + words
                own = (words >= 0) & (self.owned[np.minimum(np.searchsorted(self.owned, pairs), len(self.owned) - 1)] == pairs)
                enough = own.sum(axis=1) >= self.lengths[item] - self.room[item]
                yield from zip(place[enough].tolist(), item[enough].tolist())

    def candidates(self, flow: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) where a window of the flow agrees with the item on some sample; -3 in the flow parts documents."""
        known = np.concatenate([[0], np.cumsum(flow >= 0)])
        shared = {q: np.concatenate([[0], np.cumsum(self.has_gram(flow, known, q))]) for q in self.grams}
        for length, steps, need, runs, samples, tables in self.classes:
            ahead = lambda sums, size: np.append(sums[size:], np.full(min(size, len(flow) + 1) - 1, sums[-1]))[: len(flow)] - sums[:-1]
            near = sum(ahead(shared[q], length + int(EDITS * length)) > 0 for q in runs) > 0
            some = np.flatnonzero(near & (flow >= 0))
            some = some[known[np.minimum(some + length, len(flow))] - known[some] >= need]
            for at in range(0, len(some), WINDOWS):
                part = some[at : at + WINDOWS]
                index = part[:, None] + np.arange(length)
                windows = np.where(index < len(flow), flow[np.minimum(index, len(flow) - 1)], -3)
                gone = np.logical_or.accumulate(windows == -3, axis=1)
                windows[gone] = -3
                enough = (windows >= 0).sum(axis=1) >= need
                part, windows = part[enough], windows[enough]
                if not len(part):
                    continue
                found: set[tuple[int, int]] = set()
                for column, (keys, members) in zip(self.keys(windows, steps, samples).T, tables):
                    low, high = np.searchsorted(keys, column, "left"), np.searchsorted(keys, column, "right")
                    for w in np.flatnonzero(high > low):
                        found.update((int(part[w]), int(k)) for k in members[low[w] : high[w]])
                yield from sorted(found)


def found_in(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, words, edits) of the best passage of each text and item; start counts the text's words."""
    parts, owners, sizes = [], [], []
    for k, text in enumerate(texts):
        symbols = items.symbols(text.split())
        symbols = symbols[symbols != SKIP]
        parts += [symbols, np.array([-3])]
        sizes.append(len(symbols) + 1)
    flow = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for place, k in items.candidates(flow):
        item = items.items[k]
        most = int(EDITS * len(item))
        owner = int(np.searchsorted(firsts, place, "right")) - 1
        if best.get((owner, k), (most + 1,))[0] == 0:
            continue
        edits, words = distance(item, flow[place : min(place + len(item) + most, firsts[owner] + sizes[owner] - 1)])
        if edits <= most and words:
            best[owner, k] = min(best.get((owner, k), (most + 1, 0, 0)), (edits, place - int(firsts[owner]), words))
    tried: set[tuple[int, int]] = set()
    for place, k in items.anchored(flow):
        item = items.items[k]
        most = int(EDITS * len(item))
        owner = int(np.searchsorted(firsts, max(place + most, 0), "right")) - 1
        for owner in {owner, int(np.searchsorted(firsts, max(place, 0), "right")) - 1}:
            start, stop = int(firsts[owner]), int(firsts[owner] + sizes[owner]) - 1
            low, high = max(place - most, start), min(place + most + 1, stop)
            if best.get((owner, k), (most + 1,))[0] == 0 or low >= high or least_edits(item, flow[low : min(high + len(item) + most, stop)]) > most:
                continue
            for at in range(low, high):
                if (at, k) not in tried:
                    tried.add((at, k))
                    edits, words = distance(item, flow[at : min(at + len(item) + most, stop)])
                    if edits <= most and words:
                        best[owner, k] = min(best.get((owner, k), (most + 1, 0, 0)), (edits, at - start, words))
    return [(owner, items.ids[k], start, words, edits) for (owner, k), (edits, start, words) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, words, edits: each document and item that has a passage within a fifth of the item's words in edits.

    start and words place the best passage, counted in the text's words that have a letter or digit. Whole texts are searched. A null, empty
    or wordless text or item matches nothing; a null item_id is kept as it is not: such items are left out. Repeated rows each have
    their matches. The benchmark is the query set: it is gone through in blocks of bounded size, each sent to all documents.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    queries = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    blocks = max(1, -(-queries.count() // ITEM_BLOCK))
    schema = "doc_id long, item_id long, start long, words long, edits long"
    out = None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect()]

        def search(batches: Iterator[pa.RecordBatch], rows: list = rows) -> Iterator[pa.RecordBatch]:
            own_caches("items")
            items = Items(rows)
            for batch in in_parts(batches, 1, 2_000_000):
                ids, texts = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
                found = [(ids[owner], *rest) for owner, *rest in found_in(items, texts)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(5)], names=["doc_id", "item_id", "start", "words", "edits"])

        part = source.mapInArrow(search, schema)
        out = part if out is None else out.union(part)
    return out
