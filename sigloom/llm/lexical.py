"""Ranked lexical search for many items at once, by evaluating what items share once.

Terms that stand in the same items are one class; runs of classes that several items share, in one order of all classes, become nodes
of their own, round by round, until no two nodes that follow each other are in two items: a graph of shared sums. For a batch of
documents the partial sums of all nodes are made once, from the classes up, and an item's scores are the sum of the few nodes that are left of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.util import Scratch, in_parts, small_batches

TOP = 10
#: Items whose graph is made and whose documents are ranked at once; more items are gone through in blocks of about so many.
ITEM_BLOCK = 1000
#: Up to so many distinct terms of items are sent to the tasks; with more, documents' terms are joined to them.
SENT_TERMS = 200_000
#: Partial sums of a batch at once.
CELLS = 4_000_000
#: Other ASCII characters than letters and digits part terms, capital letters become small; bytes of other characters stay.
ASCII_TERMS = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(ASCII_TERMS).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term) of items (item, text binary): each distinct term once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            found = [(i, sorted(set(terms_of(t)))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.list_(pa.binary()))], names=["item", "terms"])

    return items.select("item", "text").mapInArrow(split, "item long, terms array<binary>").select("item", F.explode("terms").alias("term"))


def sent_postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of docs (doc_id, text binary) that have a term: n counts all terms with repeats, terms are the known ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := terms_of(text):
                    held = Counter(t for t in map(known.get, found) if t is not None)
                    for column, value in zip(out, (doc, len(found), list(held), list(held.values()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def joined_postings(docs: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """As sent_postings, for any number of known terms (term, id): the documents' distinct terms are joined to them."""
    rows = scratch.write(docs.withColumn("row", F.monotonically_increasing_id()), "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["row", "term", "tf"])

    counted = scratch.write(rows.select("row", "text").mapInArrow(count, "row long, term binary, tf long"), "counted")
    found = counted.join(known, "term").groupBy("row").agg(F.collect_list(F.struct("id", "tf")).alias("own"))
    sizes = counted.groupBy("row").agg(F.sum("tf").alias("n")).join(found, "row", "left").join(rows.select("row", "doc_id"), "row")
    none = F.array().cast("array<struct<id:int,tf:bigint>>")
    return sizes.withColumn("own", F.coalesce("own", none)).select("doc_id", "n", F.col("own.id").alias("terms"), F.col("own.tf").alias("tfs"))


def shared_nodes(items: list[list[int]], classes: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """What is left of each item's sequence of classes when every two neighbours that stand in several places are a node; and the nodes' parts.

    Node classes + k is the sum of the two parts at k. Within a round the most frequent pairs go first.
    """
    parts: list[tuple[int, int]] = []
    while True:
        pairs = Counter(p for own in items for p in zip(own, own[1:]))
        rank = {p: (-c, p) for p, c in pairs.items() if c > 1}
        if not rank:
            return items, parts
        made: dict[tuple[int, int], int] = {}
        after = []
        for own in items:
            taken, used = [], set()
            for k in sorted((k for k in range(len(own) - 1) if (own[k], own[k + 1]) in rank), key=lambda k: rank[own[k], own[k + 1]]):
                if k not in used and k + 1 not in used:
                    used |= {k, k + 1}
                    taken.append(k)
            starts, left, k = set(taken), [], 0
            while k < len(own):
                if k in starts:
                    left.append(made.setdefault((own[k], own[k + 1]), classes + len(parts) + len(made)))
                    k += 2
                else:
                    left.append(own[k])
                    k += 1
            after.append(left)
        parts += list(made)
        items = after


class Search:
    """The graph of a block of items: term classes, shared nodes, and each item's sum. items: {item: terms}, weights: {term: w}."""

    def __init__(self, items: dict[int, list[int]], weights: dict[int, int], documents: int, total: int):
        self.items = sorted(items)
        holders: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            for t in items[item]:
                holders.setdefault(t, []).append(k)
        classes: dict[tuple[int, ...], list[int]] = {}
        for t in sorted(holders):
            classes.setdefault(tuple(holders[t]), []).append(t)
        order = sorted(classes, key=lambda own: (-len(own), own))  # what many items share comes first, and next to what the same items share
        self.terms = np.array(sorted(holders), dtype=np.int64)
        of = {t: c for c, own in enumerate(order) for t in classes[own]}
        self.class_of = np.array([of[t] for t in self.terms.tolist()], dtype=np.int64)
        self.weight = np.array([weights.get(t, 0) for t in self.terms.tolist()], dtype=np.int64)
        sequences: list[list[int]] = [[] for _ in self.items]
        for c, own in enumerate(order):
            for k in own:
                sequences[k].append(c)
        self.left, self.parts = shared_nodes(sequences, len(order))
        self.leaves, self.documents, self.total = len(order), documents, total
        self.additions = len(self.parts) + sum(map(len, self.left))

    def scores(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Items by documents; n: terms of each document, row, term, tf: the occurrences of the known terms."""
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        some = self.terms[at] == term
        row, at, tf = row[some], at[some], tf[some]
        m = 10 + 90 * n * self.documents // self.total
        part = self.weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        sums = np.zeros((self.leaves + len(self.parts), len(n)), dtype=np.int64)
        np.add.at(sums, (self.class_of[at], row), part)
        for k, (a, b) in enumerate(self.parts, self.leaves):
            np.add(sums[a], sums[b], out=sums[k])
        return np.stack([sums[own].sum(axis=0) for own in self.left])

    def best(self, batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
        """item, doc_id, score of each item's best documents of all batches; ties by doc_id, null ones last."""
        held: list[np.ndarray] = [np.empty((0, 4), dtype=np.int64)]
        least = np.ones(len(self.items), dtype=np.int64)
        step = max(1, CELLS // (self.leaves + len(self.parts)))
        for batch in batches:
            for low in range(0, len(batch), step):
                own = batch.slice(low, step)
                doc = own.column("doc_id")
                none, ids = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64), doc.fill_null(0).to_numpy(zero_copy_only=False)
                terms, tfs = own.column("terms"), own.column("tfs")
                row = np.repeat(np.arange(len(own)), terms.value_lengths().to_numpy(zero_copy_only=False))
                found = self.scores(own.column("n").to_numpy(), row, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy())
                item, at = np.nonzero(found >= least[:, None])
                every = np.concatenate([held[0], np.stack([item, found[item, at], none[at], ids[at]], axis=1)])
                every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
                first = np.searchsorted(every[:, 0], every[:, 0])
                rank = np.arange(len(every)) - first
                held = [every[rank < top]]
                last = every[rank == top - 1]
                least[last[:, 0]] = last[:, 1]
        out = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(self.items, dtype=np.int64)[out[:, 0]]), pa.array(out[:, 3], mask=out[:, 2] == 1), pa.array(out[:, 1])], names=["item", "doc_id", "score"])


def weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.log((2 * F.lit(float(documents)) + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = TOP, sent_terms: int = SENT_TERMS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents.

    Null and empty texts have no terms; such items get no row, such documents don't count. Repeated items are ranked each, and repeated documents
    are documents each; among equal scores the smaller doc_id goes first, a null one last. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    items = scratch.write(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text")), "items")
    wanted = scratch.write(item_terms(items), "wanted")
    known = scratch.write(wanted.select("term").distinct().select("term", F.monotonically_increasing_id().alias("wide")), "known")
    known = scratch.write(known.select("term", (F.row_number().over(Window.partitionBy(F.shiftright("wide", 33)).orderBy("wide")) - 1).alias("at"), F.shiftright("wide", 33).alias("part")), "parts")
    sizes = {r["part"]: r["count"] for r in known.groupBy("part").count().collect()}  # one row for each task that wrote terms
    starts, held = [], 0
    for part in sorted(sizes):
        starts.append((part, held))
        held += sizes[part]
    first = spark.createDataFrame(starts, "part long, start int")
    known = scratch.write(known.join(F.broadcast(first), "part").select("term", (F.col("start") + F.col("at")).cast("int").alias("id")), "ids")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    if held <= sent_terms:
        postings = sent_postings(texts, {bytes(r["term"]): r["id"] for r in known.collect()})
    else:
        postings = joined_postings(texts, known, scratch)
    postings = scratch.write(postings, "postings")
    documents, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    counts = postings.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    weighted = scratch.write(counts.select("id", weight(F.col("df"), documents).alias("w")), "weights")
    blocks = max(1, -(-items.count() // item_block))
    dealt = wanted.join(known, "term").select("item", "id", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    dealt = scratch.write(dealt.join(weighted, "id", "left"), "dealt") if blocks > 1 else dealt.join(weighted, "id", "left")
    schema, path, best = "item long, doc_id long, score long", f"{scratch.folder}/best", None
    for block in range(blocks):
        of: dict[int, list[int]] = {}
        weights: dict[int, int] = {}
        for r in dealt.filter(F.col("block") == block).collect():
            of.setdefault(r["item"], []).append(r["id"])
            weights[r["id"]] = r["w"] or 0
        if not of or not total:
            continue
        search = Search(of, weights, documents, total)
        best = postings.mapInArrow(lambda batches, search=search: search.best(batches, top), schema)
        if blocks > 1:  # one table for all blocks, so that the plan doesn't grow with them
            best.write.mode("append").parquet(path)
    if best is None:
        best = spark.createDataFrame([], schema)
    elif blocks > 1:
        best = spark.read.schema(schema).parquet(path)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
