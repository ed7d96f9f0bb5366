"""Spelling variants by pivotal grams.

Words are runs of letters of all texts. Two words are near if they differ by one inserted, deleted or replaced code point. All
bigrams have one order, the rarest first. A word's gram prefix is its first bigrams in that order; its pivots are two bigrams of the prefix
that share no letter, chosen by dynamic programming so that they, and the letters that they anchor, are as rare as can be.
One edit leaves at least one pivot whole, and a whole pivot is in the near word's prefix, at a place that the edit's side fixes.
Pivots are indexed with what must be equal around the edit, and looked up by the prefixes of all words; the edit distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.util import Scratch, ascii_lower, small_batches

#: Fixed: runs of letters, and one of how many occurrences loses a code point.
RUN, DROPS = "[A-Za-zÀ-ÿ]+", 31
#: Words have so many code points and occurrences at least; a form has so many times a word's occurrences.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: Grams of a prefix, and at most with ties: an edit puts two new bigrams before an old one at most.
PREFIX, PREFIX_MOST = 3, 5
#: Words up to this many code points have keys of both sides of the edit, longer ones and words of this size keys of one side.
LONG = 65
#: Bits of a key: few enough to write less, so many that unlike keys seldom meet.
KEY_BITS = 40
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all texts, without the code points that the rule drops; a null id counts as the empty text."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % DROPS == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points as a matrix) of the words of each length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for m in np.unique(lengths):
        at = np.flatnonzero(lengths == m)
        yield at, np.array([words[i] for i in at], dtype=f"U{m}").view(np.uint32).reshape(len(at), m).astype(np.int64)


def gram_codes(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-1] * 2**21 + codes[:, 1:]


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): in how many places of words each bigram stands, as a code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in by_length(batch.column(0).to_pylist()):
                grams, n = np.unique(gram_codes(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Pivots:
    """Keys of words, from the order of all bigrams. grams: (gram, n) of each, at most as many as there are pairs of letters."""

    def __init__(self, grams: list[tuple[int, int]]):
        codes = np.array([g for g, _ in grams], dtype=np.int64)
        self.codes = np.sort(codes)
        n = np.array([c for _, c in grams], dtype=np.float64)[np.argsort(codes)]
        self.rank = np.empty(len(n), dtype=np.int64)
        self.rank[np.lexsort((self.codes, n))] = np.arange(len(n))
        self.weight = np.log(n / n.sum())

    def prefix(self, rank: np.ndarray) -> np.ndarray:
        """Whether each gram is in its word's prefix: the first PREFIX in the order, ties with the last of them included up to PREFIX_MOST."""
        places = np.arange(rank.shape[1])
        keys = rank * rank.shape[1] + places
        last = np.partition(rank, PREFIX - 1, axis=1)[:, PREFIX - 1 : PREFIX]
        most = min(PREFIX_MOST, rank.shape[1]) - 1
        return (rank <= last) & (keys <= np.partition(keys, most, axis=1)[:, most : most + 1])

    def pivots(self, rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two bigrams of each word's first PREFIX that share no letter, of least weight: how likely what each of them anchors is, to the left and right."""
        n = rank.shape[1]
        keys = rank * n + np.arange(n)
        mine = keys <= np.partition(keys, PREFIX - 1, axis=1)[:, PREFIX - 1 : PREFIX]
        cost = np.where(mine, np.exp(np.cumsum(weight, axis=1)) + np.exp(np.cumsum(weight[:, ::-1], axis=1)[:, ::-1]), np.inf)
        one, at = np.full(len(rank), np.inf), np.zeros(len(rank), dtype=np.int64)
        both, first, second = one.copy(), at.copy(), at.copy()
        for b in range(2, n):
            lower = cost[:, b - 2] < one  # the best pivot that ends before b
            one[lower], at[lower] = cost[lower, b - 2], b - 2
            lower = one + cost[:, b] < both
            both[lower], first[lower], second[lower] = (one + cost[:, b])[lower], at[lower], b
        return first, second

    def hashed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word's first and last letters: heads[:, j] of the j first, tails[:, j] of those from j on."""
        n, m = codes.shape
        heads, tails = np.zeros((n, m + 1), dtype=np.uint64), np.zeros((n, m + 1), dtype=np.uint64)
        letters = codes.astype(np.uint64) + np.uint64(1)
        for j in range(m):
            heads[:, j + 1] = (heads[:, j] + letters[:, j]) * MULTIPLIER
            tails[:, m - 1 - j] = (tails[:, m - j] + letters[:, m - 1 - j]) * MULTIPLIER
        return heads, tails

    def index_keys(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key): what stays equal, for each place that an edit may have beside the pivots."""
        found = np.searchsorted(self.codes, gram_codes(codes))
        first, second = self.pivots(self.rank[found], self.weight[found])
        heads, tails = self.hashed(codes)
        rows, m = np.arange(len(codes)), codes.shape[1]
        keys = []
        if m <= LONG:
            keys += [key(1, None, tails[rows, first]), key(2, heads[rows, first], tails[rows, second]), key(3, heads[rows, first + 2], tails[rows, second + 2]), key(4, heads[rows, second + 2], None)]
        if m >= LONG:
            keys += [key(5, None, tails[rows, second]), key(6, heads[rows, first + 2], None)]
        return np.tile(rows, len(keys)), np.concatenate(keys)

    def probe_keys(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key): the keys under which a near word may have its pivots, for each bigram of the prefix."""
        inside = self.prefix(self.rank[np.searchsorted(self.codes, gram_codes(codes))])
        heads, tails = self.hashed(codes)
        m, n = codes.shape[1], inside.shape[1]
        least, most = np.argmax(inside, axis=1), n - 1 - np.argmax(inside[:, ::-1], axis=1)
        rows, keys = [], []

        def take(kind: int, at: np.ndarray, head: np.ndarray | None, tail: np.ndarray | None) -> None:
            rows.append(at)
            keys.append(key(kind, head, tail))

        row, i = np.nonzero(inside)
        if m <= LONG:
            some = i + 2 <= most[row]
            take(1, row[some], None, tails[row[some], i[some]])
            some = least[row] + 2 <= i
            take(4, row[some], heads[row[some], i[some] + 2], None)
            for q in range(m + 1):
                some = q < i
                take(2, row[some], heads[row[some], q], tails[row[some], i[some]])
                some = q >= i + 3
                take(3, row[some], heads[row[some], i[some] + 2], tails[row[some], q])
        if m >= LONG:
            take(5, row, None, tails[row, i])
            take(6, row, heads[row, i + 2], None)
        return np.concatenate(rows), np.concatenate(keys)


def key(kind: int, head: np.ndarray | None, tail: np.ndarray | None) -> np.ndarray:
    """A hash of what is equal before and after the edit; unlike words with equal hashes are told apart by their edit distance."""
    x = np.uint64(kind * 0xC2B2AE3D27D4EB4F % 2**64)
    if head is not None:
        x = x ^ (head * np.uint64(0xD6E8FEB86659FD93))
    if tail is not None:
        x = x ^ (tail * np.uint64(0xA0761D6478BD642F))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - KEY_BITS)


def keyed(words: DataFrame, pivots: Pivots, kind: str) -> DataFrame:
    """(key, word, n) under each of a word's keys."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, codes in by_length(batch.column(0).to_pylist()):
                step = max(1, 2_000_000 // (codes.shape[1] * PREFIX_MOST * 2 * (8 if codes.shape[1] <= LONG else 2)))
                for low in range(0, len(at), step):
                    rows, keys = getattr(pivots, kind)(codes[low : low + step])
                    own = batch.take(pa.array(at[low : low + step][rows]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), own.column(0), own.column(1)], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(file, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) with a < b, once for each two near words of words (word, n), which has each word once."""
    pivots = Pivots([(r["gram"], r["n"]) for r in gram_counts(words).collect()])  # two letters of 90: 8,100 rows at most
    index = keyed(words, pivots, "index_keys").select("key", F.col("word").alias("x"), F.col("n").alias("x_n"))
    probes = keyed(words, pivots, "probe_keys").select("key", F.col("word").alias("y"), F.col("n").alias("y_n"))
    near = (F.abs(F.length("x") - F.length("y")) <= 1) & (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", 1) == 1)
    found = index.join(probes, "key").filter(near)
    less = F.col("x") < F.col("y")
    side = lambda one, other: F.when(less, F.col(one)).otherwise(F.col(other))
    return found.select(side("x", "y").alias("a"), side("x_n", "y_n").alias("a_n"), side("y", "x").alias("b"), side("y_n", "x_n").alias("b_n")).distinct()


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of docs.

    Null and empty texts have no words; repeated rows count each; other columns are ignored; an empty table gives none. Of near words with equally
    many occurrences the first in code-point order is the form.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(word_counts(docs, doc_id, text), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(pairs.select(F.col("b"), F.col("a"), F.col("a_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    large = -F.col("best.less") >= FORM_TIMES * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))
    formed = scratch.write(formed, "formed")
    return formed.join(roots(formed, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form. Every step is FORM_TIMES as frequent, so chains are short; each turn doubles what is followed."""
    now, turn = scratch.write(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        turn += 1
        after = scratch.write(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{turn}")
        if turn > 1:
            scratch.drop(f"roots-{turn - 1}")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now
