"""Language-model scoring: causal self-attention over subword ids, in numpy, beside the counts of all words.

The network gives each next id's class from the ids before it; an id's share of its class follows the counts over all training documents.
It learns by tasks, whose weights are averaged, in rounds that share out the training documents: each is learned from in full, every id of it once at least.
Overlapping windows score each id once, in batches with a causal mask. A word's probability is a mean of its ids' under the network, of its share of
the words so far in the text, and of its share of all training words, so what the model knows grows with the corpus in full. A plain unigram score stands beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.tokens import SOME_BYTES, WORD_BPE, ChunkIds, chunk_ids
from sigloom.llm.util import Scratch, crc32_of_id, frequent, in_parts, small_batches

DIM, INNER = 16, 32
#: Ids of a window, and by how many it moves on.
WINDOW, STRIDE = 24, 20
#: The most frequent ids have an embedding of their own; so many have a class of their own.
EMBEDDED, SINGLES = 4096, 64
BANDS = 16
START, END = 49406, 49407
STEPS, BATCH, RATE = 300, 128, 0.01
#: Training documents are dealt into so many lots by hash; a round takes those up to a number, with its rate. Few at first, so that tasks part from weights that are learned already.
LOTS, ROUNDS = 64, ((1, 0.01), (8, 0.006), (64, 0.003))
#: Where there are fewer training documents than FEW_DOCS, they are gone through again, MOST_TIMES at most.
FEW_DOCS, MOST_TIMES = 2000, 8
#: What drawn_windows takes: a window of what lies in so many bytes at the start of every so many.
DRAWN, SPACED = 120, 2640
#: Windows worked on together: their matrices stay small enough to be kept by the allocator and the cache.
BLOCK = 96
#: So many of the most frequent words have their counts sent to every task; the others' are joined.
HEAD_WORDS = 200_000
#: The network's share of a word's probability; the rest is that of the counts, and of the words so far in the text, whose part grows with their number.
NETWORK, RECENT, SETTLED = 0.15, 0.45, 30
#: Bytes of text whose words a task counts before it passes the counts on.
COUNTED_BYTES = 16_000_000


@dataclass
class Model:
    input_of: np.ndarray  # id -> row of the embedding
    class_of: np.ndarray  # id -> class
    share: np.ndarray  # id -> log of its share of its class
    weights: dict[str, np.ndarray]


def classes_of(counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """input_of, class_of and share from the ids' counts: frequent ids alone, the rest in bands of equal mass, word ends apart."""
    smooth = counts + 0.5
    order = np.argsort(-smooth, kind="stable")
    class_of = np.empty(len(counts), dtype=np.int64)
    class_of[order[:SINGLES]] = np.arange(min(SINGLES, len(order)))
    rest = order[SINGLES:]
    for part, first in ((rest[ends[rest]], SINGLES), (rest[~ends[rest]], SINGLES + BANDS)):
        mass = np.cumsum(smooth[part])
        class_of[part] = first + np.minimum((mass / max(mass[-1] if len(mass) else 1, 1e-9) * BANDS).astype(np.int64), BANDS - 1)
    total = np.bincount(class_of, weights=smooth, minlength=SINGLES + 2 * BANDS)
    input_of = EMBEDDED + class_of
    input_of[order[:EMBEDDED]] = np.arange(min(EMBEDDED, len(order)))
    return input_of, class_of, np.log(smooth) - np.log(total[class_of])


def fresh(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    classes = SINGLES + 2 * BANDS
    shapes = {"e": (EMBEDDED + classes, DIM), "p": (WINDOW, DIM), "qkv": (DIM, 3 * DIM), "o": (DIM, DIM), "a": (DIM, INNER), "b": (INNER, DIM), "out": (DIM, classes)}
    return {k: rng.normal(0, 0.1 if k in "ep" else s[0] ** -0.5, s).astype(np.float32) for k, s in shapes.items()} | {"bias": np.zeros(classes, dtype=np.float32)}


SEEN = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product of matrices."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[-1])


def forward(w: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    """rows: n x WINDOW rows of the embedding; logits of the class after each position, and what lies between.

    Scores are clipped, so exponentials need no shift; what lies ahead is masked out after them.
    """
    x = w["e"][rows] + w["p"]
    q, k, v = map(np.ascontiguousarray, np.split(times(x, w["qkv"]), 3, axis=-1))
    att = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
    att *= np.float32(DIM**-0.5)
    np.clip(att, -40, 40, out=att)
    np.exp(att, out=att)
    att *= SEEN
    att /= att.sum(axis=-1, keepdims=True)
    mixed = np.matmul(att, v)
    h = x + times(mixed, w["o"])
    inner = times(h, w["a"])
    np.maximum(inner, 0, out=inner)
    top = h + times(inner, w["b"])
    logits = times(top, w["out"])
    logits += w["bias"]
    return {"x": x, "q": q, "k": k, "v": v, "att": att, "mixed": mixed, "h": h, "inner": inner, "top": top, "logits": logits}


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, truth: np.ndarray, used: np.ndarray) -> dict[str, np.ndarray]:
    s = forward(w, rows)
    n, t = rows.shape
    flat = lambda z: z.reshape(-1, z.shape[-1])
    p = flat(s["logits"])
    np.exp(p, out=p)  # logits stay small: no shift is needed
    ones, share = np.ones(p.shape[1], dtype=p.dtype), used.reshape(-1) / used.sum()
    p *= (share / (p @ ones))[:, None]
    p.reshape(-1)[np.arange(n * t) * p.shape[1] + truth.reshape(-1)] -= share
    top, inner, h = flat(s["top"]), flat(s["inner"]), flat(s["h"])
    g = {"out": top.T @ p, "bias": np.ones(n * t, dtype=p.dtype) @ p}
    d_top = p @ w["out"].T
    g["b"] = inner.T @ d_top
    d_inner = d_top @ w["b"].T
    d_inner *= inner > 0
    g["a"] = h.T @ d_inner
    d_h = d_top + d_inner @ w["a"].T
    g["o"] = flat(s["mixed"]).T @ d_h
    d_mixed = times(d_h, w["o"].T).reshape(n, t, DIM)
    d_score = np.matmul(d_mixed, s["v"].transpose(0, 2, 1))
    d_v = np.matmul(s["att"].transpose(0, 2, 1), d_mixed)
    d_score -= np.einsum("ntd,ntd->nt", d_mixed, s["mixed"])[:, :, None]
    d_score *= s["att"]
    d_score *= np.float32(DIM**-0.5)
    d_qkv = np.concatenate([np.matmul(d_score, s["k"]), np.matmul(d_score.transpose(0, 2, 1), s["q"]), d_v], axis=-1)
    g["qkv"] = flat(s["x"]).T @ flat(d_qkv)
    d_x = d_h + flat(d_qkv) @ w["qkv"].T
    g["p"] = d_x.reshape(n, t, DIM).sum(axis=0)
    places = rows.reshape(-1)[:, None] * DIM + np.arange(DIM)
    g["e"] = np.bincount(places.reshape(-1), weights=d_x.reshape(-1), minlength=w["e"].size).reshape(w["e"].shape).astype(w["e"].dtype)
    return g


def windows_of(ids: np.ndarray, per_text: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """inputs, targets and used (n x WINDOW) and each window's places among all targets; used marks each target exactly once.

    A text's inputs are the start and its ids, its targets its ids and the end.
    """
    sizes = per_text + 1
    ends = np.cumsum(sizes) - 1
    firsts = ends - sizes + 1
    targets = np.full(len(ids) + len(sizes), END, dtype=np.int64)
    last = np.zeros(len(targets), dtype=bool)
    last[ends] = True
    targets[~last] = ids
    inputs = np.roll(targets, 1)
    inputs[firsts] = START
    counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // stride))
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (nth * stride)[:, None] + np.arange(WINDOW)
    used = (place < sizes[owner][:, None]) & ((nth == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - stride))
    at = firsts[owner][:, None] + np.minimum(place, sizes[owner][:, None] - 1)
    return inputs[at], targets[at], used, at


class Adam:
    """Steps down the gradients of some windows' cross entropy; the weights are changed in place."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))

    def learn(self, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, ease: float = 1.0) -> None:
        self.step += 1
        w = self.model.weights
        for k, grad in gradients(w, self.model.input_of[inputs], self.model.class_of[targets], used).items():
            self.first[k] += 0.1 * (grad - self.first[k])
            self.second[k] += 0.01 * (grad * grad - self.second[k])
            w[k] -= (self.rate * ease * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)


def untrained(counts: np.ndarray, ends: np.ndarray, seed: int = 11) -> Model:
    """A network that knows how frequent each class is, and no more."""
    input_of, class_of, share = classes_of(counts, ends)
    model = Model(input_of, class_of, share.astype(np.float32), fresh(seed))
    mass = np.bincount(class_of, weights=counts + 0.5, minlength=len(model.weights["bias"]))
    model.weights["bias"] = np.log(np.maximum(mass, 1e-3) / mass.sum()).astype(np.float32)
    return model


def train(ids: np.ndarray, per_text: np.ndarray, counts: np.ndarray, ends: np.ndarray, steps: int = STEPS, seed: int = 11) -> Model:
    """A network after so many steps on windows drawn from the texts' ids; for texts at hand, the tasks' way is trained_by_tasks."""
    model = untrained(counts, ends, seed)
    if len(ids):
        inputs, targets, used, _ = windows_of(ids, per_text)
        rng, adam = np.random.default_rng(seed), Adam(model, RATE)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(inputs), BATCH)
            adam.learn(inputs[pick], targets[pick], used[pick].astype(np.float32), min(1.0, 1.5 * (1 - step / (steps + 1))))
    return model


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)]).astype(np.float64)


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def drawn_windows(texts: list[bytes], ids: ChunkIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """inputs, targets and used of one window at the start of every SPACED bytes of each text; only what lies there is tokenised. No query learns from these alone.

    A part runs from white space to white space; the first follows the start, and one that reaches the text's end is followed by the end.
    """
    parts, opening, closing = [], [], []
    for text in texts:
        for s in range(0, max(1, len(text)), SPACED):
            body = text[s : s + DRAWN]
            whole = s + DRAWN >= len(text)
            low = body.find(b" ") if s else 0
            high = len(body) if whole else body.rfind(b" ")
            if 0 <= low < high or (whole and not s):
                parts.append(body[low:high])
                opening.append(s == 0)
                closing.append(whole)
    flat, sizes = ids.flows(pa.array(parts, pa.binary()))
    rows = np.full((len(parts), WINDOW + 1), -1, dtype=np.int64)
    firsts, lead = np.cumsum(sizes) - sizes, np.array(opening, dtype=np.int64)
    rows[lead == 1, 0] = START
    place = np.arange(WINDOW + 1) - lead[:, None]
    inside = (place >= 0) & (place < sizes[:, None])
    if len(flat):
        rows[inside] = flat[np.minimum(firsts[:, None] + np.maximum(place, 0), len(flat) - 1)][inside]
    rows[(place == sizes[:, None]) & np.array(closing, dtype=bool)[:, None]] = END
    inputs, targets = rows[:, :-1], rows[:, 1:]
    used = (inputs >= 0) & (targets >= 0)
    some = used.any(axis=1)
    return np.maximum(inputs, 0)[some], np.maximum(targets, 0)[some], used[some].astype(np.float32)


def trained_by_tasks(model: Model, texts: DataFrame, vocabulary: str, round_no: int, rate: float, again: int = 1) -> Model:
    """The model after one round: every task starts from its weights and learns from all windows of the texts (binary) it has, again if asked; the mean, by targets, is the new model.

    Tasks' weights are summed up by a few tasks, so the driver gets a few vectors of the model's size, whatever the corpus.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)
    kinds = "part int, n long, weights array<double>"

    def row(n: int, weights: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([n], pa.int64()), pa.array([weights], pa.list_(pa.float64()))], names=["part", "n", "weights"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, n = sent.value, chunk_ids(vocabulary), 0
        own = Model(own.input_of, own.class_of, own.share, {k: v.copy() for k, v in own.weights.items()})
        adam = Adam(own, rate)
        for batch in in_parts(batches, 0, SOME_BYTES):
            inputs, targets, used, _ = windows_of(*ids.flows(lowered(batch.column(0))), stride=WINDOW)
            for turn in range(again):
                order = np.random.default_rng((round_no, turn)).permutation(len(inputs))
                for at in range(0, len(order), BATCH):
                    pick = order[at : at + BATCH]
                    adam.learn(inputs[pick], targets[pick], used[pick].astype(np.float32))
            n += int(used.sum())
        if n:
            yield row(n, packed(own.weights) * n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, weights in zip(batch.column(1).to_pylist(), batch.column(2)):
                found = weights.values.to_numpy()
                n, total = n + k, found if total is None else total + found
        if n:
            yield row(n, total)

    sums = texts.mapInArrow(learn, kinds).repartition(8).mapInArrow(add, kinds).select("n", "weights").collect()
    if not sums:
        return model
    mean = np.sum([np.array(r["weights"]) for r in sums], axis=0) / sum(r["n"] for r in sums)
    return Model(model.input_of, model.class_of, model.share, unpacked(mean, model.weights))


def lookup_of(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row of the embedding, and each place, followed by its queries, keys and values: with one layer these need no products later."""
    return np.hstack([w["e"], w["e"] @ w["qkv"]]), np.hstack([w["p"], w["p"] @ w["qkv"]])


def logits_of(w: dict[str, np.ndarray], lookup: tuple[np.ndarray, np.ndarray], rows: np.ndarray, skip: int) -> np.ndarray:
    """forward()'s logits for the places from skip on, flat."""
    x = lookup[0].take(rows, axis=0)
    x += lookup[1]
    k, v = x[:, :, 2 * DIM : 3 * DIM], x[:, :, 3 * DIM :]
    att = np.matmul(x[:, skip:, DIM : 2 * DIM], np.ascontiguousarray(k.transpose(0, 2, 1)))
    att *= np.float32(DIM**-0.5)
    np.clip(att, -40, 40, out=att)
    np.exp(att, out=att)
    att *= SEEN[skip:]
    mixed = np.matmul(att, np.ascontiguousarray(v))
    mixed /= np.matmul(att, np.ones((WINDOW, 1), dtype=np.float32))
    h = x[:, skip:, :DIM].reshape(-1, DIM) + mixed.reshape(-1, DIM) @ w["o"]
    inner = h @ w["a"]
    np.maximum(inner, 0, out=inner)
    h += inner @ w["b"]
    logits = h @ w["out"]
    logits += w["bias"]
    return logits


def log_probabilities(model: Model, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """The log probability of every target in turn: each text's ids and its end."""
    inputs, targets, used, places = windows_of(ids, per_text)
    lookup, out = lookup_of(model.weights), np.empty(len(ids) + len(per_text))
    ones = np.ones(len(model.weights["bias"]), dtype=np.float32)
    rows, classes, shares = model.input_of[inputs], model.class_of[targets], model.share[targets]
    for skip, some in ((0, np.flatnonzero(used[:, 0])), (WINDOW - STRIDE, np.flatnonzero(~used[:, 0]))):
        for at in range(0, len(some), BLOCK):
            part = some[at : at + BLOCK]
            logits = logits_of(model.weights, lookup, rows[part], skip)
            own = logits.reshape(-1).take(np.arange(len(logits)) * logits.shape[1] + classes[part, skip:].reshape(-1))
            np.exp(logits, out=logits)  # logits stay small: no shift is needed
            logp = own - np.log(logits @ ones) + shares[part, skip:].reshape(-1)
            mine = used[part, skip:].reshape(-1)
            out[places[part, skip:].reshape(-1)[mine]] = logp[mine]
    return out


def so_far(words: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word in turn: how many words of its text come before it, and how many of those are the same."""
    of = np.repeat(np.arange(len(per_text)), per_text)
    place = np.arange(len(words)) - (np.cumsum(per_text) - per_text)[of]
    key = of * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) > 0)[: len(key)]
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    same = np.empty(len(key), dtype=np.int64)
    same[order] = rank
    return place, same


def without_counts(logp: np.ndarray, place: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of what the network, which gives logp, and the words so far make of each word's probability; and the weight that its share of all words has."""
    recent = RECENT * place / (place + SETTLED)
    cached = np.log(np.maximum(recent * same / np.maximum(place, 1), 1e-300))
    return np.where(same > 0, np.logaddexp(logp + np.log(NETWORK), cached), logp + np.log(NETWORK)), 1 - NETWORK - recent


def with_counts(rest: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    return np.where(weighted > 0, np.logaddexp(rest, np.log(np.maximum(weighted, 1e-300))), rest)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").cast(pa.string()))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column of texts (binary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 0, COUNTED_BYTES):
            found = pc.value_counts(pc.ascii_split_whitespace(lowered(batch.column(0))).flatten())
            some = found.filter(pc.not_equal(pc.binary_length(found.field("values")), 0))
            yield pa.RecordBatch.from_arrays([some.field("values").cast(pa.binary()), some.field("counts")], names=["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def token_counts(words: DataFrame, vocabulary: str) -> DataFrame:
    """(token, n) of ids over all words (word, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(vocabulary)
        total = np.zeros(len(ids.ends), dtype=np.int64)
        for batch in in_parts(batches, 0, SOME_BYTES):
            flat, sizes = ids.flows(batch.column(0))
            total += np.bincount(flat, weights=np.repeat(batch.column(1).to_numpy(), sizes), minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["token", "n"])

    return words.select("word", "n").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


#: The key of a document's own row among words: no word has white space.
ROW_MARK = b" "


def score_documents(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", vocabulary: str = WORD_BPE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per document, repeated rows and null ids included.

    Tokens are the lower-cased words and one end. base_score: the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))); c is the token's count,
    N that of all and V that of distinct tokens over the rows where learn holds. score: log10 of the text's probability: each token's is a mean of c / N,
    its share of the words so far in the text, and the product of its ids' under the network, with weights that depend on its place alone. Null texts count as empty; a text is scored as a whole, whatever its length. Without
    training rows every count is 0 and the network stays as it starts. Other columns are ignored; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), learn.alias("learn"))
    training = kept.filter("learn")
    words = scratch.write(word_counts(training.select(F.col("text").cast("binary"))), "words")
    n_docs = training.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, vocabulary_size = n_words + n_docs, distinct + (n_docs > 0)
    below = total + 0.1 * (vocabulary_size + 1)
    ids = chunk_ids(vocabulary)
    counts = np.zeros(len(ids.ends))
    for r in token_counts(words, vocabulary).collect():  # a row per id of the vocabulary at most
        counts[r["token"]] = r["n"]
    counts[END] = n_docs
    model, lot, again = untrained(counts, ids.ends), F.pmod(F.xxhash64("text"), F.lit(LOTS)), min(MOST_TIMES, -(-FEW_DOCS // max(n_docs, 1)))
    for k, (below_lot, rate) in enumerate(ROUNDS if n_docs else ()):
        part = training.filter((lot >= (ROUNDS[k - 1][0] if k else 0)) & (lot < below_lot))
        model = trained_by_tasks(model, part.select(F.col("text").cast("binary")), vocabulary, k, rate, again)
    head = {bytes(w).decode(): c for w, c in frequent(words, "word", "n", HEAD_WORDS)}
    sent = spark.sparkContext.broadcast((head, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = sent.value
        ids = chunk_ids(vocabulary)
        first = TaskContext.get().partitionId() << 36
        names = ["row", "word", "doc_id", "n_tokens", "n_known", "base", "score", "rest", "weight"]
        for batch in in_parts(batches, 1, SOME_BYTES):
            found = ids.encoded(lowered(batch.column(1)))
            n = batch.num_rows
            of = np.repeat(np.arange(n), found.per_text)
            per_text = np.bincount(of, weights=found.sizes, minlength=n).astype(np.int64)
            logp = log_probabilities(net, found.ids, per_text)
            # Each text's targets are its words' ids and one end: a word's log probability is the sum over its ids'.
            sums = np.append(0, np.cumsum(logp))
            stops = np.cumsum(found.sizes) + of
            own = sums[stops] - sums[stops - found.sizes]
            end = logp[np.cumsum(per_text + 1) - 1]
            c = np.array([known.get(w, 0) for w in found.words.to_numpy(zero_copy_only=False).tolist()], dtype=np.float64)[found.which]
            at_hand = c > 0
            place, same = so_far(found.which, found.per_text)
            rest, weight = without_counts(own, place, same)
            end_rest, end_weight = without_counts(end, found.per_text, np.zeros(n, dtype=np.int64))
            base = np.log10((np.append(c, n_docs) + 0.1) / below)
            add = lambda some, values: np.bincount(of[some], weights=values[some], minlength=n)
            score_of = (add(at_hand, with_counts(rest, weight * c / max(total, 1))) + with_counts(end_rest, end_weight * n_docs / max(total, 1))) / np.log(10)
            rows = first + np.arange(n)
            marks = [ROW_MARK + r.to_bytes(8, "big") for r in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(marks, pa.binary()), batch.column(0), pa.array(found.per_text + 1), pa.array(add(at_hand, at_hand).astype(np.int64) + (n_docs > 0)), pa.array(add(at_hand, base[:-1]) + base[-1]), pa.array(score_of), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names=names)
            rare = np.flatnonzero(~at_hand)
            nought, zero = pa.array(np.zeros(len(rare))), pa.array(np.zeros(len(rare), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows[of[rare]]), found.words.take(pa.array(found.which[rare])).cast(pa.binary()), pa.nulls(len(rare), pa.int64()), zero, zero, nought, nought, pa.array(rest[rare]), pa.array(weight[rare])], names=names)
            first += n

    rows = kept.select("doc_id", F.col("text").cast("binary")).mapInArrow(score, "row long, word binary, doc_id long, n_tokens long, n_known long, base double, score double, rest double, weight double")
    joined = rows.join(words.withColumnRenamed("n", "c"), "word", "left")
    here = F.col("rest").isNotNull()
    rare = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(below)))
    by_count = F.col("c") * F.col("weight") / F.lit(float(max(total, 1)))
    alone = F.col("rest") / float(np.log(10))
    both = F.when(F.col("c").isNull(), alone).when(F.col("rest") < -600, F.log10(by_count)).otherwise(F.log10(by_count + F.exp("rest")))
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(here & F.col("c").isNotNull(), 1).otherwise(0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.when(here, rare).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(here, both).otherwise(0.0)).alias("score"),
    ).drop("row")


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(10)) == 0
