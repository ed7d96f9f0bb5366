"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction runs units with an update gate over a window's bytes; both states label every position, and a
document's probabilities are the mean over its positions. It is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.util import crc32_of_id, free_name, in_parts, own_caches, small_batches

HIDDEN = 8
#: Bytes of a window; texts are cut into windows from their first byte to their last, each byte in exactly one.
WINDOW = 96
#: The network learns from about so many documents a language, drawn by hash, and three windows of each.
SAMPLE_DOCS = 240
STEPS, BATCH, RATE = 260, 96, 0.02
#: Windows scored at once.
BLOCK = 2048


@dataclass
class Network:
    langs: list[str]
    table: list[np.ndarray]  # for each direction: byte -> gate and candidate input, 256 x 2H
    recur: list[np.ndarray]  # 2H x H
    out: np.ndarray  # K x 2H
    bias: np.ndarray  # K

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, self.out, self.bias]


def fresh(langs: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    k = len(langs)
    table = [rng.normal(0, 0.3, (256, 2 * hidden)).astype(np.float32) for _ in range(2)]
    for t in table:
        t[:, :hidden] -= 0.5
    recur = [rng.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32) for _ in range(2)]
    return Network(langs, table, recur, rng.normal(0, 0.3, (k, 2 * hidden)).astype(np.float32), np.zeros(k, dtype=np.float32))


def run(table: np.ndarray, recur: np.ndarray, codes: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (after each position), gates and candidates; codes: L x W bytes, results L x H x W."""
    length, width = codes.shape
    hidden = recur.shape[1]
    states = np.empty((length, hidden, width), dtype=np.float32)
    gates, candidates = np.empty_like(states), np.empty_like(states)
    h = np.zeros((hidden, width), dtype=np.float32)
    flat = np.ascontiguousarray(table.T)
    for t in range(length - 1, -1, -1) if back else range(length):
        a = recur @ h
        a += flat[:, codes[t]]
        a[:hidden] *= 0.5
        np.tanh(a, out=a)
        z, c = gates[t], candidates[t]
        np.multiply(a[:hidden], 0.5, out=z)
        z += 0.5
        c[:] = a[hidden:]
        np.subtract(c, h, out=states[t])
        states[t] *= z
        states[t] += h
        h = states[t]
    return states, gates, candidates


def back_through_time(table: np.ndarray, recur: np.ndarray, codes: np.ndarray, back: bool, kept: tuple, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and recur, given those of the states."""
    states, gates, candidates = kept
    length, hidden, width = states.shape
    d_recur, d_inputs = np.zeros_like(recur), np.empty((length, 2 * hidden, width), dtype=np.float32)
    dh = np.zeros((hidden, width), dtype=np.float32)
    order = range(length) if back else range(length - 1, -1, -1)
    for t in order:
        before = t + 1 if back else t - 1
        prev = states[before] if 0 <= before < length else np.zeros_like(dh)
        dh = dh + d_states[t]
        z, c = gates[t], candidates[t]
        da = d_inputs[t]
        da[:hidden] = dh * (c - prev) * z * (1 - z)
        da[hidden:] = dh * z * (1 - c * c)
        d_recur += da @ prev.T
        dh = dh * (1 - z) + recur.T @ da
    d_table = np.zeros_like(table)
    np.add.at(d_table, codes.reshape(-1), d_inputs.transpose(0, 2, 1).reshape(-1, 2 * hidden))
    return d_table, d_recur


def label(net: Network, codes: np.ndarray) -> np.ndarray:
    """Probabilities at every position: K x L x W."""
    f, b = (run(net.table[d], net.recur[d], codes, bool(d))[0] for d in (0, 1))
    hidden = f.shape[1]
    logits = np.matmul(net.out[:, :hidden], f) + np.matmul(net.out[:, hidden:], b)
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.transpose(1, 0, 2)


def gradients(net: Network, codes: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
    kept = [run(net.table[d], net.recur[d], codes, bool(d)) for d in (0, 1)]
    both = np.concatenate([kept[0][0], kept[1][0]], axis=1)
    logits = np.matmul(net.out, both) + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[:, truth, np.arange(codes.shape[1])] -= 1
    p *= mask[:, None, :] / mask.sum()
    d_both = np.matmul(net.out.T, p)
    hidden = net.recur[0].shape[1]
    own = [back_through_time(net.table[d], net.recur[d], codes, bool(d), kept[d], d_both[:, d * hidden : (d + 1) * hidden]) for d in (0, 1)]
    return [own[0][0], own[1][0], own[0][1], own[1][1], np.einsum("lkw,lhw->kh", p, both, optimize=True), p.sum(axis=(0, 2))]


def windows_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes (L x W), mask (L x W) and each window's text."""
    counts = np.array([-(-len(t) // length) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % length) for t in texts), dtype=np.uint8).reshape(-1, length)
    used = np.frombuffer(b"".join(b"\1" * len(t) + bytes(-len(t) % length) for t in texts), dtype=np.uint8).reshape(-1, length)
    return np.ascontiguousarray(flat.T), used.T.astype(np.float32), owner


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Network:
    """Adam on the cross entropy of every position; each step draws the languages evenly."""
    langs = sorted(set(labels))
    net = fresh(langs, hidden, seed)
    if len(langs) < 2:
        return net
    codes, mask, owner = windows_of(texts, WINDOW)
    truth = np.array([langs.index(x) for x in labels])[owner]
    of = [np.flatnonzero(truth == k) for k in range(len(langs))]
    of = [x for x in of if len(x)]
    rng = np.random.default_rng(seed)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, -(-batch // len(of))) for x in of])
        grads = gradients(net, np.ascontiguousarray(codes[:, pick]), mask[:, pick], truth[pick])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; texts are not empty."""
    codes, mask, owner = windows_of(texts, WINDOW)
    total = np.zeros((len(texts), len(net.langs)))
    for at in range(0, codes.shape[1], BLOCK):
        part = slice(at, at + BLOCK)
        p = label(net, np.ascontiguousarray(codes[:, part]))
        sums = np.einsum("klw,lw->wk", p, mask[:, part], optimize=True)
        np.add.at(total, owner[part], sums)
    return total / np.array([len(t) for t in texts])[:, None]


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, learn: Column, size: int) -> tuple[list[bytes], list[str]]:
    """About size documents of each language, drawn by the hash of their text's size and id, and three windows of each."""
    labelled = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = docs.filter(learn & F.col(lang).isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[x for r in counts for x in (F.lit(r[lang]), F.lit(1.5 * size / r["n"]))])
    n = F.length(text)
    parts = F.array(*[F.substr(text, (n * share).cast("int") + 1, F.lit(WINDOW)) for share in (0.0, 0.35, 0.7)])
    rows = labelled.filter(draw < F.try_element_at(rate, F.col(lang))).select(F.col(lang).alias("lang"), F.explode(F.array_distinct(parts)).alias("part")).orderBy(F.xxhash64("part"), "part", "lang").limit(9 * size * len(counts)).collect()
    rows = sorted((r["lang"], r["part"].encode()[:WINDOW]) for r in rows if r["part"])
    return [p for _, p in rows], [x for x, _ in rows]


def predict_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced), predicted from the text's bytes alone.

    The network learns from rows where learn holds and lang is not null: a sample of bounded size a language. A text that is null or has
    no letter, and every text if no row has a language, gets ``und`` and score 0. Whole texts are read; a text's
    result doesn't depend on other rows. Repeated rows each get their result.
    """
    small_batches(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    net = train(*sample(docs, doc_id, text, lang, learn, sample_docs))
    kept = docs.drop("lang_pred", "score")
    letter = free_name(kept, "has_letter")
    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    at = kept.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("languages")
        for batch in in_parts(batches, at, 4_000_000):
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            letters = batch.column(batch.schema.get_field_index(letter)).to_pylist()
            rows = [k for k, x in enumerate(letters) if x and net.langs]
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            todo: list[int] = []
            held = 0
            for k in [*rows, None]:
                if k is not None:
                    todo.append(k)
                    held += len(texts[k])
                if todo and (k is None or held > 4_000_000):
                    p = pooled(net, [texts[i] for i in todo])
                    for i, best, s in zip(todo, p.argmax(axis=1), p.max(axis=1)):
                        names[i], scores[i] = net.langs[best], min(1.0, float(s))
                    todo, held = [], 0
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != letter]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema])

    return kept.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(4)) == 2
