import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import lm
from sigloom.llm.tokens import chunk_ids

TEXTS = ["the cat sat on the mat", "der Hund lief", "", None, "the the the " * 40, "x" * 3000, "one-off wörd, again"]


def a_model(steps=3):
    ids = chunk_ids()
    flat, sizes = ids.flows(lm.lowered(_arrow(TEXTS)))
    counts = np.bincount(flat, minlength=len(ids.ends)).astype(float)
    return lm.train(flat, sizes, counts, ids.ends, steps=steps), flat, sizes


def _arrow(texts):
    import pyarrow as pa

    return pa.array([t if t is None else t.encode() for t in texts], pa.binary())


def test_windows_use_each_target_once():
    sizes = np.array([0, 1, 5, lm.WINDOW - 1, lm.WINDOW, 3 * lm.WINDOW + 7])
    ids = np.arange(sizes.sum())
    inputs, targets, used, places = lm.windows_of(ids, sizes)
    assert sorted(places[used].tolist()) == list(range(len(ids) + len(sizes)))
    assert (targets[used] == lm.END).sum() == len(sizes) and sorted(targets[used & (targets != lm.END)].tolist()) == ids.tolist()


def test_next_ids_are_a_distribution_over_the_vocabulary():
    model, _, _ = a_model()
    s = lm.forward(model.weights, model.input_of[np.array([[lm.START] + [320] * (lm.WINDOW - 1)])])
    logits = s["logits"][0, 5]
    classes = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    assert abs((classes[model.class_of] * np.exp(model.share)).sum() - 1) < 1e-4


def test_scores_are_those_of_plain_windows():
    model, flat, sizes = a_model()
    got = lm.log_probabilities(model, flat, sizes)
    inputs, targets, used, places = lm.windows_of(flat, sizes)
    for k in range(0, len(inputs), 3):
        logits = lm.forward(model.weights, model.input_of[inputs[k : k + 1]])["logits"][0].astype(float)
        logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        for j in np.flatnonzero(used[k]):
            want = logp[j, model.class_of[targets[k, j]]] + model.share[targets[k, j]]
            assert abs(got[places[k, j]] - want) < 1e-3


def test_gradients_are_those_of_small_differences():
    model, flat, sizes = a_model(steps=1)
    inputs, targets, used, _ = lm.windows_of(flat, sizes)
    rows, truth, weight = model.input_of[inputs[:4]], model.class_of[targets[:4]], used[:4].astype(np.float64)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        logits = lm.forward(w, rows)["logits"]
        logp = logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True))
        return -(np.take_along_axis(logp, truth[:, :, None], axis=2)[:, :, 0] * weight).sum() / weight.sum()

    g = lm.gradients(w, rows, truth, weight)
    for k in ("out", "qkv", "a", "b", "o"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def brute(rows, train):
    """n_tokens, n_known, train_tokens and base_score of each text."""
    words = lambda t: (t or "").encode().lower().split()
    counts = Counter()
    for t in train:
        counts.update(words(t) + [None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for t in rows:
        tokens = words(t) + [None]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens)
        out.append((len(tokens), sum(counts[x] > 0 for x in tokens), total, round(base, 6)))
    return out


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 2])
def test_documents_are_scored_as_brute_force_does(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    texts = [*TEXTS, "the cat sat on the mat", "ünknown wörds only"]
    rows = [(None if i % 4 == 3 else i % 5, t, i % 3 != 0, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, word string, row int")
    got = lm.score_documents(docs, F.col("learn")).collect()
    want = brute(texts, [t for t, r in zip(texts, rows) if r[2]])
    assert Counter((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == Counter(want)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_joined_counts_score_as_those_at_hand(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS)], "doc_id long, text string, learn boolean")
    found = []
    for head in (lm.HEAD_WORDS, 2):
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        found.append({r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("learn")).collect()})
    assert all(abs(found[0][k] - found[1][k]) < 1e-3 * abs(found[0][k]) for k in found[0])


def test_without_training_rows_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score_documents(docs, F.lit(False)).collect())
    assert got == [(1, 0, 0), (3, 0, 0)]
    assert lm.score_documents(docs.limit(0), F.lit(True)).collect() == []


def test_words_so_far():
    place, same = lm.so_far(np.array([3, 1, 3, 3, 1, 3]), np.array([4, 0, 2]))
    assert place.tolist() == [0, 1, 2, 3, 0, 1] and same.tolist() == [0, 0, 1, 2, 0, 0]


def test_drawn_windows_are_runs_of_the_texts_ids(monkeypatch):
    monkeypatch.setattr(lm, "SPACED", 200)
    ids = chunk_ids()
    texts = [" ".join(f"word{i % 7} abc" for i in range(n)).encode() for n in (0, 1, 4, 90)] + ["é".encode() * 500]
    inputs, targets, used = lm.drawn_windows(texts, ids)
    assert len(inputs) > 5 and (inputs[:4, 0] == lm.START).all()
    flows = [[lm.START, *np.frombuffer(f, "<u4").tolist(), lm.END] for f in ids.ids_of(texts[:4])]
    for i, t, u in zip(inputs.tolist(), targets.tolist(), used.astype(bool).tolist()):
        run = [i[0]] + [x for x, y in zip(t, u) if y]
        assert any(f[k : k + len(run)] == run for f in flows for k in range(len(f))) or 0 < len(run) <= lm.WINDOW + 1 and run[0] == lm.START
