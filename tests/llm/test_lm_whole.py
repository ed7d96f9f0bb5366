"""op7's network learns from every id of every training text."""

import numpy as np

from sigloom.llm import lm
from sigloom.llm.tokens import WORD_BPE


def test_windows_side_by_side_have_each_id_once_and_no_gap():
    sizes = np.array([0, 1, lm.WINDOW - 1, lm.WINDOW, 3 * lm.WINDOW + 7])
    ids = np.arange(sizes.sum())
    inputs, targets, used, places = lm.windows_of(ids, sizes, lm.WINDOW)
    assert sorted(places[used].tolist()) == list(range(len(ids) + len(sizes)))
    assert all(u[: u.sum()].all() and i[1 : u.sum()].tolist() == t[: u.sum() - 1].tolist() for i, t, u in zip(inputs, targets, used))


def test_what_stands_anywhere_in_a_text_is_learned_from(spark):
    words = [f"word{i % 7}" for i in range(600)]
    other = words[:400] + sorted(words[400:])  # the same words, in another order far behind the text's start
    n = len(lm.chunk_ids().ends)
    found = []
    for text in (words, other):
        docs = spark.createDataFrame([(" ".join(text),)], "text string").selectExpr("cast(text as binary) as text")
        found.append(lm.trained_by_tasks(lm.untrained(np.ones(n), lm.chunk_ids().ends), docs, WORD_BPE, 0, 0.01))
    assert len(" ".join(words)) < lm.SPACED * 2 and np.abs(lm.packed(found[0].weights) - lm.packed(found[1].weights)).max() > 1e-4


def test_rounds_share_out_all_lots():
    assert lm.ROUNDS[-1][0] == lm.LOTS and [r[0] for r in lm.ROUNDS] == sorted({r[0] for r in lm.ROUNDS})
