"""Hashes of pieces of many sizes at once, and sequences that are made once."""

import numpy as np
from pyspark.sql import functions as F

from sigloom.operators import overlap


def test_pieces_of_all_sizes_share_their_doublings():
    codes = np.random.default_rng(3).integers(65, 90, (2, 150)).astype(np.uint32)
    doubled = overlap.doublings(codes, 150)
    for size in range(1, 151):
        got = overlap.hashed_pieces(codes, size, doubled)
        assert got.shape == (2, 151 - size) and (got == overlap.hashed_pieces(codes, size)).all()
        if size <= 148:
            assert (overlap.hashed_pieces(codes[:, 2 : 2 + size], size)[:, 0] == got[:, 2]).all()


def test_sequences_are_made_once_and_found_in_any_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ACDEFGHIKL"), n))
    items = [(i, word(60 + 9 * i)) for i in range(6)]
    texts = [(100 + k, word(700) + (items[k % 6][1] if k % 2 else "") + word(300)) for k in range(24)]
    monkeypatch.setattr(overlap, "IN_ROW", 500)
    dashed = lambda rows: spark.createDataFrame([(i, "-".join(t)) for i, t in rows], "id long, seq string").withColumn("seq", F.regexp_replace("seq", "-", ""))
    out = overlap.equivalent_pairs(dashed(items), dashed(texts))
    assert "regexp_replace" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {(i, d) for i, t in items for d, x in texts if t in x}
