"""Overlap index, iterative stratification, wide components and the ordered walk against plain Python."""

import random

import numpy as np
import pytest

from sigloom.operators import hits as H
from sigloom.operators import overlap, stratify, wide


def alike(a, b):
    m = min(len(a), len(b))
    return a in b or b in a or any(a[-k:] == b[:k] or b[-k:] == a[:k] for k in range(max(1, int(m * 0.8)), m + 1))


def test_overlaps_of_all_sizes(spark):
    draw = random.Random(11)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    seqs = [word("AC", draw.randint(1, 14)) for _ in range(60)] + ["AAAA" * k for k in (2, 5, 10, 30)] + ["é" * 9 + "bc"]
    for _ in range(100):
        base = word("ACDEFG", draw.randint(20, 300))
        i = draw.randint(0, len(base) // 3)
        seqs += [base, base[i:] + word("ACDEFG", draw.randint(0, len(base))), word("ACDEFG", draw.randint(0, 9)) + base[: len(base) - i], base[i : i + draw.randint(1, len(base))]]
    one, two = list(enumerate(seqs)), list(enumerate(seqs[::3]))
    a = spark.createDataFrame([*one, (9998, ""), (9999, None)], "id long, seq string")
    b = spark.createDataFrame([*two, (9997, None)], "id long, seq string")
    got = [tuple(r) for r in overlap.equivalent_pairs(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k) for i, x in one for k, y in two if alike(x, y)}
    assert overlap.equivalent_pairs(a.limit(0), b).isEmpty()


def test_overlap_candidates_follow_the_results(spark):
    draw = random.Random(12)
    long = "".join(draw.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(120_000))
    sizes = []
    for n in (500, 2000):
        df = spark.createDataFrame([(i, long[60 * i : 60 * i + 80]) for i in range(n)], "node long, seq string")
        classes = [overlap.class_size(overlap.least_overlap(80))]
        sizes.append(overlap.filed(df, None).withColumnRenamed("node", "x").join(overlap.filed(df, classes), "key").count())
    assert sizes[1] < 5 * sizes[0]


def test_labels_keep_their_shares(spark):
    draw = random.Random(1)
    weights = [1, 1, 2, 3, 5, 8, 13, 21]
    rows = [(i, x) for i in range(900) for x in set(draw.choices("abcdefgh", weights, k=draw.randint(1, 3)))]
    df = spark.createDataFrame([*rows, *rows[:50], (5, None)], "domain_id long, label string")
    total = {x: sum(r[1] == x for r in rows) for x in "abcdefgh"}
    side = {r["domain_id"]: r["side"] for r in stratify.iterative_split(df, 0.25).collect()}
    assert set(side) == {i for i, _ in rows}
    for x in total:
        assert abs(sum(side[i] == "test" for i, y in rows if x == y) - total[x] / 4) <= 1.5
    assert stratify.iterative_folds(df.limit(0), 3).isEmpty()
    with pytest.raises(ValueError):
        stratify.iterative_parts(df, [0.5, 0.2])


def test_counts_that_folds_want():
    draw = random.Random(2)
    for _ in range(300):
        k, n = draw.randint(2, 6), draw.randint(0, 30)
        wanted = np.array([draw.uniform(-8, 20) for _ in range(k)])
        counts, left = [0] * k, list(wanted)
        for _ in range(n):
            j = max(range(k), key=lambda j: (left[j], -j))
            counts[j] += 1
            left[j] -= 1
        got = stratify.wanted_counts(wanted, n)
        assert got.sum() == n and (got >= 0).all()
        assert max(abs(got - counts)) <= 1
        parts = [stratify.dealt(np.array([s]), np.array([m]), np.array([n]), got[None]) for s, m in ((0, n // 3), (n // 3, n - n // 3))]
        assert (sum(parts)[0] == got).all()


def test_wide_components_are_those_of_an_svd(spark):
    x = np.random.default_rng(0).normal(size=(15, 300)) @ np.diag(np.linspace(3, 0.1, 300))
    blocks = wide.array_blocks(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>"), "v", block=64)
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    got = np.array([r["pcs"] for r in sorted(wide.wide_components(blocks, 4).collect())])
    assert np.allclose(np.abs(u[:, :4] * s[:4]), np.abs(got))
    back = np.array([r["pcs"] for r in sorted(wide.projected(blocks, wide.wide_loadings(blocks, 4)).collect())])
    assert np.allclose(back, got)
    entries = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(x) for k, v in enumerate(row)], "id long, column long, value double")
    assert np.allclose(np.array([r["pcs"] for r in sorted(wide.wide_components(wide.entry_blocks(entries, 100), 4).collect())]), got)
    with pytest.raises(Exception):
        wide.wide_components(wide.entry_blocks(entries.filter("id <> 3 or column > 5"), 100), 4)


def test_an_ordered_walk_sees_earlier_changes(spark):
    # The second of b overlaps the row only after the first took its place; the longest, met first, is out of reach by then.
    a, b = [("s", 0, 100)], [("s", 40, 160, 1), ("s", 105, 300, 2), ("s", 0, 90, 3)]

    def walk(row, others):
        _, s, e = row
        for _, os, oe, _ in sorted((o for o in others if o[0] == row[0]), key=lambda o: (o[3], o[1], o[2])):
            if ((os <= s <= oe and oe - s >= 50) or (s <= os <= e and e - os >= 50)) and oe - os > e - s:
                s, e = os, oe
        return s, e

    draw = random.Random(3)
    make = lambda: sorted({(draw.choice("st"), x := draw.randint(0, 3000), x + draw.randint(0, 400)) for _ in range(60)})
    for one, two in ((a, b), (make(), [(*r, draw.randint(0, 20)) for r in make()])):
        left, right = spark.createDataFrame(one, "seq_id string, start long, end long"), spark.createDataFrame(two, "seq_id string, start long, end long, place long")
        got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in H.ordered_overlap(left, right).collect()}
        assert got == {r: walk(r, two) for r in one}
    assert walk(a[0], b) == (105, 300)
