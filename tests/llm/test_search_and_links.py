"""op11 to op13 over a small folder of tables with nulls, repeats, ties, empty and long texts, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sigloom.llm import lattice, lexical, queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    draw = random.Random(21)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(5, 12))) for _ in range(60)]
    words = base + [w[:3] + draw.choice("xyzß") + w[3:] for w in base] + [w[:2] + w[3:] for w in base] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "ababababa", "q" * 64, "q" * 65, "q" * 66, "r" + "q" * 65]
    weights = [60 if k < 60 else 4 for k in range(len(words))]
    rows = [(i, " ".join(w.upper() if draw.random() < 0.1 else w for w in draw.choices(words, weights, k=draw.randint(1, 60)))) for i in range(120)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1]), (500, None), (501, ""), (502, " \n.,;"), (503, "x1 é2 Ünïcode_tail 42" * 3), (504, "lange wort " * 20_000), (505, "l" * 100_000 + " " + "l" * 100_000)]
    return rows


ITEMS = [(1, "lange wort x1 nowhere"), (1, "lange wort x1 nowhere"), (None, "x1 42"), (2, None), (3, "..."), (4, " ".join(t or "" for _, t in corpus()[:6])), (5, " ".join(t or "" for _, t in corpus()[3:9])), (6, "nowhere")]


def vectors():
    draw = np.random.default_rng(4)
    rows = []
    for c in range(6):
        centre = draw.normal(size=12)
        for k in range(40):
            near = centre / np.linalg.norm(centre) + draw.normal(size=12) * [0.005, 0.03, 0.06][c % 3]
            rows.append((len(rows), [float(np.float32(x)) for x in near * draw.uniform(0.1, 9)], c % 2))
    rows += [(900 + k, rows[3][1], 0) for k in range(5)] + [(900, rows[3][1], 0), (None, rows[3][1], 0), (None, [0.5] * 12, 0), (910, rows[3][1], None), (911, None, 0), (912, [0.0] * 12, 0)]
    rows += [(913, [float("nan")] * 12, 0), (914, [1.0, None] * 6, 0), (915, [], 0), (916, rows[3][1][:5], 0), (917, [float("inf")] * 12, 0), (918, [1e30 * x for x in rows[3][1]], 0), (919, [-x for x in rows[3][1]], 0)]
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, t, "clash", 1) for i, t in corpus()], "doc_id long, text string, word string, n long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, score long").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(*r, "x") for r in vectors()], "vec_id long, embedding array<float>, label int, node string").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def ranked():
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    docs = [(i, Counter(terms(t))) for i, t in corpus()]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    want = []
    for item, text in ITEMS:
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        want += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)]
    return Counter(want)


def test_ranks(spark, sf):
    got = queries.queries()["op11_lexical_search"](spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked()


def test_ranks_with_joined_terms_and_blocks(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    got = lexical.rank_documents(read("documents"), read("benchmark"), sent_terms=3, item_block=3)
    assert Counter(map(tuple, got.collect())) == ranked()
    assert lexical.rank_documents(read("documents").limit(0), read("benchmark")).isEmpty()
    assert lexical.rank_documents(read("documents"), read("benchmark").limit(0)).isEmpty()


def test_shared_sums_are_made_once():
    draw = random.Random(5)
    common = list(range(40))
    items = {k: common[draw.randint(0, 5) :] + [100 + k, 200 + k % 3] for k in range(30)}
    search = lexical.Search(items, {t: t + 1 for own in items.values() for t in own}, 10, 100)
    assert search.additions < sum(map(len, items.values())) / 3
    rows = [(r, t) for r in range(5) for t in draw.sample(range(300), 60)]
    got = search.scores(np.array([60] * 5), np.array([r for r, _ in rows]), np.array([t for _, t in rows]), np.array([2] * len(rows)))
    m = 10 + 90 * 60 * 10 // 100
    for k, own in items.items():
        for r in range(5):
            assert got[k, r] == sum((t + 1) * (2_000_000_000 // (2000 + 8 * m)) for q, t in rows if q == r and t in own)


def linked():
    rows = vectors()
    fine = [k for k, (_, v, x) in enumerate(rows) if x is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    comp, links = list(range(len(rows))), Counter()
    for a in fine:
        for b in fine:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(np.float32(rows[k][1]), dtype=np.float64) for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links[a] += 1
                    one, two = comp[a], comp[b]
                    comp = [min(one, two) if c in (one, two) else c for c in comp]
    ids = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return Counter((rows[k][0], links[k], ids[comp[k]], rows[k][0] is not None and rows[k][0] == ids[comp[k]]) for k in range(len(rows)))


def test_near_vectors(spark, sf):
    got = queries.queries()["op12_embedding_dedup"](spark, sf)
    assert Counter(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == linked()


def test_near_vectors_of_split_cells_and_text_labels(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    for probe in (0.1, 0.3):
        assert Counter(map(tuple, lattice.link_vectors(table, block=7, probe=probe).collect())) == linked()
    wide = table.selectExpr("vec_id", "cast(embedding as array<double>) as embedding", "concat('label ', label) as label")
    assert Counter(map(tuple, lattice.link_vectors(wide).collect())) == linked()
    assert lattice.link_vectors(table.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        lattice.link_vectors(table, probe=0.5)


def test_lattice_points():
    x = np.random.default_rng(1).uniform(-3, 3, size=(500, 8))
    own = lattice.nearest(x) / 2
    assert (own.sum(axis=1) % 2 == 0).all() and (((own * 2) % 2 == 0).all(axis=1) | ((own * 2) % 2 == 1).all(axis=1)).all()
    every = np.concatenate([points for _, points in lattice.around()])
    least = ((x[:, None] - own[:, None] - every[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - own) ** 2).sum(axis=1) <= least + 1e-12).all() and {len(p) for _, p in lattice.around()} == {240, 2160, 6720}


def words():
    counts = Counter()
    for i, t in corpus():
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_variants(spark, sf):
    known = words()
    of = {w: [x for x in known if near(w, x)] for w in known}
    best = {w: min(xs, key=lambda x: (-known[x], x)) for w, xs in of.items() if xs}
    form = {w: x for w, x in best.items() if known[x] >= 10 * known[w]}
    want = set()
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        want.add((w, form.get(w), root, n, len(of[w]), known.get(form.get(w))))
    got = queries.queries()["op13_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert len(form) > 5 and sum(len(w) > 64 for w in known) >= 2


def test_every_edit_is_found(spark):
    draw = random.Random(6)
    for size in (7, 8, 12, 30, 63, 64, 65, 66, 90):
        for letters in ("ab", "abcdefghijklmnop"):
            rows = set()
            for _ in range(12):
                w = "".join(draw.choice(letters) for _ in range(size))
                k = draw.randint(0, size - 1)
                rows |= {w, w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :], w[:k] + draw.choice(letters) + w[k:]}
            rows = sorted(x for x in rows if len(x) >= 7)
            pivots = spelling.Pivots(list(Counter(g for own in rows for g in spelling.gram_codes(next(spelling.by_length([own]))[1])[0].tolist()).items()))
            keys = {w: [set(getattr(pivots, kind)(next(spelling.by_length([w]))[1])[1].tolist()) for kind in ("index_keys", "probe_keys")] for w in rows}
            for a in rows:
                for b in rows:
                    if near(a, b):
                        assert keys[a][0] & keys[b][1] or keys[b][0] & keys[a][1]


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c 1 2 3")], "doc_id long, text string")
    assert spelling.group_variants(docs).isEmpty() and spelling.group_variants(docs.limit(0)).isEmpty()
