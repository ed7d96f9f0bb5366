from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w59", "other")
LEAK = " ".join(f"q{i}" for i in range(20))


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def held(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Rows but for those whose component, over links of 0.8 or more, has one earlier by doc_id."""
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = shingles(rows[a][1]), shingles(rows[b][1])
            if x and y and len(x & y) * 100 >= 80 * len(x | y) and comp[a] != comp[b]:
                comp = [comp[b] if c == comp[a] else c for c in comp]
    first = {}
    for c, row in zip(comp, rows):
        first[c] = min(first.get(c, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    return Counter(first.values())


def test_near_duplicates_go_and_clean_documents_stay_whatever_their_ids(spark, tmp_path):
    clean = [" ".join(f"c{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(5, BASE), (None, NEAR), (3, NEAR), (None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (8, clean[4]), (8, clean[4]), (None, clean[5]), (None, clean[5]), (None, None), (9, ""), (9, None)]
    docs = table_of(spark, rows)
    want = brute_kept(rows)
    assert held(corpus_pipeline.near_duplicates(spark, docs, "")) == want
    docs.repartition(3).write.parquet(f"file://{tmp_path}/docs")
    assert held(corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"file://{tmp_path}/docs"), "")) == want


def test_leaks_go_from_rows_without_an_id_and_from_no_other_row(spark, tmp_path):
    spark.createDataFrame([(1, LEAK), (None, BASE)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(None, f"lead {LEAK} tail"), (None, "clean words without an id"), (4, f"{LEAK} again"), (4, "clean words of an equal id"), (5, BASE), (None, None), (6, "")]
    got = held(corpus_pipeline.decontaminated(spark, table_of(spark, rows), f"file://{tmp_path}"))
    assert got == Counter(r for r in rows if LEAK not in (r[1] or "") and BASE not in (r[1] or ""))


def test_secrets_are_masked_and_every_row_stays(spark):
    rows = [(None, 'signing_key = "f7Gh29xKq1LmZ0aa"'), (4, "clean"), (4, "other"), (None, None)]
    got = corpus_pipeline.without_secrets(spark, table_of(spark, rows), "").collect()
    masked = 'signing_key = "[secret]"'
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got) == Counter([(None, masked, len(masked)), (4, "clean", 5), (4, "other", 5), (None, None, 0)])
