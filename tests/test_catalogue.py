import os

import pytest

import __spark_entry__
from sigloom.operators import etl
from sigloom.operators import hits as H
from sigloom.plans import catalogue

SF = "/root/testdata/sf0.001"
CHANGES = ["match_entries", "corrections_apply", "position_range_check", "annotations_cleanup", "submission_json", "taxonomy_link", "occurrence_link", "labels_mapped"]
SOME = ["annotated_by_taxon", "detect_domains", "merge_versions", "select_all", "pair_metrics", "topn_wide", "seq_equivalent", *CHANGES]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(catalogue.ORACLE[name]).select(*[f'"{c}"' for c in cols]).fetchall()
    assert show(df.select(*[f"`{c}`" for c in cols]).collect()) == show(want)


def test_gap_of_59_merges_and_60_does_not(spark):
    rows = [("s", 0, 165), ("s", 166, 300), ("s", 359, 500), ("s", 560, 900), ("t", 167, 200)]
    df = spark.createDataFrame(rows, "seq_id string, start long, end long")
    got = {(r["seq_id"], r["start"], r["end"]) for r in H.islands(df).collect()}
    assert got == {("s", 0, 500), ("s", 560, 900), ("t", 167, 200)}


def test_pairing_reaches_199_but_neither_200_nor_0(spark):
    n = spark.createDataFrame([("a", 0, 100, 1), ("b", 0, 100, 1), ("c", 0, 100, 1)], "seq_id string, start long, end long, parts long")
    c = spark.createDataFrame([("a", 299, 350), ("a", 310, 320), ("b", 300, 350), ("c", 100, 150)], "seq_id string, start long, end long")
    assert {r["seq_id"]: r["c_end"] for r in H.pair_forward(n, c).collect()} == {"a": 350, "b": None, "c": None}


def test_every_query_is_registered_once_with_its_columns():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_corrections_of_unknown_labels_change_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "domain_id long, label string")
    known = spark.createDataFrame([("a",), ("b",)], "label string")
    fix = lambda *rows: spark.createDataFrame(list(rows), "domain_id long, label string")
    got = etl.apply_corrections(old, fix((2, "a"), (2, "a"), (3, "b")), known)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "a"), (3, "b")]
    with pytest.raises(ValueError):
        etl.apply_corrections(old, fix((1, "c")), known)


def test_occurrences_need_as_many_numbers(spark):
    places = spark.createDataFrame([("p", "x", 9), ("p", "x", 40), ("p", "y", 5), ("q", "x", 1)], "protein_id string, domain_id string, start long")
    numbers = spark.createDataFrame([("p", "x", 3), ("p", "x", 1), ("p", "y", 2), ("p", "y", 4)], "protein_id string, domain_id string, number int")
    got = {tuple(r) for r in etl.link_occurrences(places, numbers).collect()}
    assert got == {("p", "x", 1, 9), ("p", "x", 3, 40), ("p", "y", None, 5), ("q", "x", None, 1)}


def test_the_last_known_synonym_counts_and_nulls_match_nothing(spark):
    incoming = spark.createDataFrame([("a", ["s", "t"], "AAA"), ("b", [None], "CCC"), ("c", [], None)], "entry string, synonyms array<string>, sequence string")
    names = spark.createDataFrame([(1, "s"), (2, "t"), (3, None)], "id long, synonym string")
    sequences = spark.createDataFrame([(7, "CCC"), (8, "CCC"), (9, None)], "id long, sequence string")
    got = {tuple(r) for r in etl.match_entries(incoming, names, sequences).collect()}
    assert got == {("a", 2, "synonym"), ("b", 7, "sequence"), ("c", None, "new")}
