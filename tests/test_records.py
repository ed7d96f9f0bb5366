"""Nested records, the order of output, taxa that are equal in all ranks, and the graph of labels."""

import json

from sigloom.operators import etl
from sigloom.operators import prediction as R


def test_nested_records(spark):
    domains = spark.createDataFrame([("d2", "p", 2, 50, 90, "GG", "s2", "e2"), ("d1", "p", 1, 0, 40, "AA", "s1", "e1"), ("x", "q", 1, 5, 9, "C", "s", "e")], "id string, seq_id string, domain_nr int, start int, end int, sequence string, signature string, extended_signature string")
    scores = spark.createDataFrame([("d1", "b", "C", 0.25), ("d1", "a", "N", 0.75), ("d2", "b", "C", 0.5), ("d2", "a", "N", 0.5), ("x", "a", "N", 1.0)], "id string, label string, smiles string, p double")
    got = {r["protein_name"]: json.loads(r["body"]) for r in R.result_records(scores, domains, spark.createDataFrame([("p", "AAGG"), ("q", "C"), ("none", "W")], "seq_id string, sequence string")).collect()}
    assert set(got) == {"p", "q"} and got["p"]["sequence"] == "AAGG" and [r["domain_nr"] for r in got["p"]["results"]] == [1, 2]
    assert got["p"]["results"][0]["predictions"] == [{"substrate_name": "a", "substrate_smiles": "N", "probability": 0.75}, {"substrate_name": "b", "substrate_smiles": "C", "probability": 0.25}]
    assert [x["substrate_name"] for x in got["p"]["results"][1]["predictions"]] == ["a", "b"] and got["q"]["results"][0]["domain_signature"] == "s"
    numbered = spark.createDataFrame([("2", 5, 9), ("10", 7, 9), ("10", 3, 9)], "seq_id string, start int, end int")
    assert [tuple(r)[:2] for r in R.in_order(numbered).collect()] == [("10", 3), ("10", 7), ("2", 5)]


def test_taxa_are_shared_when_all_ranks_are_equal(spark):
    proteins = spark.createDataFrame([(1, ["z", "a"]), (2, ["b"]), (3, ["c"]), (4, ["none"]), (5, ["d", "a"])], "protein_id long, synonyms array<string>")
    taxonomy = spark.createDataFrame([("a|x", "G", "s", None), ("b", "G", "s", None), ("c", "G", "s", "k"), ("d", "H", "t", None)], "key string, genus string, species string, strain string")
    known = spark.createDataFrame([(9, "H", "t", None), (7, "H", "t", None)], "taxon_id long, genus string, species string, strain string")
    links, new = etl.linked_taxa(proteins, taxonomy, known, ["genus", "species", "strain"])
    of = {r["protein_id"]: r["taxon_id"] for r in links.collect()}
    assert set(of) == {1, 2, 3, 5} and of[1] == of[2] != of[3] and of[5] == "7"
    assert {(r["taxon_id"], r["genus"], r["strain"]) for r in new.collect()} == {(of[1], "G", None), (of[3], "G", "k")}


def test_graph_of_labels(spark):
    labels = spark.createDataFrame([(i, "a", 0) for i in range(60)] + [(i, "b", 1) for i in range(5)] + [(1, "b", 2), (0, "c", 0)], "domain_id long, label string, ordinal int")
    prints = spark.createDataFrame([("a", [1, 2, 3]), ("b", [2, 3, 4]), ("c", [9]), ("unused", [1, 2])], "label string, values array<bigint>")
    nodes, edges = etl.substrate_graph(labels, prints)
    assert {tuple(r) for r in nodes.collect()} == {("a", 3), ("b", 1), ("c", 1)}
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 0.5)]
