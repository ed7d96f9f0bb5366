"""Molecules as tables, and prediction from hits to the written table."""

import random

import pytest
from pyspark.sql import functions as F

from sigloom.functions.structures import read_structure
from sigloom.operators import molecules as M
from sigloom.operators import prediction as R
from sigloom.operators import signatures as G
from sigloom.plans import models

PROPS = {c: [float(i), float(i % 3)] for i, c in enumerate("-ACDEFGHIKLMNPQRSTVWY")}
#: Pairs of spellings of one molecule.
SAME = [("NC(C)C(=O)O", "OC(=O)C(N)C"), ("c1ccccc1O", "Oc1ccccc1"), ("C1CC1C", "CC1CC1"), ("N[C@@H](Cc1ccc(O)cc1)C(O)=O", "OC(=O)[C@H](N)Cc1ccc(O)cc1"), ("[NH4+]", "[NH4+1]"), ("C%12CCC%12", "C1CCC1"), ("CC(F)Cl", "ClC(F)C"), ("C=1CCC1", "C1CCC=1"), ("[Na+].[Cl-]", "[Cl-].[Na+]")]
OTHER = ["NC(C)C(=O)N", "C1CCCCC1O", "CC=C", "[NH3]", "C1CCC1C", "CC(F)Br", "[13CH4]", "C"]
BAD = ["", "C(", "C)", "C1CC", "C==C", "=C", "C=", "Cx", "[C", "[Qq1]", "C11", "C(C", "1C", "C.", "C-1CC=1", "(C)", "C(=)C"]


def test_ill_formed_structures_are_refused():
    for text in BAD:
        with pytest.raises(ValueError):
            read_structure(text)
    atoms, bonds = read_structure("c1cc[nH]c1C(=O)[O-]")
    assert [a["hydrogens"] for a in atoms] == [1, 1, 1, 1, 0, 0, 0, 0] and len(bonds) == 8 and atoms[-1]["charge"] == -1


def test_fingerprints_do_not_depend_on_the_spelling(spark):
    rows = [(f"a{i}", a) for i, (a, _) in enumerate(SAME)] + [(f"b{i}", b) for i, (_, b) in enumerate(SAME)] + [(f"o{i}", x) for i, x in enumerate(OTHER)] + [("none", None), ("bad", "C(")]
    read = M.read_structures(spark.createDataFrame(rows, "id string, smiles string")).cache()
    assert {r["id"] for r in read.filter("fault is not null").collect()} == {"none", "bad"}
    assert {tuple(r) for r in M.same_molecules(read).collect()} == {(f"a{i}", f"b{i}") for i in range(len(SAME))}
    assert M.bond_table(read).filter("id = 'a0'").count() == 10 and M.atom_table(read).filter("id = 'a0'").count() == 6


def test_custom_structures_are_read(spark):
    lines = lambda *x: spark.createDataFrame([(i, t) for i, t in enumerate(x, 1)], "line int, text string")
    own = R.custom_labels(lines("name\tsmiles", "ala\tNC(C)C(=O)O", "", "gly\tNCC(=O)O"))
    selected = [r[0] for r in M.fingerprints(M.read_structures(own.select(F.col("label").alias("id"), "smiles"))).select(F.explode("fingerprint")).distinct().orderBy("col").collect()]
    bits = {r["label"]: r["bits"] for r in R.custom_bits(own, selected).collect()}
    assert set(bits) == {"ala", "gly"} and bits["ala"] != bits["gly"] and 0 < sum(bits["gly"]) < len(selected)
    with pytest.raises(ValueError, match="line 2"):
        R.custom_labels(lines("ala\tNC(C)C(=O)O", "gly\tNCC(=O"))


def proteins(count):
    """Sequences with one domain each; odd ones are rich in A and C."""
    draw = random.Random(8)
    hits, sequences, alignments = [], [], []
    for i in range(count):
        seq = "".join(draw.choice("AC" if i % 2 else "VWY") for _ in range(420))
        hits += [(f"p{i}", "N", 10, 260, 50.0), (f"p{i}", "C", 300, 360, 40.0), (f"p{i}", "N", 380, 400, 5.0)]
        sequences.append((f"p{i}", seq))
        alignments += [(f"p{i}", "N", 10, 260, seq[10:260], "A" * 250, 0), (f"p{i}", "C", 300, 360, seq[300:336] + "K" + seq[337:360], "A" * 60, 0)]
    hits += [("q", "N", 0, 90, 50.0), ("r", "N", 5, 250, 90.0)]
    sequences += [("q", "A" * 300), ("r", "A" * 300)]
    alignments += [("q", "N", 0, 90, "A" * 90, "A" * 90, 0), ("r", "N", 5, 250, "A" * 100, "A" * 100, 0)]
    return hits, sequences, alignments


def test_from_hits_to_the_written_table(spark, tmp_path):
    found = proteins(40)
    hits, sequences, alignments = (spark.createDataFrame(r, s) for r, s in zip(found, ("seq_id string, hit_id string, start long, end long, bitscore double", "seq_id string, sequence string", "seq_id string, hit_id string, start long, end long, query string, profile string, hit_start int")))
    domains = R.domains_from_hits(hits, sequences, alignments)
    rows = {r["seq_id"]: r for r in domains.collect()}
    assert set(rows) == {f"p{i}" for i in range(40)}  # q is too short, r's alignment doesn't reach all positions
    for i, (_, seq) in enumerate(found[1][:40]):
        r = rows[f"p{i}"]
        assert (r["id"], r["start"], r["end"], r["sequence"]) == (f"p{i}|domain_1|10-360", 10, 360, seq[10:360])
        assert r["extended_signature"] == "".join(seq[10 + p] for p in G.EXTENDED) and r["signature"] == "".join(seq[10 + p] for p in G.SIGNATURE) + "K"
    labels = domains.select(F.col("id").alias("domain_id"), F.when(F.col("seq_id").rlike("[13579]$"), "odd").otherwise("even").alias("label"), F.lit(0).alias("ordinal"))
    taxa = domains.select("id", "extended_signature", F.lit("Bacteria").alias("domain"), F.lit("none").alias("kingdom"))
    folder = f"file://{tmp_path}"
    assert R.train_scopes(taxa, labels, "first_only", PROPS, f"{folder}/models", trees=4, depth=3) == {"all": 40, "fungal": 0, "bacterial": 40}
    known = spark.createDataFrame([("even", "CCO"), ("odd", "CN")], "label string, smiles string")
    out = R.predict_from_hits(hits, sequences, alignments, R.load_model(f"{folder}/models", "bacterial"), known, PROPS, top=2, path=f"{folder}/table")
    best = {r["id"]: (r["label"], r["smiles"]) for r in out.filter("p > 0.5").collect()}
    assert best == {f"p{i}|domain_1|10-360": ("odd", "CN") if i % 2 else ("even", "CCO") for i in range(40)}
    table = spark.read.csv(f"{folder}/table", sep="\t", header=True)
    assert table.count() == 40 and {r["prediction_1"] for r in table.filter("id like 'p1|%'").collect()} == {"odd"}
    with pytest.raises(ValueError):
        R.predict_from_hits(hits.filter("seq_id = 'q'"), sequences, alignments, R.load_model(f"{folder}/models"), known, PROPS)
    selected = [r[0] for r in M.fingerprints(M.read_structures(known.select(F.col("label").alias("id"), "smiles"))).select(F.explode("fingerprint")).distinct().orderBy("col").collect()]
    bits = R.custom_bits(known, selected)
    forest = R.train_pairs(domains.select("id", "extended_signature"), labels, bits, PROPS, trees=8, depth=5)
    names = spark.createDataFrame([(0, "odd")], "ord long, label string")
    custom = bits.filter("label = 'even'").withColumn("label", F.lit("mine"))
    for only, want in ((False, {"odd", "mine"}), (True, {"mine"})):
        asked = R.candidates(names, bits, custom, only)
        got = R.predict_pairs_from_hits(hits, sequences, alignments, forest, asked, PROPS).collect()
        assert {r["label"] for r in got} == want and len(got) == 40 * len(want)
        assert all((r["p"] > 0.5) == ((r["id"].split("|")[0][-1] in "13579") == (r["label"] == "odd")) for r in got)
    with pytest.raises(ValueError):
        R.predict_pairs_from_hits(hits, sequences, alignments, forest, R.candidates(names, bits, None, True), PROPS)
    assert models.predict(forest, R.paired(R.featured(domains.select("id", "extended_signature"), PROPS), bits)).count() == 160
