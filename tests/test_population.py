import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import labels as L
from sigloom.operators import metrics as E
from sigloom.operators import numbering
from sigloom.operators import population as P
from sigloom.operators import prediction as R
from sigloom.operators import signatures as G
from sigloom.plans import models
from sigloom.sources import files

PROPS = {c: [float(i), float(i % 3)] for i, c in enumerate("-ACDEFGHIKLMNPQRSTVWY")}


def proteins(spark, *rows):
    return spark.createDataFrame(list(rows), "entry string, sequence string")


def substrates(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, smiles string, fingerprint array<bigint>")


def domains(spark, *rows):
    return spark.createDataFrame(list(rows), "entry string, sequence string, signature string, extended_signature string, labels array<string>")


def first(spark):
    return proteins(spark, ("P1|P1b", "MKLV")), substrates(spark, ("ala", "CC", [1, 2]), ("ser", "CO", [3])), domains(spark, ("P1.A1|x", "KLMNPQRS", "KLMNPQRST", "E" * 34, ["ser", "ala"]))


def state(tables):
    return {k: sorted(map(str, v.collect())) for k, v in tables.items()}


def test_a_catalogue_is_populated_saved_and_written_out(spark, tmp_path):
    folder = f"file://{tmp_path}/catalogue"
    P.save(P.empty(spark), folder)
    P.populate(spark, folder, [first(spark)])
    tables = P.load(spark, folder)
    assert {k: v.count() for k, v in tables.items()} == {"proteins": 1, "protein_synonyms": 2, "substrates": 2, "domains": 1, "domain_synonyms": 2, "domain_substrates": 2}
    again = (proteins(spark, ("P1b|P1c", "MKLV"), ("P2", "MMM")), substrates(spark, ("ala", "CC", [2, 1])), domains(spark, ("x|y", "KLMNPQRS", "KLMNPQRST", "E" * 34, ["ala", "ser"])))
    P.populate(spark, folder, [again])
    tables = P.load(spark, folder)
    assert {r["synonym"] for r in tables["protein_synonyms"].collect()} == {"P1", "P1b", "P1c", "P2"} and tables["substrates"].count() == 2
    assert {r["synonym"] for r in tables["domain_synonyms"].collect()} == {"P1.A1", "x", "y"} and tables["domains"].count() == 1
    flat = P.flat_files(tables)
    P.write_files(flat, f"file://{tmp_path}/flat")
    assert [tuple(r) for r in files.read_dataset(spark, f"file://{tmp_path}/flat/dataset").collect()] == [("P1.A1|x|y", "KLMNPQRS", ["ser", "ala"])]
    assert {tuple(r) for r in files.read_fasta(spark, f"file://{tmp_path}/flat/proteins").collect()} == {("P1|P1b|P1c", "MKLV"), ("P2", "MMM")}
    assert P.exists(tables["protein_synonyms"], "synonym", "P2") and not P.exists(tables["protein_synonyms"], "synonym", "P3")


BAD = {
    "sequence": lambda s: (proteins(s, ("P1", "OTHER")), substrates(s), domains(s)),
    "molecule": lambda s: (proteins(s), substrates(s, ("ala", "CC", [9])), domains(s)),
    "name": lambda s: (proteins(s), substrates(s, ("new", "CC", [1, 2])), domains(s)),
    "signature": lambda s: (proteins(s), substrates(s), domains(s, ("x", "KLMNPQRS", "OTHER", "E" * 34, ["ala", "ser"]))),
    "labels": lambda s: (proteins(s), substrates(s), domains(s, ("x", "KLMNPQRS", "KLMNPQRST", "E" * 34, ["ala"]))),
    "unknown label": lambda s: (proteins(s), substrates(s), domains(s, ("z", "WWWWWWWW", "KLMNPQRST", "E" * 34, ["gly"]))),
    "equivalent": lambda s: (proteins(s), substrates(s), domains(s, ("z", "KLMNPQRSWW", "KLMNPQRST", "E" * 34, ["ala"]))),
}


@pytest.fixture(scope="module")
def populated(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('catalogue')}"
    P.save(P.empty(spark), folder)
    P.populate(spark, folder, [first(spark)])
    return folder


@pytest.mark.parametrize("what", sorted(BAD))
def test_what_does_not_fit_changes_nothing(spark, populated, what):
    before = state(P.load(spark, populated))
    with pytest.raises(ValueError):
        P.populate(spark, populated, [BAD[what](spark)])
    assert state(P.load(spark, populated)) == before


def test_issues_fall_into_files(spark, tmp_path):
    body = 'text\n```json\n{"protein_name":"p","protein_sequence":"MK","domains":[{"name":"p.A1","sequence":"AC","signature":"S","extended_signature":"E","substrates":["a","b"]}],"new_substrates":[{"name":"a","smiles":"C"}]}\n```'
    found = P.issue_files(spark.createDataFrame([(7, body)], "number long, body string"))
    assert [tuple(r) for r in found["dataset"].collect()] == [(7, "p.A1", "AC", "a|b")] and [tuple(r) for r in found["smiles"].collect()] == [(7, "a", "C")]
    P.write_files(found, f"file://{tmp_path}/issues", by=["number"])
    assert [tuple(r) for r in files.read_fasta(spark, f"file://{tmp_path}/issues/proteins/number=7").collect()] == [("p", "MK")]
    with pytest.raises(ValueError):
        P.issue_files(spark.createDataFrame([(8, "no entry")], "number long, body string"))


def test_strata_are_numbered_as_by_one_sort(spark):
    rows = [(i % 3 if i % 7 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "s int, id long")
    import hashlib

    want = {}
    for s in {s for s, _ in rows}:
        for k, i in enumerate(sorted((i for t, i in rows if t == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)), 1):
            want[i] = k
    got = numbering.numbered(df, ["s"], F.col("id")).collect()
    assert {r["id"]: r["rk"] for r in got} == want and len(got) == 500


def test_clades_are_split_so_that_labels_are_on_both_sides(spark):
    draw = random.Random(1)
    rows = [(c, x, draw.randint(1, 9)) for c in "abcdefgh" for x in "xyz" if draw.random() < 0.8]
    sides = L.rank_split(spark.createDataFrame(rows, "clade string, label string, n long"))
    assert set(sides) == {r[0] for r in rows}
    assert all({sides[c] for c, y, _ in rows if y == x} == {"train", "test"} for x in "xyz")
    with pytest.raises(ValueError):
        L.rank_split(spark.createDataFrame([("a", "x", 3)], "clade string, label string, n long"))


def test_splits_are_checked_and_names_remapped(spark):
    one = spark.createDataFrame([(1, "train"), (2, "test")], "domain_id long, side string")
    L.check_split(one, one.select("domain_id"))
    for bad in (one.filter("domain_id = 1"), one.union(one.filter("domain_id = 1")), one.union(spark.createDataFrame([(3, "test")], one.schema))):
        with pytest.raises(ValueError):
            L.check_split(bad, one.select("domain_id"))
    values = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "w")], "id string, value string")
    names = lambda *r: spark.createDataFrame(list(r), "id string, new_id string")
    assert {tuple(r) for r in L.remapped(values, names(("a", "n"), ("b", "n"), ("c", "m"))).collect()} == {("n", "v"), ("m", "w")}
    for bad in (names(("a", "n"), ("b", "n"), ("c", "n")), names(("a", "n"))):
        with pytest.raises(ValueError):
            L.remapped(values, bad)


def test_forests_tell_what_can_be_told_apart(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, "".join(draw.choice("AC" if i % 2 else "VWY") for _ in range(34)), "odd" if i % 2 else "even") for i in range(80)]
    docs = spark.createDataFrame(rows, "id long, extended_signature string, label string")
    known = spark.createDataFrame([("even", "C"), ("odd", "N")], "label string, smiles string")
    model = models.train_forest(R.featured(docs.filter("id < 60"), PROPS), trees=5, depth=3)
    scores = R.predict_labels(docs.filter("id >= 60").select("id", "extended_signature"), model, known, PROPS)
    best = {r["id"]: r["label"] for r in E.best(scores.drop("smiles")).collect()}
    assert best == {i: x for i, _, x in rows if i >= 60}
    R.write_top(scores, 2, f"file://{tmp_path}/top")
    top = spark.read.csv(f"file://{tmp_path}/top", sep="\t", header=True)
    assert top.columns == ["id", "prediction_1", "confidence_1", "prediction_2", "confidence_2"] and top.count() == 20
    with pytest.raises(ValueError):
        R.write_top(scores, 3, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        R.predict_labels(docs.limit(0), model, known, PROPS)
    with pytest.raises(Exception):
        R.predict_labels(docs, model, known.limit(1), PROPS).collect()
    model.write().overwrite().save(f"file://{tmp_path}/model")
    truths = docs.select("id", "label", F.lit(0).alias("ordinal"))
    folds = R.featured(docs, PROPS).withColumn("fold", (F.col("id") / 2).cast("int") % 2)
    table = {(r["fold"], r["substrate"]): r["accuracy"] for r in R.crossvalidate(folds, truths, 2, trees=5, depth=3).collect()}
    assert table == {(f, s): "1.000" for f in (0, 1) for s in ("all", "even", "odd")}


def test_principal_components_keep_the_variance_of_a_line(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], "id long, v array<double>")
    got = {r["id"]: r["pcs"] for r in models.principal_components(rows, "v", 1).collect()}
    assert all(abs(abs(got[i][0] - got[0][0]) - i * 5**0.5) < 1e-6 for i in got)


def plain_columns(profile, positions, gaps):
    held = [i for i, c in enumerate(profile) if c not in gaps]
    return [held[p] for p in sorted(positions) if 0 <= p < len(held)]


def test_signatures_of_alignments(spark):
    draw = random.Random(6)
    rows = []
    for i in range(20):
        query = "".join(draw.choice("ACDEFGHIKLMNPQRSTVWY" + "-" * 2) for _ in range(240))
        profile = "".join(draw.choice("acdefgh" * 3 + "-.") for _ in range(240))
        rows.append((i, query, profile, draw.randint(0, 15), draw.randint(0, 90), query[:60] if i % 2 else None, profile[:60] if i % 2 else None, 3))
    got = {r["id"]: r for r in G.profile_signatures(spark.createDataFrame(rows, "id long, n_query string, n_profile string, n_hit_start int, n_query_start int, c_query string, c_profile string, c_hit_start int")).collect()}
    for i, q, p, off, start, cq, cp, coff in rows:
        at = plain_columns(p, [x - off for x in G.EXTENDED], "-.")
        want = "".join(q[c] for c in at) if len(at) == 34 else None
        assert got[i]["extended_signature"] == want
        if want:
            assert got[i]["extended_positions"] == [None if q[c] == "-" else start + len(q[:c].replace("-", "")) for c in at]
        nine = plain_columns(p, [x - off for x in G.SIGNATURE], "-.")
        lysine = plain_columns(cp, [36 - coff], "-.") if cp else []
        last = cq[lysine[0]] if lysine and cq[lysine[0]] != "-" else "K"
        assert got[i]["signature"] == ("".join(q[c] for c in nine) + last if len(nine) == 9 else None)
    odd = spark.createDataFrame([(0, "ACD", "A" * 40, 0, 0, None, None, None)], "id long, n_query string, n_profile string, n_hit_start int, n_query_start int, c_query string, c_profile string, c_hit_start int")
    with pytest.raises(Exception):
        G.profile_signatures(odd).collect()


def test_users_own_tables_are_checked(spark):
    lines = lambda *t: spark.createDataFrame(list(enumerate(t, 1)), "line long, text string")
    assert {tuple(r) for r in R.custom_labels(lines("substrate\tsmiles", "ala\tCC(N)C(=O)O", "")).collect()} == {("ala", "CC(N)C(=O)O")}
    for bad in (lines("ala"), lines("ala\tnot a molecule")):
        with pytest.raises(ValueError, match="line 1"):
            R.custom_labels(bad)
    jobs = lambda s: spark.createDataFrame([("p", "d", s)], "protein string, name string, signature string")
    assert R.validated_signatures(jobs("A" * 34)).count() == 1
    for bad in ("A" * 33, "Z" * 34, None):
        with pytest.raises(ValueError):
            R.validated_signatures(jobs(bad))
    for wrong in (lambda: G.scoped(spark.range(1), "plants"), lambda: G.rank_column("tribe")):
        with pytest.raises(ValueError):
            wrong()


def test_issues_bodies_are_parsed_once(spark):
    entry = '{"protein_name": "p", "protein_sequence": "M", "domains": [{"name": "d", "sequence": "s", "substrates": ["a", "b"]}]}'
    bodies = [(1, entry), (2, f" \n{entry}"), (3, f"New\n```json\n{entry}\n```\n"), (4, f"See:\n```\n{entry}\n```\nand ```json\n{{}}\n```")]
    found = P.issue_files(spark.createDataFrame(bodies, "number long, body string"))
    assert sorted(tuple(r) for r in found["dataset"].collect()) == [(k, "d", "s", "a|b") for k in (1, 2, 3, 4)]
    for rows in found.values():
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "parse_json" not in plan.lower()
