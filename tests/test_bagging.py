"""Out-of-bag scores against a recount over the groups' trees, and annotation by equivalent sequences."""

import random

import pytest

from sigloom.operators import prediction as R
from sigloom.plans import models


def test_the_score_is_a_recount_over_unseen_trees(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(i % 3, 0.8), draw.gauss(0, 1)], "abc"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label string").cache()
    groups = models.train_bagged(df, groups=4, trees=10, depth=4)
    assert [g.stages[1].getNumTrees for g in groups] == [3, 3, 2, 2]
    times = [{r["id"]: r["drawn"] for r in models.drawn(df, g).collect()} for g in range(4)]
    again = {r["id"]: r["drawn"] for r in models.drawn(df.repartition(7), 2).collect()}
    assert times[2] == again and 0.25 < sum(n == 0 for t in times for n in t.values()) / 600 < 0.5 and 0.8 < sum(sum(t.values()) for t in times) / 600 < 1.2
    sums = {}
    for g, model in enumerate(groups):
        n = model.stages[1].getNumTrees
        for r in models.predict(model, df).collect():
            if times[g][r["id"]] == 0:
                own = sums.setdefault(r["id"], {})
                p, k = own.get(r["label"], (0.0, 0))
                own[r["label"]] = (p + n * r["p"], k + n)
    got = {(r["id"], r["label"]): r["p"] for r in models.out_of_bag(groups, df).collect()}
    assert set(got) == {(i, x) for i, own in sums.items() for x in own} and len(sums) < 150
    assert all(got[i, x] == pytest.approx(p / k) for i, own in sums.items() for x, (p, k) in own.items())
    right = [max(sorted(own), key=lambda x: round(own[x][0] / own[x][1], 12)) == "abc"[i % 3] for i, own in sums.items()]
    score = models.out_of_bag_score(groups, df)
    assert score == pytest.approx(sum(right) / len(right), abs=0.02) and 0.5 < score < 1
    whole = {r["id"]: sum(x["p"] for x in models.predict_bagged(groups, df).filter(f"id = {r['id']}").collect()) for r in df.limit(2).collect()}
    assert all(abs(p - 1) < 1e-9 for p in whole.values())


def test_annotation_by_equivalent_sequences(spark):
    known = spark.createDataFrame([(1, "ACDEFGHIKL", ["p"]), (2, "CDEFGHIKLM", ["q", "p"]), (3, "WWWW", []), (4, "ACDEFGHIKLMNP", None)], "domain_id long, sequence string, synonyms array<string>")
    asked = spark.createDataFrame([(10, "p", "ACDEFGHIKL"), (11, "x", "FGHIKLMNPQ"), (12, "q", "YYYY"), (13, None, None)], "id long, protein string, sequence string")
    alike = {r["id"]: (r["sequence_matches"], r["name_matches"]) for r in R.annotate(asked, known, equivalent=True).collect()}
    assert alike == {10: ([1, 2, 4], [1, 2]), 11: ([4], []), 12: ([], [2]), 13: ([], [])}
    same = {r["id"]: r["sequence_matches"] for r in R.annotate(asked, known).collect()}
    assert same == {10: [1], 11: [], 12: [], 13: []}


def test_forests_over_embeddings(spark):
    draw = random.Random(9)
    rows = [(i, [float(i % 2) * 4 + draw.gauss(0, 0.5), draw.gauss(0, 1)]) for i in range(60)]
    domains = spark.createDataFrame(rows, "id long, embedding array<float>")
    labels = spark.createDataFrame([(i, "odd" if i % 2 else "even", 0) for i in range(60)] + [(3, "rare", 1)], "domain_id long, label string, ordinal int")
    included = spark.createDataFrame([("odd",), ("even",)], "label string")
    model = R.train_labels_embedded(domains, labels, included, "first_valid", trees=4, depth=3)
    got = {r["id"]: r["label"] for r in models.predict(model, R.embedded(domains)).filter("p > 0.5").collect()}
    assert got == {i: "odd" if i % 2 else "even" for i in range(60)}
    known = spark.createDataFrame([("odd", "C", [0, 1]), ("even", "N", [1, 0])], "label string, smiles string, bits array<int>")
    pairs = R.train_pairs_embedded(domains, labels, known, trees=8, depth=5)
    scored = models.predict(pairs, R.paired(R.embedded(domains), known).selectExpr("struct(id, label) as pair", "features"), id_="pair").filter("label = '1' and p > 0.5").collect()
    assert {(r["pair"]["id"], r["pair"]["label"]) for r in scored} == {(i, "odd" if i % 2 else "even") for i in range(60)}
    with pytest.raises(Exception):
        R.embedded(domains.union(spark.createDataFrame([(99, [1.0])], domains.schema))).collect()
