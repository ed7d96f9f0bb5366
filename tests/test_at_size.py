"""What showed at larger tables only, on tables as small as show it."""

import random

import pytest

from sigloom.operators import molecules as M
from sigloom.operators import labels, matching, overlap, population, stratify
from sigloom.plans import catalogue, further  # noqa: F401 (adds its queries)
from sigloom.sources import sqlsurface


def test_an_export_has_all_rows(spark):
    spark.range(100_500).createOrReplaceTempView("long_table")
    found = sqlsurface.sql_export(spark, "SELECT id FROM long_table")
    assert found.count() == 100_500 and sqlsurface.export_lines(found).count() == 100_500
    assert sqlsurface.sql_export(spark, "SELECT id FROM long_table", most=7).count() == 7


def test_molecules_are_neither_joined_nor_sent_around(spark):
    rows = [(1, "CCO"), (2, "OCC"), (3, "CC(=O)N"), (4, "C(")]
    found = M.fingerprints(M.read_structures(spark.createDataFrame(rows, "id long, smiles string")))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["n_atoms"], tuple(r["fingerprint"])) for r in found.collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] and got[1] != got[3]


def test_label_sets_are_not_sent_to_all_tasks(spark):
    groups = spark.createDataFrame([(["a", "b"], 3, None), (["b"], 2, None)], "own array<string>, n long, given array<long>")
    totals = spark.createDataFrame([("a", 3), ("b", 5)], "label string, total long")
    found = stratify.next_round(groups, totals, [0.5, 0.5])
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "(own#" in line]
    assert joins and all("strategy=merge" in line for line in joins)
    assert sum(sum(r["given"]) for r in found.filter("given is not null").collect()) > 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_equivalent_texts_by_either_way(spark, monkeypatch, most):
    draw = random.Random(5)
    long = "".join(draw.choice("ACDE") for _ in range(600))
    cut = lambda least, last: (lambda at, m: long[at : at + m])(draw.randrange(500), draw.randrange(least, last))
    a, b = sorted({cut(1, 60) for _ in range(60)} | {"A", "CC"}), sorted({cut(20, 90) for _ in range(60)})
    laps = lambda x, y: any(x[-k:] == y[:k] for k in range(max(1, int(min(len(x), len(y)) * 0.8)), min(len(x), len(y)) + 1))
    alike = lambda x, y: x in y or y in x or laps(x, y) or laps(y, x)
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "seq string")
    monkeypatch.setattr(overlap, "SENT_KEYS", most)
    got = [tuple(r) for r in overlap.equivalent_texts(frame(a), frame(b)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in a for y in b if alike(x, y)}
    got = [tuple(r) for r in overlap.equivalent_texts(frame(a)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in a for y in a if alike(x, y)}


def test_the_longest_are_filed_by_their_first_letters_alone(spark):
    one = spark.createDataFrame([(1, "ACDEFGHIKLMNPQRSTVWYACCDDEEFFGGHHI")], "node long, seq string")
    assert overlap.filed(one, None, longest=34).count() == 1 and overlap.filed(one, None, longest=35).count() == 2


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_links_of_sets_with_copies(spark, least):
    draw = random.Random(9)
    sets = [sorted(draw.sample(range(12), draw.randrange(0, 5))) for _ in range(150)] + [sorted(draw.sample(range(30), 20)) for _ in range(20)] + [list(range(20)), list(range(1, 21))]
    sets = list(enumerate(sets + sets[:40]))
    alike = lambda x, y: len(set(x) & set(y)) >= least * len(set(x) | set(y)) - 1e-12
    df = spark.createDataFrame(sets, "id long, values array<int>")
    want = {(i, min(k for k, y in sets if x == y), sum(bool(y) and alike(x, y) for _, y in sets) - 1) for i, x in sets if x}
    assert sorted(map(tuple, matching.jaccard_links(df, least).collect())) == sorted(want)
    want = {(i, min(k for k, y in sets if x == y), sum(x == y for _, y in sets) - 1) for i, x in sets}
    assert sorted(map(tuple, matching.equal_links(df).collect())) == sorted(want)


def test_pairs_are_counted_in_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(matching, "COUNTED", 100)
    df = spark.createDataFrame([(i, [i % 7, 7 + i % 5, 100 + i]) for i in range(100)], "id long, values array<int>")
    found = matching.jaccard_pairs(df, 0.15)
    assert found.rdd.getNumPartitions() > 4 or "hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum((len({i % 7, 7 + i % 5} & {k % 7, 7 + k % 5}) or 0) > 0 for i in range(100) for k in range(i))


def test_populating_without_a_look_at_equivalents(spark, monkeypatch):
    monkeypatch.setattr(population, "equivalent_pairs", None)
    tables = population.empty(spark)
    rows = spark.createDataFrame([("a", "MK", "S", "E", [])], "entry string, sequence string, signature string, extended_signature string, labels array<string>")
    assert population.new_domains(rows, tables, "new")["domains"].count() == 1


def copies(draw):
    """Sets with copies, as (id, values): an id that comes up twice, none, and empty sets among them."""
    sets = [sorted(draw.sample(range(9), draw.randrange(0, 4))) for _ in range(120)] + [[1, 2]] * 30 + [list(range(20)), list(range(1, 21))]
    return [*enumerate(sets), (3, [1, 2]), (3, [1, 2]), (None, [1, 2])]


@pytest.mark.parametrize("block", [7, 1000])
def test_equal_sets_are_written_as_pairs_of_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    sets = copies(random.Random(4))
    want = [(i, k) for i, x in sets for k, y in sets if None not in (i, k) and i < k and x == y]
    assert sorted(map(tuple, matching.equal_pairs(spark.createDataFrame(sets, "id long, values array<int>")).collect())) == sorted(want)


def test_same_molecules_gives_the_pairs(spark, tmp_path):
    spark.createDataFrame([(i, [0.5 if k == i % 3 else 0.0 for k in range(64)]) for i in range(8)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.QUERIES["same_molecules"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("id", "other").collect())) == [(i, k) for i in range(8) for k in range(i + 1, 8) if i % 3 == k % 3]


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("least", [0.3, 0.5])
def test_similar_sets_are_written_as_pairs_of_all_rows(spark, monkeypatch, least, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    sets = copies(random.Random(6))
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = [(i, k, round(share(x, y), 6)) for i, x in sets for k, y in sets if x and y and None not in (i, k) and i < k and share(x, y) >= least]
    got = matching.similar_pairs(spark.createDataFrame(sets, "id long, values array<int>"), least)
    assert sorted((r["id"], r["other"], round(r["jaccard"], 6)) for r in got.collect()) == sorted(want)


def test_similar_sets_gives_the_pairs_and_how_alike_they_are(spark, tmp_path):
    rows = [(1, [0]), (2, [0, 1]), (3, [0, 1]), (4, [2]), (5, [])]
    spark.createDataFrame([(i, [0.5 if k in on else 0.0 for k in range(64)]) for i, on in rows], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.QUERIES["similar_sets"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("id", "other", "jaccard").collect())) == [(1, 2, 0.5), (1, 3, 0.5), (2, 3, 1.0)]


def test_texts_of_one_length_meet_with_their_minimizers(spark):
    draw = random.Random(8)
    long = "".join(draw.choice("ACDE") for _ in range(400))
    texts = {long[at : at + 34] for at in (draw.randrange(360) for _ in range(150))} | {"A" * 34, "AC" * 17, "CA" * 17, "ACD" * 11 + "A", "A" * 33 + "C", "C" + "A" * 33, "CDA" * 11 + "C"}
    alike = lambda x, y: any(x[-k:] == y[:k] or y[-k:] == x[:k] for k in range(27, 35))
    found = overlap.equivalent_texts(spark.createDataFrame([(x,) for x in sorted(texts)], "seq string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in texts for y in texts if alike(x, y)}


def test_pieces_are_those_of_the_letters(spark):
    texts = [None, "", "ab1c", "bjouxz BJOUXZ", "Straße – ſK İıK ab\ncd\x00ef", "é" * 9 + "abcdefghij"]
    letters = ["".join(c for c in text or "" if c.isascii() and c.isalpha()).upper().translate(str.maketrans("BJOUXZ", "ACDEFG")) for text in texts]
    found = catalogue.pieces_of_letters(spark.createDataFrame([(x,) for x in texts], "text string"), 4)
    assert sorted(r[0] for r in found.collect()) == sorted(x[i : i + 4] for x in letters for i in range(0, len(x) - 3, 4))


@pytest.mark.parametrize("block", [8, 1000])
@pytest.mark.parametrize("least", [0.0, 0.05, 0.15])
def test_pairs_are_counted_from_lists(spark, monkeypatch, least, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    draw = random.Random(11)
    sets = [(f"s{i}", draw.sample(range(40), draw.randrange(0, 9)) + [None] * (i % 5 == 0) + [99] * (i % 2)) for i in range(80)]
    size = lambda x: len(set(x))
    common = lambda x, y: len(set(x) & set(y) - {None})
    want = [(i, k, round(common(x, y) / (size(x) + size(y) - common(x, y)), 6)) for i, x in sets for k, y in sets if i < k and common(x, y) and common(x, y) / (size(x) + size(y) - common(x, y)) >= least]
    df = spark.createDataFrame([*sets, (None, [1, 2, 99])], "id string, values array<int>")
    assert sorted((r["id"], r["other"], round(r["jaccard"], 6)) for r in matching.counted_pairs(df, least).collect()) == sorted(want)


def test_counted_pairs_are_no_rows_of_a_join(spark):
    df = spark.createDataFrame([(i, [i % 7, 7 + i % 5, 100 + i]) for i in range(100)], "id long, values array<int>")
    plan = matching.counted_pairs(df, 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and not any("Join" in line and "member" in line for line in plan.splitlines())


def test_letters_of_one_byte_and_of_more_have_the_same_codes():
    import numpy as np
    import pyarrow as pa

    for texts in (["ACDE", "FGHI", "KLMN"], ["ACDE", "FéHI", "KLMN"]):
        for kind in (pa.string(), pa.large_string()):
            for first in (0, 1):
                want = np.array([[ord(c) for c in x] for x in texts[first:]])
                assert (overlap.codes_of(pa.array(texts, kind).slice(first), 4) == want).all()


@pytest.mark.parametrize("block", [8, 1000])
def test_sets_take_turns_where_lists_are_too_many(spark, monkeypatch, block):
    draw = random.Random(12)
    df = spark.createDataFrame([(i, draw.sample(range(30), 6)) for i in range(60)], "id long, values array<int>")
    want = sorted(map(tuple, matching.counted_pairs(df, 0.1).collect()))
    turns = []
    plain = matching.counted_in_turn
    monkeypatch.setattr(matching, "counted_in_turn", lambda *args: turns.append(1) or plain(*args))
    monkeypatch.setattr(matching, "BLOCK", block)
    monkeypatch.setattr(matching, "ROUND", 100)
    got = matching.counted_pairs(df, 0.1)
    assert len(turns) > 1 and sorted(map(tuple, got.collect())) == want


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    def shuffle_files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))

    before, asked = shuffle_files(), spark.conf.get(labels.TIDY)
    found = labels.checkpointed(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    assert shuffle_files() <= before and spark.conf.get(labels.TIDY) == asked and found.count() == 7
