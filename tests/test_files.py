import pytest
from pyspark.sql import functions as F

from sigloom.functions import scalars as S
from sigloom.operators import hits as H
from sigloom.operators import matching as M
from sigloom.sources import files, sqlsurface


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta_files_are_read_and_written(spark, tmp_path):
    path = put(tmp_path, "in.fasta", ">a one\nAC\nDE\n>b\nFF\n>c\n>a one\nGG\n")
    found = files.read_fasta(spark, path)
    assert rows(found) == [("a one", "GG"), ("b", "FF")]
    files.write_fasta(found, f"file://{tmp_path}/out")
    assert rows(files.read_fasta(spark, f"file://{tmp_path}/out")) == rows(found)


def test_tables_reject_ragged_rows_and_repeated_keys(spark, tmp_path):
    table = files.read_tabular(spark, put(tmp_path, "t.tsv", "id\tx\na\t1\nb\t2\n"))
    assert files.cell(table, "b", "x") == "2"
    with pytest.raises(KeyError):
        files.cell(table, "c", "x")
    with pytest.raises(KeyError):
        files.cell(table, "a", "y")
    with pytest.raises(ValueError):
        files.read_tabular(spark, put(tmp_path, "d.tsv", "id\tx\na\t1\na\t2\n"))
    with pytest.raises(Exception):
        files.read_tabular(spark, put(tmp_path, "r.tsv", "id\tx\na\t1\t2\n")).collect()


def test_tables_are_joined_by_key_when_written(spark, tmp_path):
    a = spark.createDataFrame([("k", "1"), ("l", "2")], "id string, x string")
    b = spark.createDataFrame([("k", "3")], "id string, y string")
    with pytest.raises(ValueError):
        files.write_tabular([a, b], "id", f"file://{tmp_path}/o")
    files.write_tabular([b, a], "id", f"file://{tmp_path}/o")
    assert rows(files.read_tabular(spark, f"file://{tmp_path}/o")) == [("k", "3", "1")]


def test_lists(spark, tmp_path):
    path = put(tmp_path, "l.txt", "b\n\n a \nb\n")
    assert [r[0] for r in files.read_list(spark, path).collect()] == ["b", "a", "b"]
    assert rows(files.read_list(spark, path, unique=True)) == [("a",), ("b",)]
    files.write_list(files.read_list(spark, path), "value", f"file://{tmp_path}/o")
    assert [r[0] for r in files.read_list(spark, f"file://{tmp_path}/o").collect()] == ["a", "b", "b"]


GENBANK = '''LOCUS       X
FEATURES             Location/Qualifiers
     source          1..9
     CDS             1..6
                     /locus_tag="L1"
                     /translation="MK
                     LV"
     CDS             7..9
                     /translation="MM"
     CDS             10..12
                     /protein_id="P1"
ORIGIN
//
'''


def test_coding_sequences(spark, tmp_path):
    path = put(tmp_path, "x.gb", GENBANK)
    assert rows(files.read_genbank(spark, path)) == [("L1", "MKLV"), ("gene_2", "MM")]
    files.genbank_to_fasta(spark, path, f"file://{tmp_path}/fa")
    assert rows(files.read_fasta(spark, f"file://{tmp_path}/fa")) == [("L1", "MKLV"), ("gene_2", "MM")]


def test_small_readers(spark, tmp_path):
    data = files.read_dataset(spark, put(tmp_path, "d.tsv", "domain_id\tsequence\tspecificity\nd1\tAC\tx|y\n"))
    assert [tuple(r) for r in data.collect()] == [("d1", "AC", ["x", "y"])]
    assert rows(files.read_smiles(spark, put(tmp_path, "s.tsv", "substrate\tsmiles\na\tC\n\na\tCC\nb\tN\n"))) == [("a", "CC"), ("b", "N")]
    assert [tuple(r) for r in files.read_raw_taxonomy(spark, put(tmp_path, "x.tsv", "p\tBacteria\tX\n\nq\tFungi\n")).orderBy("id").collect()] == [("p", ["Bacteria", "X"]), ("q", ["Fungi"])]
    pcs = put(tmp_path, "pcs.tsv", "id\tpc1\tpc2\na\t1.5\t2\n")
    assert [tuple(r) for r in files.read_components(spark, pcs).collect()] == [("a", [1.5, 2.0])]
    with pytest.raises(Exception):
        files.read_components(spark, put(tmp_path, "bad.tsv", "id\tpc1\tpc2\na\t1.5\n")).collect()
    esm = put(tmp_path, "e.tsv", "p\ta\tb\n1\t1\t2\n2\t3\t4\n")
    assert files.read_embeddings(spark, esm).select("embedding").collect()[0][0] == [1.0, 2.0, 3.0, 4.0]
    assert [r["label"] for r in files.list_files(spark, f"file://{tmp_path}", "gb").collect()] == []
    assert {r["label"] for r in files.list_files(spark, f"file://{tmp_path}", "tsv").collect()} >= {"d", "s", "e"}
    assert files.read_positions(spark, put(tmp_path, "p.txt", "70\t80\t90\n"), 66) == [4, 14, 24]
    assert files.read_properties(spark, put(tmp_path, "aa.tsv", "AA\tp\tq\nA\t1\t2\n-\t0\t0\n"), width=2) == {"A": [1.0, 2.0], "-": [0.0, 0.0]}
    with pytest.raises(ValueError):
        files.read_properties(spark, f"file://{tmp_path}/aa.tsv")
    tax = "id\t" + "\t".join(["domain", "kingdom", "phylum", "class", "order", "family", "genus", "species", "strain"]) + "\np\t" + "\t".join("abcdefgh") + "\tUnknown\n"
    assert files.read_taxonomy(spark, put(tmp_path, "tax.tsv", tax)).collect()[0]["strain"] is None


def test_features_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).collect()[0]["c"]
    assert one(S.features(F.lit("A-A"), {"-": [0.0], "A": [1.0]})) == [1.0, 0.0, 1.0]
    with pytest.raises(Exception):
        one(S.features(F.lit("AZ"), {"A": [1.0]}))
    assert one(S.residues(F.lit("1a.b B-jx"), 4)) == "AAAC"
    assert one(S.domain_number(F.lit("p.q.A12"))) == 12
    with pytest.raises(Exception):
        one(S.domain_number(F.lit("p.q.B12")))
    assert one(S.valid_alphabet(F.lit("AC-Y"))) and not one(S.valid_alphabet(F.lit("ACZ")))
    assert one(S.header(F.lit("p"), F.lit(1), F.lit(2), F.lit(3))) == "p|domain_1|2-3"


def test_statements_other_than_one_query_are_refused(spark):
    for sql in ("DELETE FROM x", "SELECT 1; SELECT 2", "  insert into x values (1)"):
        with pytest.raises(ValueError):
            sqlsurface.sql_page(spark, sql)
    lines = sqlsurface.export_lines(spark.createDataFrame([('a,"b"', "c")], "x string, y string"))
    assert [r[0] for r in lines.collect()] == ['"a,""b""",c']


def test_equivalent_sequences_by_brute_force(spark):
    import random

    draw = random.Random(3)
    seqs = ["".join(draw.choice("AC") for _ in range(draw.randint(1, 9))) for _ in range(60)] + ["".join(draw.choice("ACDE") for _ in range(34)) for _ in range(20)]
    seqs += [s[5:] + "ACDE" for s in seqs[-10:]]
    seqs = sorted(set(seqs))

    def alike(a, b):
        m = min(len(a), len(b))
        return a in b or b in a or any(a[-k:] == b[:k] or b[-k:] == a[:k] for k in range(max(1, int(m * 0.8)), m + 1))

    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    want = {(i, k) for i, a in enumerate(seqs) for k, b in enumerate(seqs) if alike(a, b)}
    assert {tuple(r) for r in M.equivalent_pairs(df, df).collect()} == want


def test_set_pairs_by_brute_force(spark):
    import random

    draw = random.Random(4)
    sets = [sorted(draw.sample(range(40), draw.randint(1, 12))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, values array<int>")
    for least in (0.1, 0.3, 0.5, 1.0):
        want = {(i, k) for i, a in enumerate(sets) for k, b in enumerate(sets) if i < k and len({*a} & {*b}) >= least * len({*a} | {*b})}
        assert {(r["id"], r["other"]) for r in M.jaccard_pairs(df, least).collect()} == want


def test_interval_pairs_by_brute_force(spark):
    import random

    draw = random.Random(5)
    make = lambda: sorted({("s", x := draw.randint(0, 6000), x + draw.randint(0, 3000)) for _ in range(60)})
    a, b = make(), make()
    laps = lambda x, y: (y[1] <= x[1] <= y[2] and y[2] - x[1] >= 50) or (x[1] <= y[1] <= x[2] and x[2] - y[1] >= 50)
    left, right = (spark.createDataFrame(r, "seq_id string, start long, end long") for r in (a, b))
    assert {tuple(r) for r in H.interval_overlap(left, right).collect()} == {(*x, y[1], y[2]) for x in a for y in b if laps(x, y)}
    assert {tuple(r) for r in H.interval_anti(left, right).collect()} == {x for x in a if not any(laps(x, y) for y in b)}
