"""Large files read by parts, two writers of one catalogue, guarded and timed statements."""

import time

import pytest

from sigloom.operators import population as P
from sigloom.sources import files, sqlsurface


@pytest.fixture
def small_parts(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_split_files_are_numbered_through(spark, tmp_path, small_parts):
    texts = {"a": [f"line {i} " + "x" * (i % 37) for i in range(900)], "b": ["", "one", "", "two"], "c": [str(i) for i in range(1500)]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\r\n".join(lines) + "\r\n")
    read = files.numbered_lines(spark, f"file://{tmp_path}")
    got = {}
    for r in read.collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], {})[r["line"]] = r["text"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == texts
    assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 8


def test_genbank_split_at_record_ends(spark, tmp_path, small_parts):
    cds = lambda n, names: f'     CDS             1..{n}\n{names}                     /translation="M{"K" * (n % 50)}\n                     L"\n     gene            1..2\n'
    records = [f"LOCUS       r{i}\nFEATURES             Location/Qualifiers\n" + cds(i, f'                     /locus_tag="t{i}"\n' if i % 3 else "") + cds(i + 1, "") + "ORIGIN\n" for i in range(200)]
    (tmp_path / "x.gbk").write_text("//\n".join(records) + "//\n")
    want, n = {}, 0
    for i in range(200):
        for k, name in ((i, f"t{i}" if i % 3 else None), (i + 1, None)):
            n += 1
            want[name or f"gene_{n}"] = "M" + "K" * (k % 50) + "L"
    assert {tuple(r) for r in files.read_genbank(spark, f"file://{tmp_path}/x.gbk").collect()} == set(want.items())


def test_wide_embedding_rows_are_whole(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("label\t" + "\t".join(f"f{i}" for i in range(5)) + "\nA\t" + "\t".join(str(i) for i in range(70_000)) + "\nC\t1\t2\n")
    assert files.read_embeddings(spark, f"file://{tmp_path}/e.tsv").collect()[0]["embedding"] == [float(i) for i in range(70_000)] + [1.0, 2.0]


def batch(spark, name):
    proteins = spark.createDataFrame([(name, f"MKLV{name}")], "entry string, sequence string")
    substrates = spark.createDataFrame([(name, "C" * len(name), [len(name)])], "name string, smiles string, fingerprint array<bigint>")
    domains = spark.createDataFrame([(f"{name}.A1", f"MKLV{name}" * 9, "A" * 10, "A" * 34, [name])], "entry string, sequence string, signature string, extended_signature string, labels array<string>")
    return proteins, substrates, domains


def test_the_second_of_two_writers_tries_again(spark, tmp_path):
    folder = f"file://{tmp_path}/cat"
    first = P.save(P.empty(spark), folder)
    old = P.load(spark, folder)
    P.populate(spark, folder, [batch(spark, "one")])
    with pytest.raises(P.Conflict):
        P.save(P.populated(old, *batch(spark, "second")), folder, first)
    assert {r[0] for r in P.load(spark, folder)["proteins"].select("protein_id").collect()} == {"one"}
    P.populate(spark, folder, [batch(spark, "second")])
    assert {r[0] for r in P.load(spark, folder)["proteins"].select("protein_id").collect()} == {"one", "second"}
    assert P.load(spark, folder, first)["proteins"].isEmpty() and P.last_snapshot(spark, folder) == first + 2


def test_a_writer_that_is_overtaken_keeps_both_batches(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/cat"
    P.save(P.empty(spark), folder)
    plain, met = P.populated, []

    def overtaken(*args, **kw):
        if not met:
            met.append(1)
            P.save(plain(P.load(spark, folder), *batch(spark, "other")), folder)
        return plain(*args, **kw)

    monkeypatch.setattr(P, "populated", overtaken)
    P.populate(spark, folder, [batch(spark, "mine")])
    assert {r[0] for r in P.load(spark, folder)["proteins"].select("protein_id").collect()} == {"other", "mine"}


def test_statements_are_parsed(spark):
    spark.range(3).createOrReplaceTempView("three")
    for good in ("SELECT ';' AS x", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", "select id from three where id in (select max(id) from three)"):
        assert sqlsurface.sql_page(spark, good).count() >= 1
    for bad in ("WITH x AS (SELECT 1 AS a) INSERT INTO three SELECT a FROM x", "SELECT 1; DROP TABLE three", "SELECT 1;", "INSERT INTO three SELECT 1", "SELECT (1", "with x as (select 1 as a) delete from three", "EXPLAIN SELECT 1"):
        with pytest.raises(ValueError):
            sqlsurface.sql_page(spark, bad)


def test_a_slow_statement_ends_and_the_session_lives_on(spark):
    slow = sqlsurface.sql_total(spark, "SELECT id FROM range(20000000000000) WHERE hash(id) % 1000003 = 5")
    start = time.time()
    with pytest.raises(TimeoutError):
        sqlsurface.rows_within(slow, 2)
    assert time.time() - start < 30
    assert sqlsurface.rows_within(spark.range(3), 20)[2]["id"] == 2
