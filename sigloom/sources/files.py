"""Readers and writers: delimited tables, FASTA, GenBank coding sequences, lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.operators.labels import checkpointed


def read_tabular(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited file with a header, all strings; raises for ragged rows when read, and here for a repeated first column."""
    header = spark.read.csv(path, sep=sep, header=True).columns
    schema = ", ".join(f"`{c}` string" for c in header)
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not df.groupBy(header[0]).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated key in {path}")
    return df


def parse_fasta(texts: DataFrame) -> DataFrame:
    """(id, seq) of the FASTA records in each row of text; the last of a repeated header wins, a record without sequence is left out."""
    records = texts.select(F.posexplode(F.split(F.concat(F.lit("\n"), F.col("text")), "\n>")).alias("ord", "record")).filter("ord > 0")
    lines = F.split("record", "\r?\n")
    seq = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), ""), r"\s", "")
    return records.select(F.trim(lines[0]).alias("id"), seq.alias("seq"), "ord").filter("seq <> ''").groupBy("id").agg(F.max_by("seq", "ord").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): records are split by the reader, so one file is read by many tasks' worth of records, in order of place."""
    lines = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^>", "").alias("record"))
    parts = F.split("record", "\r?\n")
    seq = F.regexp_replace(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), ""), r"\s", "")
    return lines.select("ord", F.trim(parts[0]).alias("id"), seq.alias("seq")).filter("seq <> ''").groupBy("id").agg(F.max_by("seq", "ord").alias("seq"))


def genbank_to_fasta(spark: SparkSession, path: str, out: str) -> None:
    """The coding sequences of GenBank files as FASTA, in order of id."""
    write_fasta(read_genbank(spark, path), out)


def write_fasta(df: DataFrame, path: str) -> None:
    """(id, seq) in order of id."""
    df.orderBy("id").select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq")).write.text(path)


def read_list(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    values = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")
    return values.distinct() if unique else values


def write_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.text(path)


def write_tabular(parts: list[DataFrame], key: str, path: str) -> None:
    """The parts joined on the key of the first, in its order; raises where another part lacks a key."""
    out = parts[0]
    for p in parts[1:]:
        if not out.join(p, key, "left_anti").isEmpty():
            raise ValueError(f"a key of {key} is missing")
        out = out.join(p, key)
    out.orderBy(key).write.csv(path, sep="\t", header=True)


def coding_id(protein: object, gene: object, locus: object, ordinal: object):
    """The id of a coding sequence: the first of its names, else its number."""
    return F.coalesce(protein, gene, locus, F.concat(F.lit("gene_"), ordinal))


CDS = re.compile(r"^     CDS  .*?(?=^     \S|^\S|\Z)", re.M | re.S)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of coding sequences with a translation; the last of a repeated id wins.

    Files are split at the ends of their records, so that a large one is read by many tasks; coding sequences are numbered through each file.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, at, record in zip(part["file"], part["at"], part["record"]):
                for n, cds in enumerate(CDS.findall(record), 1):
                    value = lambda key: (m := re.search(rf'/{key}="([^"]*)"', cds)) and re.sub(r"\s", "", m[1])  # noqa: B023, E731
                    rows.append((file, at, n, value("protein_id"), value("gene_id"), value("locus_tag"), value("translation")))
            yield pd.DataFrame(rows, columns=["file", "at", "k", "protein_id", "gene_id", "locus_tag", "seq"])

    records = spark.read.option("lineSep", "\n//").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r", "").alias("record"))
    found = checkpointed(records.mapInPandas(parse, "file string, at long, k int, protein_id string, gene_id string, locus_tag string, seq string"))
    # A record's first number is one more than all that the file has before it.
    sizes = found.groupBy("file", "at").agg(F.max("k").alias("c"))
    first = sizes.select("file", "at", F.coalesce(F.sum("c").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = found.filter("seq is not null").join(first, ["file", "at"]).withColumn("n", F.col("before") + F.col("k"))
    named = named.withColumn("id", coding_id(F.col("protein_id"), F.col("gene_id"), F.col("locus_tag"), F.col("n").cast("string")))
    return named.groupBy("id").agg(F.max_by("seq", F.struct("file", "n")).alias("seq")).select("id", "seq")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Nine ranks per protein; an unknown strain is null."""
    df = read_tabular(spark, path)
    return df.withColumn("strain", F.nullif(F.col("strain"), F.lit("Unknown")))


def cell(table: DataFrame, key: str, column: str) -> str | None:
    """One cell of a table read by read_tabular: the row whose first column is the key; raises for an unknown key or column."""
    if column not in table.columns:
        raise KeyError(f"no column {column}")
    found = table.filter(F.col(table.columns[0]) == key).select(F.col(column).alias("value")).first()
    if found is None:
        raise KeyError(f"no row {key}")
    return found["value"]


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(domain_id, sequence, labels) of a table whose specificity joins labels by bars; their order is kept."""
    return read_tabular(spark, path).select("domain_id", "sequence", F.split("specificity", r"\|").alias("labels"))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, smiles) below a header; blank lines are left out, of a repeated name the last row counts."""
    rows = numbered_lines(spark, path).filter("line > 0 and trim(text) <> ''").select("line", F.split("text", "\t").alias("p"))
    return rows.select(F.trim(F.get("p", 0)).alias("name"), F.trim(F.get("p", 1)).alias("smiles"), "line").groupBy("name").agg(F.max_by("smiles", "line").alias("smiles"))


def read_raw_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, ranks): the first of the tab-separated values of each line, and the list of the others."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter("trim(value) <> ''").select(parts[0].alias("id"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("ranks"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) with lines counted from 0 in each file.

    Large files are read in blocks by many tasks: the lines of each block are counted, the counts before a block are its first number. Blocks of
    a file are in the order of their offsets.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("text"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("file", "block", "first", before.alias("before"))  # a row for each block, not for each line
    return lines.join(placed, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line"), "text")


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(id, pcs) of a table of ids and numbers whose header gives how many there are; raises for a row of another width."""
    width = len(spark.read.text(path).first()["value"].split("\t")) - 1
    rows = numbered_lines(spark, path).filter("line > 0 and trim(text) <> ''").select(F.split("text", "\t").alias("p"))
    checked = F.when(F.size("p") == width + 1, F.transform(F.slice("p", 2, width), lambda x: x.cast("double"))).otherwise(F.raise_error(F.concat(F.lit("another width: "), F.get("p", 0))).cast("array<double>"))
    return rows.select(F.get("p", 0).alias("id"), checked.alias("pcs"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(file, embedding): all rows of each file in a row, without header and first column."""
    rows = numbered_lines(spark, path).filter("line > 0 and trim(text) <> ''").select("file", "line", F.transform(F.slice(F.split("text", "\t"), 2, F.greatest(F.size(F.split("text", "\t")) - 1, F.lit(0))), lambda x: x.cast("double")).alias("v"))
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "v"))).alias("rows")).select("file", F.flatten(F.transform("rows", lambda r: r["v"])).alias("embedding"))


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(label, path) of a folder's files with this extension; the label is the name without it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder).select("path")
    return found.select(F.regexp_extract("path", rf"([^/]*)\.{re.escape(extension)}$", 1).alias("label"), "path")


def read_positions(spark: SparkSession, path: str, start: int) -> list[int]:
    """The numbers of one tab-separated line, counted from start."""
    return [int(x) - start for x in spark.read.text(path, wholetext=True).first()["value"].split()]


def read_properties(spark: SparkSession, path: str, width: int = 15) -> dict[str, list[float]]:
    """Residue to its properties: a table with a row a residue, so of two dozen rows; raises for a row of another width."""
    table = read_tabular(spark, path)
    if len(table.columns) != width + 1:
        raise ValueError(f"{len(table.columns) - 1} properties, not {width}")
    return {r[0]: [float(x) for x in r[1:]] for r in table.collect()}
