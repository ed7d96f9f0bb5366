"""A catalogue as snapshots: entries of incoming files are checked against the old snapshot, and a new one is written beside it and swapped in.

Nothing is changed in place: a step that raises leaves the old snapshot, and a reader follows one small pointer table.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import scalars as S
from sigloom.operators import etl
from sigloom.operators.labels import checkpointed
from sigloom.operators.matching import equivalent_pairs
from sigloom.operators.numbering import numbered

#: The tables of a catalogue and their columns.
SCHEMA = {
    "proteins": "protein_id string, sequence string",
    "protein_synonyms": "protein_id string, synonym string",
    "substrates": "name string, smiles string, fingerprint array<bigint>",
    "domains": "domain_id string, sequence string, signature string, extended_signature string",
    "domain_synonyms": "domain_id string, synonym string",
    "domain_substrates": "domain_id string, name string, ordinal int",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of a catalogue without entries."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMA.items()}


def refuse(rows: DataFrame, what: str, *columns: str) -> None:
    """Raises if rows has any, naming the first."""
    odd = rows.select(*columns).first()
    if odd is not None:
        raise ValueError(f"{what}: {' '.join(map(str, odd))}")


def exists(names: DataFrame, column: str, value: str) -> bool:
    """Whether a name is in the catalogue."""
    return not names.filter(F.col(column) == value).limit(1).isEmpty()


def new_proteins(incoming: DataFrame, proteins: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proteins, synonyms) to be added for incoming (entry, sequence); an entry joins the protein's names by bars.

    An entry is a known protein by any of its names, of which the last known counts, else by equal sequence; then its unknown names are added. Raises
    if a known protein has another sequence. Others are new, under the entry as id; equal sequences within one batch stay apart.
    """
    named = incoming.select("entry", F.split("entry", r"\|").alias("synonyms"), "sequence")
    known = synonyms.select(F.col("protein_id").alias("id"), "synonym")
    found = etl.match_entries(named, known, proteins.select(F.col("protein_id").alias("id"), "sequence"))
    both = named.join(found, "entry")
    old = both.filter("matched is not null").join(proteins.select(F.col("protein_id").alias("matched"), F.col("sequence").alias("known_sequence")), "matched")
    refuse(old.filter("sequence <> known_sequence"), "another sequence for protein", "entry")
    added = old.select(F.col("matched").alias("protein_id"), F.explode("synonyms").alias("synonym")).join(synonyms, ["protein_id", "synonym"], "left_anti")
    new = both.filter("matched is null")
    return new.select(F.col("entry").alias("protein_id"), "sequence"), added.unionByName(new.select(F.col("entry").alias("protein_id"), F.explode("synonyms").alias("synonym"))).distinct()


def new_substrates(incoming: DataFrame, substrates: DataFrame) -> DataFrame:
    """The incoming substrates (name, smiles, fingerprint) to be added. Raises if a known name is another molecule, or a new name a known molecule."""
    key = S.same_set(F.col("fingerprint"))
    old = substrates.select(F.col("name").alias("old_name"), key.alias("old_key"))
    mine = incoming.withColumn("key", key)
    refuse(mine.join(old, F.col("name") == F.col("old_name")).filter("key <> old_key"), "another molecule under the name", "name")
    new = mine.join(old.select("old_name"), F.col("name") == F.col("old_name"), "left_anti")
    refuse(new.join(old, F.col("key") == F.col("old_key")), "a known molecule under another name", "name", "old_name")
    return new.select("name", "smiles", "fingerprint").dropDuplicates(["name"])


def new_domains(incoming: DataFrame, tables: dict[str, DataFrame], on_equivalent: str = "error") -> dict[str, DataFrame]:
    """domains, domain_synonyms and domain_substrates to be added for incoming (entry, sequence, signature, extended_signature, labels).

    An entry is a known domain by name, else by equal sequence, else, where on_equivalent is ``merge``, by an equivalent one; ``new`` makes it an entry of its own,
    ``error`` raises. Raises if a signature is missing, a known domain differs in its sequence, signatures or set of labels, or a label is unknown.
    """
    refuse(incoming.filter("signature is null or extended_signature is null"), "no signature for domain", "entry")
    labels = incoming.select("entry", F.posexplode("labels").alias("ordinal", "name"))
    refuse(labels.join(tables["substrates"], "name", "left_anti"), "no such substrate", "name", "entry")
    domains, synonyms = tables["domains"], tables["domain_synonyms"]
    named = incoming.withColumn("synonyms", F.split("entry", r"\|"))
    found = etl.match_entries(named.select("entry", "synonyms", "sequence"), synonyms.select(F.col("domain_id").alias("id"), "synonym"), domains.select(F.col("domain_id").alias("id"), "sequence"))
    if on_equivalent != "new":  # nothing else asks which sequences are equivalent
        open_ = found.filter("matched is null").select("entry").join(incoming.select("entry", "sequence"), "entry")
        alike = equivalent_pairs(open_.select(F.col("entry").alias("id"), F.col("sequence").alias("seq")), domains.select(F.col("domain_id").alias("id"), F.col("sequence").alias("seq")))
        if on_equivalent == "error":
            refuse(alike, "equivalent sequences", "id", "other")
        if on_equivalent == "merge":
            merged = alike.groupBy(F.col("id").alias("entry")).agg(F.max("other").alias("other"))
            found = found.join(merged, "entry", "left").withColumn("matched", F.coalesce("matched", "other")).drop("other")
    both = named.join(found.select("entry", "matched"), "entry")
    old = both.filter("matched is not null").join(domains.select(*[F.col(c).alias(f"old_{c}") for c in domains.columns]), F.col("matched") == F.col("old_domain_id"))
    refuse(old.filter(~S.equivalent(F.col("sequence"), F.col("old_sequence"))), "another sequence for domain", "entry")
    refuse(old.filter("signature <> old_signature or extended_signature <> old_extended_signature"), "another signature for domain", "entry")
    sets = tables["domain_substrates"].groupBy(F.col("domain_id").alias("matched")).agg(F.array_sort(F.collect_set("name")).alias("old_labels"))
    refuse(old.join(sets, "matched").filter(S.same_set(F.col("labels")) != F.col("old_labels")), "other substrates for domain", "entry")
    added = old.select(F.col("matched").alias("domain_id"), F.explode("synonyms").alias("synonym")).join(synonyms, ["domain_id", "synonym"], "left_anti")
    new = both.filter("matched is null").withColumnRenamed("entry", "domain_id")
    return {
        "domains": new.select("domain_id", "sequence", "signature", "extended_signature"),
        "domain_synonyms": added.unionByName(new.select("domain_id", F.explode("synonyms").alias("synonym"))).distinct(),
        "domain_substrates": new.select("domain_id", F.posexplode("labels").alias("ordinal", "name")).select("domain_id", "name", "ordinal"),
    }


def populated(tables: dict[str, DataFrame], proteins: DataFrame, substrates: DataFrame, domains: DataFrame, on_equivalent: str = "error") -> dict[str, DataFrame]:
    """The catalogue with all incoming entries; raises, and changes nothing, where one of them doesn't fit."""
    out = dict(tables)
    own, names = new_proteins(proteins, tables["proteins"], tables["protein_synonyms"])
    out["proteins"], out["protein_synonyms"] = out["proteins"].unionByName(own), out["protein_synonyms"].unionByName(names)
    out["substrates"] = out["substrates"].unionByName(new_substrates(substrates, tables["substrates"]))
    for name, rows in new_domains(domains, tables | {"substrates": out["substrates"]}, on_equivalent).items():
        out[name] = out[name].unionByName(rows)
    return out


class Conflict(Exception):
    """Another writer has put in a snapshot since this one's was read."""


def _pointers(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointers")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def last_snapshot(spark: SparkSession, folder: str) -> int:
    """The number of the last snapshot; 0 where there is none."""
    path, store = _pointers(spark, folder)
    return max((int(x.getPath().getName()) for x in store.listStatus(path)), default=0) if store.exists(path) else 0


def save(tables: dict[str, DataFrame], folder: str, after: int | None = None) -> int:
    """Write the tables as a new snapshot of the folder, then point to it; returns its number. Readers of the old one are not disturbed.

    after: the snapshot that the tables were made from (none: the last one). The pointer to a snapshot is a file under its number that is made only
    if there is none yet, so of two writers that read the same snapshot the second gets a Conflict, and nothing of the first is lost.
    """
    spark, name = next(iter(tables.values())).sparkSession, f"snapshot-{uuid.uuid4().hex}"
    number = (last_snapshot(spark, folder) if after is None else after) + 1
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}/{table}")
    path, store = _pointers(spark, folder)
    store.mkdirs(path)
    try:
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}"), False)
    except Py4JJavaError as e:
        if store.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}")):
            raise Conflict(f"snapshot {number} is there already") from e
        raise
    out.write(bytearray(name.encode()))
    out.close()
    return number


def load(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot (none: the last one)."""
    number = last_snapshot(spark, folder) if number is None else number
    name = spark.read.text(f"{folder}/pointers/{number:012d}", wholetext=True).first()[0]
    return {table: spark.read.schema(schema).parquet(f"{folder}/{name}/{table}") for table, schema in SCHEMA.items()}


def populate(spark: SparkSession, folder: str, batches: list[tuple[DataFrame, DataFrame, DataFrame]], on_equivalent: str = "error", tries: int = 5) -> int:
    """Add one batch (proteins, substrates, domains) after another, each to a snapshot of its own; one that raises leaves those before it.

    A batch that meets another writer's snapshot is checked and added anew, against that one.
    """
    number = last_snapshot(spark, folder)
    for batch in batches:
        for left in reversed(range(tries)):
            number = last_snapshot(spark, folder)
            try:
                number = save(populated(load(spark, folder, number), *batch, on_equivalent=on_equivalent), folder, number)
                break
            except Conflict:
                if not left:
                    raise
    return number


# --- exports -------------------------------------------------------------------------------------------------------

def joined_names(synonyms: DataFrame, key: str) -> DataFrame:
    """(key, name): all names joined by bars, in order."""
    return synonyms.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("synonym")), "|").alias("name"))


def domain_labels(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, labels): each domain's joined names and its substrates in their order, joined by bars."""
    labels = tables["domain_substrates"].groupBy("domain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), "|").alias("labels"))
    return joined_names(tables["domain_synonyms"], "domain_id").join(labels, "domain_id").select("name", "labels")


def flat_files(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a catalogue's six files hold: FASTA records as (id, seq), tables with their columns; of substrates those that a domain has."""
    named = tables["domains"].join(joined_names(tables["domain_synonyms"], "domain_id"), "domain_id")
    record = lambda rows, column: rows.select(F.col("name").alias("id"), F.col(column).alias("seq"))
    dataset = named.join(domain_labels(tables), "name").select(F.col("name").alias("domain_id"), "sequence", F.col("labels").alias("specificity"))
    used = tables["substrates"].join(tables["domain_substrates"], "name", "left_semi").select(F.col("name").alias("substrate"), "smiles")
    proteins = tables["proteins"].join(joined_names(tables["protein_synonyms"], "protein_id"), "protein_id")
    return {"domains": record(named, "sequence"), "signatures": record(named, "signature"), "extended_signatures": record(named, "extended_signature"), "proteins": record(proteins, "sequence"), "dataset": dataset, "smiles": used}


def listed_domains(tables: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """(id, seq) of the domains listed (name), each looked up by the first of its joined names."""
    first = names.select(F.split("name", r"\|")[0].alias("synonym")).distinct()
    ids = tables["domain_synonyms"].join(first, "synonym").select("domain_id").distinct()
    return tables["domains"].join(ids, "domain_id").join(joined_names(tables["domain_synonyms"], "domain_id"), "domain_id").select(F.col("name").alias("id"), F.col("sequence").alias("seq"))


#: What a submitted issue holds.
ISSUE = "protein_name string, protein_sequence string, domains array<struct<name: string, sequence: string, signature: string, extended_signature: string, substrates: array<string>>>, new_substrates array<struct<name: string, smiles: string>>"


def issue_files(issues: DataFrame) -> dict[str, DataFrame]:
    """What each issue's files hold, of issues (number, body): proteins, domains, signatures, extended_signatures as (number, id, seq), dataset, smiles.

    The body is JSON or has a fenced block of it. Raises for an issue without.
    """
    # Written once: each table, and the look for issues without an entry, would parse every body again for each field that it names.
    read = checkpointed(issues.select("number", F.from_json(S.fenced_json(F.col("body")), ISSUE).alias("b")))
    refuse(read.filter("b is null or b.protein_name is null"), "no entry in issue", "number")
    each = read.select("number", F.explode("b.domains").alias("d"))
    record = lambda column: each.select("number", F.col("d.name").alias("id"), F.col(f"d.{column}").alias("seq"))
    return {
        "proteins": read.select("number", F.col("b.protein_name").alias("id"), F.col("b.protein_sequence").alias("seq")),
        "domains": record("sequence"), "signatures": record("signature"), "extended_signatures": record("extended_signature"),
        "dataset": each.select("number", F.col("d.name").alias("domain_id"), F.col("d.sequence").alias("sequence"), F.array_join("d.substrates", "|").alias("specificity")),
        "smiles": read.select("number", F.explode("b.new_substrates").alias("s")).select("number", F.col("s.name").alias("substrate"), F.col("s.smiles").alias("smiles")),
    }


def write_files(files: dict[str, DataFrame], folder: str, by: list[str] | None = None) -> None:
    """Each table as a folder of text: FASTA for (id, seq), else tab-separated with a header; with by, a folder for each of its values."""
    for name, rows in files.items():
        keys = [c for c in by or [] if c in rows.columns]
        if {"id", "seq"} <= set(rows.columns):
            text = rows.orderBy("id").select(*keys, F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))
            (text.write.partitionBy(*keys) if keys else text.write).text(f"{folder}/{name}")
        else:
            (rows.write.partitionBy(*keys) if keys else rows.orderBy(rows.columns[0]).write).csv(f"{folder}/{name}", sep="\t", header=True)


# --- names ---------------------------------------------------------------------------------------------------------

def surrogates(rows: DataFrame, key: str) -> DataFrame:
    """rows with number: 1 to n in the order of the key's hash, for tools that need short names; the table itself maps them back."""
    return numbered(rows.withColumn("_all", F.lit(0)), ["_all"], F.col(key), "number", "_n").drop("_all", "_n")


def cleaned_names(proteins: DataFrame, domains: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(proteins, domains) with a character of protein ids replaced, in domains' names (id: ``{protein}.A{n}``) too; raises for another form of those."""
    swap = lambda c: F.translate(c, old, new)
    named = domains.withColumn("id", F.concat(swap(S.protein_of(F.col("id"))), F.lit(".A"), S.domain_number(F.col("id")).cast("string")))
    return proteins.withColumn("id", swap(F.col("id"))), named


#: The kinds of an entry and the titles that they have.
ENTRY_TYPES = {"new_entry": "New domain entries", "correction": "Domain corrections", "duplicate_entry": "Domain sequence revision"}


def entry_title(kind):
    """The title of a kind of entry; raises for an unknown one."""
    titles = F.create_map(*[F.lit(x) for pair in ENTRY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, kind), F.raise_error(F.concat(F.lit("no such kind: "), kind)).cast("string"))
