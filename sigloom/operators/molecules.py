"""Molecules as tables: atoms and bonds of structure strings, and circular fingerprints refined by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.structures import read_structure

#: Bonds that a neighbourhood reaches.
RADIUS = 2
READ = "id {id}, atoms array<struct<symbol:string,aromatic:boolean,charge:int,isotope:int,hydrogens:int>>, bonds array<struct<a:int,b:int,bond:string>>, near array<array<struct<b:int,bond:string>>>, fault string"


def read_structures(molecules: DataFrame, structure: str = "smiles") -> DataFrame:
    """(id, atoms, bonds, near, fault) of molecules (id, structure): near lists each atom's bonds; fault says why an ill-formed one, or none, has no atoms."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["structure"]):
                try:
                    atoms, bonds = read_structure((text or "").strip())
                    near = [[] for _ in atoms]
                    for a, b, s in bonds:
                        near[a].append({"b": b, "bond": s})
                        near[b].append({"b": a, "bond": s})
                    rows.append((i, atoms, [{"a": a, "b": b, "bond": s} for a, b, s in bonds], near, None))
                except ValueError as e:
                    rows.append((i, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "atoms", "bonds", "near", "fault"])

    # Reading takes long for its bytes, and a small file is one task's: rows are dealt out first.
    spread = molecules.select("id", F.col(structure).alias("structure")).repartition(int(molecules.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(read, READ.format(id=molecules.schema["id"].dataType.simpleString()))


def atom_table(read: DataFrame) -> DataFrame:
    """(id, atom, symbol, aromatic, charge, isotope, hydrogens, neighbours) of read structures, atoms counted from 0."""
    bound = F.size(F.filter("bonds", lambda b: (b["a"] == F.col("atom")) | (b["b"] == F.col("atom"))))
    return read.filter("fault is null").select("id", "bonds", F.posexplode("atoms").alias("atom", "x")).select("id", "atom", "x.*", bound.alias("neighbours"))


def bond_table(read: DataFrame) -> DataFrame:
    """(id, a, b, bond) of read structures, each bond from both of its atoms."""
    one = read.filter("fault is null").select("id", F.explode("bonds").alias("x")).select("id", "x.a", "x.b", "x.bond")
    return one.union(one.select("id", F.col("b").alias("a"), F.col("a").alias("b"), "bond"))


def fingerprints(read: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, n_atoms, fingerprint): the hashes of all neighbourhoods of up to radius bonds, in order, each once; whichever atom the string starts from. Ill-formed ones have none.

    An atom's hash is that of its own properties; in every round it becomes that of itself with its neighbours' hashes and bonds, in order. A molecule's
    atoms stay in its row, so that nothing is shuffled, joined or sent to all tasks.
    """
    own = lambda x, i: F.xxhash64(*[x[c] for c in ("symbol", "aromatic", "charge", "isotope", "hydrogens")], F.size(F.get("near", i)))
    now = read.filter("fault is null").select("id", "near", F.size("atoms").alias("n_atoms"), F.transform("atoms", own).alias("hash0"))
    for r in range(1, radius + 1):
        before = f"hash{r - 1}"
        around = lambda i: F.array_sort(F.transform(F.get("near", i), lambda n: F.struct(n["bond"].alias("bond"), F.get(before, n["b"]).alias("other"))))  # noqa: B023, E731
        now = now.withColumn(f"hash{r}", F.transform(before, lambda h, i: F.xxhash64(F.lit(r), h, around(i))))  # noqa: B023
    return now.select("id", "n_atoms", F.array_sort(F.array_distinct(F.concat(*[f"hash{r}" for r in range(radius + 1)]))).alias("fingerprint"))


def same_molecules(read: DataFrame) -> DataFrame:
    """(id, other) with id < other: structures with equal fingerprints, however they are written."""
    keyed = fingerprints(read)
    return keyed.join(keyed.select(F.col("id").alias("other"), "fingerprint"), "fingerprint").filter(F.col("id") < F.col("other")).select("id", "other")
