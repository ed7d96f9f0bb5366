"""Signatures from alignments: which columns hold a profile's positions, what the query has there, and where.

All of it is column expressions: positions are looked up in the list of a profile's ungapped columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import valid_alphabet

#: The profile's positions of the signature, of the extended signature and of the C-terminal lysine.
SIGNATURE = [46, 47, 50, 92, 124, 126, 153, 161, 162]
EXTENDED = [12, 15, 16, 40, 45, 46, 47, 48, 49, 50, 51, 54, 92, 93, 124, 125, 126, 127, 128, 151, 152, 153, 154, 155, 156, 157, 158, 159, 160, 161, 162, 163, 164, 165]
LYSINE = [36]
#: The reference domain's positions, and the number of its first residue.
REFERENCE_SIGNATURE = [235, 236, 239, 278, 299, 301, 322, 330, 331]
REFERENCE_EXTENDED = [210, 213, 214, 230, 234, 235, 236, 237, 238, 239, 240, 243, 278, 279, 299, 300, 301, 302, 303, 320, 321, 322, 323, 324, 325, 326, 327, 328, 329, 330, 331, 332, 333, 334]
REFERENCE_START = 66


def residue_columns(aligned: Column, most: int, gaps: str) -> Column:
    """The alignment columns, from 0, of the first residues, up to so many; only what holds them is looked at."""
    head = F.regexp_extract(aligned, rf"^(?:[{gaps}]*[^{gaps}]){{0,{most}}}", 0)
    return F.array_compact(F.transform(F.split(head, ""), lambda x, i: F.when((x != "") & ~x.isin(list(gaps)), i)))


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def picked(ungapped: Column, positions: list[int], offset: Column | int) -> Column:
    """The alignment columns of positions, in order, by the list of the reference's ungapped columns; those that it doesn't reach are left out."""
    places = F.array(*[F.lit(p) for p in sorted(positions)])
    reached = F.slice(ungapped, 1, max(positions) + 1)
    return F.array_compact(once(reached, lambda u: F.transform(places, lambda p: F.get(u, p - offset))))


def columns_at(aligned: Column, positions: list[int], offset: Column | int = 0, gaps: str = "-") -> Column:
    """The alignment columns of a reference's positions, in order; those that the alignment doesn't reach are left out. offset is what positions are counted from."""
    return picked(residue_columns(aligned, max(positions) + 1, gaps), positions, offset)


def fitting(query: Column, profile: Column, least: int, columns: Column) -> Column:
    """The columns; raises for a profile that is longer than the query, or shorter than there are positions."""
    wrong = (F.length(profile) < least) | (F.length(profile) > F.length(query))
    return F.when(wrong, F.raise_error(F.concat(F.lit("profile does not fit: "), F.length(profile).cast("string"))).cast("array<int>")).otherwise(columns)


def profile_columns(query: Column, profile: Column, positions: list[int], offset: Column) -> Column:
    """columns_at for a profile with gaps of two kinds; null unless all positions are reached. Raises where it doesn't fit the query."""
    found = fitting(query, profile, len(positions), residue_columns(profile, max(positions) + 1, "-."))
    return once(picked(found, positions, offset), lambda c: F.when(F.size(c) == len(positions), c))


def letters_at(query: Column, columns: Column) -> Column:
    return F.array_join(F.transform(columns, lambda c: F.substring(query, c + 1, F.lit(1))), "")


def places_at(query: Column, columns: Column, offset: Column | int) -> Column:
    """The query's own position at each column, counted from offset; null at a gap."""
    ahead = lambda c: F.length(F.replace(F.left(query, c), F.lit("-"), F.lit("")))
    return F.transform(columns, lambda c: F.when(F.substring(query, c + 1, F.lit(1)) != "-", ahead(c) + offset))


def profile_signatures(hits: DataFrame) -> DataFrame:
    """hits with signature, signature_positions, extended_signature, extended_positions.

    hits: n_query, n_profile, n_hit_start, n_query_start of the aligned N-terminal hit; c_query, c_profile, c_hit_start of the C-terminal one, null where
    there is none. The signature ends with the residue at the C-terminal lysine's position, K where that is a gap, no residue or missing.
    A signature with another character than the 21 of the alphabet is null, with its positions.
    """
    query, profile, offset = F.col("n_query"), F.col("n_profile"), F.col("n_hit_start")
    ungapped = fitting(query, profile, len(EXTENDED), residue_columns(profile, max(EXTENDED) + 1, "-."))
    whole = lambda c, positions: F.when(F.size(c) == len(positions), c)
    columns = once(ungapped, lambda u: F.struct(picked(u, SIGNATURE, offset).alias("s"), picked(u, EXTENDED, offset).alias("e")))
    lysine = letters_at(F.col("c_query"), profile_columns(F.col("c_query"), F.col("c_profile"), LYSINE, F.col("c_hit_start")))
    last = once(lysine, lambda x: F.when(x.rlike("^[ACDEFGHIKLMNPQRSTVWY]$"), x).otherwise(F.lit("K")))
    read = lambda c, positions: once(whole(c, positions), lambda at: F.struct(letters_at(query, at).alias("letters"), places_at(query, at, F.col("n_query_start")).alias("places")))
    held = lambda x: F.when(valid_alphabet(x["letters"]), x)
    found = once(columns, lambda c: F.struct(once(read(c["s"], SIGNATURE), held).alias("s"), once(read(c["e"], EXTENDED), held).alias("e")))
    taken = hits.withColumns({"found_at": found, "last_at": last})
    signature = F.when(F.col("found_at.s.letters").isNotNull(), F.concat("found_at.s.letters", "last_at"))
    return taken.select(*[F.col(f"`{c}`") for c in hits.columns], signature.alias("signature"), F.col("found_at.s.places").alias("signature_positions"), F.col("found_at.e.letters").alias("extended_signature"), F.col("found_at.e.places").alias("extended_positions"))


def reference_signatures(pairs: DataFrame) -> DataFrame:
    """pairs (aligned, reference, start) with the same four columns, from an alignment to the reference domain: nine letters, no check of the alphabet."""
    query, out = F.col("aligned"), pairs
    for name, places, positions in (("signature", "signature_positions", REFERENCE_SIGNATURE), ("extended_signature", "extended_positions", REFERENCE_EXTENDED)):
        at = columns_at(F.col("reference"), [p - REFERENCE_START for p in positions])
        out = out.withColumns({name: letters_at(query, at), places: places_at(query, at, F.col("start"))})
    return out


def complete(domains: DataFrame) -> DataFrame:
    """Domains with a sequence, both signatures and a number other than 0."""
    some = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return domains.filter(some("sequence") & some("signature") & some("extended_signature") & (F.coalesce("domain_nr", F.lit(0)) != 0))


def slices(domains: DataFrame, proteins: DataFrame) -> DataFrame:
    """domains (protein_id, start, end, ...) with sequence: the protein's (protein_id, protein_sequence) residues from start up to end, counted from 0."""
    return domains.join(proteins.select("protein_id", "protein_sequence"), "protein_id").withColumn("sequence", F.substring("protein_sequence", F.col("start") + 1, F.col("end") - F.col("start"))).drop("protein_sequence")


def scoped(domains: DataFrame, scope: str) -> DataFrame:
    """The domains of a scope: ``all``, ``fungal`` (kingdom) or ``bacterial`` (domain of life)."""
    kept = {"all": F.lit(True), "fungal": F.col("kingdom") == "Fungi", "bacterial": F.col("domain") == "Bacteria"}
    if scope.lower() not in kept:
        raise ValueError(f"no such scope: {scope}")
    return domains.filter(kept[scope.lower()])


#: The taxonomic ranks.
RANKS = ["domain", "kingdom", "phylum", "class", "order", "family", "genus", "species", "strain"]


def rank_column(rank: str) -> Column:
    """The column of a rank, named in any case."""
    if rank.lower() not in RANKS:
        raise ValueError(f"no such rank: {rank}")
    return F.col(f"`{rank.lower()}`")
