"""Changes to the catalogue as new snapshots: matching of incoming entries, corrections, linking, clean-up and export of annotations.

Every function returns a new DataFrame; the caller writes it beside the old one and swaps the two, so that a failed step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.labels import size_class
from sigloom.operators.matching import counted_pairs


def match_entries(incoming: DataFrame, synonyms: DataFrame, sequences: DataFrame) -> DataFrame:
    """entry, matched, how: the known entry of each incoming one (entry, synonyms, sequence).

    By synonym, of which the last known one counts, and of several entries that have it the one with the largest id; else by
    equal sequence, the smallest id; else null and ``new``. synonyms: (id, synonym), sequences: (id, sequence). Null synonyms and sequences match nothing.
    """
    named = synonyms.filter("synonym is not null").groupBy("synonym").agg(F.max("id").alias("by_name"))
    alike = sequences.filter("sequence is not null").groupBy("sequence").agg(F.min("id").alias("by_sequence"))
    every = incoming.select("entry", F.posexplode("synonyms").alias("place", "synonym"))
    hit = every.join(named, "synonym").groupBy("entry").agg(F.max_by("by_name", "place").alias("by_name"))
    found = incoming.select("entry", "sequence").join(hit, "entry", "left").join(alike, "sequence", "left")
    how = F.when(F.col("by_name").isNotNull(), "synonym").when(F.col("by_sequence").isNotNull(), "sequence").otherwise("new")
    return found.select("entry", F.coalesce("by_name", "by_sequence").alias("matched"), how.alias("how"))


def apply_corrections(associations: DataFrame, corrections: DataFrame, known: DataFrame) -> DataFrame:
    """The associations (domain_id, label), those of corrected domains replaced by their corrections.

    Raises if a correction has a label that known (label) lacks; then nothing is to be written.
    """
    unknown = corrections.join(known.select("label"), "label", "left_anti").select("label").first()
    if unknown is not None:
        raise ValueError(f"corrections name an unknown label: {unknown['label']}")
    kept = associations.join(corrections.select("domain_id"), "domain_id", "left_anti")
    return kept.select("domain_id", "label").unionByName(corrections.select("domain_id", "label").distinct())


def within_range(positions: DataFrame, associations: DataFrame) -> DataFrame:
    """positions (protein_id, domain_id, positions) with found: whether an association (protein_id, start, end) of the protein holds them all.

    start counts from 1 and positions from 0; gaps are null and don't count. Without any position nothing is found.
    """
    low, high = F.array_min("positions"), F.array_max("positions")
    held = (F.col("start") - 1 <= F.col("low")) & (F.col("end") >= F.col("high"))
    asked = positions.withColumns({"low": low, "high": high})
    inside = asked.join(associations.select("protein_id", "start", "end"), "protein_id").filter(held).select("protein_id", "domain_id").distinct().withColumn("found", F.lit(True))
    return positions.join(inside, ["protein_id", "domain_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def clean_annotations(annotations: DataFrame, required: list[str]) -> DataFrame:
    """protein, synonym, labels, of annotations (protein, synonym, type, label, ...): what is an update and has all required fields.

    Rows without a type or of type ``no_update`` go, so do proteins of which nothing stays.
    """
    complete = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in required]
    kept = annotations.filter(F.col("type").isNotNull() & (F.col("type") != "no_update"))
    for c in complete:
        kept = kept.filter(c)
    return kept.groupBy("protein", "synonym").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def submissions(entries: DataFrame, fields: list[str]) -> DataFrame:
    """protein, type, body: the entries of each protein and type as one JSON list, in the order of their fields."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*fields))))
    return entries.groupBy("protein", "type").agg(body.alias("body"))


def link_taxonomy(proteins: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """protein_id, taxon: proteins (protein_id, synonyms) by the first synonym that a key of taxonomy (key, taxon) has.

    A key joins names by bars; of several taxa with a name the largest counts. Proteins that match none are left out.
    """
    names = taxonomy.select("taxon", F.explode(F.split("key", r"\|")).alias("synonym")).groupBy("synonym").agg(F.max("taxon").alias("taxon"))
    every = proteins.select("protein_id", F.posexplode("synonyms").alias("place", "synonym"))
    return every.join(names, "synonym").groupBy("protein_id").agg(F.min_by("taxon", "place").alias("taxon"))


def link_occurrences(occurrences: DataFrame, numbers: DataFrame) -> DataFrame:
    """protein_id, domain_id, number, start: the n-th occurrence (protein_id, domain_id, start) gets the n-th smallest distinct number.

    One occurrence needs one number, several as many distinct ones as there are; number is null, and to be reported, where the counts differ.
    """
    per = lambda order: Window.partitionBy("protein_id", "domain_id").orderBy(order)
    every = Window.partitionBy("protein_id", "domain_id")
    placed = occurrences.select("protein_id", "domain_id", "start").withColumns({"nth": F.row_number().over(per("start")), "places": F.count(F.lit(1)).over(every)})
    named = numbers.select("protein_id", "domain_id", "number").distinct().withColumns({"nth": F.row_number().over(per("number")), "names": F.count(F.lit(1)).over(every)})
    both = placed.join(named, ["protein_id", "domain_id", "nth"], "left")
    return both.select("protein_id", "domain_id", F.when(F.col("places") == F.col("names"), F.col("number")).alias("number"), "start")


def located(pairs: DataFrame) -> DataFrame:
    """(protein_id, domain_id, start): the non-overlapping occurrences, from left to right, of a domain's sequence in a protein's, counted from 0.

    pairs: (protein_id, domain_id, sequence, domain), sequences of letters. A domain that is empty or doesn't occur has none.
    """
    some = pairs.filter((F.col("domain") != "") & F.col("sequence").contains(F.col("domain"))).withColumn("row", F.monotonically_increasing_id())
    sizes = F.transform(F.split("sequence", F.concat(F.lit(r"\Q"), "domain", F.lit(r"\E")), -1), lambda p: F.length(p))
    parts = some.select("protein_id", "domain_id", "row", F.length("domain").alias("width"), sizes.alias("sizes")).select("protein_id", "domain_id", "row", "width", F.posexplode("sizes").alias("nth", "size"))
    w = Window.partitionBy("row").orderBy("nth")
    placed = parts.withColumns({"start": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("nth") * F.col("width"), "more": F.lead("nth").over(w).isNotNull()})
    return placed.filter("more").select("protein_id", "domain_id", "start")


def link_domains(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """link_occurrences of the places at which domains occur. Raises if a pair hasn't as many distinct numbers (protein_id, domain_id, number) as places."""
    linked = link_occurrences(located(pairs), numbers)
    odd = linked.filter("number is null").first()
    if odd is not None:
        raise ValueError(f"places and numbers differ for domain {odd['domain_id']} in protein {odd['protein_id']}")
    return linked


def mapped_labels(labels: Column, names: dict[str, str], sep: str = "|") -> Column:
    """Labels in lower case with abbreviations replaced, each of whose meanings may be several labels; distinct ones in order."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    meaning = F.transform(F.split(F.lower(labels), f"[{sep}]"), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.array_join(F.array_distinct(F.flatten(F.transform(meaning, lambda x: F.split(x, f"[{sep}]")))), sep)


def linked_taxa(proteins: DataFrame, taxonomy: DataFrame, known: DataFrame, ranks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(links, new): protein_id with taxon_id of each protein (protein_id, synonyms) that a key of taxonomy (key and the ranks) names, and the taxa to be added.

    A key joins names by bars; a protein's first synonym that has a taxon counts. Taxa are equal if all ranks are, null ones included: such a taxon is the
    known one (taxon_id and the ranks; of several the smallest id), else one new one for all its proteins, whose id is a hash of the ranks.
    """
    of = F.struct(*ranks)
    named = taxonomy.select(of.alias("ranks"), F.explode(F.split("key", r"\|")).alias("synonym")).groupBy("synonym").agg(F.max("ranks").alias("ranks"))
    every = proteins.select("protein_id", F.posexplode("synonyms").alias("place", "synonym"))
    found = every.join(named, "synonym").groupBy("protein_id").agg(F.min_by("ranks", "place").alias("ranks"))
    # Null ranks are equal here: the key is the record as text.
    key = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"})
    old = known.select("taxon_id", of.alias("ranks")).groupBy(key("ranks").alias("key")).agg(F.min("taxon_id").alias("taxon_id"))
    both = found.withColumn("key", key("ranks")).join(old, "key", "left").withColumn("id", F.coalesce(F.col("taxon_id").cast("string"), F.sha2("key", 256)))
    new = both.filter("taxon_id is null").select(F.col("id").alias("taxon_id"), "ranks.*").distinct()
    return both.select("protein_id", F.col("id").alias("taxon_id")), new


def substrate_graph(labels: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph of the labels that domains have: nodes (label, class) by how many domains have each, edges (label, other, distance) with label < other.

    labels: (domain_id, label); fingerprints: (label, values). The distance is one less the share of common members; pairs without a common member are
    left out, theirs is 1.
    """
    counts = labels.select("domain_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    used = fingerprints.join(counts.select("label"), "label", "left_semi").select(F.col("label").alias("id"), "values")
    edges = counted_pairs(used, 0.0).select(F.col("id").alias("label"), "other", (1 - F.col("jaccard")).alias("distance"))
    return counts.select("label", size_class(F.col("n")).alias("class")), edges
