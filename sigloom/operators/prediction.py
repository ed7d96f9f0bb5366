"""Prediction from end to end: domains to features, forests, ranked labels with their structures, annotation and output."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import scalars as S
from sigloom.operators.labels import checkpointed, first_valid_counts, label_counts, select_labels
from sigloom.operators import hits as H
from sigloom.operators import metrics as E
from sigloom.operators import molecules as M
from sigloom.operators import signatures as G
from sigloom.operators.overlap import equivalent_pairs
from sigloom.plans import models


def featured(domains: DataFrame, properties: dict[str, list[float]], signature: str = "extended_signature") -> DataFrame:
    """domains with features: the properties of their signature's residues in a row. Raises for an unknown residue."""
    return domains.withColumn("features", S.features(F.col(signature), properties))


def with_structures(scores: DataFrame, structures: DataFrame) -> DataFrame:
    """scores (id, label, p) with smiles from structures (label, smiles). Raises for a label without one."""
    missing = F.raise_error(F.concat(F.lit("no structure for "), F.col("label"))).cast("string")
    return scores.join(structures.select("label", "smiles"), "label", "left").withColumn("smiles", F.coalesce("smiles", missing))


def candidates(names: DataFrame, fingerprints: DataFrame, custom: DataFrame | None = None, only_custom: bool = False) -> DataFrame:
    """(ord, label, smiles, bits) of the labels asked for, in their order; custom ones follow.

    names: (ord, label); fingerprints and custom: (label, smiles, bits). A name without a fingerprint is left out.
    """
    built_in = names.join(fingerprints, "label").select("ord", "label", "smiles", "bits")
    if custom is None:
        return built_in.limit(0) if only_custom else built_in
    own = custom.select((F.row_number().over(Window.orderBy("label")) + F.lit(1 << 40)).alias("ord"), "label", "smiles", "bits")
    return own if only_custom else built_in.unionByName(own)


def paired(domains: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, smiles, features) of every domain (id, features) with every candidate label (label, smiles, bits): the residues' properties, then the bits.

    The candidates are a list that a user gives, or the few hundred known ones; domains are never gathered.
    """
    every = domains.select("id", F.col("features").alias("own")).crossJoin(F.broadcast(labels.select("label", "smiles", "bits")))
    return every.select("id", "label", "smiles", F.concat("own", F.transform("bits", lambda b: b.cast("double"))).alias("features"))


def predict_labels(domains: DataFrame, model: PipelineModel, structures: DataFrame, properties: dict[str, list[float]]) -> DataFrame:
    """(id, label, smiles, p): each label's probability for each domain (id, extended_signature). Raises if there is no domain."""
    if domains.isEmpty():
        raise ValueError("no domains")
    return with_structures(models.predict(model, featured(domains, properties)), structures).select("id", "label", "smiles", "p")


def predict_pairs(domains: DataFrame, model: PipelineModel, labels: DataFrame, properties: dict[str, list[float]]) -> DataFrame:
    """(id, label, smiles, p): the probability that domain and candidate label interact, under a forest over pairs whose classes are 0 and 1."""
    if domains.isEmpty():
        raise ValueError("no domains")
    pairs = paired(featured(domains, properties), labels).withColumn("pair", F.struct("id", "label", "smiles"))
    scored = models.predict(model, pairs, id_="pair").filter(F.col("label") == "1")
    return scored.select("pair.id", "pair.label", "pair.smiles", "p")


def domains_from_hits(hits: DataFrame, sequences: DataFrame, alignments: DataFrame) -> DataFrame:
    """(id, seq_id, domain_nr, start, end, sequence, signature, extended_signature): what hits and their alignments say of sequences' domains.

    hits: (seq_id, hit_id, start, end, bitscore), hit_id N or C; sequences: (seq_id, sequence); alignments: (seq_id, hit_id, start, end, query, profile,
    hit_start) of the hits. A domain is read by the alignment of the N hit that it starts with (of several the longest), its lysine by that of the
    C hit that it ends with. Domains without a whole signature are left out; numbers count all of a sequence's domains.
    """
    found = H.detect_domains(hits)
    of = lambda kind: alignments.filter(F.col("hit_id") == kind)
    best = lambda rows, by, longest: rows.groupBy("seq_id", by).agg(F.max_by(F.struct("query", "profile", "hit_start", "start"), longest).alias("x"))
    first = best(of("N"), "start", F.col("end")).select("seq_id", "start", F.col("x.query").alias("n_query"), F.col("x.profile").alias("n_profile"), F.col("x.hit_start").alias("n_hit_start"), F.col("start").alias("n_query_start"))
    last = best(of("C"), "end", -F.col("start")).select("seq_id", "end", F.col("x.query").alias("c_query"), F.col("x.profile").alias("c_profile"), F.col("x.hit_start").alias("c_hit_start"))
    read = G.profile_signatures(found.join(first, ["seq_id", "start"]).join(last, ["seq_id", "end"], "left"))
    whole = G.complete(G.slices(read.withColumnRenamed("seq_id", "protein_id"), sequences.select(F.col("seq_id").alias("protein_id"), F.col("sequence").alias("protein_sequence"))))
    name = S.header(F.col("protein_id"), F.col("domain_nr"), F.col("start"), F.col("end"))
    return whole.select(name.alias("id"), F.col("protein_id").alias("seq_id"), "domain_nr", "start", "end", "sequence", "signature", "extended_signature")


def predict_from_hits(hits: DataFrame, sequences: DataFrame, alignments: DataFrame, model: PipelineModel, structures: DataFrame, properties: dict[str, list[float]], top: int | None = None, path: str | None = None) -> DataFrame:
    """(id, label, smiles, p) of all domains of the sequences, from hits to the model's labels; with path, each domain's best labels are written there as a table. Raises if there is no domain."""
    domains = checkpointed(domains_from_hits(hits, sequences, alignments))
    out = predict_labels(domains.select("id", "extended_signature"), model, structures, properties)
    if path:
        write_top(out, top or 3, path)
    return out


def predict_pairs_from_hits(hits: DataFrame, sequences: DataFrame, alignments: DataFrame, model: PipelineModel, labels: DataFrame, properties: dict[str, list[float]], top: int | None = None, path: str | None = None) -> DataFrame:
    """As predict_from_hits, by a forest over pairs: labels are those of ``candidates`` (built-in, bacterial, custom ones), whose bits are the ones that the forest learned from. Raises if there is none."""
    if labels.isEmpty():
        raise ValueError("no candidate labels")
    domains = checkpointed(domains_from_hits(hits, sequences, alignments))
    out = predict_pairs(domains.select("id", "extended_signature"), model, labels, properties)
    if path:
        write_top(out, top or 3, path)
    return out


def custom_bits(custom: DataFrame, selected: list[int]) -> DataFrame:
    """(label, smiles, bits) of a user's substrates (label, smiles): whether each has the selected hashes of a fingerprint."""
    read = M.read_structures(custom.select(F.col("label").alias("id"), "smiles"))
    return M.fingerprints(read).join(custom, F.col("id") == F.col("label")).select("label", "smiles", S.bitvector(F.col("fingerprint"), selected).alias("bits"))


def train_scopes(domains: DataFrame, labels: DataFrame, mode: str, properties: dict[str, list[float]], folder: str, cutoff: int = 6, scopes: tuple[str, ...] = ("all", "fungal", "bacterial"), **settings) -> dict[str, int]:
    """Train a forest for each scope of domains (id, extended_signature, domain, kingdom) and save it under the folder; labels: (domain_id, label, ordinal).

    A scope's labels are those that enough of its own domains have. Returns how many domains each scope learned from; one without labels trains none and has 0.
    """
    out = {}
    for scope in scopes:  # a model a scope
        own = G.scoped(domains, scope)
        mine = labels.join(own.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
        included = first_valid_counts(mine, cutoff) if mode == "first_valid" else label_counts(mine, first_only=mode == "first_only", cutoff=cutoff)
        chosen = checkpointed(select_labels(mine, included, mode).select(F.col("domain_id").alias("id"), F.col("labels").alias("label")))
        out[scope] = chosen.count()
        if out[scope]:
            models.train_forest(featured(own, properties).join(chosen, "id"), **settings).write().overwrite().save(f"{folder}/{scope}")
    return out


def load_model(folder: str, scope: str = "all") -> PipelineModel:
    """A forest that train_scopes saved."""
    return PipelineModel.load(f"{folder}/{scope}")


def train_labels(domains: DataFrame, labels: DataFrame, included: DataFrame, mode: str, properties: dict[str, list[float]], **settings) -> PipelineModel:
    """A forest over signature features for the domains' selected label (first_only or first_valid)."""
    return _labelled_forest(featured(domains, properties), labels, included, mode, settings)


def train_labels_embedded(domains: DataFrame, labels: DataFrame, included: DataFrame, mode: str, **settings) -> PipelineModel:
    """As train_labels, over domains' (id, embedding) embeddings or components in place of signature features."""
    return _labelled_forest(embedded(domains), labels, included, mode, settings)


def embedded(domains: DataFrame) -> DataFrame:
    """domains (id, embedding) with features: the embedding's numbers. Raises where they differ in size from the first, or are null."""
    size = domains.select(F.size("embedding").alias("n")).first()
    wrong = F.raise_error(F.concat(F.lit("another embedding for "), F.col("id").cast("string"))).cast("array<double>")
    own = F.col("embedding").cast("array<double>")
    return domains.withColumn("features", F.when(F.coalesce(F.size("embedding") == (size["n"] if size else 0), F.lit(False)), own).otherwise(wrong)).drop("embedding")


def _labelled_forest(featured_domains: DataFrame, labels: DataFrame, included: DataFrame, mode: str, settings: dict) -> PipelineModel:
    chosen = select_labels(labels, included, mode).select(F.col("domain_id").alias("id"), F.col("labels").alias("label"))
    return models.train_forest(featured_domains.join(chosen, "id"), **settings)


def train_table(table: DataFrame, properties: dict[str, list[float]], **settings) -> PipelineModel:
    """A forest over a plain table (id, signature, label); raises for a signature that hasn't 34 letters."""
    odd = table.filter(F.coalesce(F.length("signature") != 34, F.lit(True))).first()
    if odd is not None:
        raise ValueError(f"not a signature: {odd['id']}")
    return models.train_forest(featured(table, properties, "signature"), **settings)


def train_pairs(domains: DataFrame, labels: DataFrame, known: DataFrame, properties: dict[str, list[float]], **settings) -> PipelineModel:
    """A forest over pairs of a domain and a known label (label, smiles, bits): class 1 where the domain has the label, else 0."""
    return _pair_forest(featured(domains, properties), labels, known, settings)


def train_pairs_embedded(domains: DataFrame, labels: DataFrame, known: DataFrame, **settings) -> PipelineModel:
    """As train_pairs, over domains' (id, embedding) embeddings or components."""
    return _pair_forest(embedded(domains), labels, known, settings)


def _pair_forest(featured_domains: DataFrame, labels: DataFrame, known: DataFrame, settings: dict) -> PipelineModel:
    pairs = paired(featured_domains, known)
    true = labels.select(F.col("domain_id").alias("id"), "label", F.lit("1").alias("class_of")).distinct()
    rows = pairs.join(true, ["id", "label"], "left").select("id", "features", F.coalesce("class_of", F.lit("0")).alias("label"))
    return models.train_forest(rows, **settings)


def evaluate(model: PipelineModel, rows: DataFrame, truths: DataFrame) -> dict[str, DataFrame]:
    """The tables that a test run gives, of rows (id, features) and truths (id, label, ordinal): accuracy, confidences, confusion."""
    top = E.best(models.predict(model, rows))
    return {"accuracy": E.accuracy_table(top, truths), "confidences": E.confidence_table(top, truths), "confusion": E.confusion(top, truths)}


def crossvalidate(rows: DataFrame, truths: DataFrame, k: int, **settings) -> DataFrame:
    """(fold, substrate, accuracy): each fold of rows (id, features, label, fold) scored by a forest that learned from the others."""
    out = None
    for fold in range(k):  # a model a fold
        model = models.train_forest(rows.filter(F.col("fold") != fold), **settings)
        part = rows.filter(F.col("fold") == fold)
        table = evaluate(model, part, truths.join(part.select("id"), "id", "left_semi"))["accuracy"].withColumn("fold", F.lit(fold))
        out = table if out is None else out.unionByName(table)
    return out


def annotate(predictions: DataFrame, domains: DataFrame, equivalent: bool = False) -> DataFrame:
    """(id, protein, sequence_matches, name_matches): known domains (domain_id, sequence, synonyms) with the same sequence, or with the protein among their names.

    predictions: (id, protein, sequence). Both lists are in order and empty where nothing matches. equivalent: sequences match too where one holds the
    other, or they overlap over four fifths of the shorter.
    """
    if equivalent:
        pairs = equivalent_pairs(predictions.select("id", F.col("sequence").alias("seq")), domains.select(F.col("domain_id").alias("id"), F.col("sequence").alias("seq"))).withColumnRenamed("other", "domain_id")
    else:
        pairs = predictions.join(domains.select("sequence", "domain_id"), "sequence").select("id", "domain_id")
    by_sequence = pairs.groupBy("id").agg(F.array_sort(F.collect_set("domain_id")).alias("sequence_matches"))
    names = domains.select(F.explode("synonyms").alias("protein"), "domain_id")
    by_name = predictions.join(names, "protein").groupBy("id").agg(F.array_sort(F.collect_set("domain_id")).alias("name_matches"))
    none = F.array().cast("array<long>")
    return predictions.select("id", "protein").join(by_sequence, "id", "left").join(by_name, "id", "left").select("id", "protein", F.coalesce("sequence_matches", none).alias("sequence_matches"), F.coalesce("name_matches", none).alias("name_matches"))


def by_protein(results: DataFrame, *fields: str) -> DataFrame:
    """(ord, protein, results): each protein's results in the order of ord, proteins by their first; results: (ord, protein, ...)."""
    return results.groupBy("protein").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("results"))


def result_json(fields: list[str]) -> Column:
    """Columns as one JSON object, nested ones too."""
    return F.to_json(F.struct(*fields))


def result_records(predictions: DataFrame, domains: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein_name, body): each protein's results as one nested JSON record, its domains by number and their labels from the most probable on, ties by name.

    predictions: (id, label, smiles, p); domains: as domains_from_hits gives them; proteins: (seq_id, sequence). A protein without a domain has no record.
    """
    order = F.struct((-F.col("p")).alias("less"), "label", "smiles", "p")
    ranked = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["label"].alias("substrate_name"), x["smiles"].alias("substrate_smiles"), x["p"].alias("probability")))
    own = domains.join(predictions.groupBy("id").agg(ranked.alias("predictions")), "id")
    record = F.struct(F.col("seq_id").alias("domain_name"), "domain_nr", F.col("start").alias("domain_start"), F.col("end").alias("domain_end"), F.col("sequence").alias("domain_sequence"), F.col("signature").alias("domain_signature"), F.col("extended_signature").alias("domain_extended_signature"), "predictions")
    results = own.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("domain_nr", record.alias("r")))), lambda x: x["r"]).alias("results"))
    whole = results.join(proteins.select("seq_id", F.col("sequence").alias("protein_sequence")), "seq_id")
    return whole.select(F.col("seq_id").alias("protein_name"), F.to_json(F.struct(F.col("seq_id").alias("protein_name"), F.col("protein_sequence").alias("sequence"), "results")).alias("body"))


def in_order(domains: DataFrame) -> DataFrame:
    """Domains in the order of output: by their protein's name as text, then by start."""
    return domains.orderBy(F.col("seq_id").cast("string"), "start", "end")


def write_top(scores: DataFrame, n: int, path: str) -> None:
    """A table of each id's n most probable labels, tab-separated with a header. Raises if some id has fewer labels."""
    fewest = scores.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c")).first()[0]
    if fewest is not None and n > fewest:
        raise ValueError(f"{n} predictions asked for, {fewest} there")
    E.top_wide(scores, n).orderBy("id").write.csv(path, sep="\t", header=True)


def validated_signatures(rows: DataFrame) -> DataFrame:
    """Submitted domains (protein, name, signature) as they are; raises for one without a name, or whose signature hasn't 34 characters of the alphabet."""
    bad = F.col("name").isNull() | (F.col("name") == "") | F.col("signature").isNull() | (F.length("signature") != 34) | ~S.valid_alphabet(F.col("signature"))
    odd = rows.filter(F.coalesce(bad, F.lit(True))).first()
    if odd is not None:
        raise ValueError(f"not a signature: {odd['name']} {odd['signature']}")
    return rows


def numbered_by_protein(rows: DataFrame) -> DataFrame:
    """rows (protein, name, start) with domain_nr: from 1 within the protein, by name and start."""
    return rows.withColumn("domain_nr", F.row_number().over(Window.partitionBy("protein").orderBy("name", "start")))


def custom_labels(lines: DataFrame) -> DataFrame:
    """(label, smiles) of a user's two-column table (line, text), with or without a header. Raises, with its number, for a line of another form."""
    parts = F.split(F.trim("text"), "\t")
    rows = lines.filter(F.trim("text") != "").select("line", parts.alias("p")).filter(~((F.col("line") == 1) & (F.lower(F.get("p", 0)).isin("substrate", "name"))))
    bad = rows.filter((F.size("p") != 2) | (F.coalesce(F.trim(F.get("p", 0)), F.lit("")) == "") | ~F.coalesce(F.get("p", 1), F.lit("")).rlike(r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+$")).orderBy("line").first()
    if bad is not None:
        raise ValueError(f"line {bad['line']} is no substrate")
    faults = M.read_structures(rows.select(F.col("line").alias("id"), F.get("p", 1).alias("smiles"))).filter("fault is not null").orderBy("id").first()
    if faults is not None:
        raise ValueError(f"line {faults['id']} is no substrate: {faults['fault']}")
    return rows.select(F.trim(F.get("p", 0)).alias("label"), F.trim(F.get("p", 1)).alias("smiles"))
