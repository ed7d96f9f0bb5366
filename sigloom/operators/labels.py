"""Label counts and selection, clades, and splits. labels: (domain_id, label, ordinal)."""

from __future__ import annotations

import random
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.numbering import numbered

_own: dict[str, str] = {}
#: Spark's setting by which a query's shuffle files go with its end, instead of when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the session names; where it names none, in the warehouse, or on one machine alone in a temporary folder. What was shuffled for it is deleted."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get("folder")
    if not folder and not spark.sparkContext.master.startswith("local["):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sigloom-scratch"
    if not folder:
        folder = _own["folder"] = "file://" + tempfile.mkdtemp(prefix="sigloom-")
    path = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def label_counts(labels: DataFrame, first_only: bool = False, cutoff: int = 0) -> DataFrame:
    """label, n: over all labels or each domain's first; with n of at least cutoff."""
    some = labels.filter("ordinal = 0") if first_only else labels
    return some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cutoff)


def size_class(n):
    return F.when(n > 100, 4).when(n > 50, 3).when(n > 10, 2).when(n > 0, 1)


def select_labels(labels: DataFrame, included: DataFrame, mode: str) -> DataFrame:
    """domain_id, labels (joined by |): first_only, first_valid or all of those that are included; domains without are left out."""
    marked = labels.join(included.select("label", F.lit(True).alias("in")), "label", "left").filter("in" if mode != "first_only" else "ordinal = 0 and in")
    if mode == "first_valid":
        return marked.groupBy("domain_id").agg(F.min_by("label", "ordinal").cast("string").alias("labels"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", F.col("label").cast("string").alias("label"))))
    return marked.groupBy("domain_id").agg(F.array_join(F.transform(ordered, lambda x: x["label"]), "|").alias("labels"))


def first_valid_counts(labels: DataFrame, cutoff: int) -> DataFrame:
    """label, n of each domain's first valid label, at a fixpoint: labels below the cutoff stop being valid until all keep it."""
    valid = checkpointed(label_counts(labels, cutoff=cutoff).select("label"))
    held = valid.count()
    while True:
        first = labels.join(valid, "label", "left_semi").groupBy("domain_id").agg(F.min_by("label", "ordinal").alias("label"))
        counts = checkpointed(first.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cutoff))
        left = counts.count()
        if left == held:
            return counts
        valid, held = counts.select("label"), left


def clades(links: DataFrame) -> DataFrame:
    """taxon, clade: connected components of taxa that share a domain; links: (taxon, domain_id). Least labels, with pointer jumping."""
    shared = checkpointed(links.distinct())
    label = shared.select("taxon").distinct().withColumn("clade", F.col("taxon"))
    before = None
    while True:
        by_domain = shared.join(label, "taxon").groupBy("domain_id").agg(F.min("clade").alias("m"))
        near = shared.join(by_domain, "domain_id").groupBy("taxon").agg(F.min("m").alias("clade"))
        jump = near.join(near.select(F.col("taxon").alias("clade"), F.col("clade").alias("far")), "clade", "left")
        label = checkpointed(jump.select("taxon", F.least("clade", F.coalesce("far", "clade")).alias("clade")))
        mark = label.agg(F.sum(F.xxhash64("taxon", "clade").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            return label
        before = mark


def stratified_split(rows: DataFrame, stratum: str, id_: str, test_share: float) -> DataFrame:
    """rows with side: in each stratum round(share * n) rows, by the hash of their ids, are the test side."""
    ranked = numbered(rows, [stratum], F.col(id_), "_rk", "_n")
    return ranked.withColumn("side", F.when(F.col("_rk") <= F.floor(F.col("_n") * test_share + 0.5), "test").otherwise("train")).drop("_rk", "_n")


def folds(rows: DataFrame, stratum: str, id_: str, k: int) -> DataFrame:
    """rows with fold: each stratum is dealt out in turn, by the hash of the ids."""
    return numbered(rows, [stratum], F.col(id_), "_rk", "_n").withColumn("fold", F.pmod(F.col("_rk") - 1, F.lit(k))).drop("_rk", "_n")


def undersample(rows: DataFrame, label: str, id_: str) -> DataFrame:
    """As many rows of every class as the smallest has, without replacement, by the hash of their ids."""
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_least"))
    return numbered(rows, [label], F.col(id_), "_rk", "_n").crossJoin(F.broadcast(least)).filter("_rk <= _least").drop("_rk", "_n", "_least")  # least is one row


def rarest_label(labels: DataFrame) -> DataFrame:
    """(domain_id, label): each domain's label that the fewest domains have, the first in name order of ties: the stratum of a domain with several labels."""
    counts = labels.groupBy("label").agg(F.countDistinct("domain_id").alias("_c"))
    return labels.join(counts, "label").groupBy("domain_id").agg(F.min(F.struct("_c", "label")).alias("m")).select("domain_id", F.col("m.label").alias("label"))


def multilabel_split(labels: DataFrame, test_share: float) -> DataFrame:
    """(domain_id, side) of domains with any number of labels: labels are served from the rarest on, each domain with its rarest label's."""
    return stratified_split(rarest_label(labels), "label", "domain_id", test_share).select("domain_id", "side")


def multilabel_folds(labels: DataFrame, k: int) -> DataFrame:
    """(domain_id, fold), as multilabel_split."""
    return folds(rarest_label(labels), "label", "domain_id", k).select("domain_id", "fold")


def multi_hot(labels: DataFrame) -> tuple[list, DataFrame]:
    """The classes in order, and (domain_id, hot): whether the domain has each. The classes are gathered: as many as there are labels."""
    classes = [r[0] for r in labels.select("label").distinct().orderBy("label").collect()]
    sets = labels.groupBy("domain_id").agg(F.collect_set("label").alias("_own"))
    return classes, sets.select("domain_id", F.array(*[F.array_contains("_own", F.lit(c)).cast("int") for c in classes]).alias("hot"))


def clade_counts(labels: DataFrame, clades: DataFrame, included: DataFrame, mode: str) -> DataFrame:
    """(clade, label, n) of included labels over each clade's domains; clades: (domain_id, clade). Modes: all, first_only, first_valid, which has zeros too."""
    valid = labels.join(included.select("label"), "label", "left_semi")
    if mode == "first_only":
        valid = valid.filter("ordinal = 0")
    if mode == "first_valid":
        valid = valid.groupBy("domain_id").agg(F.min_by("label", "ordinal").alias("label"))
    counts = valid.join(clades, "domain_id").groupBy("clade", "label").agg(F.count(F.lit(1)).alias("n"))
    if mode != "first_valid":
        return counts
    every = clades.select("clade").distinct().crossJoin(F.broadcast(included.select("label").distinct()))  # clades by labels: the result's own size
    return every.join(counts, ["clade", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_split(counts: DataFrame, ratio: float = 0.75, attempts: int = 200, seed: int = 4242) -> dict:
    """{clade: side}, from (clade, label, n): every label on both sides, then the rest greedily, the largest clades first, so that labels come near the ratio.

    Counts are gathered: as many as there are pairs of a clade and a label, whatever the number of domains. Raises if some label can't be
    on both sides, or none of the attempts puts it there.
    """
    of: dict = {}
    for r in counts.filter("n > 0").orderBy("clade", "label").collect():
        of.setdefault(r["clade"], {})[r["label"]] = r["n"]
    names = sorted({label for own in of.values() for label in own})
    holders = {label: [c for c in of if label in of[c]] for label in names}
    draw = random.Random(seed)
    sides = next((s for s in (_covering(names, holders, draw) for _ in range(attempts)) if s is not None), None)
    if sides is None:
        raise ValueError("no split has every label on both sides")
    train = {label: sum(of[c][label] for c in holders[label] if sides.get(c) == "train") for label in names}
    total = {label: sum(of[c].get(label, 0) for c in sides) for label in names}
    for clade in sorted((c for c in of if c not in sides), key=lambda c: -sum(of[c].values())):
        miss = {side: sum((train[x] + n * (side == "train") - ratio * (total[x] + n)) ** 2 - (train[x] - ratio * total[x]) ** 2 for x, n in of[clade].items()) for side in ("train", "test")}
        sides[clade] = "train" if miss["train"] <= miss["test"] else "test"
        for x, n in of[clade].items():
            train[x] += n * (sides[clade] == "train")
            total[x] += n
    return sides


def _covering(names: list, holders: dict, draw: random.Random) -> dict | None:
    """Sides of as few clades as it takes for every label to be on both, chosen label by label in a random order; null where a label is left without."""
    sides: dict = {}
    for label in draw.sample(names, len(names)):
        free = draw.sample([c for c in holders[label] if c not in sides], sum(c not in sides for c in holders[label]))
        for side in ("train", "test"):
            if not any(sides.get(c) == side for c in holders[label]):
                if not free:
                    return None
                sides[free.pop()] = side
    return sides


def check_split(assigned: DataFrame, legal: DataFrame) -> None:
    """Raises unless exactly the legal domains (domain_id) are assigned (domain_id, side), each once."""
    for a, b, what in ((assigned, legal, "assigned but not legal"), (legal, assigned, "legal but not assigned")):
        odd = a.join(b, "domain_id", "left_anti").select("domain_id").first()
        if odd is not None:
            raise ValueError(f"{what}: {odd[0]}")
    twice = assigned.groupBy("domain_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").first()
    if twice is not None:
        raise ValueError(f"assigned twice: {twice['domain_id']}")


def remapped(values: DataFrame, names: DataFrame) -> DataFrame:
    """(id, value) under new ids; names: (id, new_id). Raises if an id has no new one, or unlike values get one id."""
    both = values.join(names, "id", "left")
    lost = both.filter("new_id is null").first()
    if lost is not None:
        raise ValueError(f"no new id for {lost['id']}")
    out = both.groupBy(F.col("new_id").alias("id")).agg(F.min("value").alias("value"), F.max("value").alias("_other"))
    clash = out.filter("value <> _other").first()
    if clash is not None:
        raise ValueError(f"unlike values for {clash['id']}")
    return out.drop("_other")
