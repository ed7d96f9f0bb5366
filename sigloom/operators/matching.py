"""Matching of sequences and of sets."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.scalars import jaccard, same_set
from sigloom.operators.labels import checkpointed
from sigloom.operators.overlap import equivalent_of_one_length, equivalent_pairs, equivalent_texts

#: Below this similarity prefixes leave nearly nothing out.
LEAST_FILTERED = 0.2
#: Sets are filed under all parts that a similar one may share, where these are so many at most.
PARTS = 100
#: Pairs that a task counts, or writes out.
COUNTED = 1_000_000
#: Pairs whose lists are on disk at once.
ROUND = 300_000_000
#: Rows with one set that stand together where their pairs are written out.
BLOCK = 1_000


def specificity_match(a, b):
    """Match of two label lists: same list, same set in another order, overlapping, or disjoint."""
    return F.when(a == b, "match").when(same_set(a) == same_set(b), "mismatching_order").when(F.arrays_overlap(a, b), "partial_mismatch").otherwise("full_mismatch")


def occurrences(texts: DataFrame, token: str) -> DataFrame:
    """(id, nth, start): the non-overlapping literal occurrences of token in text, 0-based, from left to right: what stands between them is summed up once."""
    sized = texts.select("id", F.monotonically_increasing_id().alias("row"), F.transform(F.split("text", r"\Q" + token + r"\E", -1), lambda p: F.length(p)).alias("sizes"))
    parts = sized.select("id", "row", F.posexplode("sizes").alias("nth", "size"))
    w = Window.partitionBy("row").orderBy("nth")
    placed = parts.withColumns({"start": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("nth") * len(token), "more": F.lead("nth").over(w).isNotNull()})
    return placed.filter("more").select("id", "nth", F.col("start").cast("int").alias("start"))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, other) of equal sets: an equi-join on the sorted set."""
    key = lambda d, c: d.select(F.col("id").alias(c), same_set(F.col("values")).alias("key"))
    return key(a, "id").join(key(b, "other"), "key").select("id", "other")


def counted_pairs(sets: DataFrame, least: float) -> DataFrame:
    """As jaccard_pairs, by counting what every two sets that share a member share. Tasks are as many as the pairs ask for, so that none grows with them.

    A pair isn't a row until it is counted: each set goes to its task with a list, for each of its members, of the smaller sets that have it (by size, then id).
    Where the lists are too many for the disk, the sets take turns.
    """
    sized = sets.filter("id is not null").select("id", F.array_distinct("values").alias("values")).withColumn("n", F.size("values"))
    members = checkpointed(sized.select("id", "n", F.explode("values").alias("member")).filter("member is not null"))
    counts = members.groupBy("member").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    pairs, most = counts.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.max("c")).first()
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil((pairs or 0) / COUNTED))
    large = counts.filter(F.col("c") > BLOCK).select("member", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    dealt = members.join(F.broadcast(large), "member", "left") if (most or 0) > BLOCK else members.withColumn("blocks", F.lit(1))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    blocks = dealt.groupBy("member", "block").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("having"))
    rounds = max(1, ceil((pairs or 0) / ROUND))
    if rounds == 1:
        return counted_in_turn(blocks, members, large if (most or 0) > BLOCK else None, tasks, least, F.lit(True))
    blocks = checkpointed(blocks)
    turns = [F.pmod(F.xxhash64("x.id"), F.lit(rounds)) == r for r in range(rounds)]
    found = [checkpointed(counted_in_turn(blocks, members, large if most > BLOCK else None, ceil(tasks / rounds), least, turn)) for turn in turns]
    return reduce(DataFrame.union, found)


def counted_in_turn(blocks: DataFrame, members: DataFrame, large: DataFrame | None, tasks: int, least: float, turn) -> DataFrame:
    """(id, other, jaccard) of the sets x whose turn it is and the smaller ones, given members (id, n, member) and blocks (member, block, having); large: the members of several blocks."""
    near = blocks.select(F.posexplode("having").alias("place", "x"), "having").filter(turn).select("x.id", "x.n", F.slice("having.id", F.lit(1), F.col("place")).alias("others"))
    if large is not None:
        some = checkpointed(blocks.join(F.broadcast(large.select("member")), "member", "left_semi"))
        far = some.join(some.toDF("member", "other_block", "other_having"), "member").filter(F.col("block") != F.col("other_block"))
        smaller = lambda y: y < F.col("x")
        near = near.union(far.select(F.explode("having").alias("x"), "other_having").filter(turn).select("x.id", "x.n", F.transform(F.filter("other_having", smaller), lambda y: y["id"]).alias("others")))
    lists = near.filter(F.size("others") > 0).withColumn("others", F.sort_array("others")).repartition(tasks, "id")
    shared = lists.select("id", "n", F.explode("others").alias("other")).filter("id <> other").groupBy("id", "n", "other").agg(F.count(F.lit(1)).alias("common"))
    # A set is a part of both together, and the other one is no larger.
    some = shared.filter(F.col("common") >= F.col("n") * least - 1e-9)
    value = F.col("common") / (F.col("n") + F.col("other_n") - F.col("common"))
    both = some.join(members.select(F.col("id").alias("other"), F.col("n").alias("other_n")).distinct(), "other").withColumn("jaccard", value).filter(F.col("jaccard") >= least)
    return both.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "jaccard")


def keyed_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key) of sets (id, values), the key being the set in order, and (key, class_id, n): each distinct set, the least id that has it, and how many do."""
    keyed = checkpointed(sets.filter("values is not null").select("id", same_set(F.col("values")).alias("key")))
    return keyed, keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))


def equal_links(sets: DataFrame) -> DataFrame:
    """(id, class_id, n_links): the least id with an equal set, and how many other rows have one. Copies aren't written as pairs."""
    keyed, classes = keyed_sets(sets)
    return keyed.join(classes, "key").select("id", "class_id", (F.col("n") - 1).alias("n_links"))


def jaccard_links(sets: DataFrame, least: float) -> DataFrame:
    """(id, class_id, n_links) of sets that aren't empty: the least id with an equal set, and how many other rows have a set with a Jaccard similarity of least or more.

    Distinct sets are compared once, whatever the number of their copies.
    """
    keyed, classes = keyed_sets(sets.filter(F.size("values") > 0))
    classes = checkpointed(classes)
    pairs = jaccard_pairs(classes.select(F.col("class_id").alias("id"), F.col("key").alias("values")), least).select("id", "other")
    sizes = classes.select("class_id", "n")
    both = pairs.union(pairs.select("other", "id")).join(sizes.select(F.col("class_id").alias("other"), "n"), "other").select(F.col("id").alias("class_id"), "n")
    links = both.union(sizes).groupBy("class_id").agg((F.sum("n") - 1).alias("n_links"))
    return keyed.join(classes.select("key", "class_id"), "key").join(links, "class_id").select("id", "class_id", "n_links")


def class_blocks(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, key, n): each distinct set of sets (id, values), its number and how many rows have it; and (class, block, ids): those rows, about BLOCK at a time.

    Only the sets that more rows have than a block holds are sent to the rows, so that no task gets all rows of one.
    """
    keyed = checkpointed(sets.filter("values is not null").select("id", same_set(F.col("values")).alias("key")))
    classes = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("class"), "key", "n"))
    large = classes.filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = keyed.join(F.broadcast(large), "key", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    blocks = dealt.groupBy("key", "block").agg(F.collect_list("id").alias("ids")).join(classes.select("key", "class"), "key")
    return classes, checkpointed(blocks.select("class", "block", "ids"))


def pairs_of_rows(linked: DataFrame, classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, other, jaccard), id < other, of all rows of the linked classes (a, b, jaccard), a class with itself among them.

    Blocks meet blocks, and what meets is dealt to as many tasks as the pairs ask for, which write them out row by row.
    """
    sizes = classes.select("class", F.col("n").cast("double").alias("n"))
    both = linked.join(sizes.toDF("a", "a_n"), "a").join(sizes.toDF("b", "b_n"), "b")
    count = both.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0] or 0
    tasks = max(int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(count / COUNTED))
    side = lambda c: blocks.toDF(c, f"{c}_block", f"{c}_ids")
    met = linked.join(side("a"), "a").join(side("b"), "b").filter((F.col("a") != F.col("b")) | (F.col("a_block") <= F.col("b_block")))
    own = (F.col("a") == F.col("b")) & (F.col("a_block") == F.col("b_block"))
    dealt = met.select("a_ids", "b_ids", own.alias("own"), "jaccard", F.xxhash64("a", "a_block", "b", "b_block").alias("deal")).repartition(tasks, "deal")
    rows = dealt.select("own", "jaccard", "b_ids", F.explode("a_ids").alias("x")).select("own", "jaccard", "x", F.explode("b_ids").alias("y"))
    return rows.filter((F.col("x") < F.col("y")) | (~F.col("own") & (F.col("x") > F.col("y")))).select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other"), "jaccard")


def equal_pairs(sets: DataFrame) -> DataFrame:
    """(id, other) with id < other of equal sets (id, values)."""
    classes, blocks = class_blocks(sets)
    linked = classes.filter("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs_of_rows(linked, classes, blocks).select("id", "other")


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """As jaccard_pairs, of sets that aren't empty: distinct sets are compared once, then the rows that have them are written out as pairs."""
    classes, blocks = class_blocks(sets.filter(F.size("values") > 0))
    unlike = jaccard_pairs(classes.select(F.col("class").alias("id"), F.col("key").alias("values")), least).toDF("a", "b", "jaccard")
    alike = classes.filter("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs_of_rows(checkpointed(unlike.union(alike)), classes, blocks)


def shared_least(p: int, q: int, least: float) -> int:
    """How many members sets of p and q members have in common at least, if they are similar enough."""
    return max(1, ceil(least / (1 + least) * (p + q) - 1e-9))


def by_parts(p: int, q: int, least: float) -> bool:
    o = shared_least(p, q, least)
    return o <= min(p, q) and max(comb(p, o), comb(q, o)) <= PARTS


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(id, other, jaccard) of pairs with id < other and a Jaccard similarity of least or more.

    Small sets are filed, for each size of the other, under all their parts of so many members as both share at least: what meets is similar.
    For larger ones, members are ordered by how many sets have them; two sets that are similar enough meet in the first n - ceil(least * n) + 1 of each, and
    their sizes differ by least at most. Only such pairs are compared. Below LEAST_FILTERED prefixes are nearly whole sets, and shared members are counted instead.
    """
    if least < LEAST_FILTERED:
        return counted_pairs(sets, least)
    sized = checkpointed(sets.select("id", F.array_sort(F.array_distinct("values")).alias("values")).withColumn("n", F.size("values")))
    sizes = sorted(r[0] for r in sized.select("n").distinct().collect() if r[0] and r[0] > 0)  # as many as there are sizes
    fit = [(p, q) for p in sizes for q in sizes if p >= least * q - 1e-9 and q >= least * p - 1e-9]
    parts = [(p, min(p, q), max(p, q), list(c)) for p, q in fit if by_parts(p, q, least) for c in combinations(range(p), shared_least(p, q, least))]
    longer = [(p, q) for p, q in fit if not by_parts(p, q, least)]
    pairs = None
    if parts:
        table = F.broadcast(sets.sparkSession.createDataFrame(parts, "n int, small int, large int, places array<int>"))
        key = F.xxhash64("small", "large", F.transform("places", lambda i: F.get("values", i)))
        filed = sized.join(table, "n").select("id", "small", "large", "n", key.alias("key"))
        of = lambda c: filed.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), "small", "large", "key")
        sizes_fit = (F.least("id_n", "other_n") == F.col("small")) & (F.greatest("id_n", "other_n") == F.col("large"))
        pairs = of("id").join(of("other").hint("merge"), ["key", "small", "large"]).filter((F.col("id") < F.col("other")) & sizes_fit).select("id", "other")
    if longer:
        own_sizes = F.broadcast(sets.sparkSession.createDataFrame([(p,) for p in sorted({p for p, _ in longer})], "n int"))
        members = sized.join(own_sizes, "n", "left_semi").select("id", "n", F.explode("values").alias("member"))
        ordered = members.join(members.groupBy("member").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "member")
        own = Window.partitionBy("id").orderBy("c", "member")
        # Members that no other set has come first in the order and use up places.
        ahead = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id")) + F.row_number().over(own)
        prefix = ordered.withColumn("place", ahead).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
        side = lambda c: prefix.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), "member")
        fits = (F.col("id_n") >= least * F.col("other_n") - 1e-9) & (F.col("other_n") >= least * F.col("id_n") - 1e-9)
        met = side("id").join(side("other"), "member").filter((F.col("id") < F.col("other")) & fits).select("id", "other")
        pairs = met if pairs is None else pairs.union(met)
    if pairs is None:
        return counted_pairs(sets.limit(0), least)
    held = lambda c: sized.select(F.col("id").alias(c), F.col("values").alias(f"{c}_values"))
    both = pairs.distinct().join(held("id"), "id").join(held("other"), "other")
    return both.select("id", "other", jaccard(F.col("id_values"), F.col("other_values")).alias("jaccard")).filter(F.col("jaccard") >= least)


__all__ = ["equivalent_of_one_length", "equivalent_pairs", "equivalent_texts", "specificity_match", "occurrences", "same_sets", "equal_links", "jaccard_links", "equal_pairs", "similar_pairs", "jaccard_pairs", "jaccard"]
