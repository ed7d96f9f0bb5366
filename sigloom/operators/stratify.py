"""Iterative stratification of domains with several labels, in rounds over distinct label sets.

Domains with equal label sets are one group, so the rounds work on counts. In a round every open group is served by its label of which the fewest
domains are left. A label is ready when it serves all open groups that have it; ready labels share no group, so all of them are served at once:
what each fold still wants of the label says how many of its domains each fold gets, and the groups are dealt out in turn by these
numbers. The rarest label is always ready, and rounds end when no group is open. Labels that are served later make up for what
earlier ones brought along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.labels import checkpointed
from sigloom.operators.numbering import numbered


def wanted_counts(wanted: np.ndarray, n: int) -> np.ndarray:
    """How many of n each fold gets, by what it wants: as if one after another went to the fold that wants the most. Ties go to earlier folds."""
    some, level = np.ones(len(wanted), dtype=bool), 0.0
    while True:
        level = (wanted[some].sum() - n) / some.sum()
        over = some & (wanted < level)
        if not over.any():
            break
        some &= ~over
    share = np.where(some, wanted - level, 0.0)
    counts = np.floor(share + 1e-9).astype(np.int64)
    rest = np.round(share - counts, 9)
    counts[np.lexsort((np.arange(len(rest)), -rest))[: n - counts.sum()]] += 1
    return counts


def dealt(start: np.ndarray, n: np.ndarray, total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of the places from start on, n of total, each fold gets, when the folds' counts are spread evenly over all places."""

    def until(place: np.ndarray) -> np.ndarray:
        out, left, rest = np.empty_like(counts), place.copy(), total.copy()
        for j in range(counts.shape[1]):
            out[:, j] = left * counts[:, j] // np.maximum(rest, 1)
            left, rest = left - out[:, j], rest - counts[:, j]
        return out

    return until(start + n) - until(start)


def next_round(groups: DataFrame, totals: DataFrame, shares: list[float]) -> DataFrame:
    """groups (own, n, given) with given filled in for the groups that the round's ready labels serve."""
    opened = groups.filter("given is null").select("own", "n", F.explode("own").alias("label"))
    left = opened.groupBy("label").agg(F.sum("n").alias("left"))
    # Groups are dealt out next to those with like further labels, the rarest first, so that each of these is spread evenly too.
    serving = opened.join(left, "label").groupBy("own").agg(F.array_sort(F.collect_list(F.struct("left", "label"))).alias("order")).withColumn("by", F.col("order")[0])
    marked = opened.join(serving.hint("merge"), "own").withColumn("mine", F.col("by.label") == F.col("label"))
    ready = marked.groupBy("label").agg(F.bool_and("mine").alias("ready")).filter("ready").select("label")
    served = marked.filter("mine").join(ready, "label").select("label", "own", "n", "order")
    given = groups.filter("given is not null").select(F.explode("own").alias("label"), F.posexplode("given").alias("fold", "x")).groupBy("label", "fold").agg(F.sum("x").alias("x"))
    held = given.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("fold", "x"))).alias("held"))
    place = F.sum("n").over(Window.partitionBy("label").orderBy("order", "own").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sized = served.withColumns({"start": place, "every": F.sum("n").over(Window.partitionBy("label"))}).join(totals, "label").join(held, "label", "left")
    has = F.array(*[F.coalesce(F.try_element_at("held", F.lit(j)), F.lit(0)).cast("long") for j in range(len(shares))])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            counts = np.empty((len(rows), len(shares)), dtype=np.int64)
            for (_, every, total), at in rows.groupby(["label", "every", "total"]).indices.items():
                counts[at] = wanted_counts(total * np.array(shares) - np.array(rows["has"].iloc[at[0]], dtype=np.float64), int(every))
            found = dealt(rows["start"].to_numpy(), rows["n"].to_numpy(), rows["every"].to_numpy(), counts)
            yield pd.DataFrame({"own": rows["own"], "now": list(found)})

    kind = groups.schema["own"].dataType.simpleString()
    now = sized.select("label", "own", "n", "start", "every", "total", has.alias("has")).mapInPandas(deal, f"own {kind}, now array<bigint>")
    return groups.join(now.hint("merge"), "own", "left").select("own", "n", F.coalesce("given", "now").alias("given"))


def iterative_parts(labels: DataFrame, shares: list[float]) -> DataFrame:
    """(domain_id, part) of labels (domain_id, label): parts from 0 on, with about these shares (which add up to 1) of every label's domains.

    Null labels are left out; repeated ones count once. Within a group, the hash of the ids says who goes where.
    """
    if abs(sum(shares) - 1) > 1e-9 or min(shares) < 0:
        raise ValueError("shares are to add up to 1")
    sets = checkpointed(labels.filter("label is not null").groupBy("domain_id").agg(F.array_sort(F.collect_set("label")).alias("own")))
    groups = checkpointed(sets.groupBy("own").agg(F.count(F.lit(1)).alias("n")).withColumn("given", F.lit(None).cast("array<bigint>")))
    totals = checkpointed(groups.select(F.explode("own").alias("label"), "n").groupBy("label").agg(F.sum("n").alias("total")))
    while not groups.filter("given is null").isEmpty():
        groups = checkpointed(next_round(groups, totals, shares))
    placed = numbered(sets.join(groups.select("own", "given").hint("merge"), "own"), ["own"], F.col("domain_id"), "place", "of")
    ends = F.transform(F.sequence(F.lit(1), F.size("given")), lambda k: F.aggregate(F.slice("given", F.lit(1), k), F.lit(0).cast("bigint"), lambda s, x: s + x))
    return placed.select("domain_id", F.size(F.filter(ends, lambda e: e < F.col("place"))).alias("part"))


def iterative_split(labels: DataFrame, test_share: float) -> DataFrame:
    """(domain_id, side): every label has about the test share of its domains on the test side."""
    return iterative_parts(labels, [test_share, 1 - test_share]).select("domain_id", F.when(F.col("part") == 0, "test").otherwise("train").alias("side"))


def iterative_folds(labels: DataFrame, k: int) -> DataFrame:
    """(domain_id, fold) of k folds with about equal shares of every label."""
    return iterative_parts(labels, [1 / k] * k).select("domain_id", F.col("part").alias("fold"))
