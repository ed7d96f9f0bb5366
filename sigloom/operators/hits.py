"""From profile hits to numbered domains: islands, forward pairing, interval reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of detection.
LEAST_SCORE, GAP, REACH, LEAST_LENGTH, LEAST_OVERLAP = 20, 60, 200, 100, 50
#: Places of a stretch under which intervals are filed.
BIN = 1024


def filter_hits(hits: DataFrame) -> DataFrame:
    """Hits (seq_id, hit_id, start, end, bitscore) above the score; of repeated ones the best stays."""
    return hits.filter(F.col("bitscore") > LEAST_SCORE).groupBy("seq_id", "hit_id", "start", "end").agg(F.max("bitscore").alias("bitscore"))


def islands(hits: DataFrame) -> DataFrame:
    """Merge hits of a sequence while the gap to the preceding hit's end stays below GAP: seq_id, start, end, parts."""
    w = Window.partitionBy("seq_id").orderBy("start", "end")
    new = F.when(F.col("start") - F.lag("end").over(w) < GAP, 0).otherwise(1)
    marked = hits.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("seq_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("island")


def pair_forward(n_hits: DataFrame, c_hits: DataFrame) -> DataFrame:
    """n_hits with c_start and c_end of the first C hit that starts after the end, by less than REACH; null where there is none.

    One pass over both sides in order of start: the next C start at or after each place is carried backwards.
    """
    ends = n_hits.select("seq_id", F.col("end").alias("at"), F.lit(0).alias("side"), F.struct("start", "end", "parts").alias("n"), F.lit(None).cast("struct<c_start:long,c_end:long>").alias("c"))
    starts = c_hits.select("seq_id", F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(ends.schema["n"].dataType).alias("n"), F.struct(F.col("start").cast("long").alias("c_start"), F.col("end").cast("long").alias("c_end")).alias("c"))
    # Of C hits with one start the first in order of end is taken; a C hit that starts just at the end comes before it.
    w = Window.partitionBy("seq_id").orderBy(F.col("at").desc(), F.col("side").asc(), F.col("c.c_end").desc())
    seen = ends.unionByName(starts).withColumn("next", F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.col("next.c_start") - F.col("at") < REACH
    return seen.filter("side = 0").select("seq_id", "n.*", F.when(near, F.col("next.c_start")).alias("c_start"), F.when(near, F.col("next.c_end")).alias("c_end"))


def detect_domains(hits: DataFrame) -> DataFrame:
    """seq_id, domain_nr, start, end: filter, islands of N hits, pairing to C hits, length filter, numbering by start."""
    good = filter_hits(hits)
    paired = pair_forward(islands(good.filter("hit_id = 'N'")), good.filter("hit_id = 'C'"))
    whole = paired.select("seq_id", "start", F.coalesce("c_end", "end").alias("end")).filter(F.col("end") - F.col("start") > LEAST_LENGTH)
    return number(whole, "seq_id")


def number(domains: DataFrame, key: str) -> DataFrame:
    return domains.withColumn("domain_nr", F.row_number().over(Window.partitionBy(key).orderBy("start", "end")))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, least: int = LEAST_OVERLAP) -> Column:
    one = lambda s, os, oe: (s >= os) & (s <= oe) & (oe - s >= least)
    return one(a_start, b_start, b_end) | one(b_start, a_start, a_end)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of overlapping rows of a and b, of the same sequence, as a.* and b.*.

    Rows are filed under each stretch of BIN places that they touch, and meet in the one where the later of the two starts: a join on sequence
    and stretch, so that a long sequence with many rows isn't compared all with all.
    """
    filed = lambda d, name: d.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.greatest("start", "end") / BIN)))).alias(name)
    first = F.floor(F.greatest("a.start", "b.start") / BIN) == F.col("a.bin")
    same = (F.col("a.seq_id") == F.col("b.seq_id")) & (F.col("a.bin") == F.col("b.bin")) & first
    return filed(a, "a").join(filed(b, "b"), same & overlaps(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")))


def interval_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows with each overlapping row of b, of the same sequence."""
    return _met(a, b).select(*[F.col(f"a.`{c}`") for c in a.columns], F.col("b.start").alias("o_start"), F.col("b.end").alias("o_end"))


def interval_anti(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows (seq_id, start, end, ...) that overlap none of b."""
    return a.join(_met(a, b).select("a.seq_id", "a.start", "a.end").distinct(), ["seq_id", "start", "end"], "left_anti").select(a.columns)


def longest_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows, with the coordinates of the longest overlapping row of b where that is strictly longer."""
    pick = F.max(F.struct((F.col("b.end") - F.col("b.start")).alias("size"), (-F.col("b.start")).alias("first"), F.col("b.end").alias("e"))).alias("l")
    best = a.select("seq_id", "start", "end").distinct().join(_met(a, b).groupBy("a.seq_id", "a.start", "a.end").agg(pick), ["seq_id", "start", "end"], "left")
    longer = F.col("l.size") > F.col("end") - F.col("start")
    return best.select("seq_id", F.when(longer, -F.col("l.first")).otherwise(F.col("start")).alias("start"), F.when(longer, F.col("l.e")).otherwise(F.col("end")).alias("end"))


def merge_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with longer coordinates from b, and b's rows that overlap none of those; numbered anew."""
    kept = longest_overlap(a, b)
    only = interval_anti(b.select("seq_id", "start", "end"), kept)
    return number(kept.unionByName(only), "seq_id")


def clusters(rows: DataFrame) -> DataFrame:
    """rows (seq_id, start, end, ...) with cluster: runs of intervals of a sequence that touch one another, whatever the order in a run."""
    before = Window.partitionBy("seq_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    return rows.withColumn("new_run", new).withColumn("cluster", F.sum("new_run").over(Window.partitionBy("seq_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))).drop("new_run")


def ordered_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows (seq_id, start, end) with the coordinates that a walk over b (seq_id, start, end, place) leaves them: seq_id, a_start, a_end, start, end.

    b's rows of the sequence are gone through by place (ties: start, end). One that overlaps the row as it is by then, and is strictly longer, takes
    its place, so that later ones are compared with that. Whatever a row can come to touches it in an unbroken run, so a run's rows of b
    are all that meet it.
    """
    cols = ["seq_id", "start", "end"]
    both = clusters(a.select(*cols).distinct().withColumn("place", F.lit(None).cast("long")).unionByName(b.select(*cols, F.col("place").cast("long"))))
    walk = both.filter("place is not null").groupBy("seq_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("place", "start", "end"))).alias("walk"))
    mine = both.filter("place is null").join(walk, ["seq_id", "cluster"], "left")
    own = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    step = lambda now, x: F.when(overlaps(now["start"], now["end"], x["start"], x["end"]) & (x["end"] - x["start"] > now["end"] - now["start"]), F.struct(x["start"].alias("start"), x["end"].alias("end"))).otherwise(now)
    last = F.when(F.col("walk").isNull(), own).otherwise(F.aggregate("walk", own, step))
    return mine.select("seq_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"), last.alias("last")).select("seq_id", "a_start", "a_end", "last.start", "last.end")


def merge_in_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """merge_versions with the walk of ordered_overlap: a as it comes out, and b's rows that overlap none of those; numbered anew."""
    kept = ordered_overlap(a, b).select("seq_id", "start", "end")
    only = interval_anti(b.select("seq_id", "start", "end").distinct(), kept.distinct())
    return number(kept.unionByName(only), "seq_id")
