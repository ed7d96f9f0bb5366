"""Domain detection for sequences of any size: ranges of places scanned each on its own, with a state carried from range to range.

``hits`` takes a sequence's hits as one window. Here a sequence is cut into ranges of RANGE places by where hits start, a range is a window, and
one row for each range that has hits says what the next ones need to know. The results are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.hits import BIN, GAP, LEAST_LENGTH, REACH, filter_hits

RANGE = 1 << 14


def islands(hits: DataFrame, size: int = RANGE) -> DataFrame:
    """As hits.islands: seq_id, start, end, parts.

    A range's first hit is told to be new or not by the last hit of the range with hits before it; the islands that begin in earlier ranges are
    summed up over the ranges' rows.
    """
    cut = hits.select("seq_id", "start", "end", F.floor(F.col("start") / size).alias("range"))
    own = Window.partitionBy("seq_id", "range").orderBy("start", "end")
    new = F.when(F.col("start") - F.lag("end").over(own) < GAP, 0).otherwise(1)
    marked = cut.withColumns({"place": F.row_number().over(own), "new": new}).withColumn("inner", F.sum(F.when(F.col("place") > 1, F.col("new")).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    states = marked.groupBy("seq_id", "range").agg(F.min("start").alias("first"), F.max_by("end", F.struct("start", "end")).alias("last"), F.max("inner").alias("begun"))
    along = Window.partitionBy("seq_id").orderBy("range")
    told = states.withColumn("opens", F.when(F.col("first") - F.lag("last").over(along) < GAP, 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("opens") + F.col("begun")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.select("seq_id", "range", (before + F.col("opens")).alias("base"))
    placed = marked.join(told, ["seq_id", "range"]).withColumn("island", F.col("base") + F.col("inner"))
    return placed.groupBy("seq_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("island")


def pair_forward(n_hits: DataFrame, c_hits: DataFrame) -> DataFrame:
    """As hits.pair_forward: n_hits (seq_id, start, end, parts) with c_start and c_end.

    A C hit is filed under the stretch that it starts in, an N hit under those within its reach, two at most. Of C hits with one start only the
    first in order of end is filed, so that an N hit meets fewer than REACH of them.
    """
    starts = c_hits.groupBy("seq_id", F.col("start").cast("long").alias("c_start")).agg(F.min("end").cast("long").alias("c_end")).withColumn("bin", F.floor(F.col("c_start") / BIN))
    near = n_hits.select("seq_id", F.col("end").alias("at")).distinct().withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / BIN), F.floor((F.col("at") + REACH) / BIN))))
    within = (F.col("c_start") > F.col("at")) & (F.col("c_start") - F.col("at") < REACH)
    best = near.join(starts, ["seq_id", "bin"]).filter(within).groupBy("seq_id", F.col("at").alias("end")).agg(F.min(F.struct("c_start", "c_end")).alias("c"))
    return n_hits.join(best, ["seq_id", "end"], "left").select("seq_id", "start", "end", "parts", "c.c_start", "c.c_end")


def number(domains: DataFrame, key: str, size: int = RANGE) -> DataFrame:
    """As hits.number: domain_nr counts a sequence's domains by start and end; those of earlier ranges are summed up."""
    cut = domains.withColumn("range", F.floor(F.col("start") / size))
    counts = cut.groupBy(key, "range").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(key, "range").orderBy("start", "end"))
    placed = cut.withColumn("own", own).join(counts.select(key, "range", before.alias("before")), [key, "range"])
    return placed.select(*domains.columns, (F.col("own") + F.col("before")).cast("int").alias("domain_nr"))


def detect_domains(hits: DataFrame) -> DataFrame:
    """As hits.detect_domains: seq_id, domain_nr, start, end."""
    good = filter_hits(hits)
    paired = pair_forward(islands(good.filter("hit_id = 'N'")), good.filter("hit_id = 'C'"))
    whole = paired.select("seq_id", "start", F.coalesce("c_end", "end").alias("end")).filter(F.col("end") - F.col("start") > LEAST_LENGTH)
    return number(whole, "seq_id")
