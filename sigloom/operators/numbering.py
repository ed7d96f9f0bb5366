"""Row numbers within strata without sorting a stratum in one task.

Rows are dealt into parts by the first digits of their order key's hash; the parts are counted, the counts are summed up to offsets, and rows
are numbered within their part. The numbers are those of one sort of the whole stratum by (hash, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that name a part: a stratum falls into 16 ** DIGITS of them.
DIGITS = 3


def numbered(rows: DataFrame, stratum: list[str], id_: Column, number: str = "rk", total: str = "n") -> DataFrame:
    """rows with number (from 1, in the order of md5(id), id within the stratum) and total (the stratum's rows). Null strata are one stratum."""
    keyed = rows.withColumns({"_hash": F.md5(id_.cast("string")), "_id": id_}).withColumn("_part", F.coalesce(F.left("_hash", F.lit(DIGITS)), F.lit("")))
    strata = [F.col(f"`{c}`") for c in stratum]
    counts = keyed.groupBy(*strata, "_part").agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*strata)
    before = F.sum("_c").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[c.alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(over).alias(total))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(strata):
        same = same & c.eqNullSafe(F.col(f"_s{i}"))
    own = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("_hash", "_id"))
    ranked = keyed.withColumn("_own", own).join(offsets, same)
    return ranked.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(number), total)
