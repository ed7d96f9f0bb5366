"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic. They stand in the order of their text's hash; groups that share the
hash's leading bits form one atom, so the number of atoms is bounded whatever the input. The smallest
capacity that a greedy pass can keep with the given number of shards is found by binary search over the
atoms' sizes, and the order is cut within it, as near to even shares as it allows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.util import written

#: 2 ** ATOM_BITS atoms at most; their sums (two numbers each) are all that reaches the driver.
ATOM_BITS = 16
#: Rows of a shard are numbered in so many parts, side by side.
SLOT_PARTS = 1024


def greedy_cuts(ends: list[int], lo: int, hi: int, capacity: int, shards: int) -> list[int] | None:
    """Fill shard after shard with atoms lo..hi-1 up to the capacity; the cuts, or None if the shards don't suffice."""
    cuts, at = [], lo
    for _ in range(shards):
        full = bisect_right(ends, (ends[at - 1] if at else 0) + capacity, lo=at, hi=hi)
        if full == at and at < hi:
            return None
        at = full
        cuts.append(at)
    return cuts if at == hi else None


def smallest_capacity(ends: list[int], lo: int, hi: int, shards: int) -> int:
    total = (ends[hi - 1] if hi else 0) - (ends[lo - 1] if lo else 0) if hi > lo else 0
    least, most = -(-total // shards), total
    while least < most:
        mid = (least + most) // 2
        if greedy_cuts(ends, lo, hi, mid, shards) is None:
            least = mid + 1
        else:
            most = mid
    return least


def even_cuts(ends: list[int], lo: int, hi: int, capacity: int, shards: int) -> list[int]:
    """Cuts that keep a feasible capacity, each the one nearest to an even share of what is left from which the other shards still suffice."""
    end = lambda c: ends[c - 1] if c else 0
    starts = [hi]  # where the last 0, 1, 2 ... shards begin at the earliest
    for _ in range(shards - 1):
        starts.append(max(lo, bisect_left(ends, end(starts[-1]) - capacity, lo=0, hi=starts[-1]) + 1) if end(starts[-1]) - end(lo) > capacity else lo)
    cuts, at = [], lo
    for left in range(shards - 1, -1, -1):
        most = bisect_right(ends, end(at) + capacity, lo=at, hi=hi)
        share = end(at) + (end(hi) - end(at)) / (left + 1)
        near = bisect_left(ends, share, lo=at, hi=hi)
        options = [min(max(c, at, starts[left]), most) for c in (near, near + 1)]
        at = min(options, key=lambda c: abs(end(c) - share)) if left else hi
        cuts.append(at)
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """End (exclusive) of each shard over the ordered sizes; the largest shard is as small as it can be.

    Where one atom alone sets that capacity, it gets a shard of its own and both sides are cut anew with the
    remaining shards, so that the others still come out near equal.
    """
    ends = list(accumulate(sizes))

    def cut(lo: int, hi: int, k: int) -> list[int]:
        capacity = smallest_capacity(ends, lo, hi, k)
        top = max(range(lo, hi), key=lambda i: sizes[i], default=None)
        if top is not None and k > 1 and sizes[top] == capacity:
            options = []
            for left in range(k):
                right = k - 1 - left
                if (left == 0) == (top == lo) and (right == 0) == (top == hi - 1):
                    load = max([smallest_capacity(ends, a, b, n) for a, b, n in ((lo, top, left), (top + 1, hi, right)) if n], default=0)
                    options.append((load, left))
            if options:
                left = min(options)[1]
                return (cut(lo, top, left) if left else []) + [top + 1] + (cut(top + 1, hi, k - 1 - left) if left < k - 1 else [])
        return even_cuts(ends, lo, hi, capacity, k)

    return cut(0, len(sizes), shards)


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law), one row per document.

    size: UTF-8 bytes of the text plus 1. A null text has no bytes: size 1, crc 0; null and empty texts
    are one group. Null or repeated doc_ids are rows like others; slots are gapless from 0 in each shard. Other
    columns are ignored. With fewer groups than shards some shards stay empty.
    """
    body = F.col(text).cast("binary")
    narrow = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - ATOM_BITS).cast("int").alias("atom"),
        ).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SLOT_PARTS)).cast("int")),
        "shard-rows",
    )
    atoms = sorted((r["atom"], r["size"]) for r in narrow.groupBy("atom").agg(F.sum("size").alias("size")).collect())
    cuts = minimax_cuts([size for _, size in atoms], shards)
    firsts = [atoms[c][0] if c < len(atoms) else 1 << ATOM_BITS for c in cuts[:-1]]
    shard = sum((F.when(F.col("atom") >= first, 1).otherwise(0) for first in firsts), F.lit(0)).cast("int")
    dealt = narrow.withColumn("shard", shard)
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = dealt.withColumn("in_part", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1)
    return numbered.join(F.broadcast(before), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_part")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
