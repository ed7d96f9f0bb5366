"""Detection by ranges equals detection by whole sequences."""

import random

from sigloom.operators import hits as H
from sigloom.operators import ranges


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ranges_give_what_whole_sequences_give(spark):
    draw = random.Random(7)
    found = []
    for seq, count, far in (("hot", 3000, 200_000), ("dense", 400, 3000), ("few", 5, 90_000), ("long", 40, 400_000)):
        for _ in range(count):
            start = draw.randint(-50, far)
            found.append((seq, draw.choice("NNC"), start, start + draw.choice([0, 30, 90, 150, 400, 40_000 if seq == "long" else 60]), draw.choice([19.0, 21.0, 50.0])))
    # Gaps and reaches of just the limits, over the ends of ranges.
    edge = ranges.RANGE
    for k, gap in enumerate((59, 60, 61)):
        found += [(f"e{k}", "N", edge - 400, edge - 30, 50.0), (f"e{k}", "N", edge - 30 + gap, edge + 300, 50.0), (f"e{k}", "C", edge + 300 + 140 + gap, edge + 700, 50.0), (f"e{k}", "C", edge + 300 + 140 + gap, edge + 650, 50.0)]
    hits = spark.createDataFrame(found, "seq_id string, hit_id string, start long, end long, bitscore double").cache()
    assert rows(ranges.detect_domains(hits), "seq_id", "domain_nr", "start", "end") == rows(H.detect_domains(hits), "seq_id", "domain_nr", "start", "end")
    good = H.filter_hits(hits)
    n, c = good.filter("hit_id = 'N'"), good.filter("hit_id = 'C'")
    for size in (64, 5000):
        assert rows(ranges.islands(n, size), "seq_id", "start", "end", "parts") == rows(H.islands(n), "seq_id", "start", "end", "parts")
    key = lambda df: sorted(str(tuple(r[x] for x in ("seq_id", "start", "end", "parts", "c_start", "c_end"))) for r in df.collect())
    assert key(ranges.pair_forward(H.islands(n), c)) == key(H.pair_forward(H.islands(n), c))
