"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_caches: dict[str, Callable[[], None]] = {}
#: Rows of an Arrow batch: rows hold whole texts, and a task holds a batch on both sides.
BATCH_ROWS = 1000
#: Spark's setting by which a query's shuffle files go with its end, instead of when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a task works on at once.
PART_BYTES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: the warehouse, or on one machine alone a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sigloom-scratch"
    if not folder:
        if "folder" not in _own:
            _own["folder"] = "file://" + tempfile.mkdtemp(prefix="sigloom-")
        folder = _own["folder"]
    return folder


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most in this session, unless it asks for fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


class Scratch:
    """Tables in the shared folder that one run writes, reads again and drops after their last use: cuts lineage, survives lost executors.

    What was shuffled for a table is deleted once that is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        before = self.spark.conf.get(TIDY, None)
        self.spark.conf.set(TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder."""
    return Scratch(df.sparkSession).write(df, name)


def in_parts(batches: Iterator[pa.RecordBatch], column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts (binary) of one part take at most so many bytes, or are one: all that a task holds at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def own_caches(name: str) -> None:
    """Forget what a Python worker remembers for other operators: called by a task, as workers are used again by later stages."""
    for other, forget in _caches.items():
        if other != name:
            forget()


def cached_by(name: str, forget: Callable[[], None]) -> None:
    """Tell own_caches how an operator's memory is emptied."""
    _caches[name] = forget


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def crc32_of_id(column: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frequent(counts: DataFrame, key: str, count: str, limit: int) -> list[tuple]:
    """(key, count) of the most frequent keys, as many whole steps of frequency as limit allows; counts has each key once.

    Where the first step alone is more than that, a part of it drawn by hash.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 4).cast("int")
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:
        held += n
        if held > limit:
            break
        least = at
    if not sizes:
        return []
    some = step >= least if least is not None else (step == sizes[0][0]) & (F.pmod(F.xxhash64(key), F.lit(sizes[0][1])) < int(limit * 0.9))
    return [(r[key], r[count]) for r in counts.filter(some).select(key, count).collect()]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable. Alternating large and small stars.

    Every pass keeps the components and is written to the shared folder; no node's neighbours gather in one task.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark_of = f"stars-{uuid.uuid4().hex}"
    now = scratch.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{mark_of}-0")
    before, mark, turn = None, sign(now), 0
    while mark != before:
        wide = both(now)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = wide.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        turn += 1
        now = scratch.write(small.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{mark_of}-{turn}")
        scratch.drop(f"{mark_of}-{turn - 1}")
        before, mark = mark, sign(now)
    own = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(own)
