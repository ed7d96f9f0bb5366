"""From raw documents to packed training windows: STAGES applied one after another to the documents table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import decontam, jaccard_join, langid, packing, secrets
from sigloom.llm.util import table, written

#: A document is rejected if it has no letter, or if no language gets so large a share of its positions' probability.
LEAST_SHARE = 0.4
MASK = "[secret]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels have; the others go, those with a null text or without a letter among them. Null ids and repeated rows stay rows of their own."""
    out = langid.predict_language(docs)
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id, a number of each row's own: its file's and its place in there, the same whenever it is read. What isn't read from files is written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = written(docs, "rows")
    placed = docs.select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_index"))
    paths = sorted(r[0] for r in placed.select("row_file").distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "file_no long, row_file string")
    return placed.join(F.broadcast(files), "row_file").select(*docs.columns, (F.shiftleft("file_no", 40) + F.col("row_index")).alias("row_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles alike to 0.8 or more: the one with the smallest doc_id, a null one last."""
    rows = numbered(docs)
    links = jaccard_join.link_documents(rows, n=5, percent=80, doc_id="row_id").select(F.col("doc_id").alias("row_id"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    first = links.join(rows.select("row_id", "doc_id"), "row_id").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first.row_id"), "row_id", "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, items without an id included."""
    rows = numbered(docs)
    items = table(spark, sf_dir, "benchmark").select(F.xxhash64("text").alias("item_id"), "text")
    leaks = decontam.find_leaks(rows, items, doc_id="row_id").select(F.col("doc_id").alias("row_id")).distinct()
    return rows.join(leaks, "row_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars brought up to date."""
    out = secrets.scan_secrets(docs, mask=MASK)
    return out.withColumn("n_chars", F.when(F.col("spans") != "", F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens; a null or empty text is one piece of one token."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("secret scans", without_secrets), ("packing", packed)]
#: Language ID, edit verification and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each over all that the one before it kept, which is written in between: pieces of windows, as the last stage gives them.

    Nulls, repeated rows and empty texts are as the stages say; an empty table gives none. Other columns than those of documents are passed on up to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
