"""Principal components of tables that are wider than long: through the products of their rows.

Columns are cut into blocks; a task holds all rows of one block, takes the columns' means off and multiplies it with itself. The sum of these
products is as large as there are rows squared; its eigenvectors, times the roots of its eigenvalues, are the rows' components. The columns' loadings follow
block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block, and rows of a table at most: the products of all rows are held at once.
BLOCK, MOST_ROWS = 2048, 8000


def array_blocks(rows: DataFrame, values: str, id_: str = "id", block: int = BLOCK) -> DataFrame:
    """(block, id, first, cells) of rows (id, an array of numbers): the array in pieces; first is the first cell's column."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(block)))
    cut = rows.select(F.col(id_).alias("id"), F.col(values).cast("array<double>").alias("whole"), start.alias("first"))
    return cut.select((F.col("first") / block).cast("long").alias("block"), "id", F.col("first").cast("long").alias("first"), F.slice("whole", F.col("first") + 1, F.lit(block)).alias("cells"))


def entry_blocks(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, id, first, cells) of entries (id, column, value), columns being counted from 0."""
    own = F.array_sort(F.collect_list(F.struct("column", F.col("value").cast("double").alias("value"))))
    grouped = entries.groupBy((F.col("column") / block).cast("long").alias("block"), "id").agg(own.alias("own"))
    return grouped.select("block", "id", F.col("own")[0]["column"].cast("long").alias("first"), F.col("own.value").alias("cells"))


def centred(part: pd.DataFrame) -> np.ndarray:
    sizes = part["cells"].map(len)
    if sizes.nunique() > 1:
        raise ValueError("rows differ in their columns")
    cells = np.stack(part["cells"].to_numpy())
    return cells - cells.mean(axis=0)


def row_products(blocks: DataFrame, ids: list) -> np.ndarray:
    """The products of all pairs of centred rows; ids: all rows, in order."""
    place = {x: k for k, x in enumerate(ids)}

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        at = part["id"].map(place).to_numpy()
        if len(set(at)) != len(ids) or len(at) != len(ids):
            raise ValueError("a row is missing or repeated in a block")
        x = np.empty((len(ids), len(part["cells"].iloc[0])))
        x[at] = centred(part)
        return pd.DataFrame({"i": np.arange(len(ids)), "products": list(x @ x.T)})

    partial = blocks.groupBy("block").applyInPandas(multiply, "i int, products array<double>")

    def add(parts):
        for own in parts:
            for i, rows in own.groupby("i")["products"]:
                yield pd.DataFrame({"i": [i], "products": [np.sum(np.stack(rows.to_numpy()), axis=0)]})

    # Sums of a task's blocks, then of all tasks', of one row at a time.
    summed = partial.mapInPandas(add, "i int, products array<double>").groupBy("i").applyInPandas(lambda own: next(add([own])), "i int, products array<double>")
    out = np.zeros((len(ids), len(ids)))
    for r in summed.toLocalIterator():
        out[r["i"]] = r["products"]
    return out


def fit_wide(blocks: DataFrame, k: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(ids, scores, eigenvalues): rows by components, the largest first; a component's largest score in size is positive. k is cut to the rank."""
    ids = sorted(r[0] for r in blocks.select("id").distinct().limit(MOST_ROWS + 1).collect())
    if len(ids) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: use principal_components, which wants fewer columns than rows")
    if not ids:
        return [], np.zeros((0, 0)), np.zeros(0)
    values, vectors = np.linalg.eigh(row_products(blocks, ids))
    order = np.argsort(-values)[:k]
    order = order[values[order] > max(values.max(), 0) * 1e-12]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return ids, vectors * np.sqrt(values), values


def wide_components(blocks: DataFrame, k: int) -> DataFrame:
    """(id, pcs) of a table's blocks: k components of each row, fewer if the table has fewer."""
    ids, scores, _ = fit_wide(blocks, k)
    rows = [(i, [float(x) for x in own]) for i, own in zip(ids, scores)]
    return blocks.sparkSession.createDataFrame(rows, f"id {blocks.schema['id'].dataType.simpleString()}, pcs array<double>")


def wide_loadings(blocks: DataFrame, k: int) -> DataFrame:
    """(column, mean, loadings): what a new row's centred columns are multiplied by, column by column."""
    ids, scores, values = fit_wide(blocks, k)
    place = {x: i for i, x in enumerate(ids)}

    def project(part: pd.DataFrame) -> pd.DataFrame:
        own = scores[part["id"].map(place).to_numpy()]
        means = np.stack(part["cells"].to_numpy()).mean(axis=0)
        return pd.DataFrame({"column": part["first"].min() + np.arange(len(means)), "mean": means, "loadings": list(centred(part).T @ own / values)})

    return blocks.groupBy("block").applyInPandas(project, "column long, mean double, loadings array<double>")


def projected(blocks: DataFrame, loadings: DataFrame) -> DataFrame:
    """(id, pcs) of new rows' blocks by the loadings of a fitted table."""
    cells = blocks.select("id", "first", F.posexplode("cells").alias("at", "value")).select("id", (F.col("first") + F.col("at")).alias("column"), "value")
    parts = cells.join(loadings, "column").select("id", F.posexplode("loadings").alias("k", "w"), (F.col("value") - F.col("mean")).alias("x"))
    sums = parts.groupBy("id", "k").agg(F.sum(F.col("w") * F.col("x")).alias("pc"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pc"))), lambda x: x["pc"]).alias("pcs"))
