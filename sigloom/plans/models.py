"""Forests over signature features, and principal components."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: n over the number of classes times the class's n."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("of_class"))
    whole = sizes.agg(F.sum("of_class").alias("n"), F.count(F.lit(1)).alias("k"))
    weights = sizes.crossJoin(F.broadcast(whole)).select(label, (F.col("n") / (F.col("k") * F.col("of_class"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)  # a row a class: a class's rows stay where they are


#: Fixed value: the forests' seed.
SEED = 25051989


def train_forest(rows: DataFrame, values: str = "features", label: str = "label", trees: int = 1000, depth: int = 30, seed: int = SEED) -> PipelineModel:
    """Trees over arrays of doubles; classes in name order, balanced weights, the square root of the features at each split."""
    vectors = balanced(rows, label).withColumn("vector", array_to_vector(F.col(values)))
    index = StringIndexer(inputCol=label, outputCol="class", stringOrderType="alphabetAsc", handleInvalid="skip")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="class", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=32, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[index, forest]).fit(vectors)


def predict(model: PipelineModel, rows: DataFrame, values: str = "features", id_: str = "id") -> DataFrame:
    """(id, label, p): every class's probability."""
    names = model.stages[0].labels
    scored = model.stages[1].transform(rows.withColumn("vector", array_to_vector(F.col(values))))
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("label"), vector_to_array("probability").alias("p"))
    return scored.select(id_, F.explode(pairs).alias("x")).select(id_, F.col("x.label").alias("label"), F.col("x.p").alias("p"))


def drawn(rows: DataFrame, group: int, id_: str = "id", seed: int = SEED) -> DataFrame:
    """rows with drawn: how often a row is in the sample of a group of trees, 0 for those that its trees don't see.

    Drawing n rows out of n gives each about as many as a Poisson number with mean 1. A hash of the id, the group and the seed says which, so that the
    sample is the same whenever it is asked for, however the rows are partitioned.
    """
    even = F.pmod(F.xxhash64(F.col(id_), F.lit(group), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    below, steps = 0.0, []
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        steps.append(below)
    return rows.withColumn("drawn", F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= even)))


def train_bagged(rows: DataFrame, groups: int = 10, values: str = "features", label: str = "label", id_: str = "id", trees: int = 1000, depth: int = 30, seed: int = SEED) -> list[PipelineModel]:
    """A forest in groups of trees, each group grown on a sample of its own, so that it is known which rows it didn't see."""
    vectors = balanced(rows, label).withColumn("vector", array_to_vector(F.col(values)))
    index = StringIndexer(inputCol=label, outputCol="class", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    out = []
    for g in range(groups):  # a model a group
        share = trees // groups + (g < trees % groups)
        if share:
            sample = drawn(vectors, g, id_, seed).filter("drawn > 0").withColumn("weight", F.col("weight") * F.col("drawn"))
            forest = RandomForestClassifier(featuresCol="vector", labelCol="class", weightCol="weight", numTrees=share, maxDepth=depth, maxBins=32, featureSubsetStrategy="sqrt", seed=seed + g, bootstrap=False)
            out.append(PipelineModel(stages=[index, forest.fit(index.transform(sample))]))
    return out


def predict_bagged(groups: list[PipelineModel], rows: DataFrame, values: str = "features", id_: str = "id") -> DataFrame:
    """(id, label, p): the mean over all trees."""
    return _mean(groups, lambda _: rows, values, id_)


def out_of_bag(groups: list[PipelineModel], rows: DataFrame, values: str = "features", id_: str = "id", seed: int = SEED) -> DataFrame:
    """(id, label, p) of the rows that train_bagged learned from: the mean over the trees that didn't see the row; rows that all of them saw are left out."""
    return _mean(groups, lambda g: drawn(rows, g, id_, seed).filter("drawn = 0"), values, id_)


def _mean(groups: list[PipelineModel], part, values: str, id_: str) -> DataFrame:
    every = None
    for g, model in enumerate(groups):
        n = model.stages[1].getNumTrees
        own = predict(model, part(g), values, id_).withColumn("p", F.col("p") * n).withColumn("n", F.lit(n))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(id_, "label").agg((F.sum("p") / F.sum("n")).alias("p"))


def out_of_bag_score(groups: list[PipelineModel], rows: DataFrame, values: str = "features", label: str = "label", id_: str = "id", seed: int = SEED) -> float | None:
    """The share of rows whose most probable label, by the trees that didn't see them, is their own; ties go to the first name. None if all trees saw all rows."""
    best = out_of_bag(groups, rows, values, id_, seed).groupBy(id_).agg(F.min(F.struct((-F.col("p")).alias("less"), F.col("label").alias("guess"))).alias("b"))
    right = best.join(rows.select(id_, label), id_).agg(F.avg((F.col("b.guess") == F.col(label)).cast("double"))).first()
    return right[0]


def principal_components(rows: DataFrame, values: str, k: int, id_: str = "id") -> DataFrame:
    """(id, pcs) for tables that have fewer columns than rows."""
    vectors = rows.select(id_, array_to_vector(F.col(values).cast("array<double>")).alias("vector"))
    model = PCA(k=k, inputCol="vector", outputCol="out").fit(vectors)
    return model.transform(vectors).select(id_, vector_to_array("out").alias("pcs"))
