"""Ranking and evaluation of predictions: scores (id, label, p), truths (id, label, ordinal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reverse_rank(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rk", F.rank().over(Window.partitionBy("id").orderBy(F.desc("p"))))


def best(scores: DataFrame, ties: str = "first") -> DataFrame:
    """Each id's label with the highest p; of ties the first or the last in name order. No label if all p are 0."""
    name = F.asc("label") if ties == "first" else F.desc("label")
    w = Window.partitionBy("id").orderBy(F.desc("p"), name)
    return scores.withColumn("rk", F.row_number().over(w)).filter("rk = 1 and p > 0").drop("rk")


def top_wide(scores: DataFrame, n: int) -> DataFrame:
    """id, prediction_1, confidence_1, ... prediction_n, confidence_n."""
    w = Window.partitionBy("id").orderBy(F.desc("p"), "label")
    ranked = scores.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)
    pick = lambda c, i: F.max(F.when(F.col("rk") == i, F.col(c)))
    return ranked.groupBy("id").agg(*[x for i in range(1, n + 1) for x in (pick("label", i).alias(f"prediction_{i}"), pick("p", i).alias(f"confidence_{i}"))])


def accuracy(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """label, correct, total: true labels count in order up to the predicted one, which counts as correct; all of them if it isn't there."""
    both = truths.join(predicted.select("id", F.col("label").alias("guess")), "id")
    hit = F.min(F.when(F.col("label") == F.col("guess"), F.col("ordinal"))).over(Window.partitionBy("id"))
    walked = both.withColumn("stop", hit).filter("stop is null or ordinal <= stop")
    return walked.groupBy("label").agg(F.sum((F.col("label") == F.col("guess")).cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"))


def exact_mean(p: Column) -> Column:
    """A mean that doesn't depend on the order of adding: probabilities are summed as decimals of 18 places."""
    exact = p.cast("decimal(20,18)")
    return F.sum(exact).cast("double") / F.count(exact)


def confidence(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """label, right, n, mean, deviation of the highest p, apart for right and wrong predictions; deviation null below two."""
    known = truths.groupBy("id").agg(F.collect_set("label").alias("labels"))
    marked = predicted.join(known, "id").withColumn("right", F.array_contains("labels", F.col("label")))
    return marked.groupBy("label", "right").agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col("p")).alias("mean"), F.stddev_samp("p").alias("deviation"))


def confusion(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """guess, actual (the first true label), n."""
    first = truths.groupBy("id").agg(F.min_by("label", "ordinal").alias("actual"))
    return predicted.join(first, "id").groupBy(F.col("label").alias("guess"), "actual").agg(F.count(F.lit(1)).alias("n"))


def pair_metrics(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1; undefined ones are null. A miss is counted for each true label of a wrong prediction."""
    known = truths.groupBy("id").agg(F.collect_set("label").alias("labels"))
    marked = predicted.join(known, "id").withColumn("right", F.array_contains("labels", F.col("label")))
    own = marked.groupBy("label").agg(F.sum(F.col("right").cast("long")).alias("tp"), F.sum((~F.col("right")).cast("long")).alias("fp"))
    missed = marked.filter(~F.col("right")).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("fn"))
    joined = own.join(missed, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return joined.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def three(value: Column) -> Column:
    """Three decimals; N/A where undefined."""
    return F.coalesce(F.format_string("%.3f", value), F.lit("N/A"))


def overall_accuracy(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """correct, total: ids whose label is any of their true ones."""
    known = truths.groupBy("id").agg(F.collect_set("label").alias("labels"))
    return predicted.join(known, "id").agg(F.sum(F.array_contains("labels", F.col("label")).cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"))


def accuracy_table(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """substrate, accuracy as text: one row for all, one for each true label."""
    every = overall_accuracy(predicted, truths).withColumn("label", F.lit("all")).unionByName(accuracy(predicted, truths))
    return every.select(F.col("label").alias("substrate"), three(F.try_divide(F.col("correct").cast("double"), F.col("total"))).alias("accuracy"))


def confidence_table(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """substrate, and mean and deviation of the highest p as text, for right and for wrong predictions: one row for all, one for each predicted label."""
    known = truths.groupBy("id").agg(F.collect_set("label").alias("labels"))
    marked = predicted.join(known, "id").withColumn("right", F.array_contains("labels", F.col("label")))
    of = lambda side: F.when(F.col("right") if side else ~F.col("right"), F.col("p"))
    names = (("confidence_correct", exact_mean(of(True))), ("stdev_correct", F.stddev_samp(of(True))), ("confidence_incorrect", exact_mean(of(False))), ("stdev_incorrect", F.stddev_samp(of(False))))
    return marked.rollup("label").agg(F.grouping("label").alias("g"), *[x.alias(n) for n, x in names]).select(F.when(F.col("g") == 1, "all").otherwise(F.col("label")).alias("substrate"), *[three(F.col(n)).alias(n) for n, _ in names])


def confusion_matrix(predicted: DataFrame, truths: DataFrame, labels: list[str]) -> DataFrame:
    """guess and one column of counts for each label, rows and columns in the order of labels."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("guess"))
    wide = confusion(predicted, truths).filter(F.col("guess").isin(labels)).groupBy("guess").pivot("actual", labels).agg(F.sum("n"))
    every = F.broadcast(predicted.sparkSession.createDataFrame([(x,) for x in labels], "guess string"))
    return every.join(wide, "guess", "left").na.fill(0).orderBy(place)


def pair_report(scores: DataFrame, truths: DataFrame) -> DataFrame:
    """label (and ``all``) with tp, fp, tn, fn, precision, recall, f1, and mean and deviation of probabilities and of ranks; null where undefined.

    The best label of an id is right if it is among the true ones. Right: one tp for it, and one tn for each label that isn't true. Wrong: one fp
    for it, and one fn for each true label. Counts of tn and fn go to the label itself, their probabilities to the best one. Ranks
    count from 1, the highest probability first, apart for true and other labels.
    """
    true = truths.select("id", "label", F.lit(True).alias("true")).distinct()
    top = best(scores).select("id", F.col("label").alias("best"))
    hit = top.join(true.select("id", F.col("label").alias("best"), F.lit(True).alias("hit")), ["id", "best"], "left").select("id", "best", F.coalesce("hit", F.lit(False)).alias("right"))
    rows = reverse_rank(scores).join(true, ["id", "label"], "left").join(hit, "id", "left").withColumn("true", F.coalesce("true", F.lit(False)))
    own, right, is_true = F.col("label") == F.col("best"), F.col("right"), F.col("true")
    kinds = {"tp": right & own, "fp": ~right & own, "tn": right & ~is_true, "fn": ~right & is_true}
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    stats = lambda name, value: (F.avg(value).alias(f"mean_{name}"), F.stddev_samp(value).alias(f"sd_{name}"))
    by_label = [*[count(kinds[k]).alias(k) for k in kinds], *stats("rank_correct", F.when(is_true, F.col("rk"))), *stats("rank_incorrect", F.when(~is_true, F.col("rk")))]
    by_best = [x for k in kinds for x in stats(f"prob_{k}", F.when(kinds[k], F.col("p")))]
    name = lambda key: F.when(F.grouping(key) == 1, F.lit("all")).otherwise(F.col(key)).alias("label")
    counts = rows.rollup("label").agg(name("label").alias("name"), *by_label).drop("label").withColumnRenamed("name", "label")
    probs = rows.filter("best is not null").rollup("best").agg(name("best").alias("name"), *by_best).drop("best").withColumnRenamed("name", "label")
    out = counts.join(probs, "label", "left")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return out.withColumns({"precision": precision, "recall": recall, "f1": F.when(precision + recall > 1e-9, 2 * precision * recall / (precision + recall))})
