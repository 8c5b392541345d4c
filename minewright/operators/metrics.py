"""Accuracy and class reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accuracy(df: DataFrame, predicted: str = "prediction", label: str = "label", subset: str | None = None) -> DataFrame:
    """One row: n, accuracy; with a boolean column also n_subset, subset_accuracy. Rows without a label don't count; a null prediction is wrong."""
    right = F.coalesce((F.col(predicted) == F.col(label)).cast("double"), F.lit(0.0))
    rows = df.filter(F.col(label).isNotNull())
    found = [F.count("*").alias("n"), F.avg(right).alias("accuracy")]
    if subset:
        found += [F.count_if(F.col(subset)).alias("n_subset"), F.avg(F.when(F.col(subset), right)).alias("subset_accuracy")]
    return rows.agg(*found)


def class_report(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, n_classes, n_total: one row per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.countDistinct(label).alias("n_classes"), F.count("*").alias("n_total"))
    return counts.crossJoin(F.broadcast(total))


def split_report(train: DataFrame, test: DataFrame, predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row: n_train, n_test, n_classes (of both sides), n and accuracy of the predictions (label, prediction)."""
    sides = train.select(label, F.lit(True).alias("_train")).unionByName(test.select(label, F.lit(False).alias("_train")))
    sizes = sides.agg(F.count_if("_train").alias("n_train"), F.count_if(~F.col("_train")).alias("n_test"), F.countDistinct(label).alias("n_classes"))
    return sizes.crossJoin(F.broadcast(accuracy(predictions)))


def class_head(df: DataFrame, key: str, n: int = 5, label: str = "label") -> DataFrame:
    """The first n rows by key of each class, with rank."""
    order = W.partitionBy(label).orderBy(key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
