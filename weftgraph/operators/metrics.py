"""Evaluation of rankings, sets and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b, or a constant where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b == 0, 1).otherwise(b))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per task of rows (task, item, rank) and gold (task, item): whether any gold item is in the first k; tasks without
    gold count as found."""
    hits = ranked.join(gold.select("task", "item").distinct(), ["task", "item"], "left_semi").groupBy("task").agg(F.min("rank").alias("first"))
    tasks = ranked.select("task").distinct().join(gold.select("task", F.lit(1).alias("has")).distinct(), "task", "left").join(hits, "task", "left")
    return tasks.select("task", *[F.when(F.col("has").isNull() | (F.col("first") <= k), 1).otherwise(0).alias(f"recall_{k}") for k in ks], F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def mrr(per_task: DataFrame) -> DataFrame:
    return per_task.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 4).alias("mrr"))


def precision_recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Per task of sets (task, item): precision, recall and F1. Both empty: 1, 1, 1; nothing found: 0, 0, 0; no gold: 0, 1, 0."""
    f, g = found.select("task", "item").distinct(), gold.select("task", "item").distinct()
    both = f.withColumn("f", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["task", "item"], "full_outer")
    n = both.groupBy("task").agg(F.count("f").alias("nf"), F.count("g").alias("ng"), F.count(F.col("f") + F.col("g")).alias("hits"))
    p = F.when((F.col("nf") == 0) & (F.col("ng") == 0), 1.0).otherwise(ratio(F.col("hits"), F.col("nf"), 0.0))
    r = F.when(F.col("ng") == 0, 1.0).otherwise(ratio(F.col("hits"), F.col("ng"), 1.0))
    out = n.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("hits") == 0, F.when((F.col("nf") == 0) & (F.col("ng") == 0), 1.0).otherwise(0.0)).otherwise(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"), 0.0))
    return out.select("task", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def brier(predictions: DataFrame) -> DataFrame:
    """Mean squared error of (p, outcome), and mean confidence where right and where wrong."""
    p, y = F.col("p"), F.col("outcome")
    return predictions.agg(F.count("*").alias("n"), F.round(F.avg((p - y) * (p - y)), 4).alias("brier"), F.round(F.avg(F.when(y == 1, p)), 4).alias("mean_correct"), F.round(F.avg(F.when(y == 0, p)), 4).alias("mean_incorrect"))


def calibration(predictions: DataFrame, buckets: int = 10) -> DataFrame:
    """(bucket, low, high, n, mean_p, accuracy) for every bucket; empty ones have their midpoint and accuracy 0."""
    width = 1.0 / buckets
    b = F.floor(F.least(F.greatest("p", F.lit(0.0)), F.lit(0.9999)) / width).cast("int")
    own = predictions.withColumn("bucket", b).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("outcome").alias("accuracy"))
    every = predictions.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    k = F.col("bucket")
    return every.join(own, "bucket", "left").select("bucket", F.round(k * width, 4).alias("low"), F.round((k + 1) * width, 4).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean_p", (k + 0.5) * width), 4).alias("mean_p"), F.round(F.coalesce("accuracy", F.lit(0.0)), 4).alias("accuracy"))


def negative_precision(found: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Per task the share of unwanted items that stayed out, and of found items that are unwanted."""
    f, u = found.select("task", "item").distinct(), unwanted.select("task", "item").distinct()
    both = f.withColumn("f", F.lit(1)).join(u.withColumn("u", F.lit(1)), ["task", "item"], "full_outer")
    n = both.groupBy("task").agg(F.count("f").alias("nf"), F.count("u").alias("nu"), F.count(F.col("f") + F.col("u")).alias("bad"))
    return n.select("task", F.round(1 - ratio(F.col("bad"), F.col("nu"), 0.0), 4).alias("negative_precision"), F.round(ratio(F.col("bad"), F.col("nf"), 0.0), 4).alias("false_inclusion"))


def percentiles(df: DataFrame, key: str, value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per key the percentiles of a value, linear between neighbours, and its mean and greatest; 2 digits."""
    return df.groupBy(key).agg(*[F.round(F.percentile(value, F.lit(q)), 2).alias(f"p{round(q * 100)}") for q in at], F.round(F.avg(value), 2).alias("mean"), F.round(F.max(value), 2).alias("max"))
