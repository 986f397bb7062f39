"""Vectors as arrays, and the per-query softmax family as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def mean_pool(table: DataFrame, key: str, vector: str, mask: Column | None = None) -> DataFrame:
    """Mean of the vectors of a key, weighed by a 0/1 mask (none: all ones), element by element."""
    m = F.lit(1.0) if mask is None else mask.cast("double")
    long = table.select(key, m.alias("_m"), F.posexplode(vector).alias("_i", "_x"))
    means = long.groupBy(key, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("_v"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(vector))


def log_softmax(score: Column, by: str) -> Column:
    w = Window.partitionBy(by)
    top = F.max(score).over(w)
    return score - top - F.ln(F.sum(F.exp(score - top)).over(w))


def log_sum_exp(table: DataFrame, by: str, value: Column) -> DataFrame:
    """by, lse: without overflow, as the maximum is taken out first."""
    top = table.withColumn("_v", value).withColumn("_t", F.max("_v").over(Window.partitionBy(by)))
    return top.groupBy(by).agg((F.first("_t") + F.ln(F.sum(F.exp(F.col("_v") - F.col("_t"))))).alias("lse"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def warmup_linear(step: Column, total: int, share: float = 0.1) -> Column:
    """Learning-rate factor: up to 1 over the first share of the steps, then down to 0."""
    warm = max(1, int(total * share))
    return F.when(step < warm, step / warm).otherwise(F.greatest(F.lit(0.0), (total - step) / max(1, total - warm)))


def warmup_cosine(step: Column, total: int, share: float = 0.1) -> Column:
    warm = max(1, int(total * share))
    return F.when(step < warm, step / warm).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * (step - warm) / max(1, total - warm))))
