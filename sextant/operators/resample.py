"""Seeded resampling and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.readers import stored


def hashed_draw(*parts: Column) -> Column:
    """A whole number from 0 to 2^32 - 1, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("bigint")


def bootstrap(scores: DataFrame, n_iterations: int = 10, seed: int = 1) -> DataFrame:
    """pipeline, iteration, f1, em: means over as many draws with replacement as the pipeline has rows.

    scores: pipeline, pos (0 .. n-1), f1, em. Each row is scored once; only indices are drawn.
    """
    sizes = scores.groupBy("pipeline").agg(F.count("*").alias("_n"))
    draws = scores.select("pipeline", F.col("pos").alias("_j")).join(sizes, "pipeline").withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(n_iterations))))
    draws = draws.select("pipeline", "iteration", (hashed_draw(F.lit(seed), F.col("iteration"), F.col("_j")) % F.col("_n")).alias("pos"))
    return draws.join(scores, ["pipeline", "pos"]).groupBy("pipeline", "iteration").agg(F.avg("f1").alias("f1"), F.avg("em").alias("em"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, population deviation and the linear 2.5 and 97.5 percentiles."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p.alias("_p")).select(by, "mean", F.col("_p")[1].alias("median"), "std", F.col("_p")[0].alias("low"), F.col("_p")[2].alias("high"))


def histogram(rows: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """bucket (1 .. n, 0 and n+1 outside), n."""
    return rows.select(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(n)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def sample_rows(rows: DataFrame, id_: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, by hash of seed and id."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))), id_).limit(n)


def shuffled(rows: DataFrame, id_: str, seed: int = 1) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))), id_)


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """Adds pos: 0, 1, ... in order; rows that tie are in some order.

    The rows are dealt by range and written once, each with its range and its place there, to the shared scratch; the counts
    of the ranges before give the offset. Everything after the write reads what was written, so sampling, coalescing and
    lost executors can't deal the rows twice in different ways, and no task sees all rows.
    """
    dealt = rows.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    written = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "positions")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = written.groupBy(part.alias("__range")).agg(F.count("*").alias("__rows"))
    offset = counts.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))  # one row a range
    return written.join(F.broadcast(offset), part == F.col("__range")).withColumn("pos", (F.col("__before") + place).cast("bigint")).drop("__range", "__before", "__at")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk: rows in order, ``size`` to a chunk."""
    return positions(rows, order).withColumn("chunk", F.floor(F.col("pos") / size)).drop("pos")


def collated(rows: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """One row a batch: each column as a list in order; a column of lists is flattened. Batches are of bounded size."""
    kinds = dict(rows.dtypes)
    lists = F.array_sort(F.collect_list(F.struct(order, *columns)))
    one = rows.groupBy(batch).agg(lists.alias("_l"))
    of = lambda c: F.transform("_l", lambda x: x[c])
    return one.select(batch, *((F.flatten(of(c)) if kinds[c].startswith("array") else of(c)).alias(c) for c in columns))
