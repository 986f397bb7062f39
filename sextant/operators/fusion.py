"""Reciprocal-rank fusion of ranked lists and the hybrid retrieval made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSTANT = 60


def rrf(dense: DataFrame, sparse: DataFrame, k: int | None = None, constant: int = CONSTANT) -> DataFrame:
    """qid, passage_id, rrf, rank of two lists (qid, passage_id, rank).

    A passage that a list names twice scores twice; passage_id -1 scores nothing but uses up its rank.
    Ties go by the best dense rank, then by the best sparse rank.
    """
    both = dense.select("qid", "passage_id", "rank", F.lit(0).alias("_l")).unionByName(sparse.select("qid", "passage_id", "rank", F.lit(1).alias("_l"))).filter(F.col("passage_id") != -1)
    best = lambda i: F.min(F.when(F.col("_l") == i, F.col("rank")))
    fused = both.groupBy("qid", "passage_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"), best(0).alias("_d"), best(1).alias("_s"))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.asc_nulls_last("_d"), F.asc_nulls_last("_s"), F.asc("passage_id"))
    out = fused.withColumn("rank", F.row_number().over(w)).drop("_d", "_s")
    return out if k is None else out.filter(F.col("rank") <= k)


def hybrid_topk(dense: DataFrame, sparse: DataFrame, passages: DataFrame, k: int, constant: int = CONSTANT, index: DataFrame | None = None, encode=None, dim: int | None = None, pad: DataFrame | None = None) -> DataFrame:
    """The fused k with title and text ("" where missing).

    With ``index`` also the embedding; a passage without one gets that of its text from ``encode`` (a table of
    passage_id and text to one of passage_id and embedding), and one without a text a zero vector of ``dim``.
    With ``pad``, the table of queries, every query has exactly k slots: those without a passage hold
    passage_id -1, empty texts and, with an index, the zero vector.
    """
    out = rrf(dense, sparse, k, constant)
    if pad is not None:
        slots = pad.select("qid").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
        out = slots.join(out, ["qid", "rank"], "left").fillna({"passage_id": -1, "rrf": 0.0})
    out = out.join(passages.select("passage_id", "title", "text"), "passage_id", "left")
    out = out.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    if index is None:
        return out
    out = out.join(index.select("passage_id", "embedding"), "passage_id", "left")
    if encode is not None:
        lack = out.filter(F.col("embedding").isNull() & (F.col("text") != "")).select("passage_id", "text").dropDuplicates(["passage_id"])
        out = out.join(encode(lack).select("passage_id", F.col("embedding").alias("_e")), "passage_id", "left").withColumn("embedding", F.coalesce("embedding", "_e")).drop("_e")
    if dim is not None:
        out = out.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)))
    return out
