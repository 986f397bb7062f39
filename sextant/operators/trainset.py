"""Training sets for a bi-encoder and a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import gold_prompt, with_prefix


def context_key(ctx: Column, compat: bool = False) -> Column:
    """passage_id, else id; the compatible form looks at id alone."""
    return ctx["id"] if compat else F.coalesce(ctx["passage_id"], ctx["id"])


def triples(examples: DataFrame, max_negatives: int = 2, total: int = 4, compat_ids: bool = False) -> DataFrame:
    """question, positive, negatives, answer of examples with answers, positive_ctxs and hard_negative_ctxs.

    Positive: the first. Negatives: hard negatives with ids unlike it and each other, at most
    ``max_negatives``; then the other positives by ascending score (none: 0), as long as ids are new,
    up to ``total``. Examples without a positive go.
    """
    key = lambda c: context_key(c, compat_ids)
    blank = F.array().cast("array<struct<passage_id:string,id:string,text:string,score:double>>")
    plain = lambda c: F.transform(c, lambda x: F.struct(*(x[f].alias(f) for f in ("passage_id", "id", "text", "score"))))
    has = examples.filter(F.size("positive_ctxs") > 0).withColumn("_p", plain("positive_ctxs")).withColumn("_h", F.coalesce(plain("hard_negative_ctxs"), blank))
    first = F.get("_p", F.lit(0))
    start = F.struct(F.array(key(first)).alias("seen"), blank.alias("kept"))

    def take(limit: int):
        def step(s: Column, c: Column) -> Column:
            new = ~F.coalesce(F.array_contains(s["seen"], key(c)), F.lit(True)) & (F.size(s["kept"]) < limit)
            return F.when(new, F.struct(F.concat(s["seen"], F.array(key(c))).alias("seen"), F.concat(s["kept"], F.array(c)).alias("kept"))).otherwise(s)

        return step

    others = F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0)))
    ranked = F.transform(F.array_sort(F.transform(others, lambda c, i: F.struct(F.coalesce(c["score"], F.lit(0.0)).alias("s"), i.alias("i"), c.alias("c")))), lambda x: x["c"])
    folded = has.withColumn("_a", F.aggregate("_h", start, take(max_negatives))).withColumn("_b", F.aggregate(ranked, F.col("_a"), take(total)))
    return folded.select(with_prefix(F.col("question"), "query", always=True).alias("query"), with_prefix(first["text"], "passage", always=True).alias("positive"), F.transform(F.col("_b.kept"), lambda c: with_prefix(c["text"], "passage", always=True)).alias("negatives"), F.coalesce(F.get("answers", F.lit(0)), F.lit("")).alias("answer"))


def gold_context_samples(examples: DataFrame) -> DataFrame:
    """prompt and target of the examples that have a short answer."""
    return examples.filter(F.size("short_answers") > 0).select(gold_prompt(F.col("question"), F.col("context")).alias("prompt"), F.get("short_answers", F.lit(0)).alias("target"))


def ranking_candidates(examples: DataFrame, most: int = 20) -> DataFrame:
    """qid, candidate_id, text, is_gold: up to ``most`` negatives and the gold."""
    gold = examples.select("qid", F.get("positive_ctxs", F.lit(0)).alias("c"), F.lit(True).alias("is_gold"))
    rest = examples.select("qid", F.explode(F.slice("negative_ctxs", 1, most)).alias("c"), F.lit(False).alias("is_gold"))
    return gold.unionByName(rest).filter("c IS NOT NULL").select("qid", context_key(F.col("c")).alias("candidate_id"), F.col("c.text").alias("text"), "is_gold")
