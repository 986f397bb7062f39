"""Beam search over a token plug, for all prompts at once.

A round extends every live beam of every prompt by the plug's tokens, bans what would repeat an n-gram, and ranks the
candidates of a prompt in one window: the first ``2 * beams`` are looked at, ends among the first
``beams`` of them finish a hypothesis, and the first ``beams`` others live on. A prompt is through when ``beams``
hypotheses have finished (early stopping) or at the length limit, where live beams finish as they are. A
hypothesis scores its log-probability over its number of tokens, the end included.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.readers import stored


def _plug(step):
    def f(prompts: pa.Array, tokens: pa.Array) -> pa.Array:
        made = step([p or "" for p in prompts.to_pylist()], tokens.to_pylist())
        return pa.array([[{"token": int(t), "logp": float(s)} for t, s in row] for row in made], pa.list_(pa.struct([("token", pa.int32()), ("logp", pa.float64())])))

    return F.arrow_udf(f, "array<struct<token:int,logp:double>>")


def repeats(tokens: Column, token: Column, n: int) -> Column:
    """Whether ``token`` after ``tokens`` makes an n-gram that is in ``tokens`` already."""
    size = F.size(tokens)
    last = F.concat(F.slice(tokens, F.greatest(size - F.lit(n - 2), F.lit(1)), F.lit(n - 1)), F.array(token))
    return (size >= n) & F.exists(F.sequence(F.lit(1), F.greatest(size - F.lit(n - 1), F.lit(1))), lambda i: F.slice(tokens, i, F.lit(n)) == last)


def beam_search(prompts: DataFrame, by: list[str], prompt: str, step, end: int, beams: int = 4, max_length: int = 64, no_repeat: int = 3, forced_first: int | None = None) -> DataFrame:
    """The columns ``by`` (a key of ``prompts``), tokens (without the end) and sequence_score: the best hypothesis of each prompt.

    ``step`` takes a list of prompts and a list of token lists and returns, for each, pairs of next token and
    log-probability: all of the vocabulary, or the best 2 * beams and as many more as there are tokens, which bans may take
    out. Ties go to the better beam, then the smaller token. A prompt whose beams all die has no row; a null prompt is empty.
    """
    live = stored(prompts.select(*by, F.coalesce(prompt, F.lit("")).alias("_p"), F.lit(0).alias("_b"), F.array().cast("array<int>").alias("tokens"), F.lit(0.0).alias("_s")), "beams")
    done = stored(live.select(*by, "tokens", F.col("_s").alias("sequence_score")).limit(0), "done")
    order = Window.partitionBy(*by).orderBy(F.desc("_s"), "_b", "_t")
    for length in range(1, max_length + 1):
        told = live.select(*by, "_p", "_b", "tokens", "_s", F.explode(_plug(step)("_p", "tokens")).alias("x")).select(*by, "_p", "_b", "tokens", F.col("x.token").alias("_t"), (F.col("_s") + F.col("x.logp")).alias("_s"))
        if no_repeat:
            told = told.filter(~repeats(F.col("tokens"), F.col("_t"), no_repeat))
        if length == 1 and forced_first is not None:
            told = told.filter(F.col("_t") == forced_first)
        first = stored(told.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 2 * beams), "round")
        ended = first.filter((F.col("_t") == end) & (F.col("_r") <= beams)).select(*by, "tokens", (F.col("_s") / length).alias("sequence_score"))
        on = first.filter(F.col("_t") != end).withColumn("_b", F.row_number().over(Window.partitionBy(*by).orderBy("_r")) - 1).filter(F.col("_b") < beams)
        on = on.select(*by, "_p", "_b", F.concat("tokens", F.array("_t")).alias("tokens"), "_s")
        if length < max_length:
            done = stored(done.unionByName(ended), "done")
            through = done.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= beams).select(*by)
            live = stored(on.join(through, by, "left_anti"), "beams")
        else:
            # At the limit the beams that live on finish as well.
            done = done.unionByName(ended).unionByName(on.select(*by, "tokens", (F.col("_s") / length).alias("sequence_score")))
            break
        if not live.head(1):
            break
    best = Window.partitionBy(*by).orderBy(F.desc("sequence_score"), "tokens")
    return done.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
