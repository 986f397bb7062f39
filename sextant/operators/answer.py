"""Generators as a plug, answer selection, and the marginal likelihood of retrieval-weighted generation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sextant.functions.text import joined_titles, snippet
from sextant.functions.vector import log_softmax, log_sum_exp
from sextant.sources import versions
from sextant.sources.readers import stored


def doc_log_prob(scores: DataFrame, mask_padding: bool = True) -> DataFrame:
    """Adds logp: log-softmax of score over the documents of a query.

    Slots without a document (passage_id -1) take no probability; with ``mask_padding=False`` they score 0 and do.
    """
    rows = scores.filter(F.col("passage_id") != -1) if mask_padding else scores.withColumn("score", F.when(F.col("passage_id") == -1, 0.0).otherwise(F.col("score")))
    return rows.withColumn("logp", log_softmax(F.col("score"), "qid"))


def sequence_nll(token_logp: DataFrame, by: list[str], ignore: int = -100) -> DataFrame:
    """by, nll: the negative log-likelihood of each target sequence, ignored labels left out."""
    return token_logp.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("label") != ignore, -F.col("logp"))), F.lit(0.0)).alias("nll"))


def marginal_nll(rows: DataFrame) -> DataFrame:
    """nll: minus the mean over queries of logsumexp(logp - nll) over documents; rows: qid, logp, nll."""
    return log_sum_exp(rows, "qid", F.col("logp") - F.col("nll")).agg((-F.avg("lse")).alias("nll"))


def select_by_sequence(candidates: DataFrame) -> DataFrame:
    """qid, answer, total: the candidate with the greatest logp + sequence score; the better rank of equals."""
    w = Window.partitionBy("qid").orderBy(F.desc("total"), F.asc("rank"))
    scored = candidates.withColumn("total", F.round(F.col("logp") + F.col("sequence_score"), 6))
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("qid", "answer", "total")


def select_marginal(candidates: DataFrame) -> DataFrame:
    """qid, answer, total: the answer whose probability summed over documents is greatest."""
    sums = candidates.groupBy("qid", "answer").agg(F.round(F.sum(F.exp(F.col("logp") + F.col("sequence_score"))), 9).alias("total"), F.min("rank").alias("rank"))
    w = Window.partitionBy("qid").orderBy(F.desc("total"), F.asc("rank"))
    return sums.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("qid", "answer", "total")


def select_by_retrieval(candidates: DataFrame) -> DataFrame:
    """qid, answer: the candidate of the best sparse score, the first of equals; none: the empty answer."""
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), F.asc("rank"))
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("qid", F.coalesce("answer", F.lit("")).alias("answer"))


def generate_with(prompts: DataFrame, prompt: str, model) -> DataFrame:
    """Adds answer and sequence_score by a pluggable generator: prompts in, (answer, score) pairs out, per Arrow batch."""

    def f(texts: pa.Array) -> pa.Array:
        made = model([t or "" for t in texts.to_pylist()])
        return pa.array([{"answer": a, "sequence_score": float(s)} for a, s in made], pa.struct([("answer", pa.string()), ("sequence_score", pa.float64())]))

    return prompts.withColumn("_g", F.arrow_udf(f, "struct<answer:string,sequence_score:double>")(prompt)).select("*", "_g.answer", "_g.sequence_score").drop("_g")


def isolated(rows: DataFrame, column: str, plug, kind: str, value: pa.DataType) -> DataFrame:
    """Adds ``made`` (of type ``kind``) and ``error``: a plug from a list of values to as many results, whose failures stay with their rows.

    A batch that fails, or comes back with another number of results, is tried again value by value; the rows that fail then
    have no result and the message of the error. One bad row costs its own result and not the job.
    """

    def one(x):
        try:
            (y,) = plug([x])
            return pa.array([y], value)[0].as_py(), None
        except Exception as e:  # whatever the plug raises is the row's error
            return None, f"{type(e).__name__}: {e}"

    def f(values: pa.Array) -> pa.Array:
        given = values.to_pylist()
        try:
            results = list(plug(given))
            if len(results) != len(given):
                raise ValueError("as many results as values are asked for")
            made, errors = pa.array(results, value), pa.nulls(len(given), pa.string())
        except Exception:
            each = [one(x) for x in given]
            made, errors = pa.array([y for y, _ in each], value), pa.array([e for _, e in each], pa.string())
        return pa.StructArray.from_arrays([made, errors], ["made", "error"])

    return rows.withColumn("_g", F.arrow_udf(f, f"struct<made:{kind},error:string>")(column)).select("*", "_g.made", "_g.error").drop("_g")


def generate_isolated(prompts: DataFrame, prompt: str, model) -> DataFrame:
    """As ``generate_with``, with error: a prompt that the generator fails on has null answer and score, and the message."""

    def plug(texts: list) -> list:
        return [{"answer": a, "sequence_score": float(s)} for a, s in model([t or "" for t in texts])]

    out = isolated(prompts, prompt, plug, "struct<answer:string,sequence_score:double>", pa.struct([("answer", pa.string()), ("sequence_score", pa.float64())]))
    return out.select("*", "made.answer", "made.sequence_score").drop("made")


def observed(rows: DataFrame, error: str = "error") -> tuple[DataFrame, Observation]:
    """``rows`` and an observation of n_rows, n_failed and n_done, taken while they are written: no second pass counts them."""
    o = Observation()
    failed = F.count(F.col(error))
    return rows.observe(o, F.count(F.lit(1)).alias("n_rows"), failed.alias("n_failed"), (F.count(F.lit(1)) - failed).alias("n_done")), o


def accepted_and_rejected(rows: DataFrame, path: str, error: str = "error") -> dict:
    """Write the good rows to ``accepted`` and the others, with their errors, to ``rejected`` below ``path``, as one version; the counts.

    The plug runs once: the rows are stored, counted while they are, and then parted.
    """
    seen, o = observed(rows, error)
    kept = stored(seen, "isolated")
    versions.publish(rows.sparkSession, path, {"accepted": kept.filter(F.col(error).isNull()).drop(error), "rejected": kept.filter(F.col(error).isNotNull())}, counts=o.get)
    return o.get


def sample_log(rows: DataFrame, epoch: str, n: int = 3) -> DataFrame:
    """The first n questions with answer, reference, and the documents in rank order.

    rows: qid, question, answer, reference, rank, title, text.
    """
    first = rows.join(F.broadcast(rows.select("qid").distinct().orderBy("qid").limit(n)), "qid")  # n rows
    docs = F.array_sort(F.collect_list(F.struct("rank", "title", "text")))
    out = first.groupBy("qid", "question", "answer", "reference").agg(docs.alias("_d"))
    return out.select(F.lit(epoch).alias("epoch"), "qid", "question", F.col("answer").alias("generated_answer"), F.col("reference").alias("reference_answer"), F.coalesce(F.get("_d", F.lit(0))["title"], F.lit("N/A")).alias("top_retrieved_doc_title"), snippet(F.get("_d", F.lit(0))["text"], 150, "N/A").alias("top_retrieved_doc_text_snippet"), joined_titles(F.col("_d")).alias("all_retrieved_titles"))
