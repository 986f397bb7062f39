"""End-to-end evaluation: retrieved passages to prompts, a generator plug, answer selection, EM and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import gold_prompt, retrieval_prompt
from sextant.operators.answer import doc_log_prob, generate_with, select_by_retrieval, select_by_sequence, select_marginal
from sextant.operators.metrics import answer_scores, corpus_scores

SELECTIONS = ("sequence", "marginal", "retrieval")


def answers(questions: DataFrame, hits: DataFrame, passages: DataFrame, model, selection: str = "sequence") -> DataFrame:
    """qid, answer: one candidate per retrieved passage by the generator ``model``, the best by ``selection``.

    questions: qid, question; hits: qid, passage_id, score, rank; a question without hits gets the empty answer.
    """
    if selection not in SELECTIONS:
        raise ValueError(f"selection is one of {SELECTIONS}")
    rows = hits.join(questions.select("qid", "question"), "qid").join(passages.select("passage_id", "title", "text"), "passage_id")
    made = generate_with(rows.withColumn("prompt", retrieval_prompt(F.col("question"), F.col("title"), F.col("text"))).drop("title", "text", "question"), "prompt", model)
    if selection == "retrieval":
        picked = select_by_retrieval(made)
    else:
        picked = (select_by_sequence if selection == "sequence" else select_marginal)(doc_log_prob(made))
    return questions.select("qid").join(picked.select("qid", "answer"), "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def evaluate(questions: DataFrame, picked: DataFrame) -> DataFrame:
    """One row: exact_match and f1 in percent; questions: qid, golds (array); picked: qid, answer."""
    rows = questions.select("qid", "golds").join(picked.select("qid", F.col("answer").alias("prediction")), "qid")
    return corpus_scores(answer_scores(rows))


def evaluate_pipelines(questions: DataFrame, retrieved: dict[str, tuple[DataFrame, str]], passages: DataFrame, model) -> DataFrame:
    """pipeline, exact_match, f1: one row for each named retrieval with its way of selection; an unknown way is an error."""
    out = None
    for name, (hits, selection) in retrieved.items():
        one = evaluate(questions, answers(questions, hits, passages, model, selection)).select(F.lit(name).alias("pipeline"), "exact_match", "f1")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_gold(examples: DataFrame, model) -> DataFrame:
    """exact_match and f1 with the gold context as the prompt; examples: qid, question, context, golds."""
    made = generate_with(examples.withColumn("prompt", gold_prompt(F.col("question"), F.col("context"))), "prompt", model)
    return evaluate(examples, made.select("qid", "answer"))
