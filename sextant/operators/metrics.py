"""Answer and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import any_answer_in, best_over, exact_match, token_f1
from sextant.functions.vector import dot, finite
from sextant.sources.readers import listed, stored


def answer_scores(rows: DataFrame, normalize: bool = True) -> DataFrame:
    """Adds em and f1, the best over the golds; rows: prediction, golds (array)."""
    return rows.withColumn("em", best_over(exact_match, F.col("prediction"), F.col("golds"))).withColumn("f1", best_over(token_f1, F.col("prediction"), F.col("golds"), normalize=normalize))


def corpus_scores(rows: DataFrame) -> DataFrame:
    """exact_match and f1 in percent over all rows with em and f1; 0 for none."""
    mean = lambda c: F.coalesce(F.avg(c) * 100, F.lit(0.0))
    return rows.agg(mean("em").alias("exact_match"), mean("f1").alias("f1"))


def recall_at(hits: DataFrame, questions: DataFrame, passages: DataFrame, ks: list[int], params: DataFrame | None = None) -> DataFrame:
    """For each k, the share of questions with an answer in the text of a top-k passage; one row, or one per row of ``params``.

    hits: qid, passage_id, rank and the columns of ``params``; questions: qid, answers (array). Each (question,
    passage) is tested once, however many parameter rows retrieve it.
    """
    by = params.columns if params is not None else []
    met = stored(hits.select("qid", "passage_id").distinct(), "met")  # ids alone go to the texts, so those that no hit names are not shuffled
    tested = passages.select("passage_id", "text").join(listed(met), "passage_id").join(questions.select("qid", "answers"), "qid")
    right = tested.filter(any_answer_in(F.col("answers"), F.col("text"))).select("qid", "passage_id")
    first = hits.join(right, ["qid", "passage_id"]).groupBy(*by, "qid").agg(F.min("rank").alias("first"))
    n = questions.select("qid").distinct().agg(F.count("*").alias("n"))  # one row
    counts = first.groupBy(*by).agg(*(F.sum((F.col("first") <= k).cast("int")).alias(f"_{k}") for k in ks))
    every = F.broadcast(params).join(counts, by, "left") if params is not None else counts
    shares = [F.coalesce(F.try_divide(F.col(f"_{k}").cast("double"), F.col("n")), F.lit(0.0)).alias(f"recall_{k}") for k in ks]
    return every.crossJoin(F.broadcast(n)).select(*by, *shares)


def sorted_table(rows: DataFrame, metric: str, *ties: str) -> DataFrame:
    """Adds place: rows by the metric, the greatest first, equals in the order of ``ties``. For small tables of results."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(metric), *ties)))


def zipped(predictions: DataFrame, references: DataFrame, pos: str = "pos") -> DataFrame:
    """prediction and golds of the rows at equal positions; what only one side has is left out, as a zip does."""
    return predictions.select(pos, "prediction").join(references.select(pos, F.array("reference").alias("golds")), pos)


def epoch_means(steps: DataFrame, value: str = "loss") -> DataFrame:
    """epoch, the mean of the finite values of its steps, and how many there were; an epoch without any has a null mean."""
    good = F.when(finite(F.col(value).cast("double")), F.col(value))
    return steps.groupBy("epoch").agg(F.avg(good).alias(value), F.count(good).alias("n_steps"))


def gold_rank(candidates: DataFrame) -> DataFrame:
    """qid, rank and rr of the gold candidate among its query's, by similarity then id, both descending."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("candidate_id"))
    return candidates.withColumn("rank", F.row_number().over(w)).filter("is_gold").select("qid", "rank", (1.0 / F.col("rank")).alias("rr"))


def mrr(ranks: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 100)) -> DataFrame:
    """mrr and, for each k, the share of queries whose reciprocal rank is 1/k at least; 0 for no queries."""
    share = lambda k: F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"recall_{k}")
    return ranks.agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), *(share(k) for k in ks))


def candidate_recall(ranks: DataFrame, totals: Column) -> DataFrame:
    """Correct over total candidates, as the original defines it: 1 wherever the gold is always among them."""
    return ranks.agg(F.try_divide(F.count("*").cast("double"), F.sum(totals)).alias("recall"))


def best_epoch(epochs: DataFrame, metric: str = "f1") -> DataFrame:
    """Adds best_so_far and improved (strictly better than every epoch before)."""
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(metric).over(w)
    return epochs.withColumn("improved", F.coalesce(F.col(metric) > before, F.lit(True))).withColumn("best_so_far", F.greatest(F.col(metric), before))


def early_stop(epochs: DataFrame, metric: str = "mrr", patience: int = 2) -> DataFrame:
    """The epochs that run: training ends once ``patience`` epochs in a row bring no improvement."""
    marked = best_epoch(epochs, metric)
    w = Window.orderBy("epoch")
    last = marked.withColumn("_last", F.max(F.when(F.col("improved"), F.col("epoch"))).over(w))
    stop = last.withColumn("_stop", F.col("epoch") - F.col("_last") >= patience)
    first = F.min(F.when(F.col("_stop"), F.col("epoch"))).over(Window.partitionBy())
    return stop.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col("epoch") <= F.col("_first"))).drop("_last", "_stop", "_first")


def checked_lengths(predictions: DataFrame, references: DataFrame) -> bool:
    """Whether both sides have as many rows, and any."""
    n = predictions.count()
    return n > 0 and n == references.count()


def in_batch_contrastive(pairs: DataFrame, temperature: float = 0.05) -> DataFrame:
    """loss of batches (batch, i, sims): row i's label is column i of its similarities to all positives, then negatives."""
    logits = F.transform("sims", lambda x: x / temperature)
    top = F.array_max(logits)
    lse = top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return pairs.groupBy("batch").agg(F.avg(lse - F.element_at(logits, (F.col("i") + 1).cast("int"))).alias("loss"))


def contrastive(queries: DataFrame, positives: DataFrame, negatives: DataFrame, temperature: float = 0.05) -> DataFrame:
    """batch, loss: each query (batch, i, embedding) against all positives of its batch (_b, j, _v; its own has j = i) and
    then all negatives of the batch. Batches are of bounded size."""
    columns = positives.withColumn("_k", F.lit(0)).unionByName(negatives.withColumn("_k", F.lit(1)))
    met = queries.join(columns, F.col("batch") == F.col("_b"))
    sims = met.groupBy("batch", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "j", F.round(dot(F.col("embedding"), F.col("_v")), 6).alias("x")))), lambda s: s["x"]).alias("sims"))
    return in_batch_contrastive(sims, temperature)
