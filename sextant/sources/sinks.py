"""Writers; each replaces what was there and commits as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import sparse
from sextant.sources import versions


def metadata_jsonl(passages: DataFrame, path: str) -> None:
    passages.select(F.col("passage_id").alias("id"), "title", "text").write.mode("overwrite").json(path)


def vectors_parquet(index: DataFrame, path: str, partition: str | None = None) -> None:
    """passage_id, embedding, and a chunk or cell to partition by."""
    w = index.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def inverted_index(index, path: str) -> None:
    """The tables of an ``Index``, published together: readers see the version before until all are there.

    Postings stay with their passages: each file has those of some passages in order of terms, so no posting is shuffled, none is
    far from its passage's others, and a frequent term is every file's. ``operators.blocks`` is the index to search at scale.
    """
    spark = index.postings.sparkSession
    base, folder = versions.latest(spark, path), versions.new_name()

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}")

    posts = written("postings", index.postings.sortWithinPartitions("term", "passage_id"))
    stats = written("doc_stats", index.doc_stats)
    written("corpus", sparse.index_stats(stats))
    if index.stem:
        written("stems", sparse.vocabulary_stems(posts))
    names = ["postings", "doc_stats", "corpus", *["stems"] * index.stem]
    versions.commit(spark, path, base, {"tables": {name: f"{folder}/{name}" for name in names}, "stem": index.stem})


def passages_tsv(passages: DataFrame, path: str) -> None:
    """id, text, title with a header, tabs between, quoted; line ends inside a field become spaces."""
    flat = [F.regexp_replace(c, r"[\r\n]+", " ").alias(c) for c in ("text", "title")]
    passages.select(F.col("passage_id").alias("id"), *flat).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', quoteAll=True)


def best_score_json(epochs: DataFrame, path: str, metric: str = "f1") -> None:
    """best_f1_score and epoch of the first epoch with the best score: one line, replaced as a whole."""
    best = epochs.groupBy().agg(F.max(metric).alias("best_f1_score"))  # one row
    first = epochs.join(F.broadcast(best), F.col(metric) == F.col("best_f1_score")).groupBy("best_f1_score").agg(F.min("epoch").alias("epoch"))
    first.write.mode("overwrite").json(path)


def sparse_results_jsonl(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def console_rows(rows: DataFrame) -> DataFrame:
    """line: numbers with four decimals, tabs between."""
    parts = [F.format_number(c, 4) if t in ("double", "float") else F.col(c).cast("string") for c, t in rows.dtypes]
    return rows.select(F.concat_ws("\t", *(F.coalesce(p, F.lit("")) for p in parts)).alias("line"))
