"""Passages as a stream into a searchable index; streaming aggregates into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import terms
from sextant.operators import blocks
from sextant.sources import versions

#: Parts of an upserted table, by hash of the key; a micro-batch rewrites those that it touches.
PARTS = 32


def ingest_passages(stream: DataFrame, path: str, checkpoint: str, stem: bool = False):
    """Each micro-batch of passages (passage_id, text) becomes a segment of the index at ``path`` (``operators.blocks``).

    A passage that comes again replaces what was there. A batch that is run again after a failure changes nothing: its number
    is in the manifest of the version that it made.
    """

    def write(batch: DataFrame, number: int) -> None:
        blocks.add(batch, path, stem, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(stream: DataFrame, text: str, ts: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Terms per event-time window, late rows up to ``late`` included."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.select("_ts", F.explode(terms(F.col(text))).alias("term")).groupBy(F.window("_ts", window), "term").agg(F.count("*").alias("n"))


def upsert(counts: DataFrame, path: str, checkpoint: str, *keys: str):
    """Write a streaming aggregate in update mode: the rows of a micro-batch replace those of the same keys.

    The aggregate's watermark lets old state go, as only changed rows come. A batch rewrites the parts of the table that its
    keys fall into and publishes them as one version; a batch run again replaces its rows by the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")).persist()
        base = versions.latest(spark, path)
        if (touched := [r[0] for r in new.select("_part").distinct().collect()]) and number > base.content.get("batch", -1):
            parts, folder = dict(base.content.get("parts", {})), versions.new_name()
            old = [parts[str(p)] for p in touched if str(p) in parts]
            rows = new
            if old:
                rows = spark.read.schema(new.schema).parquet(*(f"{path}/{x}" for x in old)).join(new.select(*keys), list(keys), "left_anti").select(new.columns).union(new)
            rows.withColumn("_in", F.col("_part")).write.partitionBy("_in").parquet(f"{path}/{folder}")
            versions.commit(spark, path, base, {"parts": parts | {str(p): f"{folder}/_in={p}" for p in touched}, "batch": number})
        new.unpersist()

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert`` keeps; before its first batch that is an error."""
    parts = versions.latest(spark, path).content.get("parts")
    if not parts:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(*(f"{path}/{x}" for x in sorted(parts.values()))).drop("_part")
