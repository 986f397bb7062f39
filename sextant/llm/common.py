"""Helpers shared by the corpus operators: shared scratch tables, Arrow settings and hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_TABLE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python by rows and by bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def scratch(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local master gets one of our own; a
    cluster, whose machines share no temporary folder, is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = getattr(spark, "_sextant_scratch", None) or tempfile.mkdtemp(prefix="sextant-")
        spark._sextant_scratch = folder
    return folder


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nested(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of theirs can meet one of ours."""
    return F.struct(*(quoted(c) for c in docs.columns))


def unnested(columns: list[str], row: str = "row", **changed: Column) -> list[Column]:
    """The columns of ``nested`` again, in order; ``changed`` replaces some by name."""
    return [changed.get(c, F.col(row).getField(c)).alias(c) for c in columns]


def row_hash(docs: DataFrame, seed: int = 0) -> Column:
    """A hash of the whole row; maps, which have no hash, by their JSON."""

    def plain(field) -> Column:
        c = quoted(field.name)
        return F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if "map<" in field.dataType.simpleString() else c

    return F.xxhash64(F.lit(seed), *(plain(f) for f in docs.schema.fields))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    The files are removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/sextant-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def let_go(*frames: DataFrame) -> None:
    """Remove the files of tables made by ``cut`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
            if path.getName().startswith("sextant-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that a writer of a scratch table holds before it flushes.
ROW_GROUP = 16 << 20
#: Rows of two or three numbers, some 25 MB as a hash table, up to which a side is broadcast.
BROADCAST_ROWS = 1 << 18


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if its count allows; else joins shuffle by key."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lowered(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def lower_bytes(b: bytes) -> bytes:
    return b.translate(_LOWER_TABLE)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) over an unsigned array."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
