"""Vectors as pairs of ``.npy`` files: ``vectors_<chunk>.npy`` (rows by width, floats) and ``ids_<chunk>.npy`` (as many whole numbers)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.resample import positions

#: Rows of a chunk; a chunk is one task's work and must fit into a file of 2 GB.
CHUNK = 100_000
_SLICE = 4096


def write(index: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Write ``index`` (passage_id, embedding, of one width) in order of ids, ``chunk`` rows to a pair of files; chunk and n of each pair.

    ``path`` is a folder that all executors reach, given as an absolute path or a URI that Arrow knows. A file is written under another name
    and moved when it is whole, so a task that is run again replaces it. Rows without an id or a vector go.
    """

    def put(fs: pafs.FileSystem, folder: str, name: str, array: np.ndarray) -> None:
        raw = io.BytesIO()
        np.save(raw, array)
        draft = f"{folder}/.{name}.draft"
        with fs.open_output_stream(draft) as out:
            out.write(raw.getvalue())
        fs.move(draft, f"{folder}/{name}")

    def save(table: pa.Table) -> pa.Table:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        table = table.sort_by("passage_id")
        ids, v = table["passage_id"].to_numpy(), table["embedding"].combine_chunks()
        widths = np.diff(v.offsets.to_numpy())
        if len(set(widths.tolist())) > 1:
            raise ValueError("vectors of a chunk have unlike widths")
        k = table["chunk"][0].as_py()
        put(fs, folder, f"vectors_{k}.npy", v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1))
        put(fs, folder, f"ids_{k}.npy", ids.astype(np.int64))
        return pa.table({"chunk": pa.array([k], pa.int64()), "n": pa.array([len(ids)], pa.int64())})

    good = index.filter(F.col("passage_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("passage_id").cast("bigint"), F.col("embedding").cast("array<float>"))
    dealt = positions(good, "passage_id").withColumn("chunk", F.floor(F.col("pos") / chunk)).drop("pos")
    done = dealt.groupBy("chunk").applyInArrow(save, "chunk bigint, n bigint")
    rows = done.collect()  # two numbers a chunk
    return index.sparkSession.createDataFrame([tuple(r) for r in rows], "chunk bigint, n bigint")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            k, vectors, ids = (batch.column(c)[r] for c in ("chunk", "vectors", "ids"))
            if not vectors.is_valid or not ids.is_valid:
                raise ValueError(f"chunk {k} has no {'vectors' if not vectors.is_valid else 'ids'}")
            x, i = (np.load(io.BytesIO(v.as_buffer()), allow_pickle=False) for v in (vectors, ids))
            if x.ndim != 2 or x.dtype.kind != "f" or i.ndim != 1 or i.dtype.kind not in "iu":
                raise ValueError(f"chunk {k}: rows of floats and as many whole numbers are asked for, not {x.dtype} {x.shape} and {i.dtype} {i.shape}")
            if len(x) != len(i):
                raise ValueError(f"chunk {k}: {len(x)} vectors and {len(i)} ids")
            for begin in range(0, len(i), _SLICE):
                part = np.ascontiguousarray(x[begin : begin + _SLICE], np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, x.shape[1], dtype=np.int32), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(i[begin : begin + _SLICE].astype(np.int64)), lists, pa.array(np.full(len(part), k.as_py(), np.int64))], ["passage_id", "embedding", "chunk"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """passage_id, embedding, chunk of all pairs below ``path``, a task a pair at the finest; Spark reads the files.

    Unequal lengths, a file without its partner and arrays of another kind fail the query that meets them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.npy").load(path)
    name = F.regexp_extract("path", r"/(vectors|ids)_(\d+)\.npy$", 1)
    named = files.select(name.alias("kind"), F.regexp_extract("path", r"_(\d+)\.npy$", 1).cast("bigint").alias("chunk"), "content").filter("kind <> ''")
    side = lambda k: named.filter(F.col("kind") == k).select("chunk", F.col("content").alias(k))
    return side("vectors").join(side("ids"), "chunk", "full").select("chunk", "vectors", "ids").mapInArrow(_pairs, "passage_id bigint, embedding array<float>, chunk bigint")
