"""Approximate inner-product search in hashed tables with a multi-probe sequence.

Each of ``tables`` tables has ``bits`` random planes through the origin; the signs of a vector's products
with them are its bucket. A query looks into its own bucket and then into those that differ where it is
nearest to the planes: bits are flipped, up to three at once, in order of the sum of the squared distances.
Buckets are blocks of vectors and every pair of blocks is one matrix product, as in exact search. The number of
probes is measured on a sample of rows and their exact neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.dense import CORPUS_BLOCK, TARGET, _best, _dealt_blocks, _meeting, _usable, neighbour_pairs, probes_for, top_k
from sextant.sources import versions

TABLES = 6
#: Rows that a bucket has in the mean, about a block's; bits follow from it.
BUCKET_ROWS = CORPUS_BLOCK // 2
FLIPS = 3


def planes(width: int, tables: int, bits: int, seed: int = 0) -> np.ndarray:
    """Random planes for vectors of one width: tables, bits, width."""
    return np.random.default_rng([seed, width]).normal(size=(tables, bits, width))


def _flips(bits: int) -> np.ndarray:
    """All choices of up to FLIPS bits, as rows of zeros and ones."""
    rows = [c for k in range(min(FLIPS, bits) + 1) for c in combinations(range(bits), k)]
    out = np.zeros((len(rows), bits))
    for i, c in enumerate(rows):
        out[i, list(c)] = 1
    return out


def sequences(x: np.ndarray, p: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` buckets of the probing sequence of each row in each table: rows, tables, probes."""
    tables, bits, _ = p.shape
    flips, weights = _flips(bits), 2 ** np.arange(bits)
    out = np.empty((len(x), tables, min(most, len(flips))), np.int64)
    for t in range(tables):
        s = x @ p[t].T
        cost = (s * s) @ flips.T
        order = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
        out[:, t] = ((s > 0).astype(np.int64) @ weights)[:, None] ^ (flips @ weights).astype(np.int64)[order]
    return out


@dataclass(frozen=True)
class HashIndex:
    """Blocks of vectors by bucket (table * 2^bits + bits set); every row is in every table."""

    blocks: DataFrame  # bucket, part, c_ids, c_matrix, c_width
    tables: int
    bits: int
    seed: int
    probes: int
    recall: float


def _buckets(tables: int, bits: int, seed: int, probes: int):
    def f(v: pa.Array) -> pa.Array:
        widths, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts, out = np.cumsum(widths) - widths, [None] * len(v)
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            seq = sequences(flat[starts[at][:, None] + np.arange(w)], planes(w, tables, bits, seed), probes)
            seq += (np.arange(tables) << bits)[None, :, None]
            for i, row in zip(at, seq.reshape(len(at), -1).tolist(), strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(f, "array<bigint>")


def build(index: DataFrame, tables: int = TABLES, bits: int | None = None, seed: int = 0, target: float = TARGET) -> HashIndex:
    """Hash every usable row of ``index`` (passage_id, embedding); bits grow with the rows, 16 at most.

    Vectors of unlike widths have planes of their own and never meet.
    """
    good = _usable(index, "passage_id")
    bits = bits or int(min(16, max(2, round(np.log2(max(1, good.count()) / BUCKET_ROWS)))))
    q, near = neighbour_pairs(good)
    most, places = len(_flips(bits)), []
    for w in {len(v) for v in q}:
        p = planes(w, tables, bits, seed)
        a, b = (np.array([v for v in side if len(v) == w], np.float64) for side in (q, near))
        for begin in range(0, len(a), 256):
            seq, own = sequences(a[begin : begin + 256], p, most), sequences(b[begin : begin + 256], p, 1)
            hit = seq == own
            places.append(np.where(hit.any(2), hit.argmax(2), most).min(1))
    probes, recall = probes_for(np.concatenate(places) if places else np.zeros(0, int), target)
    placed = good.select("passage_id", "embedding", F.explode(_buckets(tables, bits, seed, 1)("embedding")).alias("bucket"))
    return HashIndex(_dealt_blocks(placed, "bucket"), tables, bits, seed, min(probes, most), recall)


def write(index: HashIndex, path: str) -> None:
    about = {k: getattr(index, k) for k in ("tables", "bits", "seed", "probes", "recall")}
    versions.publish(index.blocks.sparkSession, path, {"blocks": index.blocks.repartitionByRange("bucket", "part").sortWithinPartitions("bucket", "part")}, hashing=about)


def open_hashed(spark: SparkSession, path: str) -> HashIndex:
    about = versions.latest(spark, path).content["hashing"]
    return HashIndex(versions.opened(spark, path)["blocks"], *(about[k] for k in ("tables", "bits", "seed", "probes", "recall")))


def search(queries: DataFrame, index: HashIndex, k: int = 10, probes: int | None = None, skip_self: bool = False) -> DataFrame:
    """qid, passage_id, score (6 decimals, exact), rank: ``probes`` buckets a table (default: as many as were measured to do)."""
    good = _usable(queries, "qid")
    asked = good.select("qid", "embedding", F.explode(_buckets(index.tables, index.bits, index.seed, probes or index.probes)("embedding")).alias("bucket"))
    hits = _meeting(asked, index.blocks, "bucket").select(F.explode(_best(k, skip_self)("q_ids", "q_matrix", "c_ids", "c_matrix", "c_width")).alias("h")).select("h.*")
    # A row that several tables find comes several times, with one score.
    return top_k(hits.dropDuplicates(["qid", "passage_id"]), k)
