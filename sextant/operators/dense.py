"""Dense retrieval: exact search in blocks, cells for approximate search, re-ranking of given pools.

Corpus and queries are packed into blocks of rows; every pair of blocks is one matrix product on an
executor that keeps the k best of each query, and a window over these candidates takes the k best of
all. What is shuffled is k rows per query and corpus block; nothing needs to fit into one broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.text import nonblank
from sextant.functions.vector import dot, l2_normalize
from sextant.sources import versions

#: Rows of a block: 4,096 vectors of 1,024 floats are 16 MB.
CORPUS_BLOCK, QUERY_BLOCK = 4096, 512


def _packer(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(width: int) -> pa.RecordBatch:
            parts = held.pop(width)
            ids, matrix = np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts])
            return pa.RecordBatch.from_arrays([pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary()), pa.array([width], pa.int32())], ["ids", "matrix", "width"])

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            widths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            starts = np.cumsum(widths) - widths
            for width in np.unique(widths).tolist():  # vectors of unlike widths never share a block
                at = np.flatnonzero(widths == width)
                matrix = flat[starts[at][:, None] + np.arange(width)]
                for begin in range(0, len(at), rows):
                    held.setdefault(width, []).append((ids[at[begin : begin + rows]], matrix[begin : begin + rows]))
                    if sum(len(i) for i, _ in held[width]) >= rows:
                        yield out(width)
        for width in list(held):
            yield out(width)

    return pack


def _blocks(table: DataFrame, id_: str, vector: str, rows: int, name: str) -> DataFrame:
    """Null ids, null and empty vectors, and vectors with a null in them, have no place in an index."""
    good = table.filter(F.col(id_).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())).select(F.col(id_).cast("bigint"), F.col(vector).cast("array<float>"))
    packed = good.mapInArrow(_packer(rows), "ids array<bigint>, matrix binary, width int")
    return packed.select(*(F.col(c).alias(f"{name}_{c}") for c in ("ids", "matrix", "width")))


def _best(k: int, skip_self: bool):
    def best(qi: pa.Array, qm: pa.Array, ci: pa.Array, cm: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for a, x, b, y, w in zip(qi, qm, ci, cm, width.to_pylist(), strict=True):
            a, b = np.asarray(a.values, np.int64), np.asarray(b.values, np.int64)
            q, c = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, w).astype(np.float64), np.frombuffer(y.as_buffer(), np.float32).reshape(-1, w).astype(np.float64)
            # Rounded before ranking, so that ties are ties whatever the order of summation.
            s = np.round(q @ c.T, 6)
            rows = []
            for i, own in enumerate(a):
                score = s[i]
                keep = np.flatnonzero(b != own) if skip_self else np.arange(len(b))
                if len(keep) > k:
                    bar = np.partition(score[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[score[keep] >= bar]
                for j in keep[np.lexsort((b[keep], -score[keep]))[:k]]:
                    rows.append({"qid": int(own), "passage_id": int(b[j]), "score": float(score[j]) + 0.0})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("qid", pa.int64()), ("passage_id", pa.int64()), ("score", pa.float64())])))

    return F.arrow_udf(best, "array<struct<qid:bigint,passage_id:bigint,score:double>>")


def top_k(hits: DataFrame, k: int, by: str = "qid", score: str = "score", id_: str = "passage_id") -> DataFrame:
    """Adds rank; the k best by score, ties by id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(id_))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _salts(rows: int) -> int:
    """Ways that corpus blocks are dealt, about a block each: a way gets a copy of every query block, and no join key more than its share."""
    return max(1, -(-rows // CORPUS_BLOCK))


def dense_topk(queries: DataFrame, index: DataFrame, k: int = 5, skip_self: bool = False, normalize: bool = False) -> DataFrame:
    """qid, passage_id, score (6 decimals), rank: exact inner-product search of all of ``index``.

    ``normalize`` scales the queries to unit length. Query and corpus vectors of unlike widths never meet.

    ``queries``: qid, embedding; ``index``: passage_id, embedding, of one width. No tie is lost: a block
    keeps k rows in the final order of ranking.
    """
    if normalize:
        queries = queries.select("qid", l2_normalize(F.col("embedding")).alias("embedding"))
    q, c = _blocks(queries, "qid", "embedding", QUERY_BLOCK, "q"), _blocks(index, "passage_id", "embedding", CORPUS_BLOCK, "c")
    salts = _salts(index.count())
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = c.withColumn("salt", F.pmod(F.xxhash64(F.get("c_ids", F.lit(0))), F.lit(salts)).cast("int"))
    pairs = c.join(q, "salt").filter(F.col("q_width") == F.col("c_width"))
    hits = pairs.select(F.explode(_best(k, skip_self)("q_ids", "q_matrix", "c_ids", "c_matrix", "c_width")).alias("h")).select("h.*")
    return top_k(hits, k)


def with_passages(hits: DataFrame, passages: DataFrame, drop_blank: bool = True) -> DataFrame:
    """Title and text to the hits, after the top k: a hit with blank or missing text goes or, if kept, is empty."""
    out = hits.join(passages.select("passage_id", "title", "text"), "passage_id", "left")
    return out.filter(nonblank(F.col("text"))) if drop_blank else out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))


def padded_slots(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows a query: ranks without a hit get passage_id -1, empty texts, score 0 and, where hits have an ``embedding``, a
    vector of zeros as wide as the query's."""
    grid = queries.groupBy("qid").agg(*([F.max(F.size("embedding")).alias("_w")] if "embedding" in queries.columns else [F.lit(0).alias("_w")]))
    grid = grid.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    out = grid.join(hits, ["qid", "rank"], "left")
    if "embedding" in hits.columns:
        zeros = F.array_repeat(F.lit(0.0), F.greatest("_w", F.lit(0))).cast(hits.schema["embedding"].dataType)
        out = out.withColumn("embedding", F.coalesce("embedding", zeros))
    return out.drop("_w").fillna({"passage_id": -1, "score": 0.0, **({"text": "", "title": ""} if "text" in hits.columns else {})})


def _usable(table: DataFrame, id_: str) -> DataFrame:
    """Rows with an id and a vector without nulls, of any width."""
    good = table.filter(F.col(id_).isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    return good.select(F.col(id_).cast("bigint").alias(id_), F.col("embedding").cast("array<float>").alias("embedding"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers: shorter ones end in zeros, longer ones are cut. It only routes; no score comes of it."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        v = np.asarray(v, np.float64)[:width]
        row[: len(v)] = v
    return out


def _sampled(rows: DataFrame, id_: str, n: int) -> DataFrame:
    """``n`` rows by hash of their ids, the same ones on every run."""
    return rows.orderBy(F.xxhash64(F.lit(17), id_), id_).limit(n)


def cells(index: DataFrame, n_cells: int, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means on a bounded sample (``sample`` rows by hash); unlike widths are filled up with zeros."""
    rows = _sampled(_usable(index, "passage_id"), "passage_id", sample).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    x = _matrix([r[0] for r in rows], max(len(r[0]) for r in rows))
    n_cells = min(n_cells, len(x))
    c = x[np.linspace(0, len(x) - 1, n_cells).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


#: Recall that probes are chosen for, and the rows of the index that are asked, with their exact neighbours, to measure it.
TARGET, ASKED, NEIGHBOURS = 0.95, 256, 10


def neighbour_pairs(index: DataFrame, asked: int = ASKED, k: int = NEIGHBOURS) -> tuple[list, list]:
    """Vectors of a sample of rows, once for each exact neighbour, and the neighbours' vectors: asked * k pairs at most."""
    good = _usable(index, "passage_id")
    some = _sampled(good, "passage_id", asked).select(F.col("passage_id").alias("qid"), "embedding")
    hits = dense_topk(some, good, k, skip_self=True).select("qid", "passage_id")
    with_queries = hits.join(F.broadcast(some.withColumnRenamed("embedding", "q")), "qid")  # a bounded sample
    rows = good.join(F.broadcast(with_queries), "passage_id").select("q", "embedding").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def probes_for(places: np.ndarray, target: float = TARGET) -> tuple[int, float]:
    """From the place (0 first) of each true neighbour in its query's sequence of probes: the least number of probes that
    reaches ``target``, and the recall it has. No neighbours: one probe."""
    if not len(places):
        return 1, 1.0
    n = int(np.sort(places)[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1
    return n, float((places < n).mean())


@dataclass(frozen=True)
class CellIndex:
    """Vectors packed into blocks by the cell of their nearest centroid; every row is indexed.

    ``probes`` cells a query have the measured ``recall``.
    """

    centroids: np.ndarray
    blocks: DataFrame  # cell, c_ids, c_matrix, c_width
    probes: int = 1
    recall: float = 1.0


def _nearest(c: np.ndarray, n: int):
    def f(v: pa.Array) -> pa.Array:
        order = np.argsort(-(_matrix([x.values for x in v], c.shape[1]) @ c.T), axis=1, kind="stable")[:, :n]
        return pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))

    return F.arrow_udf(f, "array<int>")


def _pack(v: pa.Array) -> pa.Array:
    return pa.array([np.asarray(x.values.flatten(), np.float32).tobytes() for x in v], pa.binary())


def _dealt_blocks(placed: DataFrame, key: str) -> DataFrame:
    """``placed`` (key, passage_id, embedding) as blocks of CORPUS_BLOCK rows of one key and width, the parts of a key numbered."""
    placed = placed.withColumn("c_width", F.size("embedding"))
    sizes = placed.groupBy(key, "c_width").agg(F.count("*").alias("_n"))  # one row a key and width
    dealt = placed.join(sizes, [key, "c_width"])
    part = F.pmod(F.xxhash64("passage_id"), F.ceil(F.col("_n") / (CORPUS_BLOCK // 2))).cast("int")
    grouped = dealt.groupBy(key, "c_width", part.alias("part")).agg(F.collect_list("passage_id").alias("c_ids"), F.collect_list("embedding").alias("_v"))
    return grouped.select(key, "part", "c_ids", F.arrow_udf(_pack, "binary")("_v").alias("c_matrix"), "c_width")


def _meeting(asked: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Blocks of queries (key, qid, embedding) with every block of their key and width.

    A query goes to each part of its key, so the blocks of a key with many rows are as many join keys.
    """
    parts = blocks.groupBy(key, "c_width").agg(F.max("part").alias("_last"))
    asked = asked.withColumn("c_width", F.size("embedding")).join(parts, [key, "c_width"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    at = [key, "c_width", "part"]
    pack = F.floor((F.row_number().over(Window.partitionBy(*at).orderBy("qid")) - 1) / QUERY_BLOCK)
    q = asked.withColumn("_p", pack).groupBy(*at, "_p").agg(F.collect_list("qid").alias("q_ids"), F.collect_list("embedding").alias("_v")).select(*at, "q_ids", F.arrow_udf(_pack, "binary")("_v").alias("q_matrix"))
    return blocks.join(q, at)


def build_cells(index: DataFrame, n_cells: int | None = None, target: float = TARGET) -> CellIndex:
    """Place every vector; cells grow with the root of the rows (half of it, 4 at least, 4,096 at most).

    The probes that a search takes by default are measured here: as many as reach ``target`` for a sample of rows. A cell with
    many rows, such as a copy held by a third of them, is many blocks: rows are dealt by cell and hash, never gathered as one
    group. Vectors of unlike widths may share a cell, but no block.
    """
    good = _usable(index, "passage_id")
    n = n_cells or int(min(4096, max(4, good.count() ** 0.5 / 2)))
    c = cells(good, n)
    if not len(c):
        return CellIndex(c, good.select(F.lit(0).alias("cell"), F.lit(0).alias("part"), F.array("passage_id").alias("c_ids"), F.lit(b"").alias("c_matrix"), F.lit(0).alias("c_width")).limit(0))
    q, near = (_matrix(v, c.shape[1]) for v in neighbour_pairs(good))
    score = q @ c.T
    probes, found = probes_for((score > score[np.arange(len(q)), (near @ c.T).argmax(1)][:, None]).sum(1), target)
    placed = good.select(F.get(_nearest(c, 1)("embedding"), F.lit(0)).alias("cell"), "passage_id", "embedding")
    return CellIndex(c, _dealt_blocks(placed, "cell"), probes, found)


def write_cells(index: CellIndex, path: str) -> None:
    """Publish the blocks, and the centroids beside them, as one version."""
    spark = index.blocks.sparkSession
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(index.centroids)], "cell int, centroid array<double>")
    versions.publish(spark, path, {"blocks": index.blocks.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part"), "centroids": rows}, probes=index.probes, recall=index.recall)


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    tables, about = versions.opened(spark, path), versions.latest(spark, path).content
    rows = tables["centroids"].orderBy("cell").collect()  # 4,096 at most
    return CellIndex(np.array([r["centroid"] for r in rows]), tables["blocks"], about["probes"], about["recall"])


def search_cells(queries: DataFrame, index: CellIndex, k: int = 5, probes: int | None = None, skip_self: bool = False) -> DataFrame:
    """qid, passage_id, score, rank: a query looks into ``probes`` cells (default: as many as the index was measured to need).

    Queries are packed per cell and every block of a cell is one matrix product for all its queries.
    """
    c = index.centroids
    good = _usable(queries, "qid")
    if not len(c):
        return top_k(good.select("qid", F.lit(0).cast("bigint").alias("passage_id"), F.lit(0.0).alias("score")).limit(0), k)
    asked = good.select("qid", "embedding", F.explode(_nearest(c, probes or index.probes)("embedding")).alias("cell"))
    pairs = _meeting(asked, index.blocks, "cell")
    return top_k(pairs.select(F.explode(_best(k, skip_self)("q_ids", "q_matrix", "c_ids", "c_matrix", "c_width")).alias("h")).select("h.*"), k)


def dense_topk_cells(queries: DataFrame, index: DataFrame, k: int = 5, n_cells: int | None = None, probes: int | None = None, skip_self: bool = False) -> DataFrame:
    """Approximate search over an index built in place; see ``build_cells`` and ``search_cells``."""
    return search_cells(queries, build_cells(index, n_cells), k, probes, skip_self)


def rerank_pool(pool: DataFrame, k: int = 3) -> DataFrame:
    """qid, context: the texts of the k best of each query's own pool (qid, pos, text, score), joined by spaces."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("pos"))
    best = pool.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return best.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda s: s["text"]), " ").alias("context"))


def best_of_pool(pool: DataFrame) -> DataFrame:
    """qid, text: the best by score, the first of equals."""
    return pool.groupBy("qid").agg(F.max_by("text", F.struct("score", -F.col("pos"))).alias("text"))


def encode_hashed(table: DataFrame, id_: str, terms: Column, dim: int = 64) -> DataFrame:
    """id, embedding: unit vectors of term counts hashed into ``dim`` places: the deterministic stand-in for a text encoder."""
    place = F.conv(F.substring(F.md5("_t"), 1, 8), 16, 10).cast("bigint") % dim
    counts = table.select(id_, F.explode(terms).alias("_t")).groupBy(id_, place.alias("_i")).agg(F.count("*").cast("double").alias("_n"))
    norm = counts.withColumn("_l", F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy(id_))))
    made = norm.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("_i", (F.col("_n") / F.col("_l")).alias("_v")))).alias("_m"))
    return made.select(id_, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("bigint")), F.lit(0.0)).cast("float")).alias("embedding"))


def encode_with(table: DataFrame, text: str, model) -> DataFrame:
    """An embedding column by a pluggable encoder: a function from a list of texts to a float matrix, called per Arrow batch."""

    def f(texts: pa.Array) -> pa.Array:
        m = np.asarray(model([t or "" for t in texts.to_pylist()]), np.float32)
        return pa.array(m.tolist(), pa.list_(pa.float32()))

    return table.withColumn("embedding", F.arrow_udf(f, "array<float>")(text))
