"""Approximate inner-product search in neighbour graphs.

Vectors are dealt into shards of bounded size by a hash of their ids. In each shard a neighbour graph is built by descent:
rows that random planes leave together are compared first, then every row joins the neighbours of its neighbours, and
those that point at it, and keeps the nearest, round by round.
Links that a nearer neighbour of the row covers are thinned out and reverse links added, so that the graph
can be walked. Rows get one more coordinate that makes all lengths equal, so near neighbours are large products
whatever the lengths.

A search walks all shards for a block of queries at once: a beam of the ``ef`` best rows seen starts from
a few scored entries, and each round expands the best rows of the beam that have not been, until none is left. More
``ef`` means more rows scored and a better recall; the share scored is reported. How many an index needs depends on how much
structure its vectors have, so ``write`` measures it: the first power of two that finds enough of the exact neighbours of a
sample of rows is kept with the index and is what a search takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.dense import ASKED, NEIGHBOURS, TARGET, _sampled, dense_topk, top_k
from sextant.sources import versions
from sextant.sources.readers import stored

#: Rows and bytes of vectors of a shard at most (in the mean; rows are dealt by hash).
SHARD, SHARD_BYTES = 1 << 16, 1 << 25
#: Neighbours kept by the descent, links of the finished graph, rounds, rows whose candidates are joined at once, and neighbours
#: in either direction that a row joins in a round.
NEAR, LINKS, ROUNDS, CHUNK, JOIN = 24, 40, 3, 1024, 8
#: Random partings that the descent starts from, and rows of their leaves.
TREES, LEAF = 8, 2048
QUERIES = 2048
#: The least beam that is measured, and entries of beams that are held at once.
EF, BEAMS = 64, 1 << 22
_SHARD = "shard int, ids binary, matrix binary, links binary, width int"


def _best_of(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k candidates (no row itself, none twice; -1: none) of each row with the largest products, and these."""
    cand = np.sort(cand, axis=1)
    bad = (cand < 0) | (cand == rows[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    s = np.einsum("nd,ncd->nc", x[rows], x[np.maximum(cand, 0)])
    s[bad] = -np.inf
    k = min(k, s.shape[1])
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(s, at, 1)
    order = np.argsort(-s, axis=1, kind="stable")
    s = np.take_along_axis(s, order, 1)
    return np.where(np.isfinite(s), np.take_along_axis(np.take_along_axis(cand, at, 1), order, 1), -1), s


def _reverse(near: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``most`` rows that point at each row, a random choice where there are more."""
    n, k = near.shape
    to, origin = near.ravel(), np.repeat(np.arange(n, dtype=np.int32), k)
    order = rng.permutation(np.flatnonzero(to >= 0))
    order = order[np.argsort(to[order], kind="stable")]
    to, origin = to[order], origin[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    out = np.full((n, most), -1, np.int32)
    keep = place < most
    out[to[keep], place[keep]] = origin[keep]
    return out


def _leaves(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """The rows parted by random planes between two of them, down to ``LEAF`` rows."""
    todo = [np.arange(len(x), dtype=np.int32)]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            yield at
            continue
        a, b = rng.choice(at, 2, replace=False)
        order = np.argpartition(x[at] @ (x[a] - x[b]), len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The nearest rows of each row in the leaf of any of ``TREES`` random partings, whose products are one matrix a leaf."""
    near, score = np.full((len(x), k), -1, np.int32), np.full((len(x), k), -np.inf, np.float32)
    for _ in range(TREES if len(x) > LEAF else 1):
        for at in _leaves(x, rng):
            s = x[at] @ x[at].T
            np.fill_diagonal(s, -np.inf)
            some = min(k, len(at))
            best = np.argpartition(-s, some - 1, axis=1)[:, :some]
            c, v = np.concatenate((near[at], at[best]), 1), np.concatenate((score[at], np.take_along_axis(s, best, 1)), 1)
            order = np.argsort(c, axis=1, kind="stable")
            c, v = np.take_along_axis(c, order, 1), np.take_along_axis(v, order, 1)
            v[:, 1:][c[:, 1:] == c[:, :-1]] = -np.inf
            order = np.argsort(-v, axis=1, kind="stable")[:, :k]
            score[at] = np.take_along_axis(v, order, 1)
            near[at] = np.where(np.isfinite(score[at]), np.take_along_axis(c, order, 1), -1)
    return near


def descend(x: np.ndarray, k: int = NEAR, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Approximate nearest neighbours by descent: row numbers, best first, -1 where there are fewer.

    A leaf holds all rows of a small shard, which makes the start exact. Rounds end early when few neighbours change.
    """
    n, rng = len(x), np.random.default_rng(seed)
    near = _start(x, k, rng)
    for _ in range(rounds if n > LEAF else 0):
        back = _reverse(near, JOIN, rng)
        both = np.concatenate((near[:, rng.permutation(k)[:JOIN]], back), 1)
        new = np.empty_like(near)
        for begin in range(0, n, CHUNK):
            rows = np.arange(begin, min(n, begin + CHUNK))
            mine = both[rows]
            step = np.where(mine[:, :, None] >= 0, both[np.maximum(mine, 0)][:, :, rng.permutation(2 * JOIN)[:JOIN]], -1)
            new[rows] = _best_of(x, rows, np.concatenate((near[rows], mine, step.reshape(len(rows), -1)), 1), k)[0]
        changed = np.mean(new != near)
        near = new
        if changed < 0.01:
            break
    return near


def walkable(x: np.ndarray, near: np.ndarray, links: int = LINKS, seed: int = 0) -> np.ndarray:
    """Links to walk: a neighbour stays unless one nearer to the row is nearer to it than the row is; reverse links follow."""
    n, k = near.shape
    kept = near.copy()
    for begin in range(0, n, CHUNK):
        rows = np.arange(begin, min(n, begin + CHUNK))
        c = near[rows]
        v = x[np.maximum(c, 0)]
        to_row, each = np.einsum("nd,ncd->nc", x[rows], v), np.einsum("ncd,ned->nce", v, v)
        stays = c >= 0
        for j in range(1, k):
            stays[:, j] &= ~((each[:, j, :j] > to_row[:, j, None]) & stays[:, :j]).any(1)
        # What the thinning leaves out fills the places behind, so no row loses its near ones altogether.
        order = np.argsort(~stays, axis=1, kind="stable")
        kept[rows] = np.take_along_axis(c, order, 1)
    forward = kept[:, : links // 2]
    back = _reverse(forward, links - forward.shape[1], np.random.default_rng(seed))
    return np.concatenate((forward, back), 1).astype(np.int32)


def walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, k: int, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (-1: none) and products of the k best found for each query, and how many rows were scored."""
    n, m = len(x), len(q)
    ef = min(max(ef, k), n)
    entry = np.unique(np.linspace(0, n - 1, min(n, max(ef, int(n**0.5)))).astype(np.int64))
    s = q @ x[entry].T
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    scored = np.full(m, len(entry))
    order = np.argsort(-s, axis=1, kind="stable")[:, :ef]
    beam, score = entry[order], np.take_along_axis(s, order, 1)
    done = np.zeros(beam.shape, bool)
    row = np.arange(m)[:, None]
    while True:
        waits = np.where(done, -np.inf, score)
        at = np.argsort(-waits, axis=1, kind="stable")[:, :step]
        go = np.isfinite(np.take_along_axis(waits, at, 1))
        if not go.any():
            break
        np.put_along_axis(done, at, True, 1)
        nb = np.where(go[:, :, None], links[np.take_along_axis(beam, at, 1)], -1).reshape(m, -1)
        nb = np.sort(nb, axis=1)
        bad = (nb < 0) | seen[row, np.maximum(nb, 0)]
        bad[:, 1:] |= nb[:, 1:] == nb[:, :-1]
        who, col = np.nonzero(~bad)
        new = np.full(nb.shape, -np.inf, np.float32)
        if len(who):
            target = nb[who, col]
            seen[who, target] = True
            new[who, col] = np.einsum("nd,nd->n", q[who], x[target])
            scored += np.bincount(who, minlength=m)
        every, ids, old = np.concatenate((score, new), 1), np.concatenate((beam, nb), 1), np.concatenate((done, bad), 1)
        top = np.argpartition(-every, ef - 1, axis=1)[:, :ef] if every.shape[1] > ef else np.tile(np.arange(every.shape[1]), (m, 1))
        score, beam, done = (np.take_along_axis(v, top, 1) for v in (every, ids, old))
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(score, order, 1)
    return np.where(np.isfinite(score), np.take_along_axis(beam, order, 1), -1), score, scored


def _even(x: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all rows are as long as the longest."""
    size = (x.astype(np.float64) ** 2).sum(1)
    return np.c_[x, np.sqrt(np.maximum(0, size.max(initial=0) - size))].astype(np.float32)


def _build(table: pa.Table) -> pa.Table:
    ids = table["passage_id"].to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(len(ids), -1)[order]
    even = _even(x)
    links = walkable(even, descend(even))
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "matrix": [x.tobytes()], "links": [links.tobytes()], "width": pa.array([x.shape[1]], pa.int32())})


@dataclass(frozen=True)
class GraphIndex:
    shards: DataFrame  # shard, ids, matrix, links, width
    n: int
    ef: int = EF
    recall: float = 1.0


def usable(table: DataFrame, id_: str) -> DataFrame:
    """Rows with an id and a vector without nulls."""
    good = table.filter(F.col(id_).isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull()))
    return good.select(F.col(id_).cast("bigint").alias(id_), F.col("embedding").cast("array<float>").alias("embedding"))


def build(index: DataFrame) -> DataFrame:
    """The shards of ``index`` (passage_id, embedding), one row each; every usable row is in one, widths apart."""
    good = usable(index, "passage_id").withColumn("width", F.size("embedding"))
    sizes = good.groupBy("width").agg(F.count("*").alias("_n"))  # one row a width
    rows = F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (4 * F.col("width"))))
    dealt = good.join(F.broadcast(sizes), "width").withColumn("shard", F.pmod(F.xxhash64("passage_id"), F.ceil(F.col("_n") / rows)).cast("int"))
    return dealt.select("width", "shard", "passage_id", "embedding").groupBy("width", "shard").applyInArrow(_build, _SHARD)


def _count(shards: DataFrame) -> int:
    return shards.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 8


def measured(index: DataFrame, graph: GraphIndex, target: float = TARGET) -> tuple[int, float]:
    """The least beam, a power of two, that finds ``target`` of the exact neighbours of a sample of rows, and what it finds of them.

    A beam of all rows of a shard is an exact search, so there is one.
    """
    good = usable(index, "passage_id")
    some = stored(_sampled(good, "passage_id", ASKED).withColumnRenamed("passage_id", "qid"), "sample")
    exact = stored(dense_topk(some, good, NEIGHBOURS, skip_self=True).select("qid", "passage_id"), "neighbours")
    ef, found = EF, 1.0
    while exact.head(1):
        found = recall(search(some, graph, NEIGHBOURS, ef, skip_self=True)[0], exact).first()[0]
        if found >= target or ef >= 2 * SHARD:
            break
        ef *= 2
    return ef, found


def write(index: DataFrame, path: str, target: float = TARGET) -> GraphIndex:
    """Build the index of ``index``, measure the beam it needs and publish it at ``path``; readers see the one before until it is whole."""
    spark = index.sparkSession
    base, folder = versions.latest(spark, path), f"{versions.new_name()}/shards"
    build(index).write.parquet(f"{path}/{folder}")
    shards = spark.read.schema(_SHARD).parquet(f"{path}/{folder}")
    ef, found = measured(index, GraphIndex(shards, _count(shards)), target)
    versions.commit(spark, path, base, {"tables": {"shards": folder}, "ef": ef, "recall": found})
    return open_graph(spark, path)


def open_graph(spark: SparkSession, path: str) -> GraphIndex:
    shards, about = versions.opened(spark, path)["shards"], versions.latest(spark, path).content
    return GraphIndex(shards, _count(shards), about.get("ef", EF), about.get("recall", 1.0))


def _walks(k: int, ef: int, skip_self: bool):
    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                w = one["width"].as_py()
                ids, x = (np.frombuffer(one[c].as_buffer(), t) for c, t in (("ids", np.int64), ("matrix", np.float32)))
                x = x.reshape(-1, w)
                links = np.frombuffer(one["links"].as_buffer(), np.int32).reshape(len(x), -1)
                qids = one["q_ids"].values.to_numpy()
                q = np.asarray(one["q_embeddings"].values.flatten(), np.float32).reshape(-1, w)
                part = max(1, min((1 << 25) // len(x), BEAMS // ef))  # queries at once: the rows that they have seen are marked in 32 MB
                for begin in range(0, len(q), part):
                    some, own = q[begin : begin + part], qids[begin : begin + part]
                    at, _, scored = walk(some, x, links, k + skip_self, ef)
                    hit, col = np.nonzero(at >= 0)
                    found = at[hit, col]
                    # Scored again as exact search does: doubles, rounded before ranking.
                    s = np.round(np.einsum("nd,nd->n", some[hit].astype(np.float64), x[found].astype(np.float64)), 6) + 0.0
                    keep = ids[found] != own[hit] if skip_self else np.ones(len(hit), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(own[hit][keep]), pa.array(ids[found][keep]), pa.array(s[keep]), pa.nulls(int(keep.sum()), pa.int64())], ["qid", "passage_id", "score", "scored"])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.float64()), pa.array(scored.astype(np.int64))], ["qid", "passage_id", "score", "scored"])

    return walks


def search(queries: DataFrame, index: GraphIndex, k: int = 10, ef: int | None = None, skip_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hits (qid, passage_id, score of 6 decimals, rank) and the rows scored (qid, scored, share of all rows).

    ``ef`` is the beam kept in each shard (default: as was measured). Queries meet shards of their width alone. Scores are exact, hits may be missed.
    """
    asked = usable(queries, "qid").withColumn("width", F.size("embedding"))
    spots = index.shards.select("width", "shard")  # one narrow row a shard
    per = asked.join(spots, "width").withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // QUERIES)))))
    blocks = per.groupBy("width", "shard", "_b").agg(F.collect_list("qid").alias("q_ids"), F.collect_list("embedding").alias("q_embeddings")).drop("_b")
    met = index.shards.join(blocks, ["width", "shard"]).select("ids", "matrix", "links", "width", "q_ids", "q_embeddings")
    found = stored(met.mapInArrow(_walks(k, ef or index.ef, skip_self), "qid bigint, passage_id bigint, score double, scored bigint"), "walks")
    hits = top_k(found.filter("scored IS NULL").select("qid", "passage_id", "score"), k)
    scored = found.filter("scored IS NOT NULL").groupBy("qid").agg(F.sum("scored").alias("scored"))
    return hits, scored.withColumn("share", F.col("scored") / F.lit(float(index.n or 1)))


def recall(near: DataFrame, exact: DataFrame) -> DataFrame:
    """recall: the share of the rows (qid, passage_id) of ``exact`` that ``near`` has; one row."""
    hit = near.select("qid", "passage_id", F.lit(1).alias("_hit"))
    return exact.select("qid", "passage_id").join(hit, ["qid", "passage_id"], "left").agg((F.count("_hit") / F.count("*")).alias("recall"))
