"""Hard negatives by bit-sliced integer products.

Vectors are whole numbers in two's complement. A block of rows is cut into bit-planes, and the product
of an anchor with the rows grows plane by plane, the sign first: after each plane a score lies in an
interval, the sum so far plus what the planes still to come can add at least and at most. Candidates whose
interval can't meet the wanted range, or lies below enough lower ends already known, are dropped before
the next plane; what survives the last plane has its exact score.

Anchors and rows are packed into blocks, and every block of anchors meets every block of rows once in
each of two passes: the first takes the best rows of the anchor's label, the second, with the positives'
scores beside the anchor, the best rows of other labels in the range of each. A pair of blocks returns
at most k rows for each anchor and positive, and a ranking window, which drops rows before the shuffle as well, takes the
first k of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import cut, let_go, load, quoted, settle

ROWS, ANCHORS = 4096, 256
#: Blocks of rows that meet the anchors' blocks under one join key; there are as many keys as this needs.
PER_KEY = 8
#: Share of the pairs of two blocks still alive below which planes are multiplied pair by pair.
SPARSE = 0.3


def _packer(rows: int, extra: bool):
    """Blocks of up to ``rows`` rows of one width: ids, keys, labels, matrix and, of anchors, the positives' scores."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(w: int) -> pa.RecordBatch:
            parts = held.pop(w)
            ids, keys, labels, matrix = (np.concatenate([p[k] for p in parts]) for k in range(4))
            cols = [pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([keys.tolist()], pa.list_(pa.int64())), pa.array([labels.tolist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary()), pa.array([w], pa.int32())]
            scores = [pa.array([[s for p in parts for s in p[4]]], pa.list_(pa.list_(pa.int64())))] if extra else []
            return pa.RecordBatch.from_arrays([*cols, *scores], ["ids", "keys", "labels", "matrix", "width", "scores"][: 5 + extra])

        for batch in batches:
            ids, keys, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            v = batch.column(3)
            widths, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            starts, scores = np.cumsum(widths) - widths, batch.column(4).to_pylist() if extra else None
            for w in np.unique(widths).tolist():
                where = np.flatnonzero(widths == w)
                matrix = flat[starts[where][:, None] + np.arange(w)]
                for begin in range(0, len(where), rows):
                    at = where[begin : begin + rows]
                    held.setdefault(w, []).append((ids[at], keys[at], labels[at], matrix[begin : begin + rows], [scores[i] for i in at] if extra else None))
                    if sum(len(p[0]) for p in held[w]) >= rows:
                        yield out(w)
        for w in list(held):
            yield out(w)

    return pack


def _blocks(table: DataFrame, rows: int, name: str) -> DataFrame:
    extra = "scores" in table.columns
    packed = table.mapInArrow(_packer(rows, extra), "ids array<bigint>, keys array<bigint>, labels array<bigint>, matrix binary, width int" + ", scores array<array<bigint>>" * extra)
    return packed.select(*(F.col(c).alias(f"{name}_{c}") for c in packed.columns))


class Planes:
    """The bit-planes of a matrix of whole numbers, the sign's first, with their weights."""

    def __init__(self, rows: np.ndarray, most: int):
        """``most``: the largest sum of absolute entries of a vector to multiply with."""
        top = int(max(-int(rows.min(initial=0)) - 1, int(rows.max(initial=0)), 0)).bit_length()
        reach = most * 2 ** (top + 1)  # all partial sums are below
        self.kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object
        self.planes = [((rows >> k) & 1).astype(np.uint8) for k in range(top, -1, -1)]
        self.weights = [-(2**top), *(2**k for k in range(top - 1, -1, -1))]

    def steps(self) -> Iterator[tuple[int, np.ndarray, int]]:
        """Weight, plane, and the largest sum of the weights still to come."""
        for w, p in zip(self.weights, self.planes, strict=True):
            yield w, p, abs(w) - 1


def _alive_pairs(anchors: np.ndarray, rows: np.ndarray, allowed: np.ndarray, low: np.ndarray | None, high: np.ndarray | None, best: int, prune) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor the rows that may qualify and their exact scores.

    ``low`` and ``high`` bound the wanted scores of each anchor; ``prune(anchor, lower, upper)`` tells of one anchor's
    candidates which ones can still qualify, given the ends of their intervals.
    """
    most = int(np.abs(anchors).sum(1).max(initial=0)) or 1
    planes = Planes(rows, most)
    a = anchors.astype(planes.kind)
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    total = np.zeros(allowed.shape, planes.kind)
    alive, steps = allowed, planes.steps()
    rest = 0
    for weight, plane, rest in steps:  # densely, for all anchors, while most pairs are alive
        total += a @ (plane.T.astype(planes.kind) * weight)
        if low is not None:
            alive = alive & (total + (rest * up)[:, None] >= low[:, None]) & (total + (rest * down)[:, None] <= high[:, None])
        else:
            floor = np.where(alive, total + (rest * down)[:, None], -np.inf) if rest < 2 ** (len(planes.planes) - 3) else None
            if floor is not None and floor.shape[1] > best:
                bar = np.partition(floor, floor.shape[1] - best, axis=1)[:, floor.shape[1] - best]
                alive = alive & (total + (rest * up)[:, None] >= bar[:, None])
        if np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    left = list(steps)
    for i in np.flatnonzero(alive.any(1)):
        at = np.flatnonzero(alive[i])
        s, r = total[i, at], rest
        keep = prune(i, s + r * down[i], s + r * up[i])
        at, s = at[keep], s[keep]
        for weight, plane, r in left:
            s = s + (plane[at].astype(planes.kind) * weight) @ a[i]
            keep = prune(i, s + r * down[i], s + r * up[i])
            at, s = at[keep], s[keep]
        yield i, at, np.array([int(v) for v in s], np.int64)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _positives(k: int):
    """The first k rows of each anchor's label within a pair of blocks."""

    def prune(_: int, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else np.ones(len(lower), bool)

    def best(ai: pa.Array, ak: pa.Array, al: pa.Array, am: pa.Array, ci: pa.Array, cl: pa.Array, cm: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for ids, keys, labels, m, rid, rl, rm, w in zip(ai, ak, al, am, ci, cl, cm, width.to_pylist(), strict=True):
            ids, keys, labels, rid, rl = (x.values.to_numpy() for x in (ids, keys, labels, rid, rl))
            a, c = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, w) for x in (m, rm))
            found = []
            for label in np.intersect1d(labels, rl):  # only rows of the label are multiplied at all
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(rl == label)
                for i, at, s in _alive_pairs(a[mine], c[theirs], ids[mine][:, None] != rid[theirs][None, :], None, None, k, prune):
                    own, other = mine[i], rid[theirs[at]]
                    found += [{"anchor_id": int(ids[own]), "key": int(keys[own]), "id": int(other[j]), "score": int(s[j])} for j in _first(other, s, k)]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("anchor_id", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])))

    return F.arrow_udf(best, "array<struct<anchor_id:bigint,key:bigint,id:bigint,score:bigint>>")


def _negatives(k: int, low: int, high: int):
    """For each anchor and each score of its positives the first k rows of other labels within the range."""

    def best(ai: pa.Array, ak: pa.Array, al: pa.Array, am: pa.Array, sc: pa.Array, ci: pa.Array, cl: pa.Array, cm: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for ids, keys, labels, m, scores, rid, rl, rm, w in zip(ai, ak, al, am, sc.to_pylist(), ci, cl, cm, width.to_pylist(), strict=True):
            ids, keys, labels, rid, rl = (x.values.to_numpy() for x in (ids, keys, labels, rid, rl))
            a, c = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, w) for x in (m, rm))
            # low * p <= 100 * s <= high * p in whole numbers: ceil(low * p / 100) <= s <= floor(high * p / 100).
            ranges = [[(p, -(-low * p // 100), high * p // 100) for p in ps] for ps in scores]
            least = np.array([min((lo for _, lo, _ in x), default=1) for x in ranges], np.float64)
            most = np.array([max((hi for _, _, hi in x), default=0) for x in ranges], np.float64)

            def prune(i: int, lower: np.ndarray, upper: np.ndarray, ranges=ranges) -> np.ndarray:
                keep = np.zeros(len(lower), bool)
                for _, lo, hi in ranges[i]:
                    sure = lower[(lower >= lo) & (upper <= hi)]
                    bar = max(lo, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else lo
                    keep |= (upper >= bar) & (lower <= hi)
                return keep

            found = []
            for i, at, s in _alive_pairs(a, c, labels[:, None] != rl[None, :], least, most, k, prune):
                for p, lo, hi in ranges[i]:
                    good = np.flatnonzero((s >= lo) & (s <= hi))
                    other = rid[at[good]]
                    found += [{"anchor_id": int(ids[i]), "key": int(keys[i]), "positive_score": p, "id": int(other[j]), "score": int(s[good[j]])} for j in _first(other, s[good], k)]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("anchor_id", pa.int64()), ("key", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])))

    return F.arrow_udf(best, "array<struct<anchor_id:bigint,key:bigint,positive_score:bigint,id:bigint,score:bigint>>")


def _first_of(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _meet(anchors: DataFrame, rows: DataFrame, keys: int) -> DataFrame:
    """Every block of anchors with every block of rows of its width, under ``keys`` join keys that share the blocks of rows."""
    dealt = rows.withColumn("key", F.pmod(F.xxhash64(F.get("c_ids", F.lit(0)), F.get("c_keys", F.lit(0))), F.lit(keys)).cast("int"))
    asked = anchors.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(keys - 1))))
    return dealt.join(asked, "key").filter(F.col("a_width") == F.col("c_width"))


def hard_negatives(table: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``table`` and ``anchors``: id, label, x (whole numbers). An anchor's positives are its first rows of the same label and
    another id; for each of them come the first rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score (percents of at most 100). Higher scores come first,
    ties by smaller id. A row with a null id or label, or a null, empty or partly null vector, takes no part. Vectors of unlike
    widths have no score. Rows that repeat count as often as they are there; equal anchors count once, and anchors that share
    an id but not label and vector each have their own rows. A positive score below zero has an empty range.
    Empty tables give an empty one. Scores are exact; they must fit into a long.
    """
    settle(table.sparkSession)

    def fit_rows(t: DataFrame) -> DataFrame:
        x = F.col("x")
        good = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull())
        return t.filter(good).select(F.col("id").cast("bigint"), F.xxhash64("label", "x").alias("key"), F.col("label").cast("bigint"), x.cast("array<bigint>").alias("x"))

    # Rows of a label stand together in a partition, so most pairs of blocks share few labels.
    rows = cut(_blocks(fit_rows(table).sortWithinPartitions("label"), ROWS, "c"))
    asked = cut(fit_rows(anchors).dropDuplicates(["id", "key"]))
    keys = max(1, -(-rows.count() // PER_KEY))
    met = _meet(_blocks(asked.sortWithinPartitions("label"), ANCHORS, "a"), rows, keys)
    near = met.select(F.explode(_positives(positives)("a_ids", "a_keys", "a_labels", "a_matrix", "c_ids", "c_labels", "c_matrix", "c_width")).alias("h")).select("h.*")
    chosen = cut(_first_of(near, ["anchor_id", "key"], positives).select("anchor_id", "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    per = chosen.groupBy("anchor_id", "key").agg(F.collect_set("positive_score").alias("scores"))  # as many as positives, at most
    told = asked.join(per, (F.col("id") == F.col("anchor_id")) & (asked["key"] == per["key"])).select("id", asked["key"], "label", "x", "scores")
    met = _meet(_blocks(told, ANCHORS, "a"), rows, keys)
    far = met.select(F.explode(_negatives(negatives, low, high)("a_ids", "a_keys", "a_labels", "a_matrix", "a_scores", "c_ids", "c_labels", "c_matrix", "c_width")).alias("h")).select("h.*")
    ranked = cut(_first_of(far, ["anchor_id", "key", "positive_score"], negatives))
    let_go(rows)
    out = ranked.join(chosen, ["anchor_id", "key", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def finite(column: str) -> Column:
    v = quoted(column)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose vec_id 100 divides; see ``hard_negatives`` for awkward rows.

    Components become floor(256 * x), between -2^53 and 2^53; where 7 divides vec_id the label first becomes (label + 1) % 10.
    """
    far = 1 << 53
    whole = F.transform("embedding", lambda c: F.least(F.greatest(F.floor(256 * c.cast("double")), F.lit(-far)), F.lit(far)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    rows = load(spark, sf_dir, "embeddings").filter(finite("embedding")).select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("x"))
    return hard_negatives(rows, rows.filter(F.col("id") % 100 == 0))


ORACLE = r"""
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), a AS (
  SELECT * FROM t WHERE vec_id % 100 = 0
), s AS (
  SELECT a.vec_id AS anchor_id, t.vec_id AS id, a.label = t.label AS same, CAST(list_dot_product(a.x, t.x) AS BIGINT) AS score
  FROM a JOIN t ON a.vec_id <> t.vec_id AND len(a.x) = len(t.x)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
