"""Mixing sources to target weights by balanced sampling with the cube method.

A source's rate is its target over its size, at most 3. Each document is taken floor(rate) times, and
once more with the fractional part as its inclusion probability. The cube method's flight moves these
probabilities along the null space of the constraints (tokens, documents) until each is 0 or 1, so the
balance holds exactly; it runs in small blocks of a source, side by side, and the up to two documents
a block leaves open go on to the next level. The last level also holds a reserve of the source, some
RESERVE documents by hash that no block had: what is open there at the end, two documents at most, is
the landing problem, and documents of the reserve change sides until tokens and documents come out.

Equal rows are one unit: it is taken floor(rate * rows) times, with the rest as its probability, and its
rows share what it got as evenly as they can. So no block and no reserve holds a row often.
"""

from __future__ import annotations

import itertools
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, load, nested, row_hash, settle, unnested

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents in one block of the flight. Every level keeps all rows; only the block size is bounded.
BLOCK = 2000
#: Documents of a source, in the mean, that wait for the last level.
RESERVE = 256
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Targets by weight in code-point order of the source, null last; what exceeds ``most`` times a size is reshared by weight.

    An empty dictionary gives an empty one; a source of size 0 gets 0.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, out, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        left, share = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / share > most * sizes[s]}
        if not over:
            return {s: float(out[s] if s in out else left * weight[s] / share) for s in order}
        out |= {s: Fraction(most * sizes[s]) for s in over}
        free -= over
    return {s: float(out[s]) for s in order}


def flight(pi: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move probabilities until two at most lie strictly between 0 and 1; keeps the sums of pi and of size * pi."""
    rng, pi = np.random.default_rng(seed), [float(x) for x in pi]
    size = [float(x) for x in size]
    draws = iter(rng.random(2 * len(pi) + 8))
    open_: list[int] = []
    for i in (k for k, p in enumerate(pi) if 0 < p < 1):
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            ahead = min((1 - pi[k]) / v if v > 0 else -pi[k] / v for k, v in zip(open_, u, strict=True) if v)
            back = min(pi[k] / v if v > 0 else (pi[k] - 1) / v for k, v in zip(open_, u, strict=True) if v)
            step = ahead if next(draws) * (ahead + back) < back else -back
            for k, v in zip(open_, u, strict=True):
                pi[k] += step * v
                pi[k] = 0.0 if pi[k] < 1e-9 else 1.0 if pi[k] > 1 - 1e-9 else pi[k]
            open_ = [k for k in open_ if 0 < pi[k] < 1]
    return np.array(pi)


def landing(start: np.ndarray, pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the open documents and mend what their rounding costs.

    The open ones (two at most) take the choice that misses their expected tokens least. Then, while it
    brings the totals nearer to their expectation, the best single document or pair among those that
    had a choice (0 < start < 1) changes sides. A document off counts as a token off.
    """
    size = size.astype(float)
    open_ = [i for i, p in enumerate(pi) if 0 < p < 1]
    out = pi.copy()
    if open_:
        p, s = pi[open_], size[open_]
        out[open_] = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs((np.array(x) - p) @ s), abs((np.array(x) - p).sum()), x))
    free = np.flatnonzero((start > 0) & (start < 1))
    for _ in range(8 if len(free) else 0):
        off, count = (out - start) @ size, (out - start).sum()
        sign = np.where(out[free] > 0.5, -1.0, 1.0)
        change = sign * size[free]
        one = np.abs(off + change) + np.abs(count + sign)
        pair = np.abs(off + change[:, None] + change[None, :]) + np.abs(count + sign[:, None] + sign[None, :])
        np.fill_diagonal(pair, np.inf)
        i, j = divmod(int(pair.argmin()), len(free))
        if min(one.min(), pair[i, j]) >= abs(off) + abs(count) - 1e-9:
            break
        for k in [int(one.argmin())] if one.min() <= pair[i, j] else [i, j]:
            out[free[k]] = 1.0 - out[free[k]]
    return out


def _fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["_order", "doc_id", "_key", "size"], na_position="last", kind="stable").reset_index(drop=True)
    return rows.assign(_pi=flight(rows["_pi"].to_numpy(), rows["size"].to_numpy(), zlib.crc32(repr(key).encode())))


def _land(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    start = rows.sort_values(["_order", "doc_id", "_key", "size"], na_position="last", kind="stable")["_pi"].to_numpy()
    rows = _fly(key, rows)
    return rows.assign(_pi=landing(start, rows["_pi"].to_numpy(), rows["size"].to_numpy()))


def units(docs: DataFrame) -> DataFrame:
    """One row per kind of equal rows of ``docs``: doc_id, source, size, source_size, target, key (a hash of the
    whole row), n (how many rows) and taken (how often all of them together).

    Only one row per source reaches the driver: a mixture names its sources. Blocks depend on the row's
    hash alone, so reruns agree. Nulls: a null text has size 0, a null source is a source, a null doc_id
    is a value as any other. Ties can't matter: equal rows are one unit.
    """
    spark = docs.sparkSession
    settle(spark)
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), row_hash(docs).alias("_key"))
    rows = cut(rows.groupBy("doc_id", "source", "size", "_key").agg(F.count("*").alias("_c")))
    per = {r["source"]: (r["s"] or 0, r["n"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_c")).alias("s"), F.count("*").alias("n")).collect()}
    want = targets({s: x[0] for s, x in per.items()})
    table = spark.createDataFrame([(s, x[0], want[s], min(float(MOST), want[s] / x[0]) if x[0] else 0.0, -(-x[1] // BLOCK), x[1]) for s, x in per.items()], "_source string, source_size bigint, target double, _rate double, _blocks bigint, _n bigint")
    # One row per source, as collected above: small by the same token.
    rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    times = F.col("_rate") * F.col("_c")
    whole = F.floor(times).cast("bigint")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "_key", "_c", whole.alias("_whole"), (times - whole).alias("_pi"), F.xxhash64("_key", F.lit(7)).alias("_order"), "_blocks", "_n")
    waits = F.pmod("_order", F.greatest(F.floor(F.col("_n") / RESERVE), F.lit(1))) == 0
    reserve, rows = rows.filter(waits).drop("_n"), rows.filter(~waits).drop("_n")
    done, level = [], 0
    schema = rows.schema
    while True:
        blocks = F.pmod(F.xxhash64("_key", F.lit(level)), F.col("_blocks"))
        rows = cut(rows.groupBy("source", blocks.alias("_block")).applyInPandas(_fly, schema))
        still = (F.col("_pi") > 0) & (F.col("_pi") < 1)
        done.append(rows.filter(~still))
        open_ = rows.filter(still)
        counts = {r["source"]: r["n"] for r in open_.groupBy("source").agg(F.count("*").alias("n")).collect()}
        if max(counts.values(), default=0) <= BLOCK:
            done.append(open_.unionByName(reserve).groupBy("source").applyInPandas(_land, schema))
            break
        table = spark.createDataFrame([(s, -(-n // BLOCK)) for s, n in counts.items()], "_source string, _blocks bigint")
        rows = open_.drop("_blocks").join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").select(*schema.names)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("_key").alias("key"), F.col("_c").alias("n"), (F.col("_whole") + F.col("_pi").cast("bigint")).alias("taken"))


def _times(n, step: int = 4096):
    """Two generators whose product has ``n`` rows, so that no row holds an array of more than n / step or ``step``."""
    return F.sequence(F.lit(0), F.floor((n - 1) / step)), lambda part: F.sequence(F.lit(1), F.least(F.lit(step), n - part * step))


def mixed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and copies, how often the mix takes it.

    The rows of a kind share what was taken of it, the first ones one more. See ``units`` for nulls and ties; an
    empty table gives an empty one.
    """
    chunks, within = _times(F.col("n"))
    each = units(docs).withColumn("part", F.explode(chunks)).withColumn("i", F.explode(within(F.col("part"))))
    copies = F.floor(F.col("taken") / F.col("n")) + (F.col("part") * 4096 + F.col("i") <= F.pmod("taken", F.col("n"))).cast("int")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``, whatever their names.

    Equal rows share the copies that all of them got. A document that isn't taken goes.
    """
    taken = units(docs).filter("taken > 0").select("key", "n", "taken")
    keyed = docs.select(nested(docs).alias("row"), row_hash(docs).alias("key"))
    one = keyed.join(taken.filter("n = 1"), "key").select("row", "taken")
    equal = keyed.join(taken.filter("n > 1"), "key").groupBy("key").agg(F.first("row").alias("row"), F.first("taken").alias("taken")).select("row", "taken")
    chunks, within = _times(F.col("taken"))
    each = one.union(equal).withColumn("part", F.explode(chunks)).withColumn("i", F.explode(within(F.col("part"))))
    return each.select(*unnested(docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    return mixed(load(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
