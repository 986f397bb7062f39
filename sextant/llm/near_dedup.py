"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: round i hashes every shingle to a bin and a value; a bin keeps the least value of the first
round that reaches it. The first T rounds place at random, the next T rounds send everything to bin
i - T, so after 2T rounds at most every coordinate is filled; its entries agree with the Jaccard
similarity as probability, with concentration bounds as if drawn independently. A set of n shingles
costs about n + T log T hashes in place of n * T.

Equal sets collapse to one node first. Nodes that share a band meet in a bucket, which never lists its
pairs. First every member of a bucket is held against the bucket's least node, its pivot, on full
shingle sets, and components form. A bucket whose other members are of one component is through. The
members of the rest are dealt into blocks of bounded size, those of a bucket's largest component
apart, and two blocks that share such a bucket are compared as matrices of shingles by nodes: only
links that join components come back. So every pair that shares a bucket is verified or already linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, let_go, load, lower_bytes, mix, nested, settle, small, unnested

T = 288


#: Chance that a pair at the threshold shares no band.
MISS = 1.1e-5


def shape(percent: int) -> tuple[int, int]:
    """Bands and rows of the sketch: the longest rows at which a pair at the threshold misses all bands with
    probability MISS at most. 85: 36 bands of 8; 80: 48 of 6. Thresholds that no shape meets are refused."""
    for rows in range(min(8, T), 0, -1):
        if T % rows == 0 and (1 - (percent / 100) ** rows) ** (T // rows) <= MISS:
            return T // rows, rows
    raise ValueError(f"no bands of {T} bins find pairs at {percent} percent")


_BLOCK = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_POWER = mix(np.arange(4096, dtype=np.uint64), 12) | np.uint64(1)
_UNSEEN = np.uint64(2**64 - 1)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a block of bytes."""
    a = np.frombuffer(raw, np.uint8)
    inside = ~_WHITE[a]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    index = np.flatnonzero(inside)
    first = np.searchsorted(index, starts)
    length = np.diff(np.append(first, len(index)))
    place = np.arange(len(index)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        power = _POWER[np.minimum(place, 4095)]
        if len(far := np.flatnonzero(place > 4095)):  # every place of a word has a factor of its own
            power[far] = mix(place[far].astype(np.uint64), 12) | np.uint64(1)
        sums = np.add.reduceat(_BYTE[a[index]] * power, first)
        return starts, mix(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 13)


def _words(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of each whole text, computed over blocks of about a megabyte."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    block: list[bytes] = []
    who: list[int] = []
    held = 0

    def flush() -> None:
        offsets = np.cumsum([0] + [len(b) + 1 for b in block])
        starts, hashes = _word_hashes(b"\n".join(block))
        at = np.searchsorted(starts, offsets)
        for k, i in enumerate(who):
            out[i] = np.concatenate((out[i], hashes[at[k] : at[k + 1]])) if len(out[i]) else hashes[at[k] : at[k + 1]]

    for i, t in enumerate(texts):
        raw = lower_bytes((t or "").encode("utf-8", "surrogatepass"))
        begin = 0
        while begin < len(raw):
            end = len(raw)
            if end - begin > _BLOCK:  # a long text goes in pieces that end before white space
                end = begin + _BLOCK
                while end < len(raw) and not _WHITE[raw[end]]:
                    end += 1
            block.append(raw[begin:end])
            who.append(i)
            held += end - begin
            begin = end
            if held >= _BLOCK:
                flush()
                block, who, held = [], [], 0
    if block:
        flush()
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none make none."""
    sets = []
    for h in _words(texts):
        w = min(width, len(h))
        if not w:
            sets.append(h)
            continue
        s = mix(h[: len(h) - w + 1], w)
        for k in range(1, w):
            s = mix(s ^ h[k : len(h) - w + 1 + k], k)
        sets.append(np.unique(s))
    return sets


def sketch(shingles: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: for each of ``t`` bins the first round's least value."""
    bins = np.full(t, _UNSEEN)
    step = max(1, 4096 // len(shingles))
    for begin in range(0, 2 * t, step):
        rounds = np.arange(begin, min(2 * t, begin + step), dtype=np.uint64)
        v = mix(shingles[None, :] ^ mix(rounds, 14)[:, None], 15)
        place = ((v >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        late = rounds >= t
        place[late] = (rounds[late] - np.uint64(t))[:, None]
        np.minimum.at(bins, place.astype(np.int64).ravel(), ((rounds[:, None] << np.uint64(48)) | (mix(v, 16) >> np.uint64(16))).ravel())
        if not (bins == _UNSEEN).any():
            break
    return bins


def bands(bins: np.ndarray, n: int, rows: int) -> np.ndarray:
    grid = bins.reshape(n, rows)
    h = mix(np.arange(n, dtype=np.uint64), 17)
    for k in range(rows):
        h = mix(h ^ grid[:, k], 18)
    return h.astype(np.int64)


_PRINT = "struct<n:bigint,f1:bigint,f2:bigint,bands:array<bigint>>"


def _print(width: int, percent: int):
    def prints(texts: pa.Array) -> pa.Array:
        n, f1, f2, keys = [], [], [], []
        for s in shingle_sets(texts.to_pylist(), width):
            n.append(len(s))
            with np.errstate(over="ignore"):
                f1.append(int(mix(s, 1).sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(mix(s, 2).sum(dtype=np.uint64).astype(np.int64)))
            keys.append(bands(sketch(s), *shape(percent)) if len(s) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["n", "f1", "f2", "bands"])

    return F.arrow_udf(prints, _PRINT)


def _set(width: int):
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for s in shingle_sets(texts.to_pylist(), width)], pa.binary())

    return F.arrow_udf(sets, "binary")


def _alike(percent: int):
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, left = [], None, None
        for x, y in zip(a, b, strict=True):
            x, y = x.as_buffer(), y.as_buffer()
            if x.address != last:
                last, left = x.address, np.frombuffer(x, np.uint64)
            right = np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate((left, right)), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(both) - common))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(alike, "boolean")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right``: sorted arrays of distinct numbers."""

    def postings(sets: list[np.ndarray]):
        token, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(token, kind="stable")
        token = token[order]
        cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        return token[cuts], cuts, np.diff(np.append(cuts, len(token))), who[order]

    a, a_at, a_n, a_who = postings(left)
    b, b_at, b_n, b_who = postings(right)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    a_at, a_n, b_at, b_n = a_at[i], a_n[i], b_at[j], b_n[j]
    out, times = np.zeros(len(left) * len(right)), a_n * b_n
    few = np.flatnonzero(times <= 256)  # tokens of few sets: pair by pair
    for part in np.array_split(few, len(few) // 8192 + 1):
        n = times[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(b_n[part], n)
        out += np.bincount(a_who[np.repeat(a_at[part], n) + k // width] * len(right) + b_who[np.repeat(b_at[part], n) + k % width], minlength=len(out)) if len(k) else 0
    out, many = out.reshape(len(left), len(right)), np.flatnonzero(times > 256)
    for part in np.array_split(many, len(many) // 2048 + 1):  # the rest: as a product of matrices
        if len(part):
            x, y = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
            for m, at, n, who in ((x, a_at[part], a_n[part], a_who), (y, b_at[part], b_n[part], b_who)):
                k = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                m[who[k], np.repeat(np.arange(len(part)), n)] = 1
            out += x @ y.T
    return out


def _block_links(percent: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for one, two, same in zip(batch.column("x"), batch.column("y"), batch.column("same").to_pylist(), strict=True):
                sides = []
                for side in (one.values, two.values):
                    sides.append((side.field("node").to_numpy(), side.field("comp").to_numpy(), [np.frombuffer(v.as_buffer(), np.uint64) for v in side.field("set")]))
                (node, comp, left), (node2, comp2, right) = sides
                c = common_counts(left, right)
                alike = (c > 0) & (100 * c >= percent * (np.array([len(v) for v in left])[:, None] + np.array([len(v) for v in right]) - c)) & (comp[:, None] != comp2)
                if same:
                    alike &= np.triu(np.ones(alike.shape, bool), 1)
                up: dict[int, int] = {}
                for i, j in zip(*np.nonzero(alike), strict=True):  # links that join components, no more
                    p, q = int(comp[i]), int(comp2[j])
                    while p in up:
                        p = up[p]
                    while q in up:
                        q = up[q]
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        found.append((int(node[i]), int(node2[j])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return links


def _sets(ends: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node and set: the full shingle sets of some nodes, given as node and th, the hash of a text."""
    ends = cut(ends.select(F.col("node").alias("_n"), F.col("th").alias("_t")))
    texts = docs.select(_node(docs).alias("_n"), F.xxhash64("text").alias("_t"), "text").join(small(ends), ["_n", "_t"], "left_semi")
    return cut(texts.dropDuplicates(["_n", "_t"]).select(F.col("_n").alias("node"), _set(width)("text").alias("set")))


#: Shingles and nodes that a block of the second pass is planned for.
BLOCK_SHINGLES, BLOCK_NODES = 60_000, 256


def _block_pass(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, from all pairs of ``members`` (bucket, rep, n, comp) that share a bucket."""
    per = members.groupBy("bucket").agg(F.count("*").alias("c"))
    # A node's home is its largest bucket, so nodes that meet often are of one block or few.
    home = cut(members.join(per, "bucket").groupBy("rep").agg(F.max(F.struct("c", "bucket")).alias("h"), F.first("n").alias("n"), F.first("comp").alias("comp")).select("rep", "n", "comp", F.col("h.bucket").alias("home")))
    parts = home.groupBy("home", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    largest = parts.groupBy("home").agg(F.max(F.struct("c", "comp", "w")).alias("big"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    apart = F.col("comp") == F.col("big.comp")
    weight = F.greatest(F.when(apart, F.col("big.w")).otherwise(F.col("w") - F.col("big.w")) / BLOCK_SHINGLES, F.when(apart, F.col("big.c")).otherwise(F.col("c") - F.col("big.c")) / BLOCK_NODES)
    block = F.xxhash64("home", apart, F.pmod(F.xxhash64("rep.node", F.lit(9)), F.ceil(weight)))
    dealt = cut(home.join(largest, "home").select("rep", "comp", block.alias("block")))
    spots = members.select("bucket", "rep").join(dealt, "rep").groupBy("bucket", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    spots = cut(spots)
    other = spots.select("bucket", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = spots.join(other, "bucket").filter((F.col("block") <= F.col("block2")) & (F.least("lo", "lo2") < F.greatest("hi", "hi2"))).select("block", "block2").distinct()
    pairs = cut(pairs)
    full = cut(sets.join(dealt.select("rep.node", "comp", "block"), "node").groupBy("block").agg(F.collect_list(F.struct("node", "comp", "set")).alias("x")))
    both = pairs.join(full, "block").join(full.select(F.col("block").alias("block2"), F.col("x").alias("y")), "block2")
    links = cut(both.select("x", "y", (F.col("block") == F.col("block2")).alias("same")).mapInArrow(_block_links(percent), "a bigint, b bigint"))
    let_go(full)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that edges (a, b) reach, for every node of an edge.

    Every round hooks each component to its least neighbour, jumps once and contracts the edges; on
    stars, which is what pivots give, one round does.
    """
    edges = cut(edges.filter("a <> b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("comp"))
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        up = cut(up)
        jump = up.join(up.select(F.col("a").alias("_a"), F.col("p").alias("_p")), F.col("p") == F.col("_a")).select("a", F.col("_p").alias("p"))
        jump = cut(jump)
        labels = cut(labels.join(jump, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("p", "comp").alias("comp")))
        ends = jump.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
        edges = edges.join(ends, F.col("a") == F.col("_a")).select(F.col("_p").alias("a"), "b").join(ends, F.col("b") == F.col("_a")).select("a", F.col("_p").alias("b"))
        edges = cut(edges.filter("a <> b").distinct())
    return labels


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are alike."""
    left, right = sets.select(F.col("node").alias("_a"), F.col("set").alias("_x")), sets.select(F.col("node").alias("_b"), F.col("set").alias("_y"))
    joined = pairs.join(right, F.col("b") == F.col("_b")).join(left, F.col("a") == F.col("_a"))
    return cut(joined.filter(_alike(percent)("_x", "_y")).select("a", "b"))


def _node(docs: DataFrame):
    """The doc_id; a row without one gets an id above all others from its text."""
    return F.coalesce("doc_id", F.lit(2**62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**61 - 1)))


def _near(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    docs = docs.select("doc_id", "text")
    settle(docs.sparkSession)
    prints = cut(docs.select("doc_id", _node(docs).alias("node"), F.xxhash64("text").alias("th"), _print(width, percent)("text").alias("p")).select("doc_id", "node", "th", "p.*"))
    worded = prints.filter("n > 0")
    nodes = cut(worded.groupBy("f1", "f2").agg(F.min(F.struct("node", "th")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    spread = nodes.select("rep", "n", F.explode("bands").alias("bucket"))
    pivots = cut(spread.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("pivot"), F.count("*").alias("_c")).filter("_c > 1").select("bucket", "pivot"))
    rows = cut(spread.join(pivots, "bucket").filter("rep.node <> pivot.rep.node").select("bucket", "rep", "n", "pivot"))

    def pairs_of(met: DataFrame) -> DataFrame:
        """Distinct pairs, the smaller node first, whose sizes allow the similarity."""
        size = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
        a, b = F.least("rep.node", "pivot.rep.node"), F.greatest("rep.node", "pivot.rep.node")
        return met.filter(size).select(a.alias("a"), b.alias("b")).distinct()

    # Rows of one doc_id are one document: each of its sets is linked to the least, one row a set.
    each = worded.join(nodes.select("f1", "f2", F.col("rep.node").alias("_r")), ["f1", "f2"]).select("node", "_r").distinct()
    least = each.groupBy("node").agg(F.min("_r").alias("a"), F.max("_r").alias("_z")).filter("a < _z").select("node", "a")
    own = each.join(least, "node").filter("a <> _r").select("a", F.col("_r").alias("b"))
    pairs = cut(pairs_of(rows))
    # The texts of all nodes that share a bucket move once, for both passes.
    sets = _sets(rows.select("rep.*").union(rows.select("pivot.rep.*")).distinct(), docs, width)
    links = _verified(pairs, sets, percent).union(own)
    labels = components(links)
    comp = cut(rows.select("bucket", "rep", "n").join(labels.select(F.col("node").alias("_l"), "comp"), F.col("rep.node") == F.col("_l"), "left").select("bucket", "rep", "n", F.coalesce("comp", "rep.node").alias("comp")))
    open_ = comp.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("bucket")
    members = cut(comp.join(open_, "bucket"))
    if members.head(1):
        new = _block_pass(members, sets, percent)
        if new.head(1):
            labels = components(links.union(new))
    let_go(comp, members, rows, sets)
    named = nodes.select("f1", "f2", F.col("rep.node").alias("_r")).join(labels, F.col("_r") == F.col("node"), "left").select("f1", "f2", F.coalesce("comp", "_r").alias("comp"))
    return prints, cut(named)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Links hold where 100 * intersection >= percent * union of the shingle sets. A row without words is
    linked with nothing. Rows of one doc_id are one document. Rows without a doc_id take part; a
    component of such rows alone has a null component_id, its rows are kept by ``near_dedup`` once.
    """
    prints, named = _near(docs, width, percent)
    comp = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("comp") < 2**62, F.col("comp")))
    return prints.drop("bands").join(named, ["f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.col("n") == 0).alias("kept"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each component, with the columns of ``docs``; rows without words stay.

    Null and empty texts stay as they are. Of rows that share doc_id and text one stays. Ties can't
    arise: a node is a doc_id. An empty table gives an empty one. Extra columns may have any names.
    """
    prints, named = _near(docs, width, percent)
    each = prints.filter("n > 0").join(named, ["f1", "f2"]).groupBy("node", "th").agg(F.max(F.col("node") == F.col("comp")).alias("heads"), F.count("*").alias("c"))
    first = each.filter("heads").groupBy("node").agg(F.min("th").alias("first"))
    # What goes is listed rather than what stays: in most corpora it is the shorter list.
    told = cut(each.join(first, "node", "left").select("node", "th", F.coalesce(F.col("th") == F.col("first"), F.lit(False)).alias("stays"), "c").filter("not stays or c > 1"))
    keyed = docs.select(nested(docs).alias("row"), _node(docs).alias("node"), F.xxhash64("text").alias("th"))
    rest = keyed.join(small(told.select("node", "th")), ["node", "th"], "left_anti").select("row")
    equal = keyed.join(told.filter("stays").select("node", "th"), ["node", "th"], "left_semi").groupBy("node", "th").agg(F.first("row").alias("row"))
    return rest.union(equal.select("row")).select(*unnested(docs.columns))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: 3-word shingles, links at 85 percent; only doc_id and text are read.

    See ``near_duplicates`` for texts without words, repeated rows and rows without a doc_id. Texts of any length are taken whole; an
    empty table gives an empty one.
    """
    return near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT e.b, reach.m FROM reach JOIN e ON e.a = reach.v
)
SELECT r.v AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.m) AS component_id, r.v = min(r.m) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.v GROUP BY r.v
"""
