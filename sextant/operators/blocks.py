"""An inverted index of posting blocks in segments: pruned search, updates, compaction.

Passages of a segment are put in order of their ids and cut into ranges of ``RANGE`` of them. A block is what one
term has in one range: offsets from the range's first number, term frequencies, and its impacts, the pairs of
frequency and length that no other pair of the block beats in both. From impacts follows the largest weight of the block
under any k1 and b and whatever statistics the collection has by then, so blocks stay as they are when segments come and go.

A search reads the blocks of a query's leading terms, the rarest, and scores the ranges of the passages that do best
by these terms in full; the k-th score is a floor. In any other range the best passage by the leading
terms and the largest weights of the other terms' blocks make a bound, and only where it reaches the floor
are the other blocks, those of frequent terms, read at all. The result is exact.

Each update writes a segment and, for passages that it replaces, a list of dead numbers with the
postings that they take from each term's count, so statistics are those of a fresh build at any time. A version of the
index is a manifest (``sources.versions``): readers see an update as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.text import terms
from sextant.operators.dense import top_k
from sextant.operators.sparse import K1, K3, B, idf, query_terms, stems_of
from sextant.sources import versions
from sextant.sources.readers import stored

#: Passages of a range: offsets fit into a byte.
RANGE = 128
#: Folders that terms are dealt to by hash; a search lists those of its terms and reads no other.
BUCKETS = 32
_BLOCK = "term string, range bigint, c int, places array<tinyint>, tfs array<int>, high array<int>, short array<int>, segment int, bucket int"
_RANGES = "range bigint, ids array<bigint>, dls array<int>, segment int"
_DEAD = "segment int, range bigint, place int, dl int, batch string"
_TAKEN = "term string, c bigint, batch string"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _impacts(pairs: Column) -> list[Column]:
    """Of (tf, dl) pairs those that no pair with as high a frequency and as short a length replaces: high and short, their halves."""
    kind = "array<struct<tf:int,dl:int>>"
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["tf"]).alias("t"), p["dl"].alias("dl"))))
    front = F.aggregate(ordered, F.array().cast(kind), lambda a, p: F.when((F.size(a) == 0) | (p["dl"] < F.element_at(a, -1)["dl"]), F.concat(a, F.array(F.struct((-p["t"]).alias("tf"), p["dl"].alias("dl"))))).otherwise(a))
    front = front.cast(kind)
    return [front["tf"].alias("high"), front["dl"].alias("short")]


_BUILT = "term string, range bigint, c int, places array<tinyint>, tfs array<int>, high array<int>, short array<int>, ids array<bigint>, dls array<int>"


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _builder(width: int):
    """Blocks and ranges of a partition of passages in order of their ids: every ``width`` of them are a range.

    A passage comes with all its terms, or with its distinct terms, how often it has each, and its length.
    """

    def one(part: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        listed = part.column(1)
        held = np.diff(listed.offsets.to_numpy()).astype(np.int32)
        coded = listed.flatten().dictionary_encode()
        u = coded.indices.to_numpy().astype(np.int64) * width + np.repeat(np.arange(len(held)), held)
        if part.num_columns > 2:
            by_term = np.argsort(u)
            u, tf, dl = u[by_term], part.column(2).flatten().to_numpy()[by_term], part.column(3).to_numpy()
        else:
            dl = held
            u, tf = np.unique(u, return_counts=True)
        code, place = u // width, (u % width).astype(np.int32)
        cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64), len(code))
        # Impacts: by falling frequency, a pair stays if it is shorter than all before it of its block.
        order = np.lexsort((dl[place], -tf, code))
        length = dl[place][order]
        low = length.astype(np.int64) - (code[order] << 32)
        stays = np.append(True, low[1:] < np.minimum.accumulate(low)[:-1]) if len(low) else np.zeros(0, bool)
        kept = np.append(0, np.cumsum(np.bincount(code[order][stays], minlength=len(cuts) - 1))) if len(cuts) > 1 else np.zeros(1, np.int64)
        high, short = (_lists(v, kept) for v in (tf[order][stays].astype(np.int32), length[stays]))
        n, tf = len(cuts) - 1, tf.astype(np.int32)
        terms_ = coded.dictionary.cast(pa.string())
        nulls = [pa.nulls(n, pa.list_(t)) for t in (pa.int64(), pa.int32())]
        names = ["term", "range", "c", "places", "tfs", "high", "short", "ids", "dls"]
        yield pa.RecordBatch.from_arrays([terms_, pa.array(np.full(n, number)), pa.array(np.diff(cuts).astype(np.int32)), _lists(place.astype(np.int8), cuts), _lists(tf, cuts), high, short, *nulls], names)
        ids = part.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int8())), *(pa.nulls(1, pa.list_(pa.int32())) for _ in range(3)), _lists(ids, np.array([0, len(ids)])), _lists(dl, np.array([0, len(dl)]))], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            while held.num_rows >= width:
                yield from one(pa.concat_batches([held.slice(0, width)]), number)
                held, number = held.slice(width), number + 1
        if held is not None and held.num_rows:
            yield from one(pa.concat_batches([held]), number)

    return build


def _built(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and ranges of the texts themselves: they are dealt by ranges of ids once, and no posting is shuffled.

    What the tasks make is written once, so blocks and ranges agree on the numbers whatever is run again.
    """
    dealt = passages.repartitionByRange("passage_id").sortWithinPartitions("passage_id")
    return _inverted(dealt.select("passage_id", terms(F.col("text")).alias("terms")))


def _inverted(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    made = stored(dealt.mapInArrow(_builder(RANGE), _BUILT), "built")
    return made.filter("term IS NOT NULL").drop("ids", "dls"), made.filter("ids IS NOT NULL").select("range", "ids", "dls")


def _write(spark: SparkSession, path: str, content: dict, blocks: DataFrame, ranges: DataFrame) -> dict:
    """Write one segment; its entry of the manifest. Its number is one above all that the index has had."""
    segment = versions.new_name("s")
    # By range of term and passage, so that the blocks of a frequent term are many tasks' work and files.
    dealt = blocks.withColumn("bucket", _bucket(F.col("term"))).repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range")
    dealt.write.partitionBy("bucket").parquet(f"{path}/{segment}/blocks")
    ranges.write.parquet(f"{path}/{segment}/ranges")
    written = spark.read.schema("dls array<int>").parquet(f"{path}/{segment}/ranges")
    total = written.agg(F.coalesce(F.sum(F.size("dls")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0)).alias("dl")).first()
    return {"folder": segment, "id": content.get("last", 0) + 1, "n": total["n"], "dl": total["dl"]}


@dataclass(frozen=True)
class BlockIndex:
    """An opened version: blocks and ranges of all segments, dead passages and what they take from the terms' counts."""

    blocks: DataFrame
    ranges: DataFrame
    dead: DataFrame
    taken: DataFrame
    n: int
    avgdl: float
    stem: bool
    version: versions.Version


def _parts(spark: SparkSession, path: str, folders: dict, name: str, schema: str, mark: str) -> DataFrame:
    """The tables ``name`` of some folders as one, ``mark`` what ``folders`` gives a folder."""
    if not folders:
        return spark.createDataFrame([], schema)
    fields = spark.createDataFrame([], schema).drop(mark).schema
    found = [spark.read.schema(fields).parquet(f"{path}/{f}/{name}").withColumn(mark, F.lit(m)) for f, m in folders.items()]
    return reduce(DataFrame.unionByName, found)


def open_blocks(spark: SparkSession, path: str) -> BlockIndex:
    """The latest version of an index; an index without any is empty."""
    v = versions.latest(spark, path)
    segments, deletes = v.content.get("segments", []), v.content.get("deletes", [])
    n = sum(s["n"] for s in segments) - sum(x["n"] for x in deletes)
    dl = sum(s["dl"] for s in segments) - sum(x["dl"] for x in deletes)
    folders, gone = {s["folder"]: s["id"] for s in segments}, {x["folder"]: x["folder"] for x in deletes}
    return BlockIndex(_parts(spark, path, folders, "blocks", _BLOCK, "segment"), _parts(spark, path, folders, "ranges", _RANGES, "segment"), _parts(spark, path, gone, "dead", _DEAD, "batch"), _parts(spark, path, gone, "taken", _TAKEN, "batch"), n, dl / n if dl else 1.0, bool(v.content.get("stem", False)), v)


def _stemmed(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks by English stem: those of terms with one stem become one, from their postings."""
    rows = blocks.select("term", "range", F.explode(F.arrays_zip("places", "tfs")).alias("x")).select("term", F.struct("range", F.col("x.places").cast("int").alias("place")).alias("at"), F.col("x.tfs").alias("tf"))
    posts = stems_of(rows, "at", "tf").select("term", "at.*", "tf").join(ranges.select("range", "dls"), "range")
    entry = F.struct("place", F.col("tf").cast("int").alias("tf"), F.get("dls", F.col("place")).alias("dl"))
    grouped = posts.groupBy("term", "range").agg(F.array_sort(F.collect_list(entry)).alias("p"))  # RANGE entries at most
    return grouped.select("term", "range", F.size("p").alias("c"), F.col("p.place").cast("array<tinyint>").alias("places"), F.col("p.tf").alias("tfs"), *_impacts(F.col("p")))


def _bury(spark: SparkSession, path: str, index: BlockIndex, ids: DataFrame) -> dict | None:
    """Write the live passages among ``ids`` (passage_id, distinct) as dead; the entry of the manifest, none if there are none."""
    lo, hi = ids.agg(F.min("passage_id"), F.max("passage_id")).first()
    if lo is None or not index.n:
        return None
    # Ids ascend within a range, so ranges beside the new ids are left out before anything is exploded.
    near = index.ranges.filter((F.element_at("ids", 1) <= hi) & (F.element_at("ids", -1) >= lo))
    spots = near.select("segment", "range", F.posexplode(F.arrays_zip("ids", "dls")).alias("place", "x")).select("segment", "range", "place", F.col("x.ids").alias("passage_id"), F.col("x.dls").alias("dl"))
    dead = spots.join(ids, "passage_id", "left_semi").join(index.dead.select("segment", "range", "place"), ["segment", "range", "place"], "left_anti")
    folder = versions.new_name("d")
    dead.select("segment", "range", "place", "dl").write.parquet(f"{path}/{folder}/dead")
    dead = spark.read.schema("segment int, range bigint, place int, dl int").parquet(f"{path}/{folder}/dead")
    total = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("dl").cast("bigint")), F.lit(0)).alias("dl")).first()
    if not total["n"]:
        return None
    gone = dead.groupBy("segment", "range").agg(F.collect_list(F.col("place").cast("tinyint")).alias("gone"))  # RANGE places at most
    lost = index.blocks.join(gone, ["segment", "range"]).select("term", F.size(F.array_intersect("places", "gone")).cast("bigint").alias("c")).filter("c > 0")
    lost.groupBy("term").agg(F.sum("c").alias("c")).write.parquet(f"{path}/{folder}/taken")
    return {"folder": folder, "n": total["n"], "dl": total["dl"]}


def add(passages: DataFrame, path: str, stem: bool = False, batch: int | None = None) -> versions.Version:
    """Add ``passages`` (passage_id, text) as a segment; a passage whose id is there already is replaced.

    Ids are whole numbers, unique within one call; rows without one go. ``batch`` is the number of a micro-batch: one that was
    committed before changes nothing. A new index takes ``stem``; an index that is there keeps its own.
    """
    spark = passages.sparkSession
    index = open_blocks(spark, path)
    content = index.version.content
    if batch is not None and batch <= content.get("batch", -1):
        return index.version
    stem = index.stem if content else stem
    made, ranges = _built(passages.filter("passage_id IS NOT NULL").select(F.col("passage_id").cast("bigint"), "text"))
    if stem:
        made = _stemmed(made, ranges)
    buried = _bury(spark, path, index, ranges.select(F.explode("ids").alias("passage_id")))
    segment = _write(spark, path, content, made, ranges)
    deletes = content.get("deletes", []) + ([buried] if buried else [])
    return versions.commit(spark, path, index.version, {"segments": [*content.get("segments", []), segment], "last": segment["id"], "deletes": deletes, "stem": stem, "batch": content.get("batch", -1) if batch is None else batch})


def remove(ids: DataFrame, path: str) -> versions.Version:
    """Take passages (passage_id) out; ids that are not there change nothing."""
    spark = ids.sparkSession
    index = open_blocks(spark, path)
    buried = _bury(spark, path, index, ids.select("passage_id").filter("passage_id IS NOT NULL").distinct())
    if not buried:
        return index.version
    return versions.commit(spark, path, index.version, {**index.version.content, "deletes": [*index.version.content["deletes"], buried]})


_VECTORS = "passage_id bigint, terms array<string>, tfs array<int>, dl int"


def _vectors(blocks: pa.Table, ranges: pa.Table) -> pa.Table:
    """The live passages of a group of ranges, each with its distinct terms and how often it has them, from the blocks of the group."""
    numbers = ranges["range"].to_numpy()
    ids, dls, gone = (ranges[c].combine_chunks() for c in ("ids", "dls", "dead"))
    first = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))
    live = np.ones(first[-1], bool)
    live[(first[pc.list_parent_indices(gone).to_numpy()] + pc.list_flatten(gone).to_numpy())] = False
    coded = blocks["term"].combine_chunks().dictionary_encode()
    places, tfs = blocks["places"].combine_chunks(), pc.list_flatten(blocks["tfs"].combine_chunks())
    block, order = pc.list_parent_indices(places).to_numpy(), np.argsort(numbers)
    of = order[np.searchsorted(numbers[order], blocks["range"].to_numpy())]
    at = first[of[block]] + pc.list_flatten(places).to_numpy()
    by_passage = np.argsort(at, kind="stable")
    by_passage = by_passage[live[at[by_passage]]]
    held = np.bincount(at[by_passage], minlength=len(live))[live]
    cuts = pa.array(np.append(0, np.cumsum(held)).astype(np.int32))
    words = coded.dictionary.take(coded.indices.take(pa.array(block[by_passage])))
    kept = pa.array(live)
    return pa.table({"passage_id": pc.list_flatten(ids).filter(kept), "terms": pa.ListArray.from_arrays(cuts, words), "tfs": pa.ListArray.from_arrays(cuts, tfs.take(pa.array(by_passage))), "dl": pc.list_flatten(dls).filter(kept)})


def compact(spark: SparkSession, path: str) -> versions.Version:
    """Merge all segments into one without dead passages, from their postings: no text is read.

    The blocks of a group of ranges give back its passages as terms and counts, which are dealt by ranges of ids and built as texts are;
    what is shuffled are blocks and passages, never a row a posting.
    """
    index = open_blocks(spark, path)
    if not index.version.content.get("segments"):
        return index.version
    dead = index.dead.groupBy("segment", "range").agg(F.collect_list("place").alias("dead"))  # RANGE places at most
    numbered = F.floor(F.col("range") / GROUP).alias("group")
    ranges = index.ranges.join(dead, ["segment", "range"], "left").select("segment", numbered, "range", "ids", "dls", F.coalesce("dead", F.array().cast("array<int>")).alias("dead"))
    held = index.blocks.select("segment", numbered, "range", "term", "places", "tfs")
    passages = stored(held.groupBy("segment", "group").cogroup(ranges.groupBy("segment", "group")).applyInArrow(_vectors, _VECTORS), "passages")
    segment = _write(spark, path, index.version.content, *_inverted(passages.repartitionByRange("passage_id").sortWithinPartitions("passage_id")))
    return versions.commit(spark, path, index.version, {**index.version.content, "segments": [segment], "last": segment["id"], "deletes": []})


def _asked(queries: DataFrame, index: BlockIndex) -> tuple[DataFrame, DataFrame]:
    """qid, term, qtf, df of the query terms that passages have, and the blocks of the folders these terms are in."""
    asked = query_terms(queries)
    if index.stem:
        asked = stems_of(asked, "qid", "qtf")
    asked = stored(asked, "asked")
    folders = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
    blocks = index.blocks.filter(F.col("bucket").isin(folders) if folders else F.lit(False))
    wanted = asked.select("term").distinct()
    counts = blocks.select("term", F.col("c").cast("bigint").alias("c")).unionByName(index.taken.select("term", (-F.col("c")).alias("c")))
    df = counts.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("c").alias("df")).filter("df > 0")
    return stored(asked.join(df, "term"), "weights"), blocks


#: Ranges that are scored together, and queries that meet them together.
GROUP, QUERIES = 16, 256


def _matrices(blocks, asked: list, lengths: np.ndarray, k1: float, b: float, avgdl: float) -> tuple[list, np.ndarray]:
    """Queries in order, and their scores of all places of a group of ranges: the product of query weights and block weights."""
    terms = {t: i for i, t in enumerate(sorted({x["term"] for x in asked}))}
    qids = sorted({x["qid"] for x in asked})
    at = {q: i for i, q in enumerate(qids)}
    w, m = np.zeros((len(qids), len(terms))), np.zeros((len(terms), len(lengths)))
    for x in asked:
        w[at[x["qid"]], terms[x["term"]]] = x["w"]
    for x in blocks:
        i = terms.get(x["term"].as_py())
        if i is not None:
            place = x["places"].values.to_numpy().astype(np.int64) + x["offset"].as_py()
            tf = x["tfs"].values.to_numpy().astype(float)
            m[i, place] = (k1 + 1) * tf / (k1 * ((1 - b) + b * lengths[place] / avgdl) + tf)
    return qids, w @ m


def _places(ranges, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and whether they are live of all places of a group; a place without a passage is not live."""
    ids, dls, live = np.zeros(size, np.int64), np.ones(size), np.zeros(size, bool)
    for x in ranges:
        at = x["offset"].as_py()
        n = len(x["ids"])
        ids[at : at + n], dls[at : at + n], live[at : at + n] = x["ids"].values.to_numpy(), x["dls"].values.to_numpy(), True
        if x["dead"].is_valid:
            live[at + x["dead"].values.to_numpy()] = False
    return ids, dls, live


def _best_by_range(k1: float, b: float, avgdl: float):
    """For each query and range the best score of a live passage."""

    def best(ranges: pa.Array, blocks: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for r, x, q in zip(ranges, blocks, asked.to_pylist(), strict=True):
            size = max(v["offset"].as_py() + len(v["ids"]) for v in r)
            _, dls, live = _places(r, size)
            qids, score = _matrices(x, q, dls, k1, b, avgdl)
            score[:, ~live] = 0
            found = []
            for v in r:
                at = v["offset"].as_py()
                most = score[:, at : at + len(v["ids"])].max(1)
                found += [{"qid": qids[i], "range": v["range"].as_py(), "w": float(most[i])} for i in np.flatnonzero(most > 0)]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("qid", pa.int64()), ("range", pa.int64()), ("w", pa.float64())])))

    return F.arrow_udf(best, "array<struct<qid:bigint,range:bigint,w:double>>")


def _hits(k: int, k1: float, b: float, avgdl: float):
    """For each query and range that is asked for together the k best live passages of the group."""

    def best(ranges: pa.Array, blocks: pa.Array, asked: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for r, x, q, some in zip(ranges, blocks, asked.to_pylist(), spans.to_pylist(), strict=True):
            size = max(v["offset"].as_py() + len(v["ids"]) for v in r)
            ids, dls, live = _places(r, size)
            wanted = {(v["qid"], v["range"]) for v in some}
            mine = {v["qid"] for v in some}
            qids, score = _matrices(x, [v for v in q if v["qid"] in mine], dls, k1, b, avgdl)
            found = []
            for i, qid in enumerate(qids):
                keep = live & (score[i] > 0)
                for v in r:
                    if (qid, v["range"].as_py()) not in wanted:
                        at = v["offset"].as_py()
                        keep[at : at + len(v["ids"])] = False
                at = np.flatnonzero(keep)
                s = np.round(score[i, at], 6)
                for j in np.lexsort((ids[at], -s))[:k]:
                    found.append({"qid": qid, "passage_id": int(ids[at[j]]), "score": float(s[j])})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("qid", pa.int64()), ("passage_id", pa.int64()), ("score", pa.float64())])))

    return F.arrow_udf(best, "array<struct<qid:bigint,passage_id:bigint,score:double>>")


def pruned(queries: DataFrame, index: BlockIndex, k: int = 10, k1: float = K1, b: float = B, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Hits (qid, passage_id, score, rank) and what was read for them (qid, n_blocks, n_read).

    ``share`` of a query's largest possible score is what its leading terms hold; fewer for less, the rarest first. Blocks are
    counted as the (term, segment, range) that match a query; read ones are those whose postings were scored.

    Blocks of a group of ranges come together and meet the queries in blocks, each as one product of matrices: what is shuffled are the
    blocks, and of scores one row a query and range or the k best a query and group, never a row for each posting and query.
    """
    asked, blocks = _asked(queries, index)
    asked = asked.withColumn("qid", F.col("qid").cast("bigint")).withColumn("w", idf(F.lit(index.n), F.col("df")) * (K3 + 1) * F.col("qtf") / (K3 + F.col("qtf")))
    span, group = ["qid", "segment", "range"], ["segment", "group"]
    parts = max(1, -(-asked.select("qid").distinct().count() // QUERIES))
    # A term's largest weight is that of endless frequency, so the terms are ordered before any block is looked at.
    by_weight = Window.partitionBy("qid").orderBy(F.desc("w"), "term")
    asked = asked.withColumn("leads", F.sum("w").over(by_weight) - F.col("w") < share * F.sum("w").over(Window.partitionBy("qid"))).withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    asked = stored(asked.select("qid", "term", "w", "leads", "part"), "leads")
    lead, trail = asked.filter("leads"), asked.filter("not leads")
    numbered, offset = F.floor(F.col("range") / GROUP).alias("group"), (F.col("range") % GROUP * RANGE).cast("int").alias("offset")

    def together(terms_: DataFrame, spans: DataFrame | None) -> DataFrame:
        """segment, group, ranges, blocks: GROUP ranges and the blocks of ``terms_`` in them, or in ``spans`` alone."""
        near, there = blocks.join(terms_.select("term").distinct(), "term", "left_semi"), index.ranges
        if spans is not None:
            only = spans.select("segment", "range").distinct()
            near, there = near.join(only, ["segment", "range"], "left_semi"), there.join(only, ["segment", "range"], "left_semi")
        dead = index.dead.groupBy("segment", "range").agg(F.collect_list("place").alias("dead"))  # RANGE places at most
        there = there.join(dead, ["segment", "range"], "left").select("segment", numbered, F.struct("range", offset, "ids", "dls", "dead").alias("x"))
        near = near.select("segment", numbered, F.struct("term", offset, "places", "tfs").alias("x"))
        return near.groupBy(*group).agg(F.collect_list("x").alias("blocks")).join(there.groupBy(*group).agg(F.collect_list("x").alias("ranges")), group)

    def packed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part").agg(F.collect_list(F.struct("qid", "term", "w")).alias("asked"))  # QUERIES queries or so

    limits = k1, b, index.avgdl
    # Every block of queries meets every group that holds a leading term: the queries are stated, the groups go once for each block.
    met = together(lead, None).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))).join(packed(lead), "part")
    tops = met.select("segment", F.explode(_best_by_range(*limits)("ranges", "blocks", "asked")).alias("x")).select("segment", "x.*")
    limit = F.array_max(F.zip_with("high", "short", lambda tf, dl: (k1 + 1) * tf / (k1 * ((1 - b) + b * dl / index.avgdl) + tf)))
    more = trail.join(blocks.select("term", "segment", "range", limit.alias("most")), "term").groupBy(*span).agg(F.sum(F.col("w") * F.col("most")).alias("more"), F.count("*").alias("n"))
    bounds = more.join(tops, span, "full").select(*span, F.coalesce("w", F.lit(0.0)).alias("w"), (F.coalesce("w", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("bound"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    bounds = stored(bounds, "bounds")

    def scored(spans: DataFrame) -> DataFrame:
        wanted = spans.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts))).withColumn("group", F.floor(F.col("range") / GROUP))
        wanted = wanted.groupBy(*group, "part").agg(F.collect_list(F.struct("qid", "range")).alias("spans"))
        met = together(asked, spans).join(wanted, group).join(packed(asked), "part")
        return met.select(F.explode(_hits(k, *limits)("ranges", "blocks", "asked", "spans")).alias("x")).select("x.*")

    # The ranges with the best passages by their leading terms give the floor: they are scored in full.
    best = top_k(bounds.select(*span, "n", F.struct("segment", "range").alias("at"), F.col("w").alias("score")), 2 * k, id_="at").select(*span, "n")
    best = stored(best, "best")
    known = stored(scored(best), "known")
    floor = top_k(known, k).groupBy("qid").agg(F.min("score").alias("floor"), F.count("*").alias("_n")).filter(F.col("_n") == k).select("qid", "floor")
    # The floor is lowered by what rounding to 6 decimals may hide.
    rest = stored(bounds.join(best.select(*span), span, "left_anti").join(floor, "qid", "left").filter("floor IS NULL OR bound >= floor - 1e-6").select(*span, "n"), "rest")
    hits = top_k(known.unionByName(scored(rest)), k)
    leads = lead.join(blocks.select("term"), "term").groupBy("qid").agg(F.count("*").alias("n"))
    read = leads.unionByName(best.select("qid", "n")).unionByName(rest.select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("n_read"))
    every = leads.unionByName(bounds.select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("n_blocks"))
    return hits, every.join(read, "qid")


def search(queries: DataFrame, index: BlockIndex, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """qid, passage_id, score (6 decimals), rank: the k best of all live passages; see ``pruned``."""
    return pruned(queries, index, k, k1, b)[0]
