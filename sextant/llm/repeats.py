"""Repeated passages by suffix arrays, built column by column over many short strings at once.

A 50-byte string that two documents share holds the same anchor in both: its leftmost K-byte string of
least hash. So
1. every text sends its anchors with the hashes of the K bytes before and after, dealt by hash; those that
   two different texts hold with the same bytes on one side come back (LENGTH bytes reach K or more past one side),
2. each of these goes out again with its context, the bytes that any 50-byte string around it can
   reach, dealt by the anchor's hash; equal contexts collapse to the one of the smallest doc_id,
3. the contexts of a group of anchors make a collection. Its Burrows-Wheeler transform and its common
   prefixes are built by inserting one symbol per string a round, from the last column to the first,
   and rewriting the sorted streams (symbols, common prefixes, owners) in sequence. Suffixes whose
   neighbours share 50 bytes form classes, and each position whose class has a smaller doc_id is covered,
4. the covered stretches go back to the texts.

Equal whole texts are settled by their hash: only the one with the smallest doc_id is searched.
A collection is bounded (COLLECTION strings), so its streams stay in the memory of the task that
builds it and need no local files; a single anchor with more contexts than that is settled offset by
offset, by sorting its 50-byte strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, let_go, load, mix, nested, settle

LENGTH, K = 50, 16
REACH = LENGTH - K  # bytes to the left of an anchor that a string around it can reach
WIDTH = REACH + LENGTH
#: Strings in a collection, anchors that one task of the first exchange is planned for, bytes of a piece of a text.
COLLECTION, PLANNED, PIECE = 20_000, 1_500_000, 1 << 20
#: Strings that the anchors with few contexts are gathered to: streams of this size stay in the processor's cache.
GATHERED = 3_000
_LAST = 2**63 - 1
_RECORD = np.dtype([("anchor", "<u4"), ("pos", "<u4"), ("left", "u1"), ("size", "u1"), ("doc", "<i8"), ("text", "<i8"), ("context", "u1", WIDTH)])


def _doubled(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every stretch of n neighbours, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text, and those of the K bytes before and after, 0 where the
    text ends first; none if it is shorter than LENGTH."""
    places, hashes = [], []
    for begin in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
        # K bytes more on either side for the neighbours' hashes; the anchors are those of the piece itself.
        ahead = min(K, begin)
        a = np.frombuffer(raw[begin - ahead : begin + PIECE + LENGTH - 1 + K], np.uint8)
        if len(a) - ahead < LENGTH:
            break
        every, have = mix(a.astype(np.uint64), 21), 1
        while have < K:
            every = mix(every[: len(every) - have] * np.uint64(3) + every[have:], 22)
            have *= 2
        h = every[ahead : ahead + PIECE + LENGTH - K]
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        least = _doubled(key, LENGTH - K + 1, np.minimum)
        new = np.concatenate(([True], least[1:] != least[:-1]))
        at = (least[new] & np.uint64(0xFFFFFF)).astype(np.int64)
        left, right = at + ahead - K, at + ahead + K
        sides = [np.where((x >= 0) & (x < len(every)), every[np.clip(x, 0, len(every) - 1)] | np.uint64(1), np.uint64(0)) for x in (left, right)]
        places.append(at + begin)
        hashes.append(np.stack((h[at], *sides)))
    if not places:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none, none
    place, h = np.concatenate(places), np.concatenate(hashes, axis=1)
    order = np.unique(place, return_index=True)[1]
    return place[order], *h[:, order]


def _dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash and the 32 bits that tell anchors of a bucket apart; equal bits of unequal anchors only cost time."""
    h = mix(h, 23)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _packs(bucket: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    press = zstandard.ZstdCompressor(level=1)
    for i, b in enumerate(cuts):
        end = cuts[i + 1] if i + 1 < len(cuts) else len(bucket)
        yield int(bucket[b]), press.compress(np.ascontiguousarray(records[b:end]).tobytes())


_ANCHOR = np.dtype([("anchor", "<u4"), ("pos", "<u4"), ("text", "<i8"), ("left", "<u4"), ("right", "<u4")])
_PACK = "bucket int, payload binary"


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def _send_anchors(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            records = np.concatenate([r for _, r in held])
            return _batch(list(_packs(np.concatenate([b for b, _ in held]), records)))

        for batch in batches:
            for text, t in zip(batch.column("text"), batch.column("t1").to_pylist(), strict=True):
                place, h, left, right = anchors(_raw(text.as_py()))
                if not len(place):
                    continue
                bucket, low = _dealt(h, buckets)
                r = np.empty(len(place), _ANCHOR)
                r["anchor"], r["pos"], r["text"] = low, place, t
                for side, x in (("left", left), ("right", right)):
                    r[side] = np.maximum((x >> np.uint64(20)) & np.uint64(0xFFFFFFFF), x > 0)
                held.append((bucket, r))
                size += len(r)
                if size >= 500_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return send


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The records of one bucket after the other; rows come sorted by bucket."""
    last, held = None, []
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for b, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
            if b != last and held:
                yield np.concatenate(held)
                held = []
            last = b
            held.append(np.frombuffer(press.decompress(payload.as_py()), kind))
    if held:
        yield np.concatenate(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, position) of the anchors that two different texts hold, with the same bytes before or after."""
    for r in _gathered(batches, _ANCHOR):
        text, both = np.ascontiguousarray(r["text"]), np.zeros(len(r), bool)
        for side in ("left", "right"):
            key = r["anchor"].astype(np.uint64) << np.uint64(32) | r[side]
            order = np.argsort(key, kind="stable")
            key, mine = key[order], text[order]
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            two = (np.minimum.reduceat(mine, cuts) != np.maximum.reduceat(mine, cuts)) & (r[side][order[cuts]] > 0)
            both[order] |= np.repeat(two, np.diff(np.append(cuts, len(r))))
        r = r[both]
        r = r[np.lexsort((r["pos"], r["text"]))]
        if len(r):  # equal texts send the same
            r = r[np.concatenate(([True], (r["text"][1:] != r["text"][:-1]) | (r["pos"][1:] != r["pos"][:-1])))]
        for i in range(0, len(r), 100_000):
            part = r[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part["text"]), pa.array(part["pos"].astype(np.int64))], ["t1", "pos"])


def _send_contexts(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return _batch(list(_packs(np.concatenate([b for b, _ in held]), np.concatenate([r for _, r in held]))))

        for batch in batches:
            columns = [batch.column(c) for c in ("text", "t1", "holder", "places")]
            for text, t, doc, places in zip(*columns, strict=True):
                raw = np.frombuffer(_raw(text.as_py()), np.uint8)
                place = np.unique(np.asarray(places.values, np.int64))
                padded = np.concatenate((np.zeros(REACH, np.uint8), raw + np.uint8(1), np.zeros(LENGTH, np.uint8)))
                windows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
                grams = np.lib.stride_tricks.sliding_window_view(raw, K)
                for i in range(0, len(place), 50_000):
                    at = place[i : i + 50_000]
                    h, have = mix(grams[at].astype(np.uint64), 21), 1
                    while have < K:
                        h = mix(h[:, : h.shape[1] - have] * np.uint64(3) + h[:, have:], 22)
                        have *= 2
                    bucket, low = _dealt(h[:, 0], buckets)
                    r = np.zeros(len(at), _RECORD)
                    r["anchor"], r["pos"], r["doc"], r["text"] = low, at, doc.as_py(), t.as_py()
                    r["left"] = np.minimum(REACH, at)
                    r["size"] = r["left"] + np.minimum(LENGTH, len(raw) - at)
                    r["context"] = windows[at]
                    held.append((bucket, r))
                    size += len(r)
                    if size >= 60_000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return send


def collection(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a collection in sorted order: owner, start and common prefix with the one before (at most 255).

    ``strings`` is a matrix of symbols; 0 is padding, left or right of a string. Round j inserts the
    suffix that begins in column WIDTH - j of every string that has a symbol there. Its place is that of
    the suffix it extends, mapped through the transform by a stable sort of the symbols; its common
    prefix is one more than the least one back to the last suffix before with the same symbol.
    """
    m, width = strings.shape
    end = width - np.argmax(strings[:, ::-1] > 0, axis=1)  # one past the last symbol
    owner, start = np.arange(m), end.astype(np.int16)
    lcp = np.zeros(m, np.uint8)
    newest = np.arange(m)  # places of the suffixes that the next round extends
    symbols = strings[owner, start - 1]
    while len(newest):
        order = np.argsort(symbols, kind="stable")
        none = int(np.searchsorted(symbols[order], 1))
        order = order[none:]
        fresh = np.zeros(len(symbols), bool)
        fresh[newest] = True
        into = np.concatenate((np.zeros(m, bool), fresh[order]))  # in the new list: the suffixes of this round
        at = np.flatnonzero(into)
        from_ = order[at - m]  # the suffix that each extends
        total = len(symbols) + len(at)
        new_owner, new_start, new_lcp, new_symbols = np.empty(total, owner.dtype), np.empty(total, np.int16), np.empty(total, np.uint8), np.empty(total, np.uint8)
        old = ~into
        new_owner[old], new_start[old], new_lcp[old], new_symbols[old] = owner, start, lcp, symbols
        new_owner[at], new_start[at] = owner[from_], start[from_] - 1
        before = new_start[at] - 1
        new_symbols[at] = np.where(before >= 0, strings[new_owner[at], np.maximum(before, 0)], 0)
        # Common prefixes change at the new suffixes and right after them.
        touched = np.unique(np.concatenate((at, at + 1)))
        touched = touched[touched < total]
        right = order[touched - m]
        left = order[np.maximum(touched - m - 1, 0)]
        same = (touched > m) & (symbols[left] == symbols[right])
        value = np.zeros(len(touched), np.uint8)
        if same.any():
            value[same] = np.minimum(_least(lcp, left[same] + 1, right[same]), 254) + 1
        new_lcp[touched] = value
        owner, start, lcp, symbols = new_owner, new_start, new_lcp, new_symbols
        newest = at[new_symbols[at] > 0]
    return owner, start, lcp


def _least(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of x[left..right], ends included, for many ranges, by a table of doubled stretches."""
    size = right - left + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(left), x.dtype)
    table, k = x, 0
    for k in range(int(level.max()) + 1):
        pick = np.flatnonzero(level == k)
        if len(pick):
            out[pick] = np.minimum(table[left[pick]], table[right[pick] - (1 << k) + 1])
        if len(table) > (1 << k):
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def _covered(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, offset) of the strings of LENGTH in these contexts that a smaller doc_id holds too; by the transform."""
    owner, start, lcp = collection(r["context"])
    long = r["size"][owner] + (REACH - r["left"][owner]) - start >= LENGTH
    # A suffix too short for a whole string shares less than LENGTH with either neighbour, so it parts classes anyway.
    first = lcp < LENGTH
    first[0] = True
    cuts = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(r["doc"][owner], cuts), np.diff(np.append(cuts, len(first))))
    hit = long & (r["doc"][owner] > least)
    return owner[hit], start[hit].astype(np.int64)


def _covered_by_sort(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one anchor with more contexts than a collection: a shared string has the anchor at one offset."""
    who, where = [], []
    for o in range(REACH + 1):
        ok = np.flatnonzero((o >= REACH - r["left"]) & (r["size"] + (REACH - r["left"]) - o >= LENGTH))
        if not len(ok):
            continue
        grams = np.ascontiguousarray(r["context"][ok, o : o + LENGTH]).view(f"V{LENGTH}").ravel()
        kind = np.unique(grams, return_inverse=True)[1]
        least = np.full(kind.max() + 1, _LAST)
        np.minimum.at(least, kind, r["doc"][ok])
        hit = r["doc"][ok] > least[kind]
        who.append(ok[hit])
        where.append(np.full(int(hit.sum()), o))
    return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spans(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join stretches of one text that touch or overlap."""
    if not len(text):
        return text, begin, end
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    new_text = np.concatenate(([True], text[1:] != text[:-1]))
    # Groups one after the other on one line: a step over the longest end parts them, however many there are.
    group = np.cumsum(new_text) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + group) - group
    first = new_text | np.concatenate(([True], begin[1:] > reach[:-1]))
    cuts = np.flatnonzero(first)
    return text[cuts], begin[cuts], np.maximum.reduceat(end, cuts)


def _kinds(r: np.ndarray) -> np.ndarray:
    """The number of each record's context among the distinct ones, by 128 bits of hash."""
    words = np.zeros((len(r), -(-WIDTH // 8)), np.uint64)
    words.view(np.uint8)[:, :WIDTH] = r["context"]
    a, b = mix(r["anchor"], 24), mix(r["anchor"], 25)
    for k in range(words.shape[1]):
        a, b = mix(a ^ words[:, k], 26), mix(b + words[:, k], 27)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    kind = np.empty(len(r), np.int64)
    kind[order] = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return kind


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, begin, end) of the covered stretches."""
    for r in _gathered(batches, _RECORD):
        order = np.argsort(r["anchor"], kind="stable")
        r = r[order]
        kind = _kinds(r)
        kinds = np.arange(kind.max() + 1)
        least = np.full(len(kinds), _LAST)
        np.minimum.at(least, kind, r["doc"])
        # One string per distinct context, of the smallest doc_id; it stands for the others too.
        rep = np.zeros(len(kinds), np.int64)
        by_doc = np.argsort(-r["doc"], kind="stable")
        rep[kind[by_doc]] = by_doc
        copy = np.flatnonzero(r["doc"] > least[kind])
        copy = copy[r["size"][copy] >= LENGTH]
        out_text, out_begin, out_end = [r["text"][copy]], [r["pos"][copy].astype(np.int64) - r["left"][copy]], [r["pos"][copy].astype(np.int64) - r["left"][copy] + r["size"][copy]]
        reps = np.sort(rep)
        anchor = r["anchor"][reps]
        cuts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sizes = np.diff(np.append(cuts, len(reps)))
        part: list[np.ndarray] = []
        jobs: list[tuple[np.ndarray, bool]] = []
        held = 0
        for c, n in zip(cuts.tolist(), sizes.tolist(), strict=True):
            if n == 1:
                continue
            if n > COLLECTION:
                jobs.append((reps[c : c + n], True))
                continue
            if held and held + n > GATHERED:
                jobs.append((np.concatenate(part), False))
                part, held = [], 0
            part.append(reps[c : c + n])
            held += n
        if part:
            jobs.append((np.concatenate(part), False))
        # A document may hold a context more than once: what covers one place covers them all.
        equal = np.flatnonzero(r["doc"] == least[kind])
        equal = equal[np.argsort(kind[equal], kind="stable")]
        times = np.bincount(kind[equal], minlength=len(kinds))
        first = np.cumsum(times) - times
        for rows, hot in jobs:
            who, where = (_covered_by_sort if hot else _covered)(r[rows])
            which = kind[rows[who]]
            n = times[which]
            each = equal[np.repeat(first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            begin = r["pos"][each].astype(np.int64) - REACH + np.repeat(where, n)
            t, b, e = _spans(r["text"][each], begin, begin + LENGTH)
            out_text.append(t)
            out_begin.append(b)
            out_end.append(e)
        t, b, e = _spans(np.concatenate(out_text), np.concatenate(out_begin), np.concatenate(out_end))
        for i in range(0, len(t), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(t[i : i + 100_000]), pa.array(b[i : i + 100_000]), pa.array(e[i : i + 100_000])], ["t1", "begin", "end"])


def _cutter(keep_text: bool):
    def apply(texts: pa.Array, copies: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        n, gone, spans, sha, left = [], [], [], [], []
        for t, copy, b, e in zip(texts, copies.to_pylist(), begins, ends, strict=True):
            raw = _raw(t.as_py())
            n.append(len(raw))
            if copy and len(raw) >= LENGTH:
                gone.append(len(raw))
                spans.append(1)
                rest = b""
            elif b.is_valid:
                begin, end = np.asarray(b.values, np.int64), np.asarray(e.values, np.int64)
                _, begin, end = _spans(np.zeros(len(begin), np.int64), begin, end)
                gone.append(int((end - begin).sum()))
                spans.append(len(begin))
                edges = [0, *(x for p in zip(begin.tolist(), end.tolist(), strict=True) for x in p), len(raw)]
                rest = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            else:
                gone.append(0)
                spans.append(0)
                rest = raw
            sha.append(hashlib.sha256(rest).hexdigest())
            left.append(rest.decode("utf-8", "replace") if keep_text else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return F.arrow_udf(apply, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,text:string>")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(holders, stretches): the smallest doc_id of every text hash, and the covered stretches (t1, begin, end)."""
    spark = docs.sparkSession
    settle(spark)
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("did"), F.xxhash64("text").alias("t1"), "text")
    narrow = texts.select("did", "t1", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))
    holders = cut(narrow.groupBy("t1").agg(F.min("did").alias("holder"), F.sum("n").alias("n")))
    total = holders.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 2 // (LENGTH - K + 2) // PLANNED) + 1)
    sent = texts.select("text", "t1").mapInArrow(_send_anchors(buckets), _PACK)
    shared = cut(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "t1 bigint, pos bigint"))
    places = shared.groupBy("t1").agg(F.collect_list("pos").alias("places")).join(holders.select("t1", "holder"), "t1")
    searched = texts.join(places.select(F.col("t1").alias("_t"), "holder", "places"), (F.col("t1") == F.col("_t")) & (F.col("did") == F.col("holder"))).select("text", "t1", "holder", "places")
    contexts = searched.mapInArrow(_send_contexts(buckets), _PACK)
    stretches = cut(contexts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_found, "t1 bigint, begin bigint, end bigint"))
    let_go(shared)
    return holders.select("t1", "holder"), stretches


def without_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``row`` (the columns of ``docs`` as a struct) and ``cut``: bytes, removed bytes, removed runs, SHA-256 of what is
    left, and, if asked for, its text.

    A null text counts as empty. Rows of one doc_id are one document and never cover each other; a null
    doc_id comes after all others, and rows without one are one document. Texts under LENGTH bytes stay
    whole. Cut bytes may halve a character; its rest decodes to U+FFFD. Extra columns may have any names; an
    empty table gives an empty one.
    """
    holders, stretches = repeats(docs.select("doc_id", "text"))
    gone = stretches.groupBy("t1").agg(F.collect_list("begin").alias("b"), F.collect_list("end").alias("e"))
    told = holders.join(gone, "t1", "left")
    keyed = docs.select(nested(docs).alias("row"), F.coalesce("doc_id", F.lit(_LAST)).alias("did"), F.xxhash64("text").alias("t1"))
    return keyed.join(told, "t1").select("row", _cutter(keep_text)(F.col("row.text"), F.col("did") > F.col("holder"), F.col("b"), F.col("e")).alias("cut"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: bytes, removed bytes and runs, and the SHA-256 of what is left.

    See ``without_repeats`` for null and short texts, repeated rows, rows without a doc_id and empty tables. Only doc_id and text are read.
    """
    out = without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), *(F.col(f"cut.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT r, doc_id, i, substring(h, 2 * i + 1, 100) AS s
  FROM (SELECT r, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT r, i FROM g JOIN f ON g.s = f.s WHERE g.doc_id > f.least
), run AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k
  FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM hit)
), span AS (
  SELECT r, min(i) AS b, max(i) + 50 AS e FROM run GROUP BY r, k
), piece AS (
  SELECT s.r, s.b, s.e, substring(d.h, 2 * coalesce(lag(s.e) OVER (PARTITION BY s.r ORDER BY s.b), 0) + 1, 2 * (s.b - coalesce(lag(s.e) OVER (PARTITION BY s.r ORDER BY s.b), 0))) AS kept
  FROM span s JOIN d ON d.r = s.r
), p AS (
  SELECT r, count(*) AS n, sum(e - b) AS gone, max(e) AS e, string_agg(kept, '' ORDER BY b) AS kept FROM piece GROUP BY r
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(p.gone, 0)::BIGINT AS n_removed, coalesce(p.n, 0) AS n_spans,
       sha256(unhex(coalesce(p.kept, '') || substring(d.h, 2 * coalesce(p.e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p ON p.r = d.r
"""
