"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. For a radius r
every bit position gets a non-zero code of r + 1 bits, the codes dealt in turn; table v (1 .. 2^(r+1) - 1)
keeps the positions whose code has an odd number of bits in common with v. Two fingerprints that differ in
r positions at most collide in some table, always: r codes can't span r + 1 dimensions, so some v is
orthogonal to all of them, and table v masks every differing position.

Equal fingerprints collapse first. Members of a bucket are compared with each other; a bucket above
``BUCKET`` members is never gathered. Its members go through an exact way without pairs: each lists its
variants with up to r/2 flipped bits, and members that share a variant are within r of each other (and
all that are within r share one), so a link of each to the least of the variant keeps every connection.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, let_go, load, lower_bytes, settle, small
from sextant.llm.near_dedup import components

WIDTH, RADIUS, SEED = 3, 2, 42
#: Distinct fingerprints of a bucket that are gathered and compared; larger buckets go by shared variants.
BUCKET = 256
_PIECE = 1 << 20
_WHITE = b" \t\n\x0b\x0c\r"


def _word_lists(raw: bytes):
    """The words of a text, about a megabyte at a time."""
    begin = 0
    while begin < len(raw):
        end = begin + _PIECE
        while end < len(raw) and raw[end] not in _WHITE:
            end += 1
        yield raw[begin:end].split()
        begin = end


def simhash(raw: bytes, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 without words."""
    ones, n, held = np.zeros(64, np.int64), 0, []

    def count(shingles: list[bytes]) -> None:
        nonlocal n
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        for part in np.array_split(h, len(h) // 65536 + 1):
            ones[:] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)

    for words in _word_lists(lower_bytes(raw)):
        held += words
        if len(held) >= width:
            count([b" ".join(x) for x in zip(*(held[k:] for k in range(width)), strict=False)])
            held = held[len(held) - width + 1 :]
    if not n and held:
        count([b" ".join(held)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _print(width: int):
    def prints(texts: pa.Array) -> pa.Array:
        out = [simhash(t.as_buffer().to_pybytes(), width) if t.is_valid else 0 for t in texts.cast(pa.large_binary())]
        return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(prints, "bigint")


def masks(radius: int) -> list[int]:
    """The 2^(radius + 1) - 1 covering masks of 64 bits: any ``radius`` positions are outside one of them."""
    tables = range(1, 2 ** (radius + 1))
    codes = [1 + (i * 5) % len(tables) for i in range(64)]
    return [sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() % 2) for v in tables]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _forest(radius: int):
    """Of each list of fingerprints, the links within the radius that join its components."""

    def links(lists: pa.Array) -> pa.Array:
        out = []
        for one in lists:
            x = np.sort(one.values.to_numpy())
            root, found = np.arange(len(x)), []
            for i, j in zip(*np.nonzero(np.triu(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius, 1)), strict=True):
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    found.append({"a": int(x[i]), "b": int(x[j])})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return F.arrow_udf(links, "array<struct<a:bigint,b:bigint>>")


def _variants(fp: Column, radius: int) -> Column:
    """The fingerprint with all choices of up to radius/2 bits flipped: two share one if and only if they are within the radius."""
    flips = [0, *(reduce(lambda x, y: x | y, (1 << i for i in c)) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k))]
    return F.transform(F.array(*(F.lit(_signed(m)) for m in flips)), lambda m: fp.bitwiseXOR(m))


def links_within(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all of ``prints`` (fp, distinct) that a chain of steps of ``radius`` bits connects."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))))
    spread = prints.select("fp", F.explode(tables).alias("k")).select("fp", "k.*")
    shared = cut(spread.groupBy("t", "key").agg(F.count("*").alias("c")).filter("c > 1"))
    met = cut(spread.join(small(shared), ["t", "key"]))
    few = met.filter(F.col("c") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    near = few.select(F.explode(_forest(radius)("fps")).alias("l")).select("l.*")
    many = met.filter(F.col("c") > bucket).select("fp").distinct().select("fp", F.explode(_variants(F.col("fp"), radius)).alias("v"))
    least = many.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("_z")).filter("a < _z")
    # A variant is shared by few fingerprints, its flips at most, so this join has no hot key.
    exact = many.join(least, "v").filter("a <> fp").select("a", F.col("fp").alias("b"))
    out = cut(near.union(exact).distinct())
    let_go(shared, met)
    return out


def simhash_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) and component_id, one row for every row of ``docs``.

    component_id is the smallest doc_id that links of ``radius`` differing bits at most reach; rows of one
    doc_id are one document, so their fingerprints are linked. Null, empty and blank texts have the
    fingerprint zero, which is linked like any other; fewer words than ``width`` make one shingle. Rows
    without a doc_id take part, and a component of such rows alone has a null component_id. Ties can't
    change the result; repeated rows give repeated rows. Only doc_id and text are read, whatever other
    columns there are; an empty table gives an empty one. Radii are even.
    """
    settle(docs.sparkSession)
    prints = cut(docs.select("doc_id", _print(width)("text").alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    several = prints.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("_z")).filter("a < _z").select("doc_id", "a")
    own = prints.join(several, "doc_id").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    labels = components(links_within(nodes.select("fp"), radius).union(own))
    found = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("comp", "fp").alias("comp"))
    heads = found.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = cut(found.join(heads, "comp").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (16 hexadecimal digits) and component of every document: 3-word shingles, 2 differing bits.

    See ``simhash_duplicates`` for nulls, long texts, ties, repeated rows, extra columns and empty tables.
    """
    out = simhash_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
