"""Line dedup: explode normalised lines, hash them, count the documents of each hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import WHITE, cut, let_go, load, lowered, nested, unnested

LEAST_CHARS, LEAST_DOCS = 10, 2
_NO_ID = 2**63 - 1


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line that has a key: document, hash of its text, position and a 128-bit hash of the key."""
    key = F.btrim(lowered(F.col("line")), F.lit(WHITE))
    return (
        docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("did", "th", "pos", key.alias("key"))
        .filter(F.char_length("key") >= LEAST_CHARS)
        .select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def drops(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """did, th and the positions of the lines to drop: those whose key ``least_docs`` documents hold, but in the smallest of them.

    A null doc_id comes after all others, and all rows without one count as one document. Distinct
    documents are counted per hash after rows of one document collapse, and the count combines on the
    map side, so a line in a third of all documents is one row per task; the join back leaves hot hashes
    to the skew join, as either side of it comes straight from a shuffle. The exploded hashes are
    written once and read by both.
    """
    lines = cut(_lines(docs))
    held = lines.groupBy("h1", "h2", "did").agg(F.lit(1).alias("_")).drop("_")
    common = cut(held.groupBy("h1", "h2").agg(F.min("did").alias("holder"), F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("h1", "h2", "holder"))
    gone = cut(lines.join(common, ["h1", "h2"]).filter("did <> holder").groupBy("did", "th").agg(F.collect_set("pos").alias("gone")))
    let_go(lines, common)
    return gone


def with_lines_dropped(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``row`` (the columns of ``docs`` as a struct), n_lines, n_dropped and kept, the text that is left.

    A null text stays null, with one empty line. Keys under 10 code points never drop. Rows that share
    doc_id and text lose the same lines. A document all of whose lines go has the empty text. Extra
    columns may have any names; an empty table gives an empty one.
    """
    found = drops(docs.select("doc_id", "text"), least_docs)
    # The lines are split below the join, so that the picking above it has them as a column and not as an expression.
    left = docs.select(nested(docs).alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    both = left.join(found, ["did", "th"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return both.select("row", F.coalesce(F.size("lines"), F.lit(1)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), text.alias("kept"))


def line_dedup(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All documents, their repeated lines gone; n_chars follows the text. Other columns stay."""
    changed: dict[str, Column] = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return with_lines_dropped(docs, least_docs).select(*unnested(docs.columns, **changed))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines before, lines dropped, SHA-256 of the text that is left."""
    out = with_lines_dropped(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, t.line, t.pos
  FROM (SELECT doc_id, row_number() OVER () AS rowid, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) t
), k AS (
  SELECT r, doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), h AS (
  SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT k.*, (h.key IS NOT NULL AND k.doc_id <> h.holder) AS gone FROM k LEFT JOIN h ON k.key = h.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
