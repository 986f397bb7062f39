"""Readers of passages, questions, metadata and retrieval results; every path is read by Spark's own readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.text import nonblank, safe_id, stripped
from sextant.sources import schemas, versions


def passages_tsv(spark: SparkSession, path: str, strict_ids: bool = True) -> DataFrame:
    """passage_id, text, title of a tab-separated file with a header row.

    Strict: rows without a whole-number id or with blank text go, texts are stripped. Else: only blank
    texts go and ids stay strings. Short rows have null fields and go as blank.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', schema=schemas.PASSAGE_TSV, enforceSchema=True)
    rows = raw.filter(nonblank(F.col("text")))
    if not strict_ids:
        return rows.select(F.col("id").alias("passage_id"), "text", "title")
    return rows.select(safe_id(F.col("id")).alias("passage_id"), stripped(F.col("text")).alias("text"), "title").filter("passage_id IS NOT NULL")


def rejected_passages(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the strict reader leaves out, as they are."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', schema=schemas.PASSAGE_TSV, enforceSchema=True)
    return raw.filter(~nonblank(F.col("text")) | safe_id(F.col("id")).isNull())


def row_estimate(spark: SparkSession, path: str, chunk: int) -> tuple[int, int]:
    """Lines after the header of each file, and the chunks they make."""
    per = spark.read.text(path).groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("c"))
    n = per.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).first()[0]
    return n, -(-n // chunk)


def _json_root(spark: SparkSession, path: str, schema: str, roots: str = "[{") -> DataFrame:
    """_pos (files by name, records in order) and the fields of the records of files whose root is a list or an object with
    ``data``; ``roots`` names the allowed ones. See ``json_records``."""
    kind = f"struct<{', '.join(f.replace(' ', ':', 1) for f in _fields(schema))}>"
    items = json_records(spark, path, roots).select("_pos", F.from_json("record", kind, {"mode": "FAILFAST"}).alias("x"))
    return items.select("_pos", "x.*")


def _before(rows: DataFrame, value: Column, name: str, split: list[str]) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows of the file before this one.

    Rows are summed per split of the file, the splits' sums run over one row a split, and within a split over its rows.
    """
    sums = rows.groupBy(*split).agg(F.sum(value).alias("_s"))
    run = F.sum("_s").over(Window.partitionBy(split[0]).orderBy(*split[1:])) - F.col("_s")
    carried = sums.select(*split, run.alias("_c"))
    inner = F.sum(value).over(Window.partitionBy(*split).orderBy("i")) - value
    return rows.withColumn(name, inner).join(carried, split).withColumn(name, F.col(name) + F.col("_c")).drop("_c")


def json_records(spark: SparkSession, path: str, roots: str = "[{") -> DataFrame:
    """_pos and record: the text of every record of JSON files, each a list or an object with a list ``data``.

    A file is read in splits, as lines are, but parted at commas: every record ends at one. What a comma parts may be inside a
    string or a nested value, so each piece's quotes and brackets are counted for either case, running sums over the
    splits tell which case it is and how deep it starts, and pieces that start in the list itself start records. No task
    needs a whole file; a record must fit into one row. Compressed files are one split each.
    """
    raw = spark.read.option("lineSep", ",").text(path)
    place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")]
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    depth = lambda odd: F.aggregate(F.filter(parts, lambda x, n: n % 2 == odd), F.lit(0), lambda d, x: d + F.length(F.translate(x, "]}", "")) - F.length(F.translate(x, "[{", "")))
    pieces = stored(raw.select(*place, "value", ((F.size(parts) - 1) % 2).alias("odd"), depth(0).alias("d0"), depth(1).alias("d1")), "pieces")
    first = pieces.filter("b = 0").groupBy("f").agg(F.min_by("value", "i").alias("v")).select(F.substring(F.ltrim(F.regexp_replace("v", r"^\s+", "")), 1, 1).alias("c")).distinct()
    kind = {r["c"] for r in first.collect()}
    if len(kind) > 1 or not kind <= set(roots):
        raise ValueError(f"neither a list nor an object, or not the one asked for: {path}")
    within = kind == {"{"}  # the list is a member of an object
    split = ["f", "b"]
    rows = _before(pieces, F.col("odd"), "quotes", split).withColumn("inside", F.col("quotes") % 2 == 1)
    rows = _before(rows.withColumn("d", F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))), F.col("d"), "depth", split)
    text, level = F.col("value"), 2 if within else 1
    member = ~F.col("inside") & (F.col("depth") < level)
    if within:  # which member a piece belongs to: members are numbered, and the one called data is kept
        rows = _before(rows.withColumn("m", member.cast("int")), F.col("m"), "member", split).withColumn("member", F.col("member") + F.col("m"))
        opening = r'^\s*\{?\s*"data"\s*:\s*\['
        named = stored(rows.filter("m = 1").filter(F.regexp_like("value", F.lit(opening))).select("f", "member"), "members")
        if pieces.select("f").distinct().join(named, "f", "left_anti").head(1):
            raise ValueError(f"an object without data: {path}")
        rows = rows.join(named, ["f", "member"], "left_semi")
        text = F.when(member, F.regexp_replace("value", opening, "")).otherwise(text)
    else:
        text = F.when(member, F.regexp_replace("value", r"^\s*\[", "")).otherwise(text)
    ends = F.col("depth") + F.col("d") < level
    text = F.when(ends, F.regexp_replace(text, r"\]\s*(\}\s*)?$", "")).otherwise(text)
    starts = (~F.col("inside") & (F.col("depth") <= level)).cast("int")
    rows = _before(rows.withColumn("text", text).withColumn("start", starts), F.col("start"), "n", split).withColumn("n", F.col("n") + F.col("start"))
    whole = rows.groupBy("f", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "text"))), lambda x: x["text"]), ",").alias("record"))
    whole = whole.filter(F.length(F.regexp_replace("record", r"\s+", "")) > 0)
    counts = rows.groupBy("f").agg(F.max("n").alias("_n"), F.min("n").alias("_lo"))
    offset = counts.select("f", "_lo", (F.sum(F.col("_n") - F.col("_lo") + 1).over(Window.orderBy("f")) - (F.col("_n") - F.col("_lo") + 1)).alias("_o"))  # one row a file
    return whole.join(offset, "f").select((F.col("_o") + F.col("n") - F.col("_lo")).alias("_pos"), "record")


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def questions_json(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """example_id, question, short_answers, context, in file order; a positive limit keeps the first rows."""
    rows = _json_root(spark, path, schemas.QA).orderBy("_pos")
    return rows.limit(limit) if limit and limit > 0 else rows


def grid_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with an answer, all answers kept, of a file whose root is an object with ``data``; a list is an error."""
    return answered_questions(_json_root(spark, path, schemas.QA, roots="{"))


def answered_questions(rows: DataFrame) -> DataFrame:
    """Rows with a question and at least one answer."""
    return rows.filter((F.coalesce(F.length("question"), F.lit(0)) > 0) & (F.coalesce(F.size("short_answers"), F.lit(0)) > 0))


def question_rows(qa: DataFrame, sparse: DataFrame | None = None, prefix: str = "", sparse_key: str = "example_id") -> DataFrame:
    """encoder_question, answer (the first, or "") and sparse_docs (an empty array where there are none).

    ``sparse_key="question"`` looks results up by question text, as the original does.
    """
    docs = F.array().cast(f"array<{schemas.SPARSE_DOC}>")
    rows = qa.withColumn("qid", F.coalesce("example_id", F.concat(F.lit("gen_id_"), F.col("_pos").cast("string")))) if "_pos" in qa.columns else qa.withColumn("qid", F.col("example_id"))
    if sparse is not None:
        rows = rows.join(sparse.select(F.col("key").alias("_k"), F.col("sparse_retrieved_docs").alias("_d")), F.col("_k") == (F.col("question") if sparse_key == "question" else F.col("qid")), "left").drop("_k")
    else:
        rows = rows.withColumn("_d", docs)
    answer = F.coalesce(F.get("short_answers", F.lit(0)), F.lit(""))
    return rows.filter(F.coalesce(F.length("question"), F.lit(0)) > 0).select("qid", "question", F.concat(F.lit(prefix), F.col("question")).alias("encoder_question"), answer.alias("answer"), F.coalesce("_d", docs).alias("sparse_docs"))


def bi_encoder_examples(spark: SparkSession, path: str) -> DataFrame:
    """question, answers and the three lists of contexts, in file order by _pos."""
    return _json_root(spark, path, schemas.BI_ENCODER)


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Well-formed lines with _line, an order that follows the names of the files and the lines of each.

    A task reads a stretch of a file in order, so its rows' numbers ascend within the stretch, wherever it ran.
    """
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return raw.withColumn("_line", place).filter("_bad IS NULL").drop("_bad")


def metadata_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """key, title, text: malformed lines are skipped, the last line of a key wins, a line without id is an error."""
    rows = _json_lines(spark, path, schemas.METADATA)
    keyed = rows.withColumn("key", F.when(F.col("id").isNull(), F.raise_error(F.lit("a line of the metadata has no id")).cast("string")).otherwise(F.col("id")))
    return last_wins(keyed, "key", "_line").select("key", "title", "text")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def sparse_results_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """key (example_id, else the question) and sparse_retrieved_docs; empty keys go, the last wins; a missing file is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"key string, sparse_retrieved_docs array<{schemas.SPARSE_DOC}>")
    rows = _json_lines(spark, path, schemas.SPARSE_RESULT).withColumn("key", F.coalesce("example_id", "original_question"))
    return last_wins(rows.filter(F.length("key") > 0), "key", "_line").select("key", "sparse_retrieved_docs")


def vectors_parquet(spark: SparkSession, path: str, dim: int, id_: str = "passage_id", vector: str = "embedding") -> DataFrame:
    """passage_id, embedding; a vector of another width fails the query that meets it."""
    width = F.when(F.size(vector) != dim, F.raise_error(F.lit(f"a vector is not {dim} wide")).cast("array<float>")).otherwise(F.col(vector))
    return spark.read.parquet(path).select(F.col(id_).alias("passage_id"), width.alias("embedding"))


def inverted_index(spark: SparkSession, path: str):
    """The ``Index`` that ``sinks.inverted_index`` wrote."""
    from sextant.operators.sparse import Index

    tables = versions.opened(spark, path)
    return Index(tables["postings"], tables["doc_stats"], tables["corpus"], bool(versions.latest(spark, path).content["stem"]), tables.get("stems"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that live as long as the application, in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset a local master gets one of its own; a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.gettempdir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/sextant-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder of its own and read from there: what follows is computed from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows up to which a list is broadcast.
BROADCAST_ROWS = 1 << 18


def listed(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if its count allows; else joins shuffle by key."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def catalog(entries: DataFrame, name: str) -> DataFrame:
    """The entries of a resource table (key, url, extension, compressed, description) of that key, else of that prefix."""
    exact = entries.filter(F.col("key") == name)
    return exact if exact.head(1) else entries.filter(F.col("key").startswith(name))


def resource_path(key: str, extension: str, folder: str) -> str:
    """Where a resource belongs: dots of its key are folders."""
    return "/".join([folder.rstrip("/"), *key.split(".")]) + extension


def resource_paths(entries: DataFrame, folder: str) -> DataFrame:
    """Adds path: where each resource (key, extension) belongs."""
    return entries.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.replace("key", F.lit("."), F.lit("/")), F.coalesce("extension", F.lit(""))))
