"""Queries over what the engine writes and reads back, and over its plugs: files, stored indexes, encoders, generators.

Each writes whole tables into a folder of its own in the shared scratch and answers from what it reads there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import stem, subword
from sextant.functions import text as T
from sextant.functions import vector as V
from sextant.operators import answer, beam, blocks, dense, evaluate, fusion, graph, lsh, metrics, resample, sparse, trainset
from sextant.plans import registry as R
from sextant.plans.registry import index, passages, query, questions, table, vector_queries
from sextant.sources import npy, readers, sinks, versions
from sextant.streaming import ingest

_FLAT = "regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')"


def _stems() -> str:
    """Steps of the stemmer over a table ``vocabulary`` of terms, as one nested select."""
    sql = "SELECT * FROM vocabulary"
    for name, x in stem.steps("term"):
        sql = f"SELECT *, {x} AS {name} FROM ({sql})"
    return sql.replace("'([aeiou])y', '$1Y')", "'([aeiou])y', '\\1Y', 'g')")


_STEMMED = f"""WITH t0 AS (SELECT term, doc_id AS passage_id FROM (SELECT doc_id, unnest({R._TERMS}) AS term FROM documents)),
q0 AS (SELECT qid, term FROM (SELECT item_id AS qid, unnest({R._TERMS}) AS term FROM benchmark)),
vocabulary AS (SELECT term FROM t0 UNION SELECT term FROM q0), st AS (SELECT term, stem_9 AS stem FROM ({_stems()})),
tf AS (SELECT stem AS term, passage_id, count(*) AS tf FROM t0 JOIN st USING (term) GROUP BY 1, 2), {R._DL}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT qid, stem AS term, count(*) AS qtf FROM q0 JOIN st USING (term) GROUP BY 1, 2),
m AS (SELECT q.qid, tf.passage_id, tf.tf, q.qtf, df.df, dl.dl, cs.n, cs.avgdl FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term JOIN dl ON dl.passage_id = tf.passage_id CROSS JOIN cs),
s AS (SELECT qid, passage_id, round(sum({R._bm25()}), 6) AS score FROM m GROUP BY 1, 2)"""


def _stored(spark: SparkSession, d: str, stemmed: bool) -> sparse.Index:
    path = readers.scratch(spark, "index")
    sinks.inverted_index(sparse.build_index(passages(spark, d), stemmed), path)
    return readers.inverted_index(spark, path)


@query(f"{R._BM25} {R._ranked(10)}")
def bm25_from_index(spark, d):
    return sparse.search_index(questions(spark, d), _stored(spark, d, False), 10)


def _segments(spark: SparkSession, d: str, stemmed: bool = False) -> blocks.BlockIndex:
    """The passages in three segments: a third each, and every fiftieth, which is there already, once more with its text."""
    path, p = readers.scratch(spark, "blocks"), passages(spark, d)
    third = F.col("passage_id") % 3
    blocks.add(p.filter(third == 0).withColumn("text", F.when(F.col("passage_id") % 50 == 0, F.lit("replaced below")).otherwise(F.col("text"))), path, stemmed)
    blocks.add(p.filter(third == 1), path)
    blocks.add(p.filter((third == 2) | (F.col("passage_id") % 50 == 0)), path)
    return blocks.open_blocks(spark, path)


@query(f"{R._BM25} {R._ranked(10)}")
def bm25_from_segments(spark, d):
    return blocks.search(questions(spark, d), _segments(spark, d), 10)


@query(f"{R._BM25} {R._ranked(10)}")
def bm25_from_index_pruned(spark, d):
    path = readers.scratch(spark, "blocks")
    blocks.add(passages(spark, d), path)
    return blocks.search(questions(spark, d), blocks.open_blocks(spark, path), 10)


# How many blocks there are follows from how the passages fell into ranges; that no more are read than there are is for SQL to say.
@query(f"{R._MATCH} SELECT DISTINCT qid, true AS fewer FROM m")
def bm25_blocks_read(spark, d):
    path = readers.scratch(spark, "blocks")
    blocks.add(passages(spark, d), path)
    read = blocks.pruned(questions(spark, d), blocks.open_blocks(spark, path), 10)[1]
    return read.select("qid", ((F.col("n_read") > 0) & (F.col("n_read") <= F.col("n_blocks"))).alias("fewer"))


@query(f"{R._BM25} {R._ranked(10)}")
def bm25_compacted(spark, d):
    path = readers.scratch(spark, "blocks")
    p = passages(spark, d)
    blocks.add(p.filter("passage_id % 2 = 0"), path)
    blocks.add(p.filter("passage_id % 2 = 1 OR passage_id % 20 = 0"), path)
    blocks.compact(spark, path)
    return blocks.search(questions(spark, d), blocks.open_blocks(spark, path), 10)


@query(f"{_STEMMED} {R._ranked(10)}")
def bm25_stemmed_index(spark, d):
    return sparse.search_index(questions(spark, d), _stored(spark, d, True), 10)


@query(f"{R._MATCH}, s AS (SELECT qid, passage_id, round(sum(tf * qtf * ln(n / df)), 6) AS score FROM m GROUP BY 1, 2) {R._ranked(10)}")
def tfidf_from_index(spark, d):
    return sparse.search_index(questions(spark, d), _stored(spark, d, False), 10, scheme="tfidf")


@query(f"WITH vocabulary AS (SELECT DISTINCT term FROM (SELECT unnest({R._TERMS}) AS term FROM documents)) SELECT term, stem_9 AS stem FROM ({_stems()})")
def english_stems(spark, d):
    terms = passages(spark, d).select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    return terms.withColumn("stem", stem.stemmed("term"))


@query("SELECT doc_id AS passage_id, 'chunk:' || doc_id AS term FROM documents")
def id_terms(spark, d):
    return sparse.id_terms(passages(spark, d))


def _tsv(spark: SparkSession, d: str) -> str:
    path = readers.scratch(spark, "tsv")
    sinks.passages_tsv(passages(spark, d), path)
    return path


@query(rf"SELECT doc_id AS passage_id, md5(regexp_replace({_FLAT}, '^\s+|\s+$', '', 'g')) AS text, coalesce(source, '') AS title FROM documents WHERE length(regexp_replace({_FLAT}, '\s+', '', 'g')) > 0")
def tsv_passages(spark, d):
    return readers.passages_tsv(spark, _tsv(spark, d)).select("passage_id", F.md5("text").alias("text"), F.coalesce("title", F.lit("")).alias("title"))


@query(rf"SELECT doc_id::VARCHAR AS passage_id, md5({_FLAT}) AS text FROM documents WHERE length(regexp_replace({_FLAT}, '\s+', '', 'g')) > 0")
def tsv_passages_loose(spark, d):
    return readers.passages_tsv(spark, _tsv(spark, d), strict_ids=False).select("passage_id", F.md5("text").alias("text"))


@query(rf"SELECT count(*) AS n_rejected FROM documents WHERE length(regexp_replace({_FLAT}, '\s+', '', 'g')) = 0")
def tsv_rejected(spark, d):
    return readers.rejected_passages(spark, _tsv(spark, d)).agg(F.count("*").alias("n_rejected"))


@query("SELECT count(*) AS n_rows, ceil(count(*) / 100)::BIGINT AS n_chunks FROM documents")
def tsv_row_estimate(spark, d):
    path = readers.scratch(spark, "one")
    sinks.passages_tsv(passages(spark, d).repartition(3), path)  # every file has a header
    return spark.createDataFrame([readers.row_estimate(spark, path, 100)], "n_rows bigint, n_chunks bigint")


@query("SELECT doc_id::VARCHAR AS key, coalesce(source, '') AS title, md5(coalesce(text, '')) AS text FROM documents")
def metadata_round_trip(spark, d):
    path = readers.scratch(spark, "meta")
    sinks.metadata_jsonl(passages(spark, d), path)
    return readers.metadata_jsonl(spark, path).select("key", F.coalesce("title", F.lit("")).alias("title"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))


def _json(rows: DataFrame, as_object: bool) -> str:
    """JSON documents of all rows in order of _o, one a range of rows, as the evaluation sets' files are."""
    path = readers.scratch(rows.sparkSession, "json")
    kept = [c for c in rows.columns if c != "_o"]
    ranged = readers.stored(rows.repartitionByRange("_o").select("_o", F.lpad(F.spark_partition_id().cast("string"), 6, "0").alias("file"), F.to_json(F.struct(*kept)).alias("x")), "ranged")
    up, down = Window.partitionBy("file").orderBy("_o"), Window.partitionBy("file").orderBy(F.desc("_o"))
    head, tail = ('{"data": [', "]}") if as_object else ("[", "]")
    text = F.concat(F.when(F.row_number().over(up) == 1, head).otherwise(""), "x", F.when(F.row_number().over(down) == 1, tail).otherwise(","))
    ranged.select("file", "_o", text.alias("value")).sortWithinPartitions("file", "_o").select("file", "value").write.partitionBy("file").text(path)
    return path


def _qa(spark: SparkSession, d: str) -> DataFrame:
    """Questions; every third has no id, every fifth no answer, every eleventh no question."""
    q = F.col("qid")
    return questions(spark, d).select(q.alias("_o"), F.when(q % 3 != 0, q.cast("string")).alias("example_id"), F.when(q % 11 != 0, F.col("question")).otherwise("").alias("question"), F.when(q % 5 != 0, F.array("question", F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("short_answers"), F.col("question").alias("context"))


_QA = "qa AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, CASE WHEN item_id % 3 <> 0 THEN item_id::VARCHAR END AS example_id, CASE WHEN item_id % 11 <> 0 THEN text ELSE '' END AS question, CASE WHEN item_id % 5 <> 0 THEN text ELSE '' END AS answer FROM benchmark)"


@query(f"WITH {_QA} SELECT pos, coalesce(example_id, '') AS example_id, question FROM qa")
def qa_json_object(spark, d):
    return readers.questions_json(spark, _json(_qa(spark, d), True)).select(F.col("_pos").cast("bigint").alias("pos"), F.coalesce("example_id", F.lit("")).alias("example_id"), "question")


@query(f"WITH {_QA} SELECT pos, question FROM qa WHERE pos < 7")
def qa_json_first(spark, d):
    return readers.questions_json(spark, _json(_qa(spark, d), False), 7).select(F.col("_pos").cast("bigint").alias("pos"), "question")


@query(f"WITH {_QA} SELECT pos, question, 2::BIGINT AS n_answers FROM qa WHERE question <> '' AND answer <> ''")
def qa_grid_questions(spark, d):
    return readers.grid_questions(spark, _json(_qa(spark, d), True)).select(F.col("_pos").cast("bigint").alias("pos"), "question", F.size("short_answers").cast("bigint").alias("n_answers"))


@query(f"WITH {_QA} SELECT coalesce(example_id, 'gen_id_' || pos) AS qid, 'query: ' || question AS encoder_question, answer, CASE WHEN example_id IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_docs FROM qa WHERE question <> ''")
def question_rows(spark, d):
    path = readers.scratch(spark, "sparse")
    rows = questions(spark, d).select(F.col("question").alias("original_question"), F.array("question").alias("original_answers"), F.col("qid").cast("string").alias("example_id"), F.array(F.struct(F.lit("1").alias("id"), F.lit("t").alias("title"), F.lit("x").alias("text"), F.lit(0.5).alias("sparse_score"))).alias("sparse_retrieved_docs"))
    sinks.sparse_results_jsonl(rows, path)
    qa = readers.questions_json(spark, _json(_qa(spark, d), False))
    out = readers.question_rows(qa, readers.sparse_results_jsonl(spark, path), "query: ")
    return out.select("qid", "encoder_question", "answer", F.size("sparse_docs").cast("bigint").alias("n_docs"))


@query(f"{R._BM25}, top AS ({R._ranked(50)}) SELECT qid::VARCHAR AS key, rank, passage_id::VARCHAR AS id, md5(d.text) AS text, score FROM top JOIN documents d ON d.doc_id = passage_id")
def sparse_results_round_trip(spark, d):
    path, q, p = readers.scratch(spark, "results"), questions(spark, d), passages(spark, d)
    nested = sparse.sparse_results(sparse.sparse_topk(q, p, 50), q, p)
    sinks.sparse_results_jsonl(nested.select(F.col("question").alias("original_question"), F.array("question").alias("original_answers"), F.col("qid").cast("string").alias("example_id"), "sparse_retrieved_docs"), path)
    rows = readers.sparse_results_jsonl(spark, path).select("key", F.posexplode("sparse_retrieved_docs").alias("_p", "x"))
    return rows.select("key", (F.col("_p") + 1).cast("bigint").alias("rank"), "x.id", F.md5("x.text").alias("text"), F.col("x.sparse_score").alias("score"))


@query(f"{R._H} SELECT b.text AS question, md5(x.text) AS positive, 1 + (p4 IS NOT NULL)::BIGINT AS n_positive, (p2 IS NOT NULL)::BIGINT + (p3 IS NOT NULL)::BIGINT + (p5 IS NOT NULL)::BIGINT AS n_negative FROM c JOIN benchmark b ON item_id = qid JOIN documents x ON x.doc_id = p1")
def bi_encoder_round_trip(spark, d):
    rows = readers.bi_encoder_examples(spark, _json(R._examples(spark, d).withColumnRenamed("qid", "_o"), False))
    return rows.select("question", F.md5(F.get("positive_ctxs", F.lit(0))["text"]).alias("positive"), F.size("positive_ctxs").cast("bigint").alias("n_positive"), F.size("negative_ctxs").cast("bigint").alias("n_negative"))


@query("SELECT vec_id AS passage_id, vec_id // 100 AS chunk, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total FROM embeddings")
def vectors_round_trip(spark, d):
    path = readers.scratch(spark, "vectors")
    sinks.vectors_parquet(resample.batches(index(spark, d), "passage_id", 100), path, "chunk")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return readers.vectors_parquet(spark, path, 64).select("passage_id", F.floor(F.col("passage_id") / 100).alias("chunk"), (F.round(total, 5) + 0.0).alias("total"))


@query(f"{R._dense(10)} SELECT count(DISTINCT qid) AS n_queries, (SELECT count(*) FROM embeddings) AS n_indexed, true AS enough FROM top")
def cell_index_round_trip(spark, d):
    path = readers.scratch(spark, "cells")
    dense.write_cells(dense.build_cells(index(spark, d)), path)
    stored = dense.open_cells(spark, path)
    exact = dense.dense_topk(vector_queries(spark, d), index(spark, d), 10).select("qid", "passage_id")
    near = dense.search_cells(vector_queries(spark, d), stored, 10).select("qid", "passage_id", F.lit(1).alias("hit"))
    found = exact.join(near, ["qid", "passage_id"], "left").agg(F.count_distinct("qid").alias("n_queries"), (F.sum("hit") >= 0.9 * F.count("*")).alias("enough"))
    return found.crossJoin(F.broadcast(stored.blocks.agg(F.sum(F.size("c_ids")).alias("n_indexed"))))  # one row each


@query("SELECT vec_id AS passage_id, (row_number() OVER (ORDER BY vec_id) - 1) // 150 AS chunk, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total FROM embeddings")
def npy_round_trip(spark, d):
    path = readers.scratch(spark, "npy")
    npy.write(index(spark, d), path, 150)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return npy.read(spark, path).select("passage_id", "chunk", (F.round(total, 5) + 0.0).alias("total"))


# The plug follows the prompt's first words: each word's length is the likeliest token, and only after them may it end.
@query(f"WITH w AS (SELECT item_id AS qid, {R._TOKENS.format('text')}[1:5] AS w FROM benchmark) SELECT qid, array_to_string(list_transform(w, lambda x: len(x)), ' ') AS tokens, round(-0.1::DOUBLE, 6) AS sequence_score FROM w")
def beam_answers(spark, d):
    def step(prompts, tokens):
        out = []
        for p, t in zip(prompts, tokens, strict=True):
            words = p.split()[:5]
            out.append([(len(words[len(t)]), -0.1), (len(words[len(t)]) + 1, -1.0)] if len(t) < len(words) else [(0, -0.1)])
        return out

    found = beam.beam_search(questions(spark, d), ["qid"], "question", step, 0, 4, 8, 0)
    return found.select("qid", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"), F.round("sequence_score", 6).alias("sequence_score"))


# Pieces are single characters here, so that SQL can count them; a word with any other character is one unknown.
@query(r"""WITH w AS (SELECT doc_id AS passage_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[!-/:-@\[-`{-~]|\p{P}|[^\s!-/:-@\[-`{-~\p{P}]+') AS w FROM documents),
n AS (SELECT passage_id, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[a-z0-9]+') AND len(x) <= 100 THEN len(x) ELSE 1 END)), 0)::BIGINT AS n_pieces FROM w)
SELECT passage_id, n_pieces, least(n_pieces + 2, 512)::BIGINT AS n_mask, 512::BIGINT AS n_ids FROM n""")
def subword_inputs(spark, d):
    chars = "abcdefghijklmnopqrstuvwxyz0123456789"
    v = subword.Vocabulary({p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *chars, *("##" + c for c in chars)])})
    rows = passages(spark, d).select("passage_id", subword.subwords(F.col("text"), v).alias("ids"))
    made = rows.select("passage_id", F.size("ids").cast("bigint").alias("n_pieces"), subword.model_inputs(F.col("ids"), v).alias("m"))
    total = F.aggregate("m.attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return made.select("passage_id", "n_pieces", total.alias("n_mask"), F.size("m.input_ids").cast("bigint").alias("n_ids"))


@query("SELECT doc_id AS passage_id, 'ValueError: a price' AS error FROM documents WHERE contains(text, '$')")
def rejected_prompts(spark, d):
    def model(texts):
        if any("$" in t for t in texts):
            raise ValueError("a price")
        return [(t[:20], 0.0) for t in texts]

    path = readers.scratch(spark, "isolated")
    answer.accepted_and_rejected(answer.generate_isolated(passages(spark, d).select("passage_id", "text"), "text", model), path)
    return versions.opened(spark, path)["rejected"].select("passage_id", "error")


def _recalled(spark, d, near: DataFrame, n_indexed: Column) -> DataFrame:
    """n_queries, n_exact, enough (nine tenths of the exact hits are there, with their exact scores) and n_indexed: one row."""
    exact = dense.dense_topk(vector_queries(spark, d), index(spark, d), 10).select("qid", "passage_id", "score")
    both = exact.join(near.select("qid", "passage_id", F.col("score").alias("near")), ["qid", "passage_id"], "left")
    hit = F.count(F.when(F.abs(F.col("near") - F.col("score")) < 2e-6, 1))
    return both.agg(F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_exact"), (hit >= 0.9 * F.count("*")).alias("enough")).withColumn("n_indexed", n_indexed)


_RECALLED = f"{R._dense(10)} SELECT count(DISTINCT qid) AS n_queries, count(*) AS n_exact, true AS enough, (SELECT count(*) FROM embeddings) AS n_indexed FROM top"


@query(_RECALLED)
def dense_topk_graph(spark, d):
    g = graph.write(index(spark, d), readers.scratch(spark, "graph"))
    return _recalled(spark, d, graph.search(vector_queries(spark, d), g, 10)[0], F.lit(g.n).cast("bigint"))


@query(_RECALLED)
def dense_topk_lsh(spark, d):
    path = readers.scratch(spark, "hashed")
    lsh.write(lsh.build(index(spark, d)), path)
    h = lsh.open_hashed(spark, path)
    n = h.blocks.agg((F.sum(F.size("c_ids")) / h.tables).cast("bigint")).first()[0]
    return _recalled(spark, d, lsh.search(vector_queries(spark, d), h, 10), F.lit(n))


_UNIT = "SELECT vec_id AS qid, list_transform(embedding, lambda x: (x::DOUBLE * 3 / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE * 3), list_transform(embedding, lambda y: y::DOUBLE * 3))))::FLOAT) AS embedding FROM embeddings WHERE vec_id % 50 = 0"


@query(f"{R._dense(10, _UNIT)} SELECT * FROM top")
def dense_topk_normalized(spark, d):
    longer = vector_queries(spark, d).select("qid", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding"))
    return dense.dense_topk(longer, index(spark, d), 10, normalize=True)


@query("SELECT r_name || '.' || replace(n_name, ' ', '_') AS key, 'out/' || r_name || '/' || replace(n_name, ' ', '_') || '.json' AS path FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def catalog_lookup(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    entries = both.select(F.concat("r_name", F.lit("."), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("key"), F.lit(".json").alias("extension"))
    return readers.resource_paths(readers.catalog(entries, "ASIA"), "out/").select("key", "path")


_LINE = "printf('%.4f\t%.4f\t%.4f\t%.4f', k1, b, recall_10, recall_50)"


@query(f"WITH g AS ({R._GRID}) SELECT row_number() OVER (ORDER BY recall_10 DESC, k1, b) AS place, {_LINE} AS line FROM g")
def grid_table(spark, d):
    rows = metrics.sorted_table(R.bm25_grid_recall(spark, d), "recall_10", "k1", "b")
    lines = sinks.console_rows(rows.select("k1", "b", "recall_10", "recall_50", "place"))
    return lines.select(F.substring_index("line", "\t", -1).cast("bigint").alias("place"), F.substring_index("line", "\t", 4).alias("line"))


@query("""WITH e AS (SELECT vec_id, vec_id // 8 AS batch, vec_id % 8 AS i, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.batch, a.i, b.i AS j, round(list_dot_product(a.v, b.v), 6) / 0.05 AS x FROM e a JOIN e b ON a.batch = b.batch WHERE a.i < 4),
m AS (SELECT *, max(x) OVER (PARTITION BY batch, i) AS mx FROM s), l AS (SELECT batch, i, max(mx) + ln(sum(exp(x - mx))) - max(CASE WHEN j = i THEN x END) AS l FROM m GROUP BY 1, 2)
SELECT batch, round(avg(l), 6) AS loss FROM l GROUP BY 1""")
def contrastive_loss_negatives(spark, d):
    """Batches of four queries with their positives (numbers 0 to 3) and all four negatives of the batch (4 to 7)."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), (F.col("vec_id") % 8).alias("i"), "embedding")
    side = lambda keep: e.filter(keep).select(F.col("batch").alias("_b"), F.col("i").alias("j"), F.col("embedding").alias("_v"))
    return metrics.contrastive(e.filter("i < 4"), side("i < 4"), side("i >= 4")).select("batch", F.round("loss", 6).alias("loss"))


_STUB = "md5(d.text)"


def _stub(prompts: list[str]) -> list[tuple[str, float]]:
    """A generator for tests: the passage part of the prompt, and a score from the prompt's length."""
    return [(p.partition(" [SEP_TEXT] ")[2] or p.partition("  context: ")[2], -(len(p) % 11) / 10) for p in prompts]


_PROMPT = "(b.text || ' [SEP_TITLE] ' || coalesce(d.source, '') || ' [SEP_TEXT] ' || coalesce(d.text, ''))"


def _picked(top: str, total: str, order: str) -> str:
    return f"""pk AS (SELECT qid, d.text AS prediction, b.text AS reference, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS r FROM (SELECT *, {total} AS lp FROM {top}) t JOIN documents d ON d.doc_id = t.passage_id JOIN benchmark b ON b.item_id = qid),
pr AS (SELECT item_id AS conv_id, 0 AS turn, coalesce(prediction, '') AS prediction, benchmark.text AS reference FROM benchmark LEFT JOIN pk ON qid = item_id AND r = 1), {R._f1(True)}"""


_SOFTMAX = "score - max(score) OVER (PARTITION BY qid) - ln(sum(exp(score)) OVER (PARTITION BY qid)) + max(score) OVER (PARTITION BY qid)"
_BEST = f"round(lp - (length({_PROMPT}) % 11) / 10.0, 6) DESC, rank"
_MEANS = "round(avg(em) * 100, 4) AS exact_match, round(avg(f1) * 100, 4) AS f1"


def _means(rows: DataFrame) -> DataFrame:
    return rows.select(F.round("exact_match", 4).alias("exact_match"), F.round("f1", 4).alias("f1"))


def _golds(spark, d):
    return questions(spark, d).withColumn("golds", F.array("question"))


@query(f"{R._BM25}, top AS ({R._ranked(5)}), {_picked('top', '0', 'score DESC, rank')} SELECT {_MEANS} FROM sc")
def evaluate_sparse_pipeline(spark, d):
    q, p = _golds(spark, d), passages(spark, d)
    hits = sparse.sparse_topk(q, p, 5)
    return _means(evaluate.evaluate(q, evaluate.answers(q, hits, p, _stub, "retrieval")))


@query(f"{R._dense(5, R._QVEC, True)}, {_picked('top', 'score - ln(sum(exp(score)) OVER (PARTITION BY qid))', _BEST)} SELECT {_MEANS} FROM sc")
def evaluate_dense_pipeline(spark, d):
    q, p = _golds(spark, d), passages(spark, d)
    hits = dense.dense_topk(R.question_vectors(spark, d), index(spark, d), 5, skip_self=True)
    return _means(evaluate.evaluate(q, evaluate.answers(q, hits, p, _stub)))


@query(f"{R._RRF}, top AS (SELECT qid, passage_id, rrf AS score, rank FROM r WHERE rank <= 5), {_picked('top', 'score - ln(sum(exp(score)) OVER (PARTITION BY qid))', _BEST)} SELECT 'hybrid' AS pipeline, {_MEANS} FROM sc")
def evaluate_hybrid_pipeline(spark, d):
    q, p = _golds(spark, d), passages(spark, d)
    hits = fusion.rrf(*R._lists(spark, d), 5).withColumnRenamed("rrf", "score")
    out = evaluate.evaluate_pipelines(q, {"hybrid": (hits, "sequence")}, p, _stub)
    return out.select("pipeline", F.round("exact_match", 4).alias("exact_match"), F.round("f1", 4).alias("f1"))


@query(f"{R._PAIRS}, {R._f1(True)} SELECT {_MEANS} FROM sc")
def evaluate_gold_context(spark, d):
    rows = R.qa_pairs(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.lit("?").alias("question"), F.col("prediction").alias("context"), F.array("reference").alias("golds"))
    return _means(evaluate.evaluate_gold(rows, _stub))


@query(f"{R._BM25}, top AS ({R._ranked(5)}), f AS (SELECT DISTINCT qid FROM top ORDER BY qid LIMIT 3) SELECT 'eval' AS epoch, qid, b.text AS question, md5(string_agg(d.source, ' | ' ORDER BY rank)) AS titles, max(CASE WHEN rank = 1 THEN d.text[1:150] || '...' END) AS snippet FROM top JOIN f USING (qid) JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = passage_id WHERE d.source <> '' GROUP BY 1, 2, 3")
def logged_samples(spark, d):
    q, p = questions(spark, d), passages(spark, d)
    rows = sparse.sparse_topk(q, p, 5).join(q, "qid").join(p, "passage_id").filter("title <> ''").withColumn("answer", F.lit("a")).withColumn("reference", F.col("question"))
    return answer.sample_log(rows, "eval").select("epoch", "qid", "question", F.md5("all_retrieved_titles").alias("titles"), F.col("top_retrieved_doc_text_snippet").alias("snippet"))


@query(f"{R._BM25}, top AS ({R._ranked(5)}) SELECT qid, rank, md5(coalesce(d.text, '')) AS answer, round(-(length({_PROMPT}) % 11) / 10.0, 4) AS sequence_score FROM top JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = passage_id")
def generated_candidates(spark, d):
    q, p = questions(spark, d), passages(spark, d)
    rows = sparse.sparse_topk(q, p, 5).join(q, "qid").join(p, "passage_id").withColumn("prompt", T.retrieval_prompt(F.col("question"), F.col("title"), F.col("text")))
    return answer.generate_with(rows, "prompt", _stub).select("qid", "rank", F.md5("answer").alias("answer"), (F.round("sequence_score", 4) + 0.0).alias("sequence_score"))


@query("SELECT doc_id AS passage_id, length(coalesce(text, ''))::DOUBLE AS x, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS y FROM documents")
def encoded_passages(spark, d):
    def model(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" ")] for t in texts]).reshape(-1, 2)

    out = dense.encode_with(passages(spark, d), "text", model)
    return out.select("passage_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


_CODED = R._CODE.format("doc_id", R._TERMS, "documents")


@query(f"""{R._RRF}, t AS (SELECT qid, passage_id, rank FROM r WHERE rank <= 120), g AS (SELECT item_id AS qid, unnest(range(1, 121)) AS rank FROM benchmark), {_CODED},
h AS (SELECT id, max(CASE WHEN i = 0 THEN n ELSE 0 END) / sqrt(sum(n * n)) AS x FROM c GROUP BY 1)
SELECT g.qid, g.rank, coalesce(t.passage_id, -1) AS passage_id, round(coalesce(CASE WHEN t.passage_id % 2 = 0 THEN e.embedding[1]::DOUBLE END, h.x, 0.0)::FLOAT::DOUBLE, 4) + 0.0 AS first, coalesce(d.source, '') AS title FROM g LEFT JOIN t ON t.qid = g.qid AND t.rank = g.rank LEFT JOIN embeddings e ON e.vec_id = t.passage_id LEFT JOIN h ON h.id = t.passage_id LEFT JOIN documents d ON d.doc_id = t.passage_id""")
def hybrid_padded(spark, d):
    """The fused 120, padded; passages with odd numbers have no vector and are encoded."""
    encode = lambda lack: dense.encode_hashed(lack, "passage_id", T.terms(F.col("text")))
    out = fusion.hybrid_topk(*R._lists(spark, d), passages(spark, d), 120, index=index(spark, d).filter("passage_id % 2 = 0"), encode=encode, dim=64, pad=questions(spark, d))
    return out.select("qid", "rank", "passage_id", (F.round(F.get("embedding", F.lit(0)).cast("double"), 4) + 0.0).alias("first"), "title")


@query(f"{R._EPOCHS}, b AS (SELECT max(f1) AS best FROM e) SELECT round(best, 6) AS best_f1_score, min(epoch) AS epoch FROM e, b WHERE f1 = best GROUP BY 1")
def best_score_file(spark, d):
    path = readers.scratch(spark, "best")
    sinks.best_score_json(R._epochs(spark, d), path)
    return spark.read.schema("best_f1_score double, epoch bigint").json(path).withColumn("best_f1_score", F.round("best_f1_score", 6))


@query(f"{R._EPOCHS}, m AS (SELECT *, max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e), l AS (SELECT *, max(CASE WHEN p IS NULL OR f1 > p THEN epoch END) OVER (ORDER BY epoch) AS last FROM m) SELECT epoch, round(f1, 6) AS f1 FROM l WHERE epoch <= coalesce((SELECT min(epoch) FROM l WHERE epoch - last >= 2), 1000000000)")
def early_stop(spark, d):
    return metrics.early_stop(R._epochs(spark, d), "f1").select("epoch", F.round("f1", 6).alias("f1"))


@query(f"{R._EPOCHS} SELECT epoch, round(f1, 6) AS f1 FROM e")
def tracked_metrics(spark, d):
    path = readers.scratch(spark, "metrics")
    sinks.metrics_json(R._epochs(spark, d).select("epoch", F.round("f1", 6).alias("f1")), path)
    return spark.read.schema("epoch bigint, f1 double").json(path)


@query("SELECT turn AS epoch, round(avg(CASE WHEN conv_id % 7 <> 0 THEN length(text) END), 6) AS loss, count(CASE WHEN conv_id % 7 <> 0 THEN 1 END) AS n_steps FROM conversations GROUP BY 1")
def epoch_mean_loss(spark, d):
    bad = F.when(F.col("conv_id") % 14 == 0, float("nan")).when(F.col("conv_id") % 7 == 0, float("inf"))
    steps = table(spark, d, "conversations").select(F.col("turn").alias("epoch"), F.coalesce(bad, F.char_length("text").cast("double")).alias("loss"))
    return metrics.epoch_means(steps).withColumn("loss", F.round("loss", 6))


@query(rf"SELECT conv_id, count(*) AS n_texts, md5(string_agg(text, '|' ORDER BY turn)) AS texts, sum(len({R._TOKENS.format('text')}))::BIGINT AS n_tokens FROM conversations GROUP BY 1")
def collated_batches(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", T.tokens(F.col("text")).alias("tokens"))
    return resample.collated(rows, "conv_id", "turn", "text", "tokens").select("conv_id", F.size("text").cast("bigint").alias("n_texts"), F.md5(F.array_join("text", "|")).alias("texts"), F.size("tokens").cast("bigint").alias("n_tokens"))


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_id % 10 <> 0")
def decoded_payloads(spark, d):
    e = table(spark, d, "events")
    payload = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_type", "value")))
    out = sparse.decoded_payloads(e.select("event_id", payload.alias("payload")), "payload", "event_type string, value double")
    return out.withColumn("value", F.round("value", 6))


@query(f"{R._dense(10)}, p AS (SELECT qid, d.text, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS r FROM top JOIN documents d ON d.doc_id = passage_id) SELECT qid, md5(text) AS text FROM p WHERE r = 1")
def best_of_pool(spark, d):
    pool = dense.dense_topk(vector_queries(spark, d), index(spark, d), 10).withColumnRenamed("rank", "pos").join(passages(spark, d).select("passage_id", "text"), "passage_id")
    return dense.best_of_pool(pool).withColumn("text", F.md5("text"))


@query(f"{R._GOLD} SELECT count(*) / count(*)::DOUBLE AS recall FROM g WHERE pick = 1")
def candidate_recall(spark, d):
    return metrics.candidate_recall(R._ranks(spark, d), F.lit(1))


@query("SELECT (SELECT count(*) FROM benchmark) = (SELECT count(*) FROM documents) AS unlike, true AS alike")
def checked_lengths(spark, d):
    q, p = questions(spark, d), passages(spark, d)
    return spark.createDataFrame([(metrics.checked_lengths(q, p), metrics.checked_lengths(q, q))], "unlike boolean, alike boolean")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) - 1 AS pos FROM documents")
def shuffled_rows(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", F.md5(F.concat_ws(":", F.lit("1"), F.col("doc_id").cast("string"))).alias("k"))
    return resample.positions(resample.shuffled(keyed, "doc_id"), "k", "doc_id").select("doc_id", "pos")


@query("SELECT event_id, (event_id % 3 = 0) AS fine, round(CASE WHEN s < 10 THEN s / 10.0 ELSE greatest(0.0, (100 - s) / 90.0) END, 6) AS linear, round(CASE WHEN s < 10 THEN s / 10.0 ELSE 0.5 * (1 + cos(pi() * (s - 10) / 90.0)) END, 6) AS cosine FROM (SELECT event_id, event_id % 101 AS s FROM events)")
def schedules_and_guards(spark, d):
    i, s = F.col("event_id"), F.col("event_id") % 101
    value = F.when(i % 3 == 1, float("nan")).when(i % 3 == 2, float("-inf")).otherwise(1.0)
    return table(spark, d, "events").select("event_id", V.finite(value).alias("fine"), F.round(V.warmup_linear(s, 100), 6).alias("linear"), F.round(V.warmup_cosine(s, 100), 6).alias("cosine"))


@query(f"{R._PAIRS} SELECT conv_id, turn, md5(reference || ' ' || prediction) AS prompt FROM pr")
def training_prompts(spark, d):
    rows = R.qa_pairs(spark, d)
    return rows.select("conv_id", "turn", F.md5(T.training_prompt(T.with_prefix(F.col("reference"), "query", always=True), T.with_prefix(F.col("prediction"), "passage", always=True))).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND text <> '' THEN text ELSE coalesce(source, '') END AS text, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 END AS place FROM documents")
def context_fields(spark, d):
    i = F.col("doc_id")
    ctx = F.struct(F.when(i % 2 == 0, F.col("text")).otherwise("").alias("text"), F.col("source").alias("context"))
    place = T.index_of(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>"), i % 4)
    return table(spark, d, "documents").select("doc_id", T.context_text(ctx).alias("text"), place.cast("bigint").alias("place"))


@query(f"{R._PAIRS}, {R._f1(True)}, o AS (SELECT em, f1, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM sc) SELECT pos, em, round(f1, 6) AS f1 FROM o")
def zipped_scores(spark, d):
    rows = resample.positions(R.qa_pairs(spark, d), "conv_id", "turn")
    both = metrics.zipped(rows.select("pos", "prediction"), rows.select("pos", "reference"))
    return metrics.answer_scores(both).select("pos", "em", F.round("f1", 6).alias("f1"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 4) AS value FROM events GROUP BY 1")
def last_of_key(spark, d):
    return readers.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").withColumn("value", F.round("value", 4))


@query(f"WITH t AS (SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS w, unnest({R._TERMS.replace('text', 'event_type')}) AS term FROM events) SELECT epoch(w)::BIGINT AS start, term, count(*) AS n FROM t GROUP BY 1, 2")
def windowed_terms(spark, d):
    """The streaming aggregate, run over a stream of the table's files into a table."""
    path, ck = readers.scratch(spark, "windows"), readers.scratch(spark, "progress")
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    counts = ingest.term_counts(stream, "event_type", "ts").select(F.col("window.start").alias("start"), "term", "n")
    ingest.upsert(counts, path, ck, "start", "term").awaitTermination()
    return ingest.upserted(spark, path).select(F.unix_timestamp("start").alias("start"), "term", "n")
