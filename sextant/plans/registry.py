"""Name to query and to SQL, for the driver.

Passages are ``documents`` (title: source), questions are ``benchmark``, vectors are ``embeddings``
(vec_id paired with doc_id), question and answer pairs are neighbouring ``conversations`` turns. Dense
searches take as queries every vector whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions import vector as V
from sextant.operators import answer, dense, fusion, metrics, resample, sparse, trainset

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K1S, BS = [0.8, 1.0, 1.2, 1.5, 1.8], [0.0, 0.25, 0.5, 0.75, 1.0]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from sextant.plans import files  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from sextant.plans import files  # noqa: F401

    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text", F.col("source").alias("title"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding")


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every question with the vector of its number: a synthetic pairing."""
    return questions(spark, d).join(index(spark, d), F.col("qid") == F.col("passage_id")).select("qid", "embedding")


def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, question (a user turn), reference (the same turn) and prediction (the turn after it)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("next"), F.lead("role").over(w).alias("next_role"))
    return turns.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reference"), F.col("next").alias("prediction"))


_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_TOKENS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '\s+'), lambda t: t <> '')"
_NORM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"
_TF = f"tf AS (SELECT term, doc_id AS passage_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY 1, 2)"
_DL = f"dl AS (SELECT doc_id AS passage_id, len({_TERMS}) AS dl FROM documents), cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"
_MATCH = f"""WITH {_TF}, {_DL}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
m AS (SELECT q.qid, tf.passage_id, tf.tf, q.qtf, df.df, dl.dl, cs.n, cs.avgdl FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term JOIN dl ON dl.passage_id = tf.passage_id CROSS JOIN cs)"""


def _bm25(k1: str = "1.0", b: str = "0.25") -> str:
    return f"ln(1 + (n - df + 0.5) / (df + 0.5)) * (2.0 * qtf / (1.0 + qtf)) * (({k1} + 1) * tf / ({k1} * ((1 - {b}) + {b} * dl / avgdl) + tf))"


def _ranked(k: int, name: str = "s", by: str = "qid") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, passage_id) AS rank FROM {name}) WHERE rank <= {k}"


_BM25 = f"{_MATCH}, s AS (SELECT qid, passage_id, round(sum({_bm25()}), 6) AS score FROM m GROUP BY 1, 2)"
_DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def _dense(k: int, queries_: str = "SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0", skip_self: bool = False) -> str:
    where = " WHERE a.qid <> b.vec_id" if skip_self else ""
    return f"WITH vq AS ({queries_}), s AS (SELECT a.qid, b.vec_id AS passage_id, {_DOT} AS score FROM vq a CROSS JOIN embeddings b{where}), top AS ({_ranked(k)})"


_QVEC = "SELECT item_id AS qid, embedding FROM benchmark JOIN embeddings ON item_id = vec_id"


@query(r"SELECT doc_id AS passage_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, source AS title FROM documents WHERE length(regexp_replace(text, '\s+', '', 'g')) > 0")
def passages_clean(spark, d):
    p = passages(spark, d)
    return p.filter(T.nonblank(F.col("text")) & T.safe_id(F.col("passage_id").cast("string")).isNotNull()).select("passage_id", T.stripped(F.col("text")).alias("text"), "title")


@query("SELECT doc_id AS passage_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk FROM documents")
def passage_chunks(spark, d):
    return resample.batches(passages(spark, d).select("passage_id"), "passage_id", 100)


@query("SELECT doc_id AS passage_id, 'passage: ' || text AS text FROM documents")
def prefix_passages(spark, d):
    return passages(spark, d).select("passage_id", T.with_prefix(F.col("text"), "passage", always=True).alias("text"))


@query("SELECT item_id AS qid, 'query: ' || text AS e5, text AS other, text AS bare FROM benchmark")
def prefix_queries(spark, d):
    c = F.col("question")
    return questions(spark, d).select("qid", T.with_prefix(c, "query", "intfloat/e5-large-v2").alias("e5"), T.with_prefix(c, "query", "question_encoder").alias("other"), T.without_prefix(T.with_prefix(c, "query", always=True), "query").alias("bare"))


@query(f"WITH {_TF} SELECT * FROM tf")
def tokenize_tf(spark, d):
    return sparse.postings(passages(spark, d))


@query(f"WITH {_DL} SELECT passage_id, dl FROM dl")
def doc_stats(spark, d):
    return sparse.doc_stats(passages(spark, d))


@query(f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY 1")
def term_df(spark, d):
    return sparse.term_stats(sparse.postings(passages(spark, d)))


@query(f"WITH t AS (SELECT doc_id, unnest({_TERMS.replace('text', 'source')}) AS t FROM documents) SELECT 'S' || t AS term, doc_id AS passage_id, count(*) AS tf FROM t GROUP BY 1, 2")
def title_terms(spark, d):
    return sparse.title_postings(passages(spark, d))


@query(f"{_BM25} {_ranked(10)}")
def bm25_topk(spark, d):
    return sparse.sparse_topk(questions(spark, d), passages(spark, d), 10)


@query(f"{_MATCH}, s AS (SELECT qid, passage_id, round(sum(tf * qtf * ln(n / df)), 6) AS score FROM m GROUP BY 1, 2) {_ranked(10)}")
def tfidf_topk(spark, d):
    return sparse.sparse_topk(questions(spark, d), passages(spark, d), 10, scheme="tfidf")


@query(f"{_BM25}, top AS ({_ranked(10)}) SELECT qid, passage_id, score, rank, floor(round(100 * score / max(score) OVER (PARTITION BY qid), 6)) / 100 AS percent_score FROM top")
def bm25_percent(spark, d):
    return sparse.percent(sparse.sparse_topk(questions(spark, d), passages(spark, d), 10))


_GRID = f"""{_MATCH}, p AS (SELECT k1, b FROM (SELECT unnest([0.8, 1.0, 1.2, 1.5, 1.8])::DOUBLE AS k1), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS b)),
s AS (SELECT k1, b, qid, passage_id, round(sum({_bm25('k1', 'b')}), 6) AS score FROM m CROSS JOIN p GROUP BY ALL), top AS ({_ranked(50, by='k1, b, qid')}),
f AS (SELECT k1, b, qid, min(rank) AS first FROM top JOIN benchmark ON item_id = qid JOIN documents d ON d.doc_id = passage_id WHERE contains(lower(d.text), lower(benchmark.text)) GROUP BY ALL),
e AS (SELECT g.k1, g.b, qid, first FROM (SELECT DISTINCT k1, b FROM top) g CROSS JOIN (SELECT item_id AS qid FROM benchmark) LEFT JOIN f USING (k1, b, qid))
SELECT k1, b, {', '.join(f'avg((coalesce(first, 1000000) <= {k})::INT) AS recall_{k}' for k in (1, 5, 10, 50))} FROM e GROUP BY ALL"""


@query(_GRID)
def bm25_grid_recall(spark, d):
    hits = sparse.grid(questions(spark, d), passages(spark, d), K1S, BS, 50)
    gold = questions(spark, d).select("qid", F.array("question").alias("answers"))
    return metrics.recall_at(hits, gold, passages(spark, d), [1, 5, 10, 50], sparse.grid_params(spark, K1S, BS))


@query(f"{_BM25}, top AS ({_ranked(50)}) SELECT qid, rank, passage_id AS id, d.source AS title, length(d.text) AS n_chars, score AS sparse_score FROM top JOIN documents d ON d.doc_id = passage_id")
def sparse_results_nested(spark, d):
    q, p = questions(spark, d), passages(spark, d)
    nested = sparse.sparse_results(sparse.sparse_topk(q, p, 50), q, p)
    return nested.select("qid", F.posexplode("sparse_retrieved_docs").alias("_p", "x")).select("qid", (F.col("_p") + 1).cast("bigint").alias("rank"), "x.id", "x.title", F.char_length("x.text").cast("bigint").alias("n_chars"), "x.sparse_score")


@query(f"{_BM25}, top AS ({_ranked(5)}), n AS (SELECT qid, count(*) AS c FROM top GROUP BY 1) SELECT item_id AS qid, coalesce(c, 0) AS n_docs FROM benchmark LEFT JOIN n ON qid = item_id")
def sparse_lookup_join(spark, d):
    hits = sparse.sparse_topk(questions(spark, d), passages(spark, d), 5)
    return sparse.sparse_results(hits, questions(spark, d), passages(spark, d)).select("qid", F.size("sparse_retrieved_docs").cast("bigint").alias("n_docs"))


@query("SELECT vec_id, round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0 AS x, i FROM (SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def l2_normalize(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", (F.round("x", 6) + 0.0).alias("x"), (F.col("i") + 1).cast("bigint").alias("i"))


@query("SELECT label, i, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0 AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, (vec_id % 3 <> 0)::INT AS m FROM embeddings) GROUP BY 1, 2")
def mean_pool(spark, d):
    pooled = V.mean_pool(table(spark, d, "embeddings"), "label", "embedding", (F.col("vec_id") % 3 != 0).cast("int"))
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).cast("bigint").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@query(f"{_dense(10)} SELECT * FROM top")
def dense_topk_exact(spark, d):
    return dense.dense_topk(vector_queries(spark, d), index(spark, d), 10)


@query(f"{_dense(10, skip_self=True)} SELECT qid, passage_id, score, rank, d.source AS title FROM top JOIN documents d ON d.doc_id = passage_id WHERE length(trim(d.text)) > 0")
def dense_topk_nonblank(spark, d):
    return dense.with_passages(dense.dense_topk(vector_queries(spark, d), index(spark, d), 10, skip_self=True), passages(spark, d)).drop("text")


@query(f"{_dense(10)}, g AS (SELECT qid, unnest(range(1, 16)) AS rank FROM vq) SELECT g.qid, g.rank, coalesce(passage_id, -1) AS passage_id, coalesce(score, 0.0) AS score FROM g LEFT JOIN top ON top.qid = g.qid AND top.rank = g.rank")
def dense_topk_padded(spark, d):
    q = vector_queries(spark, d)
    return dense.padded_slots(dense.dense_topk(q, index(spark, d), 10), q, 15)


# Which rows approximate search finds is not for SQL to say; that it finds nine tenths of the exact ones is.
@query(f"{_dense(10)} SELECT count(DISTINCT qid) AS n_queries, count(*) AS n_exact, true AS enough FROM top")
def dense_topk_ivf(spark, d):
    exact = dense.dense_topk(vector_queries(spark, d), index(spark, d), 10).select("qid", "passage_id")
    near = dense.dense_topk_cells(vector_queries(spark, d), index(spark, d), 10).select("qid", "passage_id", F.lit(1).alias("hit"))
    both = exact.join(near, ["qid", "passage_id"], "left")
    return both.agg(F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_exact"), (F.sum("hit") >= 0.9 * F.count("*")).alias("enough"))


_RRF = f"""{_BM25}, sp AS ({_ranked(50)}), vq AS ({_QVEC}),
ds AS (SELECT a.qid, b.vec_id AS passage_id, {_DOT} AS score FROM vq a CROSS JOIN embeddings b WHERE a.qid <> b.vec_id), de AS ({_ranked(50, 'ds')}),
u AS (SELECT qid, passage_id, rank, 0 AS l FROM de UNION ALL SELECT qid, passage_id, rank, 1 FROM sp),
f AS (SELECT qid, passage_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(CASE WHEN l = 0 THEN rank END) AS dr, min(CASE WHEN l = 1 THEN rank END) AS sr FROM u GROUP BY 1, 2),
r AS (SELECT qid, passage_id, rrf, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST, passage_id) AS rank FROM f)"""


def _lists(spark, d):
    return dense.dense_topk(question_vectors(spark, d), index(spark, d), 50, skip_self=True), sparse.sparse_topk(questions(spark, d), passages(spark, d), 50)


@query(f"{_RRF} SELECT * FROM r")
def rrf_fuse(spark, d):
    return fusion.rrf(*_lists(spark, d))


@query(f"{_RRF} SELECT r.qid, r.passage_id, r.rrf, r.rank, coalesce(d.source, '') AS title, length(coalesce(d.text, '')) AS n_chars FROM r LEFT JOIN documents d ON d.doc_id = r.passage_id WHERE r.rank <= 10")
def hybrid_topk(spark, d):
    out = fusion.hybrid_topk(*_lists(spark, d), passages(spark, d), 10)
    return out.select("qid", "passage_id", "rrf", "rank", "title", F.char_length("text").cast("bigint").alias("n_chars"))


@query(f"""WITH l AS (SELECT item_id AS qid, unnest([7, 3, 9, 7, -1, 4])::BIGINT AS p, unnest(range(1, 7)) AS rank, 0 AS l FROM benchmark UNION ALL SELECT item_id, unnest([3, 5, 7])::BIGINT, unnest(range(1, 4)), 1 FROM benchmark),
f AS (SELECT qid, p AS passage_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(CASE WHEN l = 0 THEN rank END) AS dr, min(CASE WHEN l = 1 THEN rank END) AS sr FROM l WHERE p <> -1 GROUP BY 1, 2)
SELECT qid, passage_id, rrf, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST, passage_id) AS rank FROM f""")
def rrf_with_duplicates(spark, d):
    made = lambda ids: questions(spark, d).select("qid", F.posexplode(F.array(*(F.lit(i).cast("bigint") for i in ids))).alias("_p", "passage_id")).select("qid", "passage_id", (F.col("_p") + 1).alias("rank"))
    return fusion.rrf(made([7, 3, 9, 7, -1, 4]), made([3, 5, 7]))


_SOFT = f"{_dense(10)}, g AS (SELECT qid, unnest(range(1, 13)) AS rank FROM vq), x AS (SELECT g.qid, g.rank, coalesce(passage_id, -1) AS passage_id, coalesce(score, 0.0) AS score FROM g LEFT JOIN top ON top.qid = g.qid AND top.rank = g.rank)"
_LOGP = "round(score - max(score) OVER w - ln(sum(exp(score - mx)) OVER w), 6) AS logp FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM x{}) WINDOW w AS (PARTITION BY qid)"


def _slots(spark, d):
    q = vector_queries(spark, d)
    return dense.padded_slots(dense.dense_topk(q, index(spark, d), 10), q, 12)


@query(f"{_SOFT} SELECT qid, rank, passage_id, {_LOGP.format('')}")
def doc_log_softmax(spark, d):
    return answer.doc_log_prob(_slots(spark, d), mask_padding=False).select("qid", "rank", "passage_id", F.round("logp", 6).alias("logp"))


@query(f"{_SOFT} SELECT qid, rank, passage_id, {_LOGP.format(' WHERE passage_id <> -1')}")
def padding_masked_softmax(spark, d):
    return answer.doc_log_prob(_slots(spark, d)).select("qid", "rank", "passage_id", F.round("logp", 6).alias("logp"))


@query(f"{_dense(10)} SELECT qid, round(max(score) + ln(sum(exp(score - mx))), 6) AS lse FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM top) GROUP BY qid")
def logsumexp(spark, d):
    return V.log_sum_exp(dense.dense_topk(vector_queries(spark, d), index(spark, d), 10), "qid", F.col("score")).select("qid", F.round("lse", 6).alias("lse"))


# Log-probabilities of target tokens stand in for a generator's: token j of a document's sequence has -(1 + (id + j) mod 7) / 4.
@query(f"""{_dense(10)}, x AS (SELECT * FROM top), p AS (SELECT qid, passage_id, score - mx - ln(sum(exp(score - mx)) OVER (PARTITION BY qid)) AS logp FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM x)),
n AS (SELECT qid, passage_id, logp, sum(CASE WHEN j < 6 THEN (1 + (passage_id + j) % 7) / 4.0 END) AS nll FROM p, range(8) t(j) GROUP BY ALL),
v AS (SELECT qid, logp - nll AS v, max(logp - nll) OVER (PARTITION BY qid) AS m FROM n), l AS (SELECT qid, max(m) + ln(sum(exp(v - m))) AS lse FROM v GROUP BY qid)
SELECT round(-avg(lse), 6) AS nll FROM l""")
def rag_marginal_nll(spark, d):
    hits = answer.doc_log_prob(dense.dense_topk(vector_queries(spark, d), index(spark, d), 10))
    tokens = hits.select("qid", "passage_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).select("qid", "passage_id", F.when(F.col("j") < 6, F.col("j")).otherwise(-100).alias("label"), (-(1 + (F.col("passage_id") + F.col("j")) % 7) / 4.0).alias("logp"))
    rows = hits.select("qid", "passage_id", "logp").join(answer.sequence_nll(tokens, ["qid", "passage_id"]), ["qid", "passage_id"])
    return answer.marginal_nll(rows).select(F.round("nll", 6).alias("nll"))


@query(f"{_BM25}, top AS ({_ranked(5)}) SELECT qid, rank, md5(b.text || ' [SEP_TITLE] ' || d.source || ' [SEP_TEXT] ' || d.text) AS prompt FROM top JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = passage_id")
def prompt_assembly(spark, d):
    hits = sparse.sparse_topk(questions(spark, d), passages(spark, d), 5)
    rows = hits.join(questions(spark, d), "qid").join(passages(spark, d), "passage_id")
    return rows.select("qid", "rank", F.md5(T.retrieval_prompt(F.col("question"), F.col("title"), F.col("text"))).alias("prompt"))


@query("SELECT doc_id AS passage_id, text[1:150] || '...' AS dense, CASE WHEN coalesce(text, '') <> '' THEN text[1:100] || '...' ELSE 'N/A' END AS sparse FROM documents")
def snippets(spark, d):
    return passages(spark, d).select("passage_id", T.snippet(F.col("text")).alias("dense"), T.snippet(F.col("text"), 100, "N/A").alias("sparse"))


@query(f"{_BM25}, top AS ({_ranked(5)}) SELECT qid, string_agg(d.source, ' | ' ORDER BY rank) AS titles FROM top JOIN documents d ON d.doc_id = passage_id WHERE d.source <> '' GROUP BY qid")
def title_list(spark, d):
    hits = sparse.sparse_topk(questions(spark, d), passages(spark, d), 5).join(passages(spark, d).select("passage_id", "title"), "passage_id").filter("title <> ''")
    return hits.groupBy("qid").agg(T.joined_titles(F.collect_list(F.struct("rank", "title"))).alias("titles"))


_PAD = f"WITH t AS (SELECT item_id AS qid, list_transform({_TOKENS.format('text')}, lambda x: length(x)) AS l FROM benchmark), p AS (SELECT qid, l[1:64] || list_transform(range(greatest(0, 64 - len(l))), lambda x: 0) AS ids FROM t)"


@query(f"{_PAD} SELECT qid, len(ids) AS n, list_sum(ids)::BIGINT AS total, list_sum(list_transform(ids, lambda x: (x <> 0)::INT))::BIGINT AS attended, list_sum(list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END))::BIGINT AS labels FROM p")
def pad_truncate_mask(spark, d):
    lengths = F.transform(T.tokens(F.col("question")), lambda x: F.char_length(x))
    zero, total = F.lit(0), lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = questions(spark, d).select("qid", T.padded(lengths, 64, zero).alias("ids"))
    return rows.select("qid", F.size("ids").cast("bigint").alias("n"), total(F.col("ids")).alias("total"), total(T.attention_mask(F.col("ids"), zero)).alias("attended"), total(T.masked_labels(F.col("ids"), zero)).alias("labels"))


# Candidates stand in for generated answers: the document's whole text, by its hash, scored by the id.
_CAND = "md5(d.text)"


def _candidates(hits: DataFrame, p: DataFrame) -> DataFrame:
    return hits.join(p.select("passage_id", F.md5("text").alias("answer")), "passage_id").withColumn("sequence_score", -(F.col("passage_id") % 11) / 10.0)


@query(f"""{_dense(10)}, x AS (SELECT * FROM top), p AS (SELECT qid, passage_id, rank, score - mx - ln(sum(exp(score - mx)) OVER (PARTITION BY qid)) AS logp FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM x)),
c AS (SELECT qid, rank, {_CAND} AS answer, round(logp - (passage_id % 11) / 10.0, 6) AS total FROM p JOIN documents d ON d.doc_id = passage_id)
SELECT qid, answer, total FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY total DESC, rank) AS r FROM c) WHERE r = 1""")
def answer_select_ragseq(spark, d):
    hits = answer.doc_log_prob(dense.dense_topk(vector_queries(spark, d), index(spark, d), 10))
    return answer.select_by_sequence(_candidates(hits, passages(spark, d)))


@query(f"""{_dense(10)}, x AS (SELECT * FROM top), p AS (SELECT qid, passage_id, rank, score - mx - ln(sum(exp(score - mx)) OVER (PARTITION BY qid)) AS logp FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM x)),
c AS (SELECT qid, {_CAND} AS answer, round(sum(exp(logp - (passage_id % 11) / 10.0)), 9) AS total, min(rank) AS rank FROM p JOIN documents d ON d.doc_id = passage_id GROUP BY 1, 2)
SELECT qid, answer, total FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY total DESC, rank) AS r FROM c) WHERE r = 1""")
def answer_select_marginal(spark, d):
    hits = answer.doc_log_prob(dense.dense_topk(vector_queries(spark, d), index(spark, d), 10))
    return answer.select_marginal(_candidates(hits, passages(spark, d)))


@query(f"{_BM25}, top AS ({_ranked(10)}) SELECT qid, {_CAND} AS answer FROM top JOIN documents d ON d.doc_id = passage_id WHERE rank = 1")
def answer_select_sparse(spark, d):
    return answer.select_by_retrieval(_candidates(sparse.sparse_topk(questions(spark, d), passages(spark, d), 10), passages(spark, d)))


@query(f"SELECT doc_id, {_NORM.format('text')} AS answer FROM documents")
def normalize_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("answer"))


_PAIRS = "WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS nx, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pr AS (SELECT conv_id, turn, text AS reference, nx AS prediction FROM t WHERE role = 'user' AND nr = 'assistant')"
_SAME = "list_sum(list_transform(list_intersect(list_distinct(p), list_distinct(g)), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t)))))"


def _f1(norm: bool) -> str:
    side = lambda c: _TOKENS.format(_NORM.format(c)) if norm else _TOKENS.format(c)
    empty = "1.0" if norm else "0.0"
    return f"tk AS (SELECT conv_id, turn, {side('prediction')} AS p, {side('reference')} AS g, ({_NORM.format('prediction')} = {_NORM.format('reference')})::INT::DOUBLE AS em FROM pr), sc AS (SELECT conv_id, turn, em, CASE WHEN len(p) = 0 AND len(g) = 0 THEN {empty} ELSE coalesce(2.0 * {_SAME} / (len(p) + len(g)), 0.0) END AS f1 FROM tk)"


def _scored(spark, d, normalize=True):
    rows = qa_pairs(spark, d).withColumn("golds", F.array("reference"))
    return metrics.answer_scores(rows, normalize).select("conv_id", "turn", "em", "f1")


@query(f"{_PAIRS}, {_f1(True)} SELECT conv_id, turn, em, round(f1, 6) AS f1 FROM sc")
def em_f1_pairs(spark, d):
    return _scored(spark, d).withColumn("f1", F.round("f1", 6))


@query(f"{_PAIRS}, {_f1(True)} SELECT round(coalesce(avg(em), 0) * 100, 6) AS exact_match, round(coalesce(avg(f1), 0) * 100, 6) AS f1 FROM sc")
def em_f1_corpus(spark, d):
    return metrics.corpus_scores(_scored(spark, d)).select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


@query(f"{_PAIRS}, {_f1(False)} SELECT conv_id, turn, round(f1, 6) AS f1 FROM sc")
def token_f1_raw(spark, d):
    return _scored(spark, d, normalize=False).select("conv_id", "turn", F.round("f1", 6).alias("f1"))


@query(f"""{_BM25}, top AS ({_ranked(50)}), f AS (SELECT qid, min(rank) AS first FROM top JOIN benchmark ON item_id = qid JOIN documents d ON d.doc_id = passage_id WHERE contains(lower(d.text), lower(benchmark.text)) GROUP BY 1)
SELECT {', '.join(f'avg((coalesce(first, 1000000) <= {k})::INT) AS recall_{k}' for k in (1, 5, 10, 50))} FROM benchmark LEFT JOIN f ON qid = item_id""")
def recall_at_k(spark, d):
    q = questions(spark, d)
    return metrics.recall_at(sparse.sparse_topk(q, passages(spark, d), 50), q.select("qid", F.array("question").alias("answers")), passages(spark, d), [1, 5, 10, 50])


# A query's candidates: its 20 nearest vectors; the gold is the one with the largest id among those of its label, else of all.
_GOLD = f"""{_dense(20, skip_self=True)}, c AS (SELECT top.*, (b.label = a.label)::INT AS same FROM top JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = passage_id),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY same DESC, passage_id DESC) AS pick, row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage_id DESC) AS rk FROM c)"""


def _ranks(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = dense.dense_topk(vector_queries(spark, d), index(spark, d), 20, skip_self=True).drop("rank")
    own = hits.join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("_a")), "qid").join(labels.select(F.col("vec_id").alias("passage_id"), F.col("label").alias("_b")), "passage_id")
    w = Window.partitionBy("qid").orderBy(F.desc((F.col("_a") == F.col("_b")).cast("int")), F.desc("passage_id"))
    return metrics.gold_rank(own.select("qid", F.col("passage_id").alias("candidate_id"), "score", (F.row_number().over(w) == 1).alias("is_gold")))


@query(f"{_GOLD} SELECT qid, rk AS rank, round(1.0 / rk, 6) AS rr FROM g WHERE pick = 1")
def reciprocal_rank(spark, d):
    return _ranks(spark, d).withColumn("rr", F.round("rr", 6))


@query(f"{_GOLD} SELECT round(avg(1.0 / rk), 6) AS mrr FROM g WHERE pick = 1")
def mrr(spark, d):
    return metrics.mrr(_ranks(spark, d)).select(F.round("mrr", 6).alias("mrr"))


@query(f"{_GOLD} SELECT {', '.join(f'avg((rk <= {k})::INT) AS recall_{k}' for k in (5, 10, 20, 100))} FROM g WHERE pick = 1")
def recall_from_rr(spark, d):
    return metrics.mrr(_ranks(spark, d)).drop("mrr")


_BOOT = f"""{_PAIRS}, {_f1(True)}, po AS (SELECT f1, em, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM sc), al AS (SELECT 'plain' AS pipeline, pos, f1, em FROM po UNION ALL SELECT 'half', pos, f1 / 2, em FROM po),
nn AS (SELECT count(*) AS n FROM po), dr AS (SELECT pipeline, it AS iteration, ('0x' || substr(md5('1:' || it || ':' || pos), 1, 8))::BIGINT % n AS pos FROM al, nn, range(1, 11) t(it)),
bo AS (SELECT dr.pipeline, dr.iteration, avg(f1) AS f1, avg(em) AS em FROM dr JOIN al ON al.pipeline = dr.pipeline AND al.pos = dr.pos GROUP BY 1, 2)"""


def _boot(spark, d):
    scored = _scored(spark, d)
    place = resample.positions(scored, "conv_id", "turn").select("f1", "em", "pos")
    both = place.withColumn("pipeline", F.lit("plain")).unionByName(place.withColumn("f1", F.col("f1") / 2).withColumn("pipeline", F.lit("half")))
    return resample.bootstrap(both)


@query(f"{_BOOT} SELECT pipeline, iteration, round(f1, 6) AS f1, round(em, 6) AS em FROM bo")
def bootstrap_iterations(spark, d):
    return _boot(spark, d).select("pipeline", "iteration", F.round("f1", 6).alias("f1"), F.round("em", 6).alias("em"))


@query(f"{_BOOT} SELECT pipeline, round(avg(f1), 6) AS mean, round(median(f1), 6) AS median, round(stddev_pop(f1), 6) AS std, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM bo GROUP BY 1")
def bootstrap_summary(spark, d):
    s = resample.summary(_boot(spark, d), "pipeline", "f1")
    return s.select("pipeline", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std", "low", "high")))


@query(f"{_dense(50)} SELECT CASE WHEN score < -1 THEN 0 WHEN score >= 1 THEN 21 ELSE floor((score + 1) / 0.1)::BIGINT + 1 END AS bucket, count(*) AS n FROM (SELECT round(score, 3) + 0.0005 AS score FROM top) GROUP BY 1")
def score_histogram(spark, d):
    hits = dense.dense_topk(vector_queries(spark, d), index(spark, d), 50).select((F.round("score", 3) + 0.0005).alias("score"))
    return resample.histogram(hits, "score", -1, 1, 20)


@query("SELECT doc_id FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 500")
def sample_without_replacement(spark, d):
    return resample.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 500)


def _examples(spark, d):
    """Questions with contexts out of the BM25 list: rank 1 and 4 as positives, 1, 2, 2, 3 and 5 as hard negatives."""
    hits = sparse.sparse_topk(questions(spark, d), passages(spark, d), 5)
    ctx = F.struct(F.col("passage_id").cast("string").alias("passage_id"), F.col("passage_id").cast("string").alias("id"), F.col("text"), F.col("score"))
    per = hits.join(passages(spark, d).select("passage_id", "text"), "passage_id").groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("rank", ctx.alias("c")))).alias("m"))
    of = lambda *r: F.filter(F.array(*(F.try_element_at("m", F.lit(i)) for i in r)), lambda c: c.isNotNull())
    return per.join(questions(spark, d), "qid").select("qid", "question", F.array("question").alias("answers"), of(1, 4).alias("positive_ctxs"), of(1, 2, 2, 3, 5).alias("hard_negative_ctxs"), of(2, 3, 5).alias("negative_ctxs"))


_H = f"{_BM25}, top AS ({_ranked(5)}), c AS (SELECT qid, max(CASE WHEN rank = 1 THEN passage_id END) AS p1, max(CASE WHEN rank = 2 THEN passage_id END) AS p2, max(CASE WHEN rank = 3 THEN passage_id END) AS p3, max(CASE WHEN rank = 4 THEN passage_id END) AS p4, max(CASE WHEN rank = 5 THEN passage_id END) AS p5 FROM top GROUP BY 1)"


@query(f"{_H} SELECT 'query: ' || b.text AS query, md5('passage: ' || a.text) AS positive, md5(concat_ws('|', 'passage: ' || x.text, 'passage: ' || y.text, 'passage: ' || z.text)) AS negatives, b.text AS answer FROM c JOIN benchmark b ON item_id = qid JOIN documents a ON a.doc_id = p1 LEFT JOIN documents x ON x.doc_id = p2 LEFT JOIN documents y ON y.doc_id = p3 LEFT JOIN documents z ON z.doc_id = p4")
def train_triples(spark, d):
    return trainset.triples(_examples(spark, d)).withColumn("negatives", F.md5(F.array_join("negatives", "|"))).withColumn("positive", F.md5("positive"))


@query(f"{_H}, u AS (SELECT qid, unnest([p1, p2, p3, p5]) AS candidate_id, unnest([true, false, false, false]) AS is_gold FROM c) SELECT u.*, md5(d.text) AS text FROM u JOIN documents d ON d.doc_id = candidate_id")
def mrr_candidates(spark, d):
    return trainset.ranking_candidates(_examples(spark, d)).select("qid", F.col("candidate_id").cast("bigint").alias("candidate_id"), "is_gold", F.md5("text").alias("text"))


@query("WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS nx, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT 'question: ' || text || '  context: ' || nx AS prompt, nx AS target FROM t WHERE role = 'user' AND nr = 'assistant'")
def gold_context_samples(spark, d):
    rows = qa_pairs(spark, d).select(F.col("reference").alias("question"), F.col("prediction").alias("context"), F.array("prediction").alias("short_answers"))
    return trainset.gold_context_samples(rows)


# Batches of the vectors in order of id: eight rows, each against all eight.
@query("""WITH e AS (SELECT vec_id, vec_id // 8 AS batch, vec_id % 8 AS i, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.batch, a.i, b.i AS j, round(list_dot_product(a.v, b.v), 6) / 0.05 AS x FROM e a JOIN e b ON a.batch = b.batch),
m AS (SELECT *, max(x) OVER (PARTITION BY batch, i) AS mx, row_number() OVER (PARTITION BY batch, i ORDER BY j) - 1 AS o FROM s), l AS (SELECT batch, i, max(mx) + ln(sum(exp(x - mx))) - max(CASE WHEN j = i THEN x END) AS l FROM m GROUP BY 1, 2)
SELECT batch, round(avg(l), 6) AS loss FROM l GROUP BY 1""")
def contrastive_loss(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), (F.col("vec_id") % 8).alias("i"), "embedding")
    other = e.select(F.col("batch").alias("_b"), F.col("i").alias("j"), F.col("embedding").alias("_v"))
    sims = e.join(other, F.col("batch") == F.col("_b")).groupBy("batch", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.round(V.dot(F.col("embedding"), F.col("_v")), 6).alias("x")))), lambda s: s["x"]).alias("sims"))
    return metrics.in_batch_contrastive(sims).select("batch", F.round("loss", 6).alias("loss"))


# A turn stands in for an epoch: its mean F1 is what training would have reached.
_EPOCHS = f"{_PAIRS}, {_f1(True)}, e AS (SELECT turn AS epoch, round(avg(f1), 9) AS f1 FROM sc GROUP BY 1)"


def _epochs(spark, d):
    return _scored(spark, d).groupBy(F.col("turn").alias("epoch")).agg(F.round(F.avg("f1"), 9).alias("f1"))


@query(f"{_EPOCHS}, w AS (SELECT *, max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e) SELECT epoch, round(f1, 6) AS f1, coalesce(f1 > p, true) AS improved, round(greatest(f1, p), 6) AS best_so_far FROM w")
def best_epoch(spark, d):
    return metrics.best_epoch(_epochs(spark, d)).select("epoch", F.round("f1", 6).alias("f1"), "improved", F.round("best_so_far", 6).alias("best_so_far"))


@query("SELECT doc_id, 'chunk:' || CASE WHEN length(text) > 239 THEN sha256(text) ELSE text END AS term FROM documents")
def term_key_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.term_key(F.col("text")).alias("term"))


@query(f"""{_dense(10)}, p AS (SELECT qid, d.text, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM top JOIN documents d ON d.doc_id = passage_id), r AS (SELECT qid, md5(string_agg(text, ' ' ORDER BY r)) AS context FROM p WHERE r <= 3 GROUP BY 1) SELECT * FROM r""")
def rerank_pool(spark, d):
    pool = dense.dense_topk(vector_queries(spark, d), index(spark, d), 10).withColumnRenamed("rank", "pos")
    return dense.rerank_pool(pool.join(passages(spark, d).select("passage_id", "text"), "passage_id"), 3).withColumn("context", F.md5("context"))


_CODE = r"""c AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS i, count(*) AS n FROM (SELECT {0} AS id, unnest({1}) AS t FROM {2}) GROUP BY 1, 2)"""


@query(f"WITH {_CODE.format('item_id', _TERMS, 'benchmark')} SELECT id AS qid, i, round((n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 5) AS x FROM c")
def encode_questions(spark, d):
    made = dense.encode_hashed(questions(spark, d), "qid", T.terms(F.col("question")))
    return made.select("qid", F.posexplode("embedding").alias("i", "x")).filter("x <> 0").select("qid", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))
