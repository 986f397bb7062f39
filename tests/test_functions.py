import math

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions import vector as V
from sextant.operators import answer, dense, fusion, metrics, resample, trainset


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in values.items()))
    return row.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("The  cat's, a-hat!", "cats ahat"), (None, ""), ("", ""), ("An theory of the", "theory of")])
def test_normalize_answer(spark, given, want):
    assert one(spark, T.normalize_answer(F.col("x")), x=given) == want


@pytest.mark.parametrize("p, g, norm, want", [("red dog", "the red cat", True, 0.5), ("red dog", "the red cat", False, 0.4), ("", "", True, 1.0), ("", "", False, 0.0), ("a a b", "a b b", False, 2 / 3)])
def test_token_f1(spark, p, g, norm, want):
    assert one(spark, T.token_f1(F.col("p"), F.col("g"), normalize=norm), p=p, g=g) == pytest.approx(want)


def test_em_means_f1_of_one(spark):
    rows = spark.createDataFrame([("The Cat!", ["dog", "cat"]), ("x", [])], "prediction string, golds array<string>")
    got = metrics.answer_scores(rows).collect()
    assert (got[0]["em"], got[0]["f1"]) == (1.0, 1.0) and (got[1]["em"], got[1]["f1"]) == (0.0, 0.0)


def test_term_key(spark):
    assert one(spark, T.term_key(F.col("x")), x="i" * 239) == "chunk:" + "i" * 239
    assert len(one(spark, T.term_key(F.col("x")), x="i" * 240)) == 6 + 64


def test_prefix_and_prompts(spark):
    assert one(spark, T.with_prefix(F.col("x"), "query", "e5-base"), x="q") == "query: q"
    assert one(spark, T.with_prefix(F.col("x"), "query", "question_encoder"), x="q") == "q"
    assert one(spark, T.gold_prompt(F.col("x"), F.col("y")), x="q", y="c") == "question: q  context: c"
    assert one(spark, T.retrieval_prompt(F.col("x"), F.col("y"), F.col("x")), x="q", y="t") == "q [SEP_TITLE] t [SEP_TEXT] q"
    assert one(spark, T.first_answer(F.col("x")), x=[]) == ""


def test_log_softmax_with_and_without_padding(spark):
    rows = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.2), (1, -1, 0.0)], "qid long, passage_id long, score double")
    free = {r["passage_id"]: r["logp"] for r in answer.doc_log_prob(rows, mask_padding=False).collect()}
    assert free[5] == pytest.approx(-0.6435130, abs=1e-6) and math.exp(free[-1]) == pytest.approx(0.2136293, abs=1e-6)
    masked = answer.doc_log_prob(rows).collect()
    assert sum(math.exp(r["logp"]) for r in masked) == pytest.approx(1) and len(masked) == 2


def test_marginal_nll(spark):
    rows = spark.createDataFrame([(1, -0.6435130, 2.0), (1, -1.3435130, 1.0), (1, -1.5435130, 6.0)], "qid long, logp double, nll double")
    assert answer.marginal_nll(rows).first()["nll"] == pytest.approx(1.7859938, abs=1e-6)
    picked = answer.select_by_sequence(rows.selectExpr("qid", "logp", "-nll AS sequence_score", "cast(nll AS string) AS answer", "1 AS rank")).first()
    assert picked["answer"] == "1.0" and picked["total"] == pytest.approx(-2.343513)


def lists(spark, *ids):
    return spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ids)], "qid long, passage_id long, rank int")


def test_rrf(spark):
    got = [(r["passage_id"], round(r["rrf"], 9)) for r in fusion.rrf(lists(spark, 7, 3, 9), lists(spark, 3, 5, 7)).orderBy("rank").collect()]
    assert got == [(3, 0.032522475), (7, 0.032266458), (5, 0.016129032), (9, 0.015873016)]
    assert [r["passage_id"] for r in fusion.rrf(lists(spark, 1), lists(spark, 2)).orderBy("rank").collect()] == [1, 2]
    skipped = fusion.rrf(lists(spark, -1, 4), lists(spark, 5)).filter("passage_id = 4").first()
    assert skipped["rrf"] == pytest.approx(1 / 62, abs=1e-9)


def test_summary(spark):
    rows = spark.createDataFrame([("p", float(i * i)) for i in range(1, 11)], "pipeline string, f1 double")
    s = resample.summary(rows, "pipeline", "f1").first()
    assert (s["low"], s["high"], s["std"]) == pytest.approx((1.675, 95.725, 32.4199013))


def test_bootstrap_reruns_agree(spark):
    rows = spark.createDataFrame([("p", i, i / 10, float(i % 2)) for i in range(10)], "pipeline string, pos long, f1 double, em double")
    a, b = (sorted(map(tuple, resample.bootstrap(rows).collect())) for _ in range(2))
    assert a == b and len(a) == 10


def test_triples(spark):
    c = lambda i, s=None: {"passage_id": None, "id": i, "title": None, "text": i, "score": s}
    rows = spark.createDataFrame([("q", ["x"], [c("p"), c("n", 9.0), c("o", 1.0)], [], [c("p"), c("a"), c("a"), c("b"), c("c")]), ("none", ["x"], [], [], [])], "question string, answers array<string>, positive_ctxs array<struct<passage_id:string,id:string,title:string,text:string,score:double>>, negative_ctxs array<struct<passage_id:string,id:string,title:string,text:string,score:double>>, hard_negative_ctxs array<struct<passage_id:string,id:string,title:string,text:string,score:double>>")
    got = trainset.triples(rows).collect()
    assert len(got) == 1 and [x.removeprefix("passage: ") for x in got[0]["negatives"]] == ["a", "b", "o", "n"]


def test_mrr_and_early_stop(spark):
    rows = spark.createDataFrame([(1, "g", 0.5, True), (1, "a", 0.9, False), (2, "g", 0.7, True), (2, "a", 0.7, False)], "qid long, candidate_id string, score double, is_gold boolean")
    got = metrics.mrr(metrics.gold_rank(rows)).first()
    assert got["mrr"] == 0.75 and got["recall_5"] == 1.0
    epochs = spark.createDataFrame([(1, 0.3), (2, 0.2), (3, 0.3), (4, 0.9)], "epoch int, mrr double")
    assert [r["epoch"] for r in metrics.early_stop(epochs).orderBy("epoch").collect()] == [1, 2, 3]


def test_recall_is_monotone(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "qid long, passage_id long, rank int")
    q = spark.createDataFrame([(1, ["Gold"]), (2, ["nothing"])], "qid long, answers array<string>")
    p = spark.createDataFrame([(10, "a"), (11, None), (12, "the gold one")], "passage_id long, text string")
    got = metrics.recall_at(hits, q, p, [1, 5]).first()
    assert (got["recall_1"], got["recall_5"]) == (0.0, 0.5)


def test_dense_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype("float32")
    index = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "passage_id long, embedding array<float>")
    q = index.filter("passage_id < 7").withColumnRenamed("passage_id", "qid")
    got = {(r["qid"], r["rank"]): r["passage_id"] for r in dense.dense_topk(q, index, 5, skip_self=True).collect()}
    s = np.round(x[:7].astype(float) @ x.astype(float).T, 6)
    for i in range(7):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert [got[i, k + 1] for k in range(5)] == order
    near = {(r["qid"], r["passage_id"]) for r in dense.dense_topk_cells(q, index, 5, n_cells=8, probes=6, skip_self=True).collect()}
    want = {(a, b) for (a, _), b in got.items()}
    assert len(near & want) / len(want) >= 0.9
    assert dense.dense_topk(q.limit(0), index, 5).count() == 0


def test_padding(spark):
    hits = spark.createDataFrame([(1, 7, 0.5, 1)], "qid long, passage_id long, score double, rank int")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    got = sorted((r["qid"], r["rank"], r["passage_id"]) for r in dense.padded_slots(hits, q, 2).collect())
    assert got == [(1, 1, 7), (1, 2, -1), (2, 1, -1), (2, 2, -1)]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k long, v array<float>")
    got = {r["k"]: r["u"] for r in rows.select("k", V.l2_normalize(F.col("v")).alias("u")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]
    steps = spark.range(0, 11).select(V.warmup_linear(F.col("id"), 10, 0.2).alias("x")).collect()
    assert [round(r["x"], 3) for r in steps][:3] == [0.0, 0.5, 1.0] and steps[-1]["x"] == 0.0


def test_vectors_of_unlike_widths_never_meet(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0])], "passage_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(9, [0.0, 2.0, 0.0])], "qid long, embedding array<float>")
    assert [(r["passage_id"], r["score"]) for r in dense.dense_topk(asked, rows, 5).collect()] == [(3, 2.0)]
    assert [(r["passage_id"], r["score"]) for r in dense.dense_topk(asked, rows, 5, normalize=True).collect()] == [(3, 1.0)]


def test_cells_of_no_rows(spark):
    none = spark.createDataFrame([], "passage_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [0.0, 2.0, 0.0])], "qid long, embedding array<float>")
    assert dense.dense_topk_cells(asked, none, 5).count() == 0


def test_overlap_of_long_texts(spark):
    a, b = " ".join(f"w{i % 300}" for i in range(4000)), " ".join(f"w{i % 200}" for i in range(3000))
    ca, cb = ({f"w{i}": n // m + (i < n % m) for i in range(m)} for n, m in ((4000, 300), (3000, 200)))
    same = sum(min(ca[k], cb.get(k, 0)) for k in ca)
    assert one(spark, T.token_f1(F.col("x"), F.col("y"), normalize=False), x=a, y=b) == pytest.approx(2 * same / 7000)


def test_positions_and_collation(spark):
    rows = spark.createDataFrame([(i, i % 3, [str(i)], f"t{i}") for i in range(50)], "id long, b long, l array<string>, t string").repartition(5)
    got = resample.positions(rows, "id").collect()
    assert all(r["pos"] == r["id"] for r in got)
    one_ = {r["b"]: (r["l"], r["t"]) for r in resample.collated(rows, "b", "id", "l", "t").collect()}
    assert one_[0][0] == [str(i) for i in range(0, 50, 3)] and one_[2][1][0] == "t2"
