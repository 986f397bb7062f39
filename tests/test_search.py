"""Approximate search by graph, hashed tables and cells against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import dense, graph, lsh

INDEX, QUERIES = "passage_id bigint, embedding array<float>", "qid bigint, embedding array<float>"


def latent(n, d=32, inner=8, seed=0, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, inner)) @ np.random.default_rng(99).normal(size=(inner, d)) + 0.2 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x * rng.uniform(0.5, 2, (n, 1)) if scale else x).astype(np.float32)


def table(spark, x, schema, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], schema)


ODD = [(None, [1.0] * 32), (90001, None), (90002, []), (90003, [None] * 32), (90004, [0.5, 0.5]), (90005, [0.5, -0.5]), (90006, [1.0, 0.0])]


@pytest.fixture(scope="module")
def data(spark):
    x, q = latent(6000, scale=True), latent(60, seed=5)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + ODD, INDEX).repartition(4).cache()
    asked = spark.createDataFrame([(70000 + i, v.tolist()) for i, v in enumerate(q)] + [(99, [1.0, 1.0]), (98, None)], QUERIES)
    exact = dense.dense_topk(asked, index, 10).select("qid", "passage_id", "score").cache()
    return index, asked, exact


def scores_are_exact(near, exact):
    both = near.join(exact.withColumnRenamed("score", "want"), ["qid", "passage_id"])
    return both.filter(F.abs(F.col("score") - F.col("want")) > 2e-6).count() == 0


def test_graph(spark, data, tmp_path, monkeypatch):
    index, asked, exact = data
    monkeypatch.setattr(graph, "SHARD", 3000)  # several shards, each above a leaf
    g = graph.write(index, str(tmp_path / "g"))
    assert g.n == 6003 and g.shards.count() == 3
    hits, scored = graph.search(asked, g, 10, 48)
    assert graph.recall(hits, exact).first()[0] >= 0.95 and scores_are_exact(hits, exact)
    shares = {r["qid"]: r["share"] for r in scored.collect()}
    assert len(shares) == 61 and max(shares.values()) < 0.25
    assert [r["passage_id"] for r in hits.filter("qid = 99").orderBy("rank").collect()] == [90004, 90006, 90005]
    few = graph.search(asked, g, 10, 10)
    assert few[1].agg(F.sum("scored")).first()[0] < scored.agg(F.sum("scored")).first()[0]
    own = index.filter("passage_id < 20").select(F.col("passage_id").alias("qid"), "embedding")
    assert graph.search(own, g, 3, 32, skip_self=True)[0].filter("qid = passage_id").count() == 0


def test_graph_of_vectors_without_structure(spark, tmp_path):
    """A beam of 64 finds too few of their neighbours; the one that is measured finds enough."""
    x = np.random.default_rng(7).normal(size=(12000, 64)).astype(np.float32)
    index = table(spark, x, INDEX).repartition(4).cache()
    asked = index.filter("passage_id % 100 = 0").withColumnRenamed("passage_id", "qid")
    exact = dense.dense_topk(asked, index, 10).cache()
    g = graph.write(index, str(tmp_path / "g"))
    assert graph.recall(graph.search(asked, g, 10, 64)[0], exact).first()[0] < 0.9
    assert g.ef > 64 and g.recall >= 0.95 and graph.open_graph(spark, str(tmp_path / "g")).ef == g.ef
    assert graph.recall(graph.search(asked, g, 10)[0], exact).first()[0] >= 0.9


def test_descent_finds_neighbours():
    x = graph._even(latent(5000, seed=2))
    near = graph.descend(x)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -np.inf
    want = np.argsort(-s, axis=1)[:, : graph.NEAR]
    assert np.mean([len(set(a) & set(b)) / graph.NEAR for a, b in zip(near[:200], want, strict=True)]) > 0.9
    assert not any(i in near[i] for i in range(200))


def test_graph_of_few_and_equal_rows(spark, tmp_path):
    same = table(spark, np.ones((50, 4)), INDEX)
    g = graph.write(same, str(tmp_path / "same"))
    hits, _ = graph.search(table(spark, np.ones((1, 4)), QUERIES), g, 5)
    assert sorted(r["score"] for r in hits.collect()) == [4.0] * 5
    none = graph.write(same.limit(0), str(tmp_path / "none"))
    assert none.n == 0 and graph.search(table(spark, np.ones((1, 4)), QUERIES), none)[0].count() == 0


def test_hashed_tables(spark, data, tmp_path):
    index, asked, exact = data
    built = lsh.build(index, bits=6)
    lsh.write(built, str(tmp_path / "h"))
    h = lsh.open_hashed(spark, str(tmp_path / "h"))
    assert (h.tables, h.bits, h.probes) == (built.tables, built.bits, built.probes) and h.recall >= 0.95
    assert h.blocks.agg(F.sum(F.size("c_ids"))).first()[0] == 6003 * h.tables
    hits = lsh.search(asked, h, 10)
    assert graph.recall(hits, exact).first()[0] >= 0.9 and scores_are_exact(hits, exact)
    assert [r["passage_id"] for r in hits.filter("qid = 99").orderBy("rank").collect()][:1] == [90004]
    assert graph.recall(lsh.search(asked, h, 10, probes=1), exact).first()[0] < graph.recall(hits, exact).first()[0]
    assert lsh.search(asked, lsh.build(index.limit(0))).count() == 0


def test_probing_sequences():
    p = lsh.planes(8, 2, 5, 1)
    x = np.random.default_rng(3).normal(size=(20, 8))
    seq = lsh.sequences(x, p, 100)
    for i in range(20):
        for t in range(2):
            s = p[t] @ x[i]
            own = sum(1 << j for j in range(5) if s[j] > 0)
            cost = [sum(s[j] ** 2 for j in range(5) if (own ^ int(b)) >> j & 1) for b in seq[i, t]]
            assert seq[i, t, 0] == own and len(set(seq[i, t])) == 26 and cost == sorted(cost)


def test_cells_of_mixed_widths_measure_their_probes(spark, data, tmp_path):
    index, asked, exact = data
    built = dense.build_cells(index)
    dense.write_cells(built, str(tmp_path / "c"))
    c = dense.open_cells(spark, str(tmp_path / "c"))
    assert c.recall >= 0.95 and 1 <= c.probes < len(c.centroids) and c.blocks.agg(F.sum(F.size("c_ids"))).first()[0] == 6003
    hits = dense.search_cells(asked, c, 10)
    assert graph.recall(hits, exact).first()[0] >= 0.9 and scores_are_exact(hits, exact)
    assert dense.build_cells(index.limit(0)).blocks.count() == 0


def test_a_bucket_with_a_third_of_the_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((np.tile(rng.normal(size=(1, 8)), (3000, 1)), rng.normal(size=(3000, 8))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = table(spark, x, INDEX)
    h = lsh.build(index, bits=3)
    assert h.blocks.filter(F.size("c_ids") > dense.CORPUS_BLOCK).count() == 0
    hits = lsh.search(table(spark, x[:2], QUERIES), h, 5)
    assert sorted({r["passage_id"] for r in hits.collect()}) == [0, 1, 2, 3, 4]
