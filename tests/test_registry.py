import os

import duckdb
import pytest

from sextant.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark embeddings labels conversations events nation region".split()


def plain(v):
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 9) + 0.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["passages_clean", "tokenize_tf", "bm25_topk", "dense_topk_exact", "hybrid_topk", "rag_marginal_nll", "em_f1_pairs", "bootstrap_summary", "train_triples", "recall_at_k", "bm25_stemmed_index", "hybrid_padded", "question_rows", "evaluate_hybrid_pipeline", "cell_index_round_trip", "grid_table", "windowed_terms"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    mine = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    theirs = sorted((tuple(map(plain, r)) for r in db.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()), key=key)
    assert mine == theirs


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
