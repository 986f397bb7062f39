import pytest
from pyspark.sql import functions as F

from sextant.operators import resample

N = 300_000


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "t")
    spark.range(N).select(F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 5).alias("text")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("shuffle", [False, True])
def test_every_wide_row_gets_its_place(spark, wide, shuffle):
    rows = wide.repartition(40, "text") if shuffle else wide
    out = resample.positions(rows, "id")
    assert out.columns == ["id", "text", "pos"] and out.filter("id = pos").count() == N
    assert out.select("pos").count() == N  # pruned to one column: the same rows


def test_batches_and_zips_of_wide_rows(spark, wide):
    sizes = resample.batches(wide, "id", 1000).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("lo")).collect()
    assert len(sizes) == 300 and all(r["n"] == 1000 and r["lo"] == 1000 * r["chunk"] for r in sizes)
    rows = resample.positions(wide, "id")
    assert rows.select("pos", "text").join(rows.select("pos", "id"), "pos").filter(F.col("id") == F.col("pos")).count() == N


def test_positions_of_few_rows_and_ties(spark):
    assert resample.positions(spark.createDataFrame([], "k int, _p string"), "k").columns == ["k", "_p", "pos"]
    t = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (None, "d")], "k int, v string").repartition(3)
    got = sorted((r["pos"], r["k"]) for r in resample.positions(t, "k").collect())
    assert got == [(0, None), (1, None), (2, 1), (3, 1)]


def test_bootstrap_of_wide_rows(spark, wide):
    scored = resample.positions(wide, "id").select(F.lit("p").alias("pipeline"), "pos", (F.col("pos") % 2).cast("double").alias("f1"), F.lit(1.0).alias("em"))
    rows = resample.bootstrap(scored, 2).collect()
    assert len(rows) == 2 and all(abs(r["f1"] - 0.5) < 0.01 and r["em"] == 1 for r in rows)
