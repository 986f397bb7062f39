import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.sources import npy


def test_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(257, 5)).astype(np.float32)
    t = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 5), (5, None)], "passage_id bigint, embedding array<float>").repartition(5)
    done = {r["chunk"]: r["n"] for r in npy.write(t, str(tmp_path / "v"), 100).collect()}
    assert done == {0: 100, 1: 100, 2: 57}
    assert np.load(tmp_path / "v" / "ids_0.npy").tolist() == list(range(744, 844)) and np.load(tmp_path / "v" / "vectors_2.npy").shape == (57, 5)
    got = {r["passage_id"]: r for r in npy.read(spark, str(tmp_path / "v")).collect()}
    assert len(got) == 257 and all(got[1000 - i]["embedding"] == v.tolist() and got[1000 - i]["chunk"] == (1000 - i - 744) // 100 for i, v in enumerate(x))
    assert npy.write(t.limit(0), str(tmp_path / "none")).count() == 0


def test_bad_pairs_fail(spark, tmp_path):
    def saved(name, v, i):
        (tmp_path / name).mkdir()
        for kind, a in (("vectors", v), ("ids", i)):
            if a is not None:
                np.save(tmp_path / name / f"{kind}_0.npy", a)
        return npy.read(spark, str(tmp_path / name)).agg(F.count("*")).collect()

    for name, v, i, said in (("short", np.ones((3, 2)), np.arange(2), "3 vectors and 2 ids"), ("alone", np.ones((3, 2)), None, "has no ids"), ("kinds", np.ones(3), np.arange(3), "are asked for")):
        with pytest.raises(Exception, match=said):
            saved(name, v, i)
    assert saved("fine", np.ones((3, 2)), np.arange(3, dtype=np.uint32))[0][0] == 3
