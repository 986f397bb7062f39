"""The quality classifier on classes that overlap and on labels held out."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("scale", [0.1, 1, 5, 40])
@pytest.mark.parametrize("share", [0.1, 0.5, 0.86])
def test_combination_of_overlapping_classes(scale, share):
    rng = np.random.default_rng(1)
    y = (rng.random(400) < share).astype(float)
    z = np.c_[scale * (2 * y - 1 + rng.normal(size=400)), scale * (0.3 * (2 * y - 1) + rng.normal(size=400))]
    w = np.array(qc._combine(z, y))
    x = np.c_[np.clip(z, -12, 12), np.ones(400)]
    assert (w[:2] >= 0).all() and np.abs(w).max() < 100
    right = lambda v: ((x @ np.array(v) >= 0) == (y > 0)).mean()
    assert right(w) >= max(share, 1 - share) - 0.02 and qc._loss(x, y, w) <= min(qc._loss(x, y, np.array(v)) for v in ((1.0, 0, 0), (0, 1.0, 0), (1.0, 1.0, 0))) + 1e-6


def test_combination_without_a_useful_view():
    y = np.array([1.0, 0.0] * 50)
    w = qc._combine(np.c_[-5 * (2 * y - 1), -5 * (2 * y - 1)], y)  # both views are wrong about every row
    assert w[0] >= 0 and w[1] >= 0
    assert qc._combine(np.zeros((3, 2)), np.ones(3)) == (1.0, 1.0, 0.0) and qc._combine(np.zeros((0, 2)), np.zeros(0)) == (1.0, 1.0, 0.0)


def test_pseudo_labels_that_hurt_are_left():
    rows = [(np.array([i % 2]), np.ones(1)) for i in range(80)]
    y = np.array([i % 2 for i in range(80)], bool)
    t = qc.Trainer.of([rows, rows], y)
    before = t.models[0]
    assert not t.learn(0, [(np.array([1]), np.ones(1))] * 400, [0.0] * 400) and t.models[0] is before
    assert t.learn(0, [(np.array([1]), np.ones(1))] * 20, [1.0] * 20) and len(t.rows[0]) == len(t.labels[0]) == t.known + 20
    low, high = t.bars(0)
    assert low < 0 < high


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_labels(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    given, surest = [], qc._surest
    monkeypatch.setattr(qc, "_surest", lambda *a: given.append(surest(*a)) or given[-1])
    got = {r["doc_id"]: r for r in qc.classify(docs, labels.filter(~held)).select("doc_id", "quality", "toxic").collect()}
    assert {x[:2] for x in given[0]} == {(t, k) for t in qc.TASKS for k in (0, 1)}  # both views give, for both heads
    truth = labels.filter(held).collect()
    for task, least in (("quality", 0.95), ("toxic", 0.92)):
        known = [r for r in truth if r[task] is not None]
        assert np.mean([(got[r["doc_id"]][task] >= 0.5) == (r[task] > 0) for r in known]) >= least
    assert 0.5 * len(got) < sum(r["quality"] >= 0.5 and r["toxic"] < 0.5 for r in got.values()) < 0.95 * len(got)
