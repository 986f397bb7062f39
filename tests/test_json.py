"""JSON documents read in splits."""

import json
import random

import pytest

from sextant.sources import readers

SCHEMA = "example_id string, question string, short_answers array<string>, context string"


def records(n, seed=1):
    rng = random.Random(seed)
    bits = ['a "quoted" word', "back\\slash\\", "comma, comma,, ,", "[{", "]}", "é 漢 \U0001f600", "line\nend\ttab", "", '\\"', "}],[{", "x" * 300, 'data": [']
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
    return [{"example_id": str(i), "question": text(), "short_answers": [text() for _ in range(rng.randint(0, 4))], "context": text()} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"data": x}, lambda x: {"version": "1,0", "other": [{"a": [1, 2]}, {"data": [3]}], "data": x, "end": [{"question": "no"}]}])
def test_one_file_over_several_tasks(spark, tmp_path, small_splits, wrap, indent):
    want = records(400)
    (tmp_path / "q.json").write_text(json.dumps(wrap(want), indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    assert spark.read.option("lineSep", ",").text(str(tmp_path / "q.json")).rdd.getNumPartitions() > 10
    got = readers._json_root(spark, str(tmp_path / "q.json"), SCHEMA).orderBy("_pos").collect()
    assert [r["_pos"] for r in got] == list(range(400))
    assert [r.asDict() for r in got] == [{"_pos": i, **x} for i, x in enumerate(want)]


def test_files_by_name_and_empty_lists(spark, tmp_path):
    for k, part in enumerate([records(3), [], records(2, 5)]):
        (tmp_path / f"{k}.json").write_text(json.dumps(part))
    got = readers.questions_json(spark, str(tmp_path)).collect()
    assert [r["question"] for r in got] == [x["question"] for x in records(3) + records(2, 5)]
    assert len({r["_pos"] for r in got}) == 5
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.json").write_text(' {"data" : [ ] } ')
    assert readers.questions_json(spark, str(tmp_path / "e")).count() == 0


def test_broken_records_fail(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"question": "a"}, {"question": broken}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.questions_json(spark, str(tmp_path / "b.json")).collect()
