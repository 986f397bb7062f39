import json

import pytest
from pyspark.sql import functions as F

from sextant.operators import blocks, sparse
from sextant.sources import readers, sinks
from sextant.streaming import ingest


def test_passages(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text('id\ttext\ttitle\n1\t one \tA\nx\tbad id\tB\n2\t   \tC\n3\t"quoted\ttab"\tD\n\tno id\tE\n4\n')
    strict = {r["passage_id"]: r["text"] for r in readers.passages_tsv(spark, str(p)).collect()}
    assert strict == {1: "one", 3: "quoted\ttab"}
    loose = {r["passage_id"]: r["text"] for r in readers.passages_tsv(spark, str(p), strict_ids=False).collect()}
    assert loose["1"] == " one " and loose["x"] == "bad id"
    assert readers.rejected_passages(spark, str(p)).count() == 4
    assert readers.row_estimate(spark, str(p), 4) == (6, 2)


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"data": x}])
def test_question_roots(spark, tmp_path, wrap):
    p = tmp_path / "q.json"
    p.write_text(json.dumps(wrap([{"example_id": "e1", "question": "q1", "short_answers": ["a", "b"]}, {"question": "q2", "short_answers": []}, {"question": ""}])))
    rows = readers.questions_json(spark, str(p)).collect()
    assert [r["question"] for r in rows] == ["q1", "q2", ""]
    assert readers.questions_json(spark, str(p), 1).count() == 1
    assert readers.answered_questions(readers.questions_json(spark, str(p))).count() == 1
    sparse_ = spark.createDataFrame([("e1", [("7", "t", "x", 0.5)])], "key string, sparse_retrieved_docs array<struct<id:string,title:string,text:string,sparse_score:double>>")
    got = {r["qid"]: (r["answer"], len(r["sparse_docs"])) for r in readers.question_rows(readers.questions_json(spark, str(p)), sparse_, "query: ").collect()}
    assert got == {"e1": ("a", 1), "gen_id_1": ("", 0)}
    assert [len(r["sparse_docs"]) for r in readers.question_rows(readers.questions_json(spark, str(p)), sparse_, sparse_key="question").collect()] == [0, 0]


def test_question_root_errors(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('{"other": []}')
    with pytest.raises(ValueError):
        readers.questions_json(spark, str(p))
    p.write_text('"text"')
    with pytest.raises(ValueError):
        readers.questions_json(spark, str(p))


def test_metadata_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"id": 1, "title": "a", "text": "x"}\nbroken{\n{"id": 1, "title": "b", "text": "y"}\n')
    rows = readers.metadata_jsonl(spark, str(p)).collect()
    assert [(r["key"], r["title"]) for r in rows] == [("1", "b")]
    p.write_text('{"title": "a", "text": "x"}\n')
    with pytest.raises(Exception, match="no id"):
        readers.metadata_jsonl(spark, str(p)).collect()


def test_sparse_results(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    assert readers.sparse_results_jsonl(spark, str(p)).count() == 0
    p.write_text('{"original_question": "q", "example_id": null, "sparse_retrieved_docs": []}\n{"example_id": "e", "sparse_retrieved_docs": [{"id": "1", "text": "t", "sparse_score": 0.5}]}\nbad\n{"example_id": "", "original_question": ""}\n')
    assert {r["key"] for r in readers.sparse_results_jsonl(spark, str(p)).collect()} == {"q", "e"}


def test_catalog():
    assert readers.resource_path("data.retriever.train", ".json", "out/") == "out/data/retriever/train.json"


def test_catalog_lookup(spark):
    rows = spark.createDataFrame([("data.a",), ("data.ab",), ("x",)], "key string")
    assert readers.catalog(rows, "data.a").count() == 1 and readers.catalog(rows, "data").count() == 2 and readers.catalog(rows, "no").count() == 0


def test_sinks_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red cat red", "t"), (2, "blue", "u")], "passage_id long, text string, title string")
    sinks.metadata_jsonl(rows, f"{tmp_path}/meta")
    assert readers.metadata_jsonl(spark, f"{tmp_path}/meta").count() == 2
    sinks.inverted_index(sparse.build_index(rows), f"{tmp_path}/index")
    stored = readers.inverted_index(spark, f"{tmp_path}/index")
    assert stored.postings.count() == 3 and not stored.stem
    asked = spark.createDataFrame([(1, "Cats! red")], "qid long, question string")
    assert [r["passage_id"] for r in sparse.search_index(asked, stored, 5).collect()] == [1]
    assert [tuple(r)[:3] for r in sparse.search_index(asked, sparse.build_index(rows, stem=True), 5).collect()] == [tuple(r)[:3] for r in sparse.search_index(asked.selectExpr("qid", "'cat red' AS question"), stored, 5).collect()]
    assert sinks.console_rows(spark.createDataFrame([("a", 0.5)], "k string, v double")).first()["line"] == "a\t0.5000"
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.ingest_passages(stream, f"{tmp_path}/live", f"{tmp_path}/ck").awaitTermination(60)
    live = blocks.open_blocks(spark, f"{tmp_path}/live")
    assert {(r["term"], r["c"]) for r in live.blocks.collect()} == {("red", 1), ("cat", 1), ("blue", 1)} and (live.n, live.avgdl) == (2, 2.0)


def test_sparse_search_ignores_titles(spark):
    p = spark.createDataFrame([(1, "red cat", "blue"), (2, "blue cat", None), (3, None, "red")], "passage_id long, text string, title string")
    q = spark.createDataFrame([(1, "Blue!"), (2, "nothing here")], "qid long, question string")
    got = sparse.sparse_topk(q, p, 5).collect()
    assert [(r["qid"], r["passage_id"]) for r in got] == [(1, 2)]
    nested = {r["qid"]: len(r["sparse_retrieved_docs"]) for r in sparse.sparse_results(sparse.sparse_topk(q, p, 5), q, p).collect()}
    assert nested == {1: 1, 2: 0}


def test_last_line_wins_across_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    old = [json.dumps({"id": str(i), "title": "old", "text": ""}) for i in range(50)]
    new = [json.dumps({"id": str(i), "title": "new", "text": "x" * 5000}) for i in range(50)]
    (tmp_path / "m" / "a.jsonl").write_text("\n".join(old))
    (tmp_path / "m" / "b.jsonl").write_text("\n".join(new))  # the larger split is read first
    assert {r["title"] for r in readers.metadata_jsonl(spark, str(tmp_path / "m")).collect()} == {"new"}


def test_row_estimate_of_a_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k, n in enumerate([40, 30, 20, 10]):
        (tmp_path / "t" / f"{k}.tsv").write_text("id\ttext\ttitle\n" + "".join(f"{i}\tx\ty\n" for i in range(n)))
    assert readers.row_estimate(spark, str(tmp_path / "t"), 30) == (100, 4)
