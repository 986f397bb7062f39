"""The block index against the search in place; versions; segments, removal and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import blocks, sparse
from sextant.sources import versions
from sextant.streaming import ingest

PASSAGES, QUESTIONS = "passage_id bigint, text string", "qid bigint, question string"


def texts(n, seed=1, start=0):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    return [(start + 7 * i, " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.choice([0, 1, 5, 30, 80])))) for i in range(n)]


def asked(spark, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([(q, " ".join([f"w{rng.randrange(30)}" for _ in range(3)] + [f"r{rng.randrange(3000)}" for _ in range(4)])) for q in range(12)] + [(98, None), (99, "nothing has this"), (100, "w1 w1 w1")], QUESTIONS)


def rows(df):
    return sorted((r["qid"], r["rank"], r["passage_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    passages = spark.createDataFrame([*texts(3000), (30000, None)], PASSAGES)
    whole, blocks.RANGE = blocks.RANGE, 16  # as many ranges as a larger table has
    blocks.add(passages, path)
    blocks.RANGE = whole
    return passages, path


@pytest.mark.parametrize(("k", "k1", "b", "share"), [(10, 1.0, 0.25, 0.8), (3, 1.8, 1.0, 0.3), (5, 0.8, 0.0, 0.9)])
def test_pruned_search_is_exact_and_reads_less(spark, built, k, k1, b, share):
    passages, path = built
    hits, read = blocks.pruned(asked(spark), blocks.open_blocks(spark, path), k, k1, b, share)
    assert rows(hits) == rows(sparse.sparse_topk(asked(spark), passages, k, k1=k1, b=b))
    total = read.agg(F.sum("n_blocks").alias("all"), F.sum("n_read").alias("read")).first()
    assert 0 < total["read"] < (0.8 if share >= 0.8 else 1) * total["all"]


def test_blocks_hold_what_they_say(spark, built):
    _, path = built
    for r in blocks.open_blocks(spark, path).blocks.filter("term = 'w1'").collect():
        assert r["c"] == len(r["places"]) == len(r["tfs"]) <= 16 and r["places"] == sorted(set(r["places"]))
        assert r["high"][0] == max(r["tfs"]) and r["high"] == sorted(set(r["high"]), reverse=True) and r["short"] == sorted(set(r["short"]), reverse=True)


def test_three_batches_a_replacement_and_a_removal_equal_a_fresh_build(spark, tmp_path):
    path = f"{tmp_path}/live"
    first, second, third = texts(400, 3), texts(300, 4, 400 * 7), texts(200, 5, 700 * 7)
    changed = [(i, t + " w1 r1 fresh") for i, t in texts(60, 6, 70)]  # ids that are there already
    parts = [first, second, third + changed]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, PASSAGES).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    stream = spark.readStream.schema(PASSAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/batch=*")
    ingest.ingest_passages(stream, path, f"{tmp_path}/ck").awaitTermination(300)
    opened = blocks.open_blocks(spark, path)
    assert opened.version.number == 3 and len(opened.version.content["segments"]) == 3
    now = dict(first + second + third) | dict(changed)
    # Batches come in no promised order; the later one of an id counts, so ask the index which it holds.
    plain = spark.createDataFrame(list(now.items()), PASSAGES)
    want = rows(sparse.sparse_topk(asked(spark), plain, 10))
    assert opened.n == len(now) and rows(blocks.search(asked(spark), opened, 10)) == want
    again = blocks.add(spark.createDataFrame(first, PASSAGES), path, batch=2)  # a batch that was committed before
    assert again.number == 3
    blocks.remove(spark.createDataFrame([(0,), (7,), (70,), (123456,), (None,)], "passage_id bigint"), path)
    left = spark.createDataFrame([x for x in now.items() if x[0] not in (0, 7, 70)], PASSAGES)
    want, opened = rows(sparse.sparse_topk(asked(spark), left, 10)), blocks.open_blocks(spark, path)
    assert opened.n == len(now) - 3 and rows(blocks.search(asked(spark), opened, 10)) == want
    blocks.compact(spark, path)
    merged = blocks.open_blocks(spark, path)
    assert merged.n == opened.n and abs(merged.avgdl - opened.avgdl) < 1e-12 and rows(blocks.search(asked(spark), merged, 10)) == want
    assert len(merged.version.content["segments"]) == 1 and not merged.version.content["deletes"]
    assert versions.vacuum(spark, path, 1) > 0 and rows(blocks.search(asked(spark), blocks.open_blocks(spark, path), 10)) == want


def test_stems_and_empty_indexes(spark, tmp_path):
    none = blocks.open_blocks(spark, f"{tmp_path}/none")
    assert none.n == 0 and blocks.search(asked(spark), none).count() == 0
    blocks.add(spark.createDataFrame([], PASSAGES), f"{tmp_path}/empty")
    assert blocks.search(asked(spark), blocks.open_blocks(spark, f"{tmp_path}/empty")).count() == 0
    p = spark.createDataFrame([(1, "running cats"), (2, "a cat runs runs"), (3, "dogs"), (None, "cat")], PASSAGES)
    blocks.add(p, f"{tmp_path}/stems", stem=True)
    q = spark.createDataFrame([(1, "cats running")], QUESTIONS)
    assert rows(blocks.search(q, blocks.open_blocks(spark, f"{tmp_path}/stems"))) == rows(sparse.search_index(q, sparse.build_index(p.filter("passage_id IS NOT NULL"), stem=True)))
    assert blocks.remove(spark.createDataFrame([(9,)], "passage_id bigint"), f"{tmp_path}/stems").number == 1
    assert blocks.compact(spark, f"{tmp_path}/none").number == 0


def test_compaction_writes_a_row_a_passage_and_none_a_posting(spark, tmp_path, monkeypatch):
    path, written = f"{tmp_path}/c", {}
    first, second = texts(150, 7), [(i, t + " w2 w2 cats") for i, t in texts(40, 8, 70)] + [(5, None), (6, ""), (2**40, "cat cats w1")]
    blocks.add(spark.createDataFrame(first, PASSAGES), path, stem=True)
    blocks.add(spark.createDataFrame(second, PASSAGES), path)
    blocks.remove(spark.createDataFrame([(0,), (14,), (70,)], "passage_id bigint"), path)
    store = blocks.stored

    def counted(df, name):
        made = store(df, name)
        written[name] = made.count()
        return made

    monkeypatch.setattr(blocks, "stored", counted)
    blocks.compact(spark, path)
    monkeypatch.undo()
    now = {i: t for i, t in (dict(first) | dict(second)).items() if i not in (0, 14, 70)}
    fresh = f"{tmp_path}/fresh"
    blocks.add(spark.createDataFrame(list(now.items()), PASSAGES), fresh, stem=True)
    merged, plain = blocks.open_blocks(spark, path), blocks.open_blocks(spark, fresh)
    assert written["passages"] == len(now) == merged.n == plain.n and merged.avgdl == plain.avgdl

    def held(index):
        posts = index.blocks.select("range", "term", F.explode(F.arrays_zip("places", "tfs")).alias("x")).select("range", "term", F.col("x.places").cast("int").alias("place"), "x.tfs")
        spots = index.ranges.select("range", F.posexplode(F.arrays_zip("ids", "dls")).alias("place", "y")).select("range", "place", "y.ids", "y.dls")
        return sorted(tuple(r) for r in posts.join(spots, ["range", "place"]).select("term", "ids", "tfs", "dls").collect())

    assert held(merged) == held(plain)
    for r in merged.blocks.filter("term = 'w1'").collect():
        assert r["c"] == len(r["places"]) and r["places"] == sorted(set(r["places"])) and r["high"][0] == max(r["tfs"])


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path)
    versions.publish(spark, path, {"a": spark.range(3), "b": spark.range(5)}, note="one")
    broken = spark.range(7).select(F.when(F.col("id") == 6, F.raise_error(F.lit("midway")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="midway"):
        versions.publish(spark, path, {"a": spark.range(9), "b": broken})
    seen = versions.opened(spark, path)
    assert (seen["a"].count(), seen["b"].count(), versions.latest(spark, path).content["note"]) == (3, 5, "one")
    versions.publish(spark, path, {"a": seen["a"].union(seen["b"]), "b": seen["b"]})  # derived from what it replaces
    assert versions.opened(spark, path)["a"].count() == 8 and seen["a"].count() == 3
    assert versions.vacuum(spark, path, 1) == 2 and versions.opened(spark, path)["a"].count() == 8


def test_one_of_two_writers_of_a_version_fails(spark, tmp_path):
    path = str(tmp_path)
    base = versions.latest(spark, path)
    assert base.number == 0 and versions.opened(spark, path) == {}
    versions.commit(spark, path, base, {"by": "one"})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, base, {"by": "two"})
    assert versions.latest(spark, path) == versions.Version(1, {"by": "one"})


def test_upsert_keeps_counts_over_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"2024-01-01 00:0{k}:00", "a b"), ("2024-01-01 00:30:00", f"c{k}")], "ts string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    stream = spark.readStream.schema("ts string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/batch=*")
    counts = ingest.term_counts(stream, "text", "ts", late="1 hour").select(F.col("window.start").alias("start"), "term", "n")
    with pytest.raises(FileNotFoundError):
        ingest.upserted(spark, f"{tmp_path}/t")
    ingest.upsert(counts, f"{tmp_path}/t", f"{tmp_path}/ck", "start", "term").awaitTermination(300)
    got = {(r["term"], r["n"]) for r in ingest.upserted(spark, f"{tmp_path}/t").collect()}
    assert got == {("a", 3), ("b", 3), ("c0", 1), ("c1", 1), ("c2", 1)}
    assert ingest.upserted(spark, f"{tmp_path}/t").count() == 5 and versions.latest(spark, f"{tmp_path}/t").content["batch"] == 2
